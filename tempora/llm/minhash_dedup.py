"""Near-duplicate groups by b-bit MinHash.

A document's set is its distinct five-word shingles.  Its signature is the minimum of the set
under ``HASHES`` hash functions; bands of ``ROWS`` whole minima give bucket keys, and the low
``BITS`` bits of all minima are packed into a few longs.  Candidates from the buckets are kept if
the similarity estimated from equal low bits, corrected for chance collisions, comes within
``MARGIN`` of the threshold, and are then confirmed on the full sets.

A bucket never emits all its pairs.  It compares its members with its hub, the member that shares
most buckets, and in ``ROUNDS`` more rounds those still in other components with one more centre and
with ``PIVOTS`` of its members.  What a bucket then still holds in different components is settled
exactly: these documents, sorted so that related ones are neighbours, are packed into blocks of
bounded size, and blocks that share such a bucket meet once.  A task compares the signatures and
then the full sets of its two blocks and emits links only, one at most for two components, so that
thousands of documents of one template give no table of pairs.  Copies with equal sets, known by
their size and two 64-bit sums of their hashes, are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import bounded_broadcast, table, whole_batches, write_table
from .components import contract, merged

SHINGLE, NUMERATOR, DENOMINATOR = 5, 3, 4
BANDS, ROWS = 40, 4
HASHES = BANDS * ROWS
BITS = 2
#: Five standard deviations of the estimate at the threshold.
MARGIN = 0.2
#: Rounds of further centres, and members that others in a bucket are compared with in each.
ROUNDS, PIVOTS = 1, 4
#: Rows and bytes of sets of a block of documents that are still apart; a larger document is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 2048, 2 << 20
#: Ids in a broadcast (8 bytes each) at most.
BROADCAST_IDS = 2_000_000
_FACTOR = (K.mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_WORDS = HASHES * BITS // 64


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
    for _, _, data, bounds in K.text_slices(texts):
        words = K.words_of(data, bounds)
        grams, at = K.ngrams(words, SHINGLE)
        first = words.first()
        cut = np.searchsorted(words.doc[at], np.arange(len(bounds))) if len(at) else np.zeros(len(bounds), np.int64)
        for d in range(len(bounds) - 1):
            short = words.hash[first[d] : first[d + 1]] if cut[d] == cut[d + 1] else ()
            if len(short):
                whole = (short * K.place_factors(len(short))).sum(dtype=np.uint64)
                yield K.mixed(np.array([whole], np.uint64) + np.uint64(len(short)))
            else:
                yield np.unique(grams[cut[d] : cut[d + 1]])


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys and packed low bits of a set that isn't empty."""
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(folded), 4096):  # long texts in pieces
        np.minimum(least, (_FACTOR[:, None] * folded[None, k : k + 4096]).min(axis=1), out=least)
    keys = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        keys = K.mixed(keys + least[k::ROWS].astype(np.uint64) + np.uint64(k + 1))
    keys = K.mixed(keys ^ (np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40)))
    # The lowest bit of an odd multiple doesn't depend on the factor; mix before bits are taken.
    low = (K.mixed(least.astype(np.uint64) * np.uint64(HASHES) + np.arange(HASHES, dtype=np.uint64)) & np.uint64(2**BITS - 1)).reshape(_WORDS, -1)
    packed = (low << (np.arange(low.shape[1], dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


_SIGNATURES = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, " + ", ".join(f"s{k} long" for k in range(_WORDS))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column(0).to_pylist(), []
        for doc_id, shingles in zip(ids, shingle_sets(batch.column(1))):
            keys, packed = signature(shingles) if len(shingles) and doc_id is not None else (np.zeros(0, np.int64), np.zeros(_WORDS, np.int64))
            sums = [int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (shingles, K.mixed(shingles))]
            rows.append((doc_id, len(shingles), *sums, keys, *packed.tolist()))
        columns = list(zip(*rows)) or [()] * (5 + _WORDS)
        types = [pa.int64()] * 4 + [pa.list_(pa.int64())] + [pa.int64()] * _WORDS
        names = ["doc_id", "n_shingles", "set_a", "set_b", "bands", *[f"s{k}" for k in range(_WORDS)]]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), K.binary_rows(list(shingle_sets(batch.column(1))))], names=["id", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(DENOMINATOR * shared >= NUMERATOR * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def estimated_similarity(left: str, right: str) -> F.Column:
    """From the equal low-bit groups of two packed signatures, corrected for groups equal by chance."""
    equal = F.lit(0)
    for k in range(_WORDS):
        same = F.bitwise_not(F.col(f"{left}{k}").bitwiseXOR(F.col(f"{right}{k}")))
        equal = equal + F.bit_count(same.bitwiseAND(F.shiftrightunsigned(same, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 2.0**-BITS
    return (equal / F.lit(float(HASHES)) - F.lit(chance)) / F.lit(1 - chance)


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    bits = [f"s{k}" for k in range(_WORDS)]
    side = lambda end, to: nodes.select(F.col("id").alias(end), *[F.col(s).alias(f"{to}{k}") for k, s in enumerate(bits)])
    near = pairs.join(side("a", "p"), "a").join(side("b", "q"), "b").filter(estimated_similarity("p", "q") >= NUMERATOR / DENOMINATOR - MARGIN)
    near = write_table(near.select("a", "b").distinct(), "near-pairs")
    if near.isEmpty():
        return near
    ids = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    found = docs.join(bounded_broadcast(ids, 2 * near.count(), BROADCAST_IDS), "doc_id", "left_semi")
    sets = write_table(found.mapInArrow(_sets, "id long, shingles binary"), "shingle-sets")
    full = near.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    return write_table(full.select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long"), "links")


def _with_roots(members: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
    """``members`` with the roots of the ids in ``columns``."""
    for c in columns:
        members = members.join(roots.select(F.col("id").alias(c), F.col("root").alias("_root")), c, "left").withColumn(f"{c}_root", F.coalesce("_root", c)).drop("_root")
    return members


def _hubs(nodes: DataFrame) -> DataFrame:
    """(key, id, degree, hub) of the buckets with two members or more.

    A node's degree counts the members of all its buckets; a bucket's hub is its member of the
    highest degree, as the text that others were copied from is closer to them than they are to
    each other.
    """
    held = nodes.select("id", F.explode("bands").alias("key")).distinct()
    sizes = held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = write_table(held.join(sizes, "key"), "shared-buckets")
    members = shared.select("key", "id").join(shared.groupBy("id").agg(F.sum("n").alias("degree")), "id")
    hubs = members.groupBy("key").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("hub"))
    return write_table(members.join(hubs, "key"), "buckets")


def _new_pairs(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    """The distinct pairs, smaller id first, that haven't been tested."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return write_table(pairs.join(tested, ["a", "b"], "left_anti") if tested else pairs, "pairs")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, id, degree, hub, id_root) of the buckets that hold members of different components."""
    rooted = _with_roots(members, roots, "id")
    mixed = rooted.groupBy("key").agg(F.min("id_root").alias("least"), F.max("id_root").alias("most")).filter("least < most").select("key")
    return write_table(rooted.join(mixed, "key"), "open")


def _signed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column(1)))
        packed = [signature(x)[1].tobytes() if len(x) else bytes(8 * _WORDS) for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), K.binary_rows(sets)], names=["id", "packed", "shingles"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, root, packed, shingles) in blocks: arrays of ids, roots and set sizes, and the bytes of all signatures and sets."""
    held, size = [], 0

    def block() -> pa.RecordBatch:
        ids, roots, packed, sets = zip(*held)
        columns = [pa.array([list(v)], pa.list_(pa.int64())) for v in (ids, roots, [len(x) // 8 for x in sets])]
        return pa.RecordBatch.from_arrays([*columns, pa.array([b"".join(packed)]), pa.array([b"".join(sets)])], names=["ids", "roots", "sizes", "packed", "shingles"])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and (len(held) == BLOCK_ROWS or size + len(row[3]) > BLOCK_BYTES):
                yield block()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield block()


_BLOCK = "ids array<long>, roots array<long>, sizes array<long>, packed binary, shingles binary"


class _Block:
    def __init__(self, ids, roots, sizes, packed, shingles):
        self.ids, self.roots, self.sizes = (v.values.to_numpy() for v in (ids, roots, sizes))
        self.packed = np.frombuffer(packed.as_buffer(), np.uint64).reshape(len(self.ids), -1)
        at = np.concatenate([[0], np.cumsum(self.sizes)])
        data = np.frombuffer(shingles.as_buffer(), np.uint64)
        self.sets = [data[s:e] for s, e in zip(at[:-1], at[1:])]


def _estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """As :func:`estimated_similarity`, of one packed signature and many."""
    same = ~(one ^ many)
    equal = np.bitwise_count(same & (same >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)
    return (equal / HASHES - 2.0**-BITS) / (1 - 2.0**-BITS)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (a, b) that join components of the two blocks of a row, each set of components once."""
    for batch in batches:
        links: list[tuple[int, int]] = []
        for r in range(len(batch)):
            one, two = (_Block(*[batch.column(c)[r] for c in range(k, k + 5)]) for k in (0, 5))
            own, where = np.unique(np.concatenate([one.roots, two.roots]), return_inverse=True)
            root, at, other = np.arange(len(own)), where[: len(one.ids)], where[len(one.ids) :]
            for i in range(len(one.ids)):
                n, m = one.sizes[i], two.sizes
                near = (DENOMINATOR * np.minimum(n, m) >= NUMERATOR * np.maximum(n, m)) & (root[other] != root[at[i]])
                near = np.flatnonzero(near)
                guess = _estimates(one.packed[i], two.packed[near])
                for j in near[np.argsort(-guess)][: int((guess >= NUMERATOR / DENOMINATOR - MARGIN).sum())]:
                    if root[other[j]] == root[at[i]]:
                        continue  # joined by a link found above
                    shared = len(np.intersect1d(one.sets[i], two.sets[j], assume_unique=True))
                    if DENOMINATOR * shared >= NUMERATOR * (n + m[j] - shared):
                        links.append((int(one.ids[i]), int(two.ids[j])))
                        root[root == root[other[j]]] = root[at[i]]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])


def _apart_links(open_: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join all components that members of a bucket in ``open_`` can be joined to within it."""
    least = open_.groupBy("key").agg(F.min("id").alias("a"))
    clusters = contract(open_.join(least, "key").select("a", F.col("id").alias("b")))
    apart = open_.select("id", F.col("id_root").alias("root")).distinct()
    ids = write_table(apart.join(clusters.select("id", F.col("root").alias("cluster")), "id"), "apart")
    found = docs.join(bounded_broadcast(ids.select(F.col("id").alias("doc_id")), ids.count(), BROADCAST_IDS), "doc_id", "left_semi")
    rows = found.mapInArrow(_signed_sets, "id long, packed binary, shingles binary").join(ids, "id")
    rows = rows.repartitionByRange("cluster", "root", "id").sortWithinPartitions("cluster", "root", "id")
    blocks = write_table(rows.select("id", "root", "packed", "shingles").mapInArrow(_blocks, _BLOCK).withColumn("block", F.monotonically_increasing_id()), "apart-blocks")
    held = blocks.select("block", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("roots").alias("root"))))
    per = write_table(open_.select("key", "id").join(held, "id").groupBy("key", "block").agg(F.min("root").alias("least"), F.max("root").alias("most")), "bucket-blocks")
    side = lambda end: per.select("key", F.col("block").alias(f"block_{end}"), F.col("least").alias(f"least_{end}"), F.col("most").alias(f"most_{end}"))
    pairs = side("i").join(side("j"), "key").filter("block_i <= block_j AND NOT (least_i = most_i AND least_j = most_j AND least_i = least_j)")
    pairs = write_table(pairs.select("block_i", "block_j").distinct(), "block-pairs")
    names = ["ids", "roots", "sizes", "packed", "shingles"]
    of = lambda end: blocks.select(F.col("block").alias(f"block_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in names])
    met = pairs.join(of("i"), "block_i").join(of("j"), "block_j").select(*[f"{c}_{end}" for end in "ij" for c in names])
    return write_table(met.mapInArrow(_met, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Links join documents whose sets have a Jaccard similarity of 0.75 or more; a component is
    known by its smallest doc_id, whose rows are kept.  Empty and null texts, and texts of white
    space, have no shingles and are linked with nothing.  A null id is linked with nothing, has a
    null component and is kept.  Rows with the same id are one node; all of them are rows of the
    result.  Other columns are ignored; an empty table gives no rows.
    """
    docs = whole_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = write_table(docs.mapInArrow(_signatures, _SIGNATURES), "signatures")
    same = ["n_shingles", "set_a", "set_b"]
    sets = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # Classes of one row need no join; of two plain tables, Spark splits a hot class.
    classes = write_table(sets.groupBy(*same).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "classes")
    member_of = write_table(sets.select("doc_id", *same).join(classes, same, "left").select("doc_id", F.coalesce("least", "doc_id").alias("id")), "members")
    nodes = sets.join(classes, same, "left").filter("least IS NULL OR doc_id = least").select(F.col("doc_id").alias("id"), *same, "bands", *[f"s{k}" for k in range(_WORDS)])
    nodes = write_table(nodes.dropDuplicates(["id", *same]).drop(*same), "nodes")
    if not signed.groupBy("doc_id").count().filter("count > 1").isEmpty():
        docs = docs.distinct()
    members = _hubs(nodes)
    # A repeated id with several texts ties their classes together.
    ties = member_of.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a <> last")
    roots = merged(None, ties.join(member_of, "doc_id").selectExpr("a", "id AS b"))
    tested = _new_pairs(members.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")), None)
    roots = merged(roots, _links(tested, nodes, docs))
    open_ = _open(members, roots)
    for _ in range(ROUNDS):
        if open_.isEmpty():
            break
        hubs = _with_roots(open_, roots, "hub").withColumn("apart", F.col("id_root") != F.col("hub_root"))
        centre = hubs.groupBy("key").agg(F.max_by(F.struct("id", "id_root"), F.when(F.col("apart"), F.struct("degree", -F.col("id")))).alias("c"))
        centres = open_.join(centre, "key").filter("c IS NOT NULL AND id_root <> c.id_root").select(F.col("c.id").alias("a"), F.col("id").alias("b"))
        # Each bucket's best of PIVOTS random parts: members close to most others.
        pivots = open_.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(PIVOTS)).alias("part")).agg(F.max_by(F.struct("id", "id_root"), F.struct("degree", -F.col("id"))).alias("p"))
        tried = hubs.filter("apart").select("key", F.col("id").alias("b"), "id_root").join(pivots.select("key", "p"), "key").filter("p.id_root <> id_root").select(F.col("p.id").alias("a"), "b")
        new = _new_pairs(centres.unionByName(tried), tested)
        tested = write_table(tested.unionByName(new), "tested")
        roots = merged(roots, _links(new, nodes, docs))
        members = members.join(centre.select("key", F.col("c.id").alias("centre")), "key", "left").withColumn("hub", F.coalesce("centre", "hub")).drop("centre")
        members = write_table(members, "members")
        open_ = _open(members, roots)
    if not open_.isEmpty():
        roots = merged(roots, _apart_links(open_, docs))
    found = member_of.join(roots.select("id", "root"), "id", "left").select("doc_id", F.coalesce("root", "id").alias("component_id"))
    found = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_minhash_dedup": op3_minhash_dedup}
ORACLE_SQL: dict = {}
