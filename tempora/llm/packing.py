"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Pieces of a whole sequence stand alone.  The others are dealt to shards of about
``SHARD_PIECES``, and several islands evolve packings of each shard.  A solution is its set of
bins; the first ones fill them in random order, which wastes one or two in a hundred.  Crossover
injects whole well-filled bins of one parent into the other, removes the bins that they duplicate,
and best-fits the displaced pieces, longest first.  Between epochs the elite of each island moves
on to the next island of its shard; the best packing of a shard stays.  The emptiest bins of all
shards are packed once more together, until one shard holds what is left.
"""

from __future__ import annotations

import random
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, table, whole_batches, write_table

CAPACITY, SEPARATOR = 2048, 0
SHARD_PIECES = 8192
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2, 3, 4, 10
#: Generations of the first epoch that take place even if the packing can't get any better.
LEAST_GENERATIONS = 3
#: Shares of the donor's well-filled bins that a crossover injects.
INJECTED = (0.3, 0.6)
#: Of a shard's bins, those that are packed again with those of other shards: the emptiest, and others of any fill,
#: whose small pieces let the rest come together.
EMPTIEST, OTHERS = 2, 256
_WORDS_KEPT = 700_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letters that stand for the 256 bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordIds(dict):
    """Word -> its token ids as bytes; once full, it keeps only words met since it was last full."""

    def __init__(self, path: str, kept: int):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.kept, self.older = self.tokenizer.model, kept, {}
        self.letters = dict(enumerate(_byte_letters()))
        self.ends = {c: _packed(self.tokenizer.encode(c, add_special_tokens=False).ids) for c in ".,;:!?"}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._ids(word)
        if len(self) >= self.kept:
            self.older = dict(self)
            self.clear()
            self[""] = b""
        self[word] = ids
        return ids

    def _ids(self, word: str) -> bytes:
        """Plain words go straight to the BPE model, once for all their cases and ends; any other takes the tokenizer's whole way."""
        end = self.ends.get(word[-1], b"")
        core = word[:-1] if end else word
        low = core.lower()
        if not (core.isalpha() and low.isalpha() and "\u03a3" not in core and unicodedata.is_normalized("NFC", core)):
            return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if low != word:
            return self[low] + end
        return _packed([t.id for t in self.model.tokenize(low.encode().decode("latin-1").translate(self.letters))])


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Token ids of texts, word by word: the tokenizer never joins what white space separates."""

    def __init__(self, path: str, kept: int = _WORDS_KEPT):
        self.words = WordIds(path, kept)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        text = text or ""
        for blank in BLANKS[1:]:
            text = text.replace(blank, " ")
        return b"".join(map(self.words.__getitem__, text.split(" ")))


_encoders: dict[str, WordEncoder] = {}


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its tokens and then id 0; only one longer than ``capacity`` is cut, into pieces of
    ``capacity`` tokens, the last of which may be shorter.  Null and empty texts are the one id 0.
    Repeated rows give repeated pieces; a null id stays null; other columns are ignored.
    """
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        for batch in batches:
            found: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py()) + SEPARATOR.to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for to, value in zip(found, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4") if with_ids else None)):
                        to.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found, kinds)][: 5 + with_ids], names=names[: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, schema)


class Packing:
    """A set of bins: lists of piece numbers, with their fill."""

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.lengths, self.bins, self.capacity = lengths, bins, capacity
        self.fill = [sum([lengths[i] for i in b]) for b in bins]

    def quality(self) -> tuple[int, float]:
        """Fewer bins first, then uneven fill, which leaves room that can be used."""
        return len(self.bins), -sum([f * f for f in self.fill])

    def best_fit(self, pieces: list[int]) -> Packing:
        """Add ``pieces`` in turn, each to the fullest bin that has room, else to a new one."""
        lengths, capacity = self.lengths, self.capacity
        rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
        open_ = 0
        for b, f in enumerate(self.fill):
            rooms[capacity - f].append(b)
            open_ |= 1 << (capacity - f)
        for i in pieces:
            size = lengths[i]
            wide = open_ >> size
            if wide:
                room = size + (wide & -wide).bit_length() - 1
                b = rooms[room].pop()
                if not rooms[room]:
                    open_ ^= 1 << room
                self.bins[b].append(i)
                self.fill[b] += size
            else:
                room, b = capacity, len(self.bins)
                self.bins.append([i])
                self.fill.append(size)
            left = room - size
            if not rooms[left]:
                open_ |= 1 << left
            rooms[left].append(b)
        return self

    def numbers(self) -> list[int]:
        """The bin of each piece."""
        out = [0] * len(self.lengths)
        for number, bin_ in enumerate(self.bins):
            for i in bin_:
                out[i] = number
        return out

    def without(self, dropped: set[int]) -> Packing:
        new = Packing.__new__(Packing)
        new.lengths, new.capacity = self.lengths, self.capacity
        keep = [b for b in range(len(self.bins)) if b not in dropped]
        new.bins, new.fill = [list(self.bins[b]) for b in keep], [self.fill[b] for b in keep]
        return new


def from_numbers(lengths: list[int], bins: list[int], capacity: int) -> Packing:
    """The packing that has each piece in the bin of its number."""
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(bins):
        groups.setdefault(b, []).append(i)
    return Packing(lengths, list(groups.values()), capacity)


def crossover(into: Packing, donor: Packing, share: float, rng: random.Random) -> Packing:
    """Inject a share of the donor's well-filled bins; remove the bins that they duplicate; best-fit what these displace."""
    capacity, where = into.capacity, {}
    for b, bin_ in enumerate(into.bins):
        for i in bin_:
            where[i] = b
    mean = sum(donor.fill) / max(1, len(donor.fill))
    chosen = [b for b, f in enumerate(donor.fill) if f >= mean and rng.random() < share]
    moved = {i for b in chosen for i in donor.bins[b]}
    hit = {where[i] for i in moved}
    # Mutation: the emptiest bins and a few others with room dissolve.
    roomy = sorted((b for b, f in enumerate(into.fill) if f < capacity and b not in hit), key=into.fill.__getitem__)
    worst = max(1, len(into.bins) // 50)
    hit.update(roomy[:worst])
    hit.update(rng.sample(roomy, min(len(roomy), 3 * worst)))
    child = into.without(hit)
    displaced = [i for b in sorted(hit) for i in into.bins[b] if i not in moved]
    child.bins += [list(donor.bins[b]) for b in chosen]
    child.fill += [donor.fill[b] for b in chosen]
    displaced.sort(key=child.lengths.__getitem__, reverse=True)
    return child.best_fit(displaced)


def evolve(lengths: list[int], capacity: int, seed: int, start: list[list[int]], population: int = POPULATION, generations: int = GENERATIONS) -> tuple[list[int], int]:
    """The bin of each piece in the best packing found, and the crossovers that entered; ``start`` has packings of earlier epochs in that form."""
    rng, bound = random.Random(seed), -(-sum(lengths) // capacity)
    herd, crossed = [], 0
    for bins in start:
        if max(bins) + 1 == bound:  # nothing is left to gain
            return bins, 0
    herd += [from_numbers(lengths, bins, capacity) for bins in start]
    while len(herd) < max(2, population):
        order = list(range(len(lengths)))
        rng.shuffle(order)
        herd.append(Packing(lengths, [], capacity).best_fit(order))
    herd.sort(key=Packing.quality)
    for generation in range(generations):
        if len(herd[0].bins) == bound and generation >= LEAST_GENERATIONS:
            break
        a, b = rng.sample(range(len(herd)), 2)
        child = crossover(herd[min(a, b)], herd[max(a, b)], rng.uniform(*INJECTED), rng)
        if child.quality() <= herd[-1].quality():
            herd[-1], crossed = child, crossed + 1
            herd.sort(key=Packing.quality)
    return herd[0].numbers(), crossed


def largest_first(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each piece in the plain best fit of the pieces by falling length."""
    return Packing(lengths, [], capacity).best_fit(sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)).numbers()


def _epoch(islands: DataFrame, epoch: int, capacity: int) -> DataFrame:
    """Evolve each island (shard, island, pieces, lengths, own, migrant, crossovers, migrants).

    In the last epoch the plain best fit competes, so that no island ends above it: of as many bins, those
    win whose room stands together, as it can then be used by what other shards have left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seed = (row["shard"] * ISLANDS + row["island"]) * EPOCHS + epoch
                bins, crossed = evolve(row["lengths"], capacity, seed, [x for x in (row["own"], row["migrant"]) if x])
                if epoch == EPOCHS - 1:
                    bins = min((bins, largest_first(row["lengths"], capacity)), key=lambda b: from_numbers(row["lengths"], b, capacity).quality())
                columns = [[row["shard"]], [row["island"]], [row["pieces"]], [row["lengths"]], [bins], [crossed + row["crossovers"]], [row["migrants"] + int(row["migrant"] is not None)]]
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "island", "pieces", "lengths", "bins", "crossovers", "migrants"])

    return islands.mapInArrow(run, "shard long, island int, pieces array<long>, lengths array<int>, bins array<int>, crossovers int, migrants int")


def evolved(loose: DataFrame, shards: int, capacity: int) -> DataFrame:
    """(shard, island, pieces, lengths, bins, crossovers, migrants) of all islands after the last epoch, for pieces (item, length).

    ``crossovers`` and ``migrants`` count those that entered in all epochs.
    """
    dealt = loose.groupBy(F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard")).agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("held"))
    none = F.lit(None).cast("array<int>")
    islands = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("held.item").alias("pieces"), F.col("held.length").alias("lengths"), none.alias("own"), none.alias("migrant"), F.lit(0).alias("crossovers"), F.lit(0).alias("migrants"))
    for epoch in range(EPOCHS):
        grown = write_table(_epoch(islands.repartition(ISLANDS * shards, "shard", "island"), epoch, capacity), f"islands-{epoch}")
        moved = grown.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("bins").alias("migrant"))
        islands = grown.withColumnRenamed("bins", "own").join(moved, ["shard", "island"])
    return grown


def place(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` (unique ``item`` and ``length`` from 1 to ``capacity``) with sequence_id and offset.

    A sequence is known by the item of its first piece.  Pieces of equal length are told apart by
    their item; an empty table gives no rows.
    """
    whole = pieces.filter(F.col("length") == capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose, done = pieces.filter(F.col("length") < capacity).select("item", F.col("length").cast("int").alias("length")), []
    while True:
        shards = max(1, -(-loose.count() // shard_pieces))
        ranked = evolved(loose, shards, capacity).withColumn("n", F.array_max("bins")).groupBy("shard").agg(F.min_by(F.struct("pieces", "lengths", "bins"), F.struct("n", "island")).alias("best"))
        rows = ranked.select("shard", F.explode(F.arrays_zip("best.pieces", "best.lengths", "best.bins")).alias("p")).select("shard", "p.*").toDF("shard", "item", "length", "bin")
        filled = rows.groupBy("shard", "bin").agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("held"), F.sum("length").alias("fill"))  # a bin holds ``capacity`` pieces at most
        if shards == 1:
            done.append(filled.select("held"))
            break
        of, bins = Window.partitionBy("shard"), F.count(F.lit(1)).over(Window.partitionBy("shard"))  # SHARD_PIECES bins at most
        least, any_ = F.row_number().over(of.orderBy("fill", "bin")), F.row_number().over(of.orderBy(F.xxhash64("shard", "bin"), "bin"))
        again = (least <= F.least(F.lit(EMPTIEST), bins / 4)) | (any_ <= F.least(F.lit(OTHERS), bins / 4))
        filled = write_table(filled.withColumn("again", again), "bins")
        done.append(filled.filter("NOT again").select("held"))
        loose = filled.filter("again").select(F.inline("held"))
    spots = F.expr("transform(held, (h, i) -> named_struct('item', h.item, 'offset', aggregate(slice(held, 1, i), 0L, (s, x) -> s + x.length)))")
    for held in done:
        whole = whole.unionByName(held.select(F.col("held")[0]["item"].alias("sequence_id"), F.inline(spots)).select("item", "sequence_id", "offset"))
    return whole


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all ``docs`` (see :func:`token_pieces`) with sequence_id and offset, gapless from 0 in each sequence.

    Rows are packed whatever their text, and null or repeated ids are packed like any other; other
    columns are ignored; an empty table gives no rows.
    """
    pieces = write_table(token_pieces(whole_batches(docs), tokenizer, capacity).withColumn("item", F.monotonically_increasing_id()), "pieces")
    return pieces.join(place(pieces, capacity), "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_pack": op4_pack}
ORACLE_SQL: dict = {}
