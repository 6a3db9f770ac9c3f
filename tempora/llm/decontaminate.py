"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

A seed is three words near each other, with or without others between (``PATTERNS``), so that a copy
with a third of its words changed still has some.  The seeds of the benchmark fill a table of bits
that goes to every task; a document's seeds that hit it mark passages, wide enough for the longest
item on either side.  Passages and items meet by a join on the whole seed hash, and where they share
two seeds they are aligned word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import bit_table, bounded_broadcast, table, whole_batches, write_table

#: The places of a seed's words.  Those of one and two words serve items that are no longer.
PATTERNS = ((0,), (0, 1), (0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4))
#: Seeds that a passage and an item share at least before they are aligned; one, if the item has no more.
SHARED_SEEDS = 2
MATCH, MISMATCH, GAP = 2, -1, -1
#: The least alignment score, as a share of the item's score against itself.
THRESHOLD = 0.5
#: The table of bits has so many places for each seed, as a document has thousands of seeds, and 2^28 (32 MB) at most; beyond, more passages pass on to the join.
TABLE_BITS, PLACES = 28, 512
BROADCAST_SEEDS, BROADCAST_BYTES = 1_000_000, 32 << 20
_POINTS = np.isin(np.arange(256), list(b".,;:!?\"'()"))


def plain_words(data: np.ndarray, bounds: np.ndarray) -> K.Words:
    """Words without points and quotes around them; words of points alone stay."""
    words = K.words_of(data, bounds)
    start, end = words.start.copy(), words.end.copy()
    for _ in range(3):
        end -= _POINTS[data[end - 1]] & (end - start > 1) if len(end) else 0
        start += _POINTS[data[start]] & (end - start > 1) if len(end) else 0
    return words._replace(start=start, end=end, hash=K.span_hash(data, start, end))


def _one(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return plain_words(data, np.array([0, len(data)])).hash


def pattern_hashes(words: K.Words, pattern: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at ``pattern``'s places from each word on, within a document, and that word."""
    many = len(words.hash) - pattern[-1]
    if many <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factors = K.place_factors(pattern[-1] + 1)
    total = np.full(many, PATTERNS.index(pattern), np.uint64)
    for k in pattern:
        total += words.hash[k : many + k] * factors[k]
    at = np.flatnonzero(words.doc[:many] == words.doc[pattern[-1] :])
    return K.mixed(total[at]), at


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, seeds, sizes = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = np.frombuffer(text.encode(), np.uint8)
            words = plain_words(data, np.array([0, len(data)]))
            n = len(words.hash)
            own = [p for p in PATTERNS if len(p) == min(n, 3)]
            grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *(pattern_hashes(words, p)[0] for p in own)])).view(np.int64)
            keys += [key] * len(grams)
            seeds += grams.tolist()
            sizes += [n] * len(grams)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(seeds, pa.int64()), pa.array(sizes, pa.int32())], names=["item", "seed", "words"])


def _passages(table_, bits: int, reach: int, patterns: list[tuple[int, ...]]):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_ = table_.value
        for batch in batches:
            rows: list[tuple] = []
            for lo, _, data, bounds in K.text_slices(batch.column(1)):
                words = plain_words(data, bounds)
                hits = []
                for p in patterns:
                    grams, at = pattern_hashes(words, p)
                    hit = np.flatnonzero(K.in_bits(set_, bits, grams))
                    hits.append((at[hit], grams[hit]))
                at, grams = (np.concatenate(x) for x in zip(*hits))
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, grams = at[order], grams[order]
                first, doc = words.first(), words.doc[at]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (np.diff(at) > 2 * reach)]))
                for a, b in zip(new, np.append(new[1:], len(at))):
                    d = doc[a]
                    begin = max(int(first[d]), int(at[a]) - reach)
                    stop = min(int(first[d + 1]), int(at[b - 1]) + PATTERNS[-1][-1] + 1 + reach)
                    rows.append((lo + int(d), begin - int(first[d]), data[words.start[begin] : words.end[stop - 1]].tobytes(), np.unique(grams[a:b]).view(np.int64)))
            picked = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([picked, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["doc_id", "first_word", "passage", "seeds"])

    return found


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score, and one past its last word in the passage (Smith-Waterman, linear gaps)."""
    if not len(item) or not len(passage):
        return 0, 0
    slope = np.arange(len(passage), dtype=np.int64) * -GAP
    above, best, end = np.zeros(len(passage), np.int64), 0, 0
    for word in item:
        row = np.where(passage == word, MATCH, MISMATCH)
        row[1:] += above[:-1]
        np.maximum(row, above + GAP, out=row)
        np.maximum(row, 0, out=row)
        above = np.maximum.accumulate(row + slope) - slope  # gaps along the passage
        top = int(above.argmax())
        if above[top] > best:
            best, end = int(above[top]), top + 1
    return best, end


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items: dict[str, np.ndarray] = {}
        score, end = [], []
        passages = [x.as_py() for x in batch.column(3)]
        for text, first, passage in zip(batch.column(4).to_pylist(), batch.column(2).to_pylist(), passages):
            item = items[text] if text in items else items.setdefault(text, _one(text))
            data = np.frombuffer(passage, np.uint8)
            got, to = align(item, plain_words(data, np.array([0, len(data)])).hash)
            score.append(got / (MATCH * len(item)))
            end.append(first + to)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "score", "end_word"])


def rare_seeds(items: DataFrame) -> DataFrame:
    """(item, seed, words, need): each item's seeds that no more items have than half of its seeds, and how many a passage must share."""
    seeds = items.select("item", "text").mapInArrow(_item_seeds, "item long, seed long, words int")
    seeds = seeds.join(seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n")), "seed")
    common = seeds.groupBy("item").agg(F.percentile_approx("n", 0.5, F.lit(10000)).alias("common"))
    rare = seeds.join(common, "item").filter("n <= common")
    needs = rare.groupBy("item").agg(F.least(F.lit(SHARED_SEEDS), F.count(F.lit(1))).alias("need"))
    return rare.join(needs, "item").select("item", "seed", "words", "need")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and item that align: doc_id, item_id, score (0 to 1), end_word.

    ``score`` is the best local alignment as a share of the item's alignment with itself, kept from
    ``threshold`` on; ``end_word`` counts the document's words up to its end.  Null and empty texts
    align with nothing.  Items of one or two words are found where all their words stand.  Repeated
    rows and ids give one row with their best score, whichever of an id's texts it belongs to; null
    ids count as one id; other columns are ignored; an empty table on either side gives no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).filter("text IS NOT NULL").distinct()
    items = write_table(items.withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = write_table(rare_seeds(items), "seeds")
    reach, many, least = seeds.agg(F.max("words"), F.count(F.lit(1)), F.collect_set(F.least("words", F.lit(3)))).first()
    patterns = [p for p in PATTERNS if len(p) in least]
    words, bits = bit_table(seeds, "seed", many, TABLE_BITS, PLACES)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    rows = whole_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    rows = rows if patterns else rows.limit(0)
    found = rows.mapInArrow(_passages(shared, bits, reach or 0, patterns), "doc_id long, first_word long, passage binary, seeds array<long>")
    found = write_table(found.withColumn("at", F.monotonically_increasing_id()), "passages")
    met = found.select("at", F.explode("seeds").alias("seed")).join(bounded_broadcast(seeds.select("seed", "item", "need"), many, BROADCAST_SEEDS), "seed")
    met = met.groupBy("at", "item", "need").agg(F.count(F.lit(1)).alias("n")).filter("n >= need").select("at", "item")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pairs = met.join(bounded_broadcast(items, size, BROADCAST_BYTES), "item").join(found.drop("seeds"), "at")
    scored = pairs.select("doc_id", "item_id", "first_word", "passage", "text").mapInArrow(_scored, "doc_id long, item_id long, score double, end_word long")
    return scored.filter(F.col("score") >= threshold).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max_by("end_word", F.struct("score", -F.col("end_word"))).alias("end_word"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLE_SQL: dict = {}
