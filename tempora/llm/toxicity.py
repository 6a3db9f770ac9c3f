"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams with word marks, hashed to ``BUCKETS`` vectors; a word
is the mean of its bag and a text the mean of its words.  Misspelt or unseen words share the
n-grams of the words they resemble.  The model is fitted on the driver from the bags of a bounded
sample of labelled rows and has a fixed size; scoring reads all rows in their tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import drop_table, table, whole_batches, write_table

BUCKETS, DIMENSIONS = 1 << 17, 6
#: Lengths in bytes of a word's n-grams, its two marks included.
LENGTHS = (3, 4, 5, 6)
#: Labelled rows of each class in the training sample at most, and entries of all their bags (six bytes each on the driver); texts are read whole.
SAMPLE_PER_CLASS, SAMPLE_ENTRIES = 1000, 40_000_000
#: Words without any effect that every text has besides its own, so that a few words don't decide.
NEUTRAL_WORDS = 20
#: The weight of class 1 in training, whatever its share in the sample.
PRIOR = 0.2
EPOCHS, RATE, BATCH, SEED = 12, 0.1, 32, 11
INIT, GAIN_POWER = 0.002, 0.5
FOLDS = 5
_FACTOR, _SHIFT = np.uint64(0xBF58476D1CE4E5B9), np.uint64(64 - BUCKETS.bit_length() + 1)


def distinct_words(words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct words of a slice: their bytes, each after a blank, and their starts; of all words: which they are."""
    _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
    size = words.end[first] - words.start[first]
    start = np.cumsum(size + 1) - size
    solid = np.flatnonzero(_solid(size))
    padded = np.full(int(size.sum()) + len(size) + 1, 32, np.uint8)
    padded[solid] = words.data[np.repeat(words.start[first] - start, size) + solid]
    return padded, start, which


def _solid(size: np.ndarray) -> np.ndarray:
    """False at the blank before each word, True at its bytes."""
    out = np.ones(int(size.sum()) + len(size), bool)
    out[np.cumsum(size + 1) - size - 1] = False
    return out


def word_grams(padded: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of the words, and of every whole word; the blanks around a word are its marks."""
    word_at = np.zeros(len(padded), np.int64)
    word_at[start] = 1
    word_at = np.cumsum(word_at) - 1
    word_at[:-1] = np.where(padded[:-1] == 32, word_at[1:], word_at[:-1])  # a blank opens the word that follows
    blank = np.concatenate([[0], np.cumsum(padded == 32)])
    word, bucket = [], []
    for n in LENGTHS:
        at = np.arange(max(0, len(padded) - n + 1))
        at = at[blank[at + n - 1] == blank[at + 1]]  # blanks at the ends only
        word.append(word_at[at])
        bucket.append((K.span_hash(padded, at, at + n) + np.uint64(n)) * _FACTOR >> _SHIFT)
    end = np.append(start[1:] - 1, len(padded) - 1)[: len(start)]
    word.append(np.arange(len(start)))
    bucket.append((K.span_hash(padded, start, end) + np.uint64(99)) * _FACTOR >> _SHIFT)
    return np.concatenate(word), np.concatenate(bucket).astype(np.int64)


#: Of a text: the buckets of its n-grams, the share of each in the text, and the number of words.
Bag = tuple[np.ndarray, np.ndarray, int]


def text_bags(data: np.ndarray, bounds: np.ndarray) -> Iterator[Bag]:
    """The bags of a slice's texts."""
    words = K.words_of(data, bounds)
    if not len(words.doc):
        yield from [(np.zeros(0, np.int32), np.zeros(0, np.float32), 0)] * (len(bounds) - 1)
        return
    padded, start, which = distinct_words(words)
    word, bucket = word_grams(padded, start)
    order = np.argsort(word, kind="stable")
    bucket, sizes = bucket[order], np.bincount(word, minlength=len(start))
    edge, counted = np.cumsum(sizes) - sizes, np.bincount(words.doc, minlength=len(bounds) - 1)
    # Each document's distinct words and how often it has them, then their n-grams.
    pair, times = np.unique(words.doc * len(start) + which, return_counts=True)
    of, many = pair % len(start), sizes[pair % len(start)]
    place = np.repeat(edge[of] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    key, inverse = np.unique(np.repeat(pair // len(start), many) * BUCKETS + bucket[place], return_inverse=True)
    value = np.bincount(inverse, np.repeat(times / many, many), len(key)) / (counted[key // BUCKETS] + NEUTRAL_WORDS)
    edges = np.searchsorted(key, np.arange(len(bounds)) * BUCKETS)
    for d, (a, b) in enumerate(zip(edges, edges[1:])):
        yield (key[a:b] % BUCKETS).astype(np.int32), value[a:b].astype(np.float32), int(counted[d])


class SubwordSoftmax:
    """The model: ``vectors`` (buckets x dimensions), ``weights`` (dimensions x 2) and ``bias`` (2)."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, INIT, (BUCKETS, DIMENSIONS))
        self.weights, self.bias, self.gain = rng.normal(0, 1, (DIMENSIONS, 2)), np.zeros(2), 1.0

    def fit(self, bags: list[Bag], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> SubwordSoftmax:
        """Adaptive gradient descent on mini-batches of whole texts' bags, which hold the roots of their shares."""
        ids, shares, lengths = zip(*bags) if bags else ((), (), ())
        y, used = np.array(labels), [i for i, x in enumerate(ids) if len(x)]
        if not used:
            return self
        weigh = np.where(y == 1, PRIOR / max(1, (y == 1).sum()), (1 - PRIOR) / max(1, (y == 0).sum())) * len(y)
        # Texts average many words, so that one word moves the mean little: the logits get a gain.
        self.gain = float(np.median([lengths[i] for i in used])) ** GAIN_POWER
        rng, seen = np.random.default_rng(seed), [np.full(x.shape, 1e-6) for x in (self.vectors, self.weights, self.bias)]
        for _ in range(epochs):
            order = rng.permutation(used)
            for k in range(0, len(order), BATCH):
                batch = order[k : k + BATCH]
                sizes = np.array([len(ids[i]) for i in batch])
                bucket, part = np.concatenate([ids[i] for i in batch]), np.concatenate([shares[i] for i in batch]).astype(np.float64) ** 2
                mean = np.add.reduceat(self.vectors[bucket] * part[:, None], np.cumsum(sizes) - sizes, axis=0) * self.gain
                logits = mean @ self.weights + self.bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(batch)), y[batch]] -= 1
                p *= weigh[batch][:, None] / len(batch)
                d_mean = np.repeat(self.gain * p @ self.weights.T, sizes, axis=0) * part[:, None]
                d_vectors = np.stack([np.bincount(bucket, d_mean[:, j], BUCKETS) for j in range(DIMENSIONS)], axis=1)
                for x, d, s in ((self.weights, mean.T @ p, seen[1]), (self.bias, p.sum(axis=0), seen[2]), (self.vectors, d_vectors, seen[0])):
                    s += d * d
                    x -= rate * d / np.sqrt(s)
        return self

    def bucket_logits(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to logit 1 minus logit 0, as the model is linear after its look-up, and the bias."""
        return self.gain * self.vectors @ (self.weights[:, 1] - self.weights[:, 0]), float(self.bias[1] - self.bias[0])


def text_logits(texts: pa.Array, buckets: np.ndarray, bias: float) -> np.ndarray:
    """The logit of each whole text: the mean over its words of the mean over their n-grams."""
    out = [np.zeros(0)]
    for _, _, data, bounds in K.text_slices(texts):
        words = K.words_of(data, bounds)
        padded, start, which = distinct_words(words)
        word, bucket = word_grams(padded, start)
        values = np.bincount(word, buckets[bucket], len(start)) / np.maximum(np.bincount(word, minlength=len(start)), 1)
        total = np.bincount(words.doc, values[which], len(bounds) - 1)
        out.append(total / (np.bincount(words.doc, minlength=len(bounds) - 1) + NEUTRAL_WORDS) + bias)
    return np.concatenate(out)


def training_bags(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, entries: int = SAMPLE_ENTRIES) -> list[tuple[Bag, int]]:
    """The bags of whole texts of a sample bounded by ``per_class`` of the labelled rows outside the held-out fold, by a hash of the id.

    Tasks turn the texts into bags of at most ``BUCKETS`` entries; only these reach the driver, and of
    each class, in the same order, as many as fit into half of ``entries`` (one at least).
    """
    known = labels.filter("toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id", F.lit(SEED))
    picked = [known.filter(F.col("toxic") == k).groupBy("doc_id", "toxic").agg(F.lit(1)).orderBy(order, "doc_id").limit(per_class).select("doc_id", "toxic") for k in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [x for slice_ in K.text_slices(batch.column(2)) for x in text_bags(*slice_[2:])]
            # Six bytes an entry, as the driver holds them all: roots of shares, so that small ones of long texts keep their digits.
            columns = [K.binary_rows([b[0] for b in bags]), K.binary_rows([np.sqrt(b[1]).astype(np.float16) for b in bags])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), *columns, pa.array([b[2] for b in bags], pa.int64())], names=["doc_id", "toxic", "ids", "shares", "words"])

    bags = write_table(rows.mapInArrow(bagged, "doc_id long, toxic int, ids binary, shares binary, words long"), "bags")  # at most 2 * per_class rows
    ranked = Window.partitionBy("toxic").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fits = bags.select("doc_id", "toxic", F.sum(F.octet_length("ids") / 4).over(ranked).alias("upto"), F.row_number().over(Window.partitionBy("toxic").orderBy(order, "doc_id")).alias("rn")).filter((F.col("upto") <= entries / 2) | (F.col("rn") == 1))
    found = bags.join(F.broadcast(fits.select("doc_id", "toxic")), ["doc_id", "toxic"]).toArrow()
    rows_ = [
        (doc_id, toxic, (np.frombuffer(ids.as_buffer(), np.int32), np.frombuffer(shares.as_buffer(), np.float16), n))
        for batch in found.to_batches()
        for doc_id, toxic, ids, shares, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4).to_pylist())
    ]
    drop_table(bags)
    return [(bag, toxic) for _, toxic, bag in sorted(rows_, key=lambda r: r[:2])]


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> SubwordSoftmax:
    rows = training_bags(whole_batches(docs), labels)
    return SubwordSoftmax().fit([b for b, _ in rows], [y for _, y in rows])


def score_toxicity(docs: DataFrame, model: SubwordSoftmax, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` (1 from 0.5 on).

    A text is scored whole.  Null and empty texts get the score of the bias, like every text
    without words; repeated rows get equal scores; clashing columns are replaced; an empty table
    gives no rows.
    """
    buckets, bias = model.bucket_logits()
    shared = docs.sparkSession.sparkContext.broadcast(buckets)

    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(text_logits(texts, shared.value, bias), -500, 500))))

    scored.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    score = F.arrow_udf(scored, "double")
    return whole_batches(docs).withColumn("score", score(F.col(text_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict = {}
