"""Exact ranked lexical search by best-first descent of sparse ball trees.

A document is a sparse vector over the terms of the queries: the share of a term's weight that its
frequency earns, in whole numbers.  A query's score is the inner product with its terms' indicator,
so terms that no query has can be left out of the vectors without changing a score.

1. One pass counts, over whole texts: documents, terms, and each query term's documents.
2. Every task cuts its documents into blocks and builds a ball tree on each: a ball has a centroid
   and a radius around it, and splits at the median of its projection on the line through two far members.
3. A query visits balls best-first.  Its terms' sum over the centroid, plus the radius times the
   query's length, bounds every score inside; so does that sum plus the ball's radius along each of
   these terms alone, which is the smaller one where a ball is wide in terms that the query lacks.
   The smaller bound counts, with a margin beyond any rounding, and the descent ends when the best
   bound left is below the query's ``k``-th best score so far in this task.  Leaves are scored in
   exact integers.
4. Each task's best ``k`` rows of a query, at most, meet in one ranking.

Queries are taken in blocks of bounded size, each a pass over the documents: what tasks hold grows
with the block, and no more.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, whole_batches, write_table
from .kernels import text_slices

TOP = 50
#: Queries of a block at most, and the bytes of their texts after which a block is closed.
BLOCK_QUERIES, BLOCK_BYTES = 10_000, 8 << 20
#: Documents, and vector entries, after which a task builds a tree on what it has; members of a leaf.
TREE_DOCS, TREE_ENTRIES, LEAF = 4096, 2_000_000, 64
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BYTE = np.arange(256)
_TERM = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_LOW = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
FOUND = "item long, doc_id long, score long"


def terms_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(document of each term, the terms) of a slice's texts."""
    solid = _TERM[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    opens[inner] = solid[inner]
    closes[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    letters = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(letters), pa.py_buffer(_LOW[data[solid]])])
    return np.searchsorted(bounds, start, "right") - 1, words


def known_terms(texts: pa.Array, vocabulary: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of slices of texts: (first, one past the last, terms of each text, text and term number and frequency of each known term of a text)."""
    for at, to, data, bounds in text_slices(texts):
        doc, words = terms_of(data, bounds)
        coded = words.dictionary_encode()
        number = pc.index_in(coded.dictionary, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        term = number[coded.indices.to_numpy()] if len(doc) else np.zeros(0, np.int64)
        pair, tf = np.unique((doc * max(1, len(vocabulary)) + term)[term >= 0], return_counts=True)
        yield at, to, np.bincount(doc, minlength=to - at), pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary)), tf


def _counted(vocabulary: Broadcast):
    """(term, documents) for a task's documents; term -1 has the documents with any term, -2 all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(vocabulary.value), np.int64)
        docs = total = 0
        for batch in batches:
            for _, _, n, _, term, _ in known_terms(batch.column(1), vocabulary.value):
                held += np.bincount(term, minlength=len(held))
                docs += int((n > 0).sum())
                total += int(n.sum())
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some])), pa.array(np.concatenate([[docs, total], held[some]]))], names=["term", "n"])

    return run


class Vectors:
    """Sparse vectors in rows: row r has the entries first[r]:first[r + 1]."""

    def __init__(self, first: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.first, self.term, self.value = first, term, value

    def rows(self, at: np.ndarray) -> Vectors:
        size = (self.first[1:] - self.first[:-1])[at]
        to = np.cumsum(size)
        where = np.repeat(self.first[at] - (to - size), size) + np.arange(size.sum())
        return Vectors(np.concatenate([[0], to]), self.term[where], self.value[where])

    def sums(self, entries: np.ndarray) -> np.ndarray:
        """Of each row's ``entries``."""
        total = np.concatenate([np.zeros(1, entries.dtype), np.cumsum(entries)])
        return total[self.first[1:]] - total[self.first[:-1]]


class Tree:
    """A ball tree over sparse vectors of whole numbers; balls are numbered, 0 is the root.

    Distances use entries over the roots of ``weight``, queries the roots: the inner product is the
    same, and rare and frequent terms weigh alike in a ball's radius.
    """

    def __init__(self, vectors: Vectors, weight: np.ndarray, leaf: int = LEAF):
        self.scale = np.sqrt(np.maximum(weight, 1))
        self.children: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray] = []
        self.leaves: list[Vectors | None] = []
        centres, radii, along = [], [], []
        waiting = [(np.arange(len(vectors.first) - 1), None)]
        while waiting:
            at, parent = waiting.pop()
            ball = len(self.members)
            if parent is not None:
                was = self.children[parent]
                self.children[parent] = (was[0], ball) if was else (ball, ball)
            part = vectors.rows(at)
            x = part.value / self.scale[part.term]
            centre = np.bincount(part.term, x, len(weight)) / len(at)
            far = np.sqrt(np.maximum(0.0, part.sums(x * x) - 2 * part.sums(x * centre[part.term]) + centre @ centre))
            centres.append(centre)
            radii.append(far.max())
            most = np.zeros(len(weight))
            np.maximum.at(most, part.term, x)
            along.append(most - centre)
            self.children.append(None)
            self.members.append(at)
            self.leaves.append(part if len(at) <= leaf else None)
            if len(at) > leaf:
                for side in self._halves(part, x, far):
                    waiting.append((at[side], ball))
        self.centres = np.array(centres) * self.scale  # so that a query adds up its terms' entries
        self.radii = np.array(radii)
        self.along = np.array(along) * self.scale  # how far above the centroid members get along a term

    def _halves(self, part: Vectors, x: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows at either side of the median on the line through a row far from the centre and one far from that."""
        norms = part.sums(x * x)

        def along(row: int) -> np.ndarray:
            dense = np.zeros(len(self.scale))
            own = slice(part.first[row], part.first[row + 1])
            dense[part.term[own]] = x[own]
            return part.sums(x * dense[part.term])

        one = int(far.argmax())
        first = along(one)
        other = int((norms - 2 * first).argmax())
        by = np.argsort(first - along(other), kind="stable")
        return by[: len(by) // 2], by[len(by) // 2 :]

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """For every ball, what no score inside exceeds: a relative 1e-6 and one more cover all rounding of sums in doubles."""
        length = np.sqrt((self.scale[terms] ** 2).sum())
        rest = np.minimum(length * self.radii, self.along[:, terms].sum(axis=1))
        return (self.centres[:, terms].sum(axis=1) + rest) * (1 + 1e-6) + 1

    def search(self, terms: np.ndarray, asked: np.ndarray, best: list, k: int, ids: np.ndarray) -> int:
        """Add the tree's rows to ``best``, a heap of the ``k`` best (score, -id, id); returns how many rows were scored."""
        above = self.bounds(terms)
        asked[terms] = True
        open_, scored = [(-above[0], 0)], 0
        while open_:
            bound, ball = heapq.heappop(open_)
            if len(best) == k and -bound < best[0][0]:
                break
            if self.leaves[ball] is None:
                for child in self.children[ball]:
                    heapq.heappush(open_, (-above[child], child))
                continue
            part = self.leaves[ball]
            scored += len(part.first) - 1
            score = part.sums(np.where(asked[part.term], part.value, 0))
            least = best[0][0] if len(best) == k else 1
            for row in np.flatnonzero(score >= max(1, least)):
                one = int(ids[self.members[ball][row]])
                entry = (int(score[row]), -one, one)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        asked[terms] = False
        return scored


def _searched(shared: Broadcast, k: int):
    """The best ``k`` rows of a task for each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weight, items, queries, many, total = shared.value
        best: list[list] = [[] for _ in queries]
        asked = np.zeros(len(weight), bool)
        held: list[tuple] = []
        docs = entries = 0

        def descend() -> None:
            ids = np.concatenate([h[0] for h in held])
            size, term, value = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            tree = Tree(Vectors(np.concatenate([[0], np.cumsum(size)]), term, value), weight)
            for terms, top in zip(queries, best):
                if len(terms):
                    tree.search(terms, asked, top, k, ids)
            held.clear()

        for batch in batches:
            names = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for at, to, n, doc, term, tf in known_terms(batch.column(1), vocabulary):
                m = 100 - 50 + (50 * n * many) // max(1, total)
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                size = np.bincount(doc, minlength=to - at)
                some = np.flatnonzero(size)
                held.append((names[at:to][some], size[some], term, value))
                docs, entries = docs + len(some), entries + len(term)
                if docs >= TREE_DOCS or entries >= TREE_ENTRIES:
                    descend()
                    docs = entries = 0
        if docs:
            descend()
        rows = [(item, one, score) for item, top in zip(items, best) for score, _, one in top]
        columns = zip(*rows) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return run


#: Stands for a null id among the ids: behind all others of its score.
NO_ID = 2**63 - 1


def _block(docs: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """The best rows of each task for a block of (query number, its terms' bytes)."""
    share = docs.sparkSession.sparkContext.broadcast
    found = pc.unique(pa.array([t for _, terms in queries for t in terms], pa.large_binary()))
    counts = dict(docs.mapInArrow(_counted(share(found)), "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # a row a term of the block
    many, total = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(len(found), np.int64)
    df[list(counts)] = list(counts.values())
    weight = np.floor(1000 * np.log((2 * many + 2) / (2 * df + 1))).astype(np.int64)
    numbers = [np.unique(pc.index_in(pa.array(terms, pa.large_binary()), value_set=found).to_numpy()).astype(np.int64) for _, terms in queries]
    return docs.mapInArrow(_searched(share((found, weight, [i for i, _ in queries], numbers, many, total)), k), FOUND)


def ball_search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """For each row of ``queries`` (item_id, text) the ``k`` best rows of ``docs``: item_id, rank (from 1), doc_id, score.

    Scores of 0 don't count, so a query may have fewer rows or none; equal scores rank by id, a null
    id last.  Null and empty texts hold no terms, and aren't counted as documents.  Repeated rows of
    ``docs`` are documents of their own, equal queries (the same id and text) one query; queries
    of one id and different texts are ranked each, under their id.  Other columns are ignored; an
    empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    rows = whole_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = write_table(queries.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()), "queries")
    found, block, size = [], [], 0

    def close() -> None:
        if block:
            found.append(write_table(_block(rows, block, k), "found"))
            block.clear()

    for item, text in items.select("item", "text").toLocalIterator():  # one block of queries at a time
        terms = sorted(set(TERM.findall(text.encode().translate(bytes(_LOW)))))
        if terms:
            block.append((item, terms))
            size += len(text)
        if len(block) >= BLOCK_QUERIES or size >= BLOCK_BYTES:
            close()
            size = 0
    close()
    best = spark.createDataFrame([], FOUND)
    for part in found:
        best = best.unionByName(part)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def op11_ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_ball_search": op11_ball_search}
ORACLE_SQL: dict = {}
