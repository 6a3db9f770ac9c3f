"""Runs of words that repeat with a period, by Lyndon arrays.

A run is a stretch of words with smallest period q, of at least max(6, 4 q) words, that no
neighbouring word extends.  Every run holds the longest Lyndon word at some of its places, under
the order of words or the reverse one, and that word's length is the run's period.

1. *Reduction, exact.*  In a run of this length every three words in a row stand there three times
   or more.  Words that aren't part of three words found three times in the document stand in no
   run and cut it; stretches of under six words go.
2. *Lyndon arrays.*  The first phase of Baier's suffix sorter (grouping) runs over all stretches of a
   slice of documents at once, under both orders.  Groups of places, one for each longest
   Lyndon word, are taken from the highest down; each place of a group lengthens the word of the
   nearest earlier place that isn't taken yet, and equally lengthened places of one group
   become a group of their own right above it.
3. *Runs.*  A Lyndon word that its next copies follow is extended to both sides by the longest common
   extensions of its start and its second copy, found by doubling steps on hashes of word ranges.
   What comes out is compared word by word.

Words are numbered by Arrow's dictionary of their bytes, exactly.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_batches
from .kernels import mixed, text_slices, word_spans

LEAST, TIMES = 6, 4
_U = np.uint64
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def lyndon_array(ids: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word at each place; 0 ends a sequence, and stands first and last.

    Places of a group are taken in order, and a taken place leaves the chain of untaken ones, so the
    nearest untaken place before it is at hand.  Every place lengthens one other place at most once:
    linear, but for sorting inside groups.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    edges = np.flatnonzero(np.diff(ids[order], prepend=-1))
    groups = [g.tolist() for g in np.split(order, edges[1:])]  # of places; the first holds the zeros
    group = np.zeros(n, np.int64)
    group[order] = np.repeat(np.arange(len(groups)), np.diff(np.append(edges, n)))
    group, length, below = group.tolist(), [1] * len(groups), list(range(-1, len(groups) - 1))
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    out = [0] * n
    alive = [len(g) for g in groups]
    above = {g: g + 1 for g in range(len(groups) - 1)}
    top = len(groups) - 1
    while top > 0:
        size, grown = length[top], {}
        members = groups[top]
        members.sort()
        for i in members:
            if group[i] == top:
                out[i] = size
                before, after = left[i], right[i]
                right[before] = after
                if after < n:
                    left[after] = before
                grown[before] = grown.get(before, 0) + 1
        parts: dict = {}
        for i, times in grown.items():
            if group[i] and group[i] != top:
                parts.setdefault((times, group[i]), []).append(i)
        for times, old in sorted(parts, reverse=True):
            moved = parts[times, old]
            if len(moved) == alive[old]:
                length[old] += times * size
                continue
            new = len(groups)
            groups.append(moved)
            length.append(length[old] + times * size)
            alive.append(len(moved))
            alive[old] -= len(moved)
            for i in moved:
                group[i] = new
            higher = above[old]  # at most ``top``, which is taken now
            above[old], above[new] = new, higher
            below.append(old)
            below[higher] = new
        top = below[top]
    return np.array(out)


def _extension(power: np.ndarray, sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many numbers from ``a`` on equal those from ``b`` on (or before them, ``back``), at most ``most``: doubling steps, then halving ones.

    ``b`` > ``a``; ``sums`` are running sums of numbers times powers, so equal ranges differ by a power.
    """
    got, last = np.zeros(len(a), np.int64), len(sums) - 1
    steps = [1 << e for e in range(int(most.max(initial=0)).bit_length())]
    open_ = np.arange(len(a))

    def alike(at: np.ndarray, n: int) -> np.ndarray:
        x, y = (a[at] - got[at] - n, b[at] - got[at] - n) if back else (a[at] + got[at], b[at] + got[at])
        fits = got[at] + n <= most[at]
        x, y = np.where(fits, x, 0), np.where(fits, y, 0)
        m = np.where(fits, n, 0)
        return fits & ((sums[np.minimum(x + m, last)] - sums[x]) * power[y - x] == sums[np.minimum(y + m, last)] - sums[y])

    for n in steps:
        yes = alike(open_, n)
        got[open_[yes]] += n
        open_ = open_[yes]
    for n in reversed(steps):
        every = np.arange(len(a))
        got[every[alike(every, n)]] += n
    return got


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, 0x9E3779B97F4A7C13, _U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def runs_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; ``ids`` as for :func:`lyndon_array`."""
    n = len(ids)
    power, sums = _powers(n + 1), np.zeros(n + 1, _U)
    np.cumsum(mixed(ids.astype(_U) + _U(1)) * power[:n], out=sums[1:])
    ends = np.flatnonzero(ids == 0)
    until, since = ends[np.searchsorted(ends, np.arange(n))], ends[np.searchsorted(ends, np.arange(n), "right") - 1] + 1
    found = []
    for order in (ids, np.where(ids > 0, ids.max(initial=0) + 1 - ids, 0)):
        q = lyndon_array(order)
        i = np.flatnonzero((q > 0) & (np.arange(n) + 2 * q <= until))
        same = (sums[i + q[i]] - sums[i]) * power[q[i]] == sums[i + 2 * q[i]] - sums[i + q[i]]
        i = i[same]
        p = q[i]
        # of copies in a row, only the first is extended
        first = ~((i - p >= since[i]) & (q[np.maximum(i - p, 0)] == p) & ((sums[i] - sums[np.maximum(i - p, 0)]) * power[p] == sums[i + p] - sums[i]))
        i, p = i[first], p[first]
        ahead = _extension(power, sums, i, i + p, until[i] - i - p, False)
        behind = _extension(power, sums, i, i + p, i - since[i], True)
        found.append(np.stack([i - behind, p + ahead + behind, p]))
    start, length, period = np.unique(np.concatenate(found, axis=1), axis=1)
    long = length >= np.maximum(LEAST, TIMES * period)
    start, length, period = start[long], length[long], period[long]
    for s, m, p in zip(start.tolist(), length.tolist(), period.tolist()):
        if not np.array_equal(ids[s : s + m - p], ids[s + p : s + m]):
            raise ArithmeticError(f"hashes of different word ranges agree at {s}")
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def repetitive(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each word is part of three words in a row that its document holds three times."""
    keep = np.zeros(len(ids), bool)
    if len(ids) < 3:
        return keep
    seed = ids.astype(_U)
    three = mixed(mixed(mixed(seed[:-2] + _U(1)) ^ seed[1:-1]) ^ seed[2:])
    at = np.flatnonzero(doc[:-2] == doc[2:])
    three, owner = three[at], doc[at]
    by = np.lexsort((three, owner))
    turn = np.flatnonzero(np.concatenate([[True], (np.diff(owner[by]) != 0) | (three[by][1:] != three[by][:-1])])) if len(by) else np.zeros(0, np.int64)
    many = np.diff(np.append(turn, len(by)))
    often = at[by[np.repeat(many >= 3, many)]]
    for k in range(3):
        keep[often + k] = True
    return keep


def _stretches(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers with a 0 before each stretch and one at the end, the word of each number or -1), numbers from 1 on."""
    keep = repetitive(ids, doc)
    turn = np.flatnonzero(np.diff(keep, prepend=False, append=False) | np.append(np.diff(doc, prepend=-1) != 0, False))
    start, stop = turn[:-1], turn[1:]
    good = (stop - start >= LEAST) & keep[start] if len(turn) else np.zeros(0, bool)
    start, stop = start[good], stop[good]
    size = stop - start + 1
    word = np.repeat(start - 1 - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    word[np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)[: len(size)]] = -1
    word = np.append(word, -1).astype(np.int64)
    return np.where(word >= 0, ids[word] + 1 if len(ids) else 0, 0), word


def _rewritten(first: np.ndarray, ids: list[str | None]) -> np.ndarray:
    """For every word the word that stands there: documents whose hash is a multiple of ten end in copies of some of their words."""
    word = np.arange(first[-1])
    for d, name in enumerate(ids):
        n, h = int(first[d + 1] - first[d]), zlib.crc32(name.encode()) if name is not None else 1
        if n and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            word[first[d] + a : first[d + 1]] = first[d] + a + np.arange(n - a) % p
    return word


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(start) else np.zeros(0, np.int64)


def judged_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0).cast(pa.string()).to_pylist()
        for at, to, data, bounds in text_slices(batch.column(1)):
            doc, start, end = word_spans(data, bounds)
            size = end - start
            letters = np.concatenate([[0], np.cumsum(size)])
            packed = data[_ranges(start, size)]
            words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(letters), pa.py_buffer(packed)])
            ids = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(size) else np.zeros(0, np.int64)
            first = np.searchsorted(doc, np.arange(to - at + 1))
            word = _rewritten(first, names[at:to])
            ids = ids[word]
            numbers, place = _stretches(ids, doc)
            s, m, p = runs_of(numbers)
            s = place[s]
            gone = np.zeros(len(ids) + 1, np.int64)
            np.add.at(gone, s + p, 1)
            np.add.at(gone, s + m, -1)
            kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
            yield _rows(batch.column(0)[at:to], first, (s, m, p), kept, word[kept], size, letters, packed)


def _rows(ids: pa.Array, first: np.ndarray, runs: tuple, kept: np.ndarray, source: np.ndarray, size: np.ndarray, letters: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
    s, m, p = runs
    long = size[source] + 1  # with a space behind
    text = np.full(long.sum(), 32, np.uint8)
    ends = np.cumsum(long)
    text[_ranges(ends - long, long - 1)] = packed[_ranges(letters[source], long - 1)]
    bytes_ = np.concatenate([[0], ends])[np.searchsorted(kept, first)]
    owner = np.searchsorted(first, s, "right") - 1
    edge = np.searchsorted(owner, np.arange(len(first)))
    best: list[list] = [[], [], [], []]
    counts, listed, collapsed = [], [], []
    for d in range(len(first) - 1):
        a, b = edge[d], edge[d + 1]
        starts, lengths, periods = (v[a:b].tolist() for v in (s - first[d], m, p))
        rows = sorted(zip(starts, lengths, periods), key=lambda r: (r[0], r[2]))
        counts.append(len(rows))
        listed.append(hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in rows).encode()).hexdigest())
        top = min(rows, key=lambda r: (-r[1], r[0], r[2]), default=None)
        for column, value in zip(best, (*top, 1000 * top[1] // top[2]) if top else [None] * 4):
            column.append(value)
        collapsed.append(hashlib.sha256(text[bytes_[d] : max(bytes_[d], bytes_[d + 1] - 1)].tobytes()).hexdigest())
    columns = [pa.array(counts, pa.int64()), *[pa.array(v, pa.int64()) for v in best], pa.array(listed, pa.string()), pa.array(collapsed, pa.string())]
    return pa.RecordBatch.from_arrays([ids, *columns], names=[c.split()[0] for c in RESULT.split(", ")])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    A null or empty text has no words and no runs.  Documents whose id's CRC-32 is a multiple of ten are
    judged with their last words replaced by copies, as the contract says; a null id is never rewritten.
    Repeated rows are judged each; other columns are ignored; an empty table gives no rows.  A text is
    taken whole, one or many at a time, and takes some hundred bytes of memory for each of its words.
    """
    return whole_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judged_runs, RESULT)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLE_SQL: dict = {}
