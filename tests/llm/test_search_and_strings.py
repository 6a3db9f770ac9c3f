"""Ranked search, periodic runs and repeated strings against brute force, with nulls, empties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tempora.llm import ball_search, periodic_runs, suffix_dedup

SCHEMA = "doc_id long, text string, score int, rank string, n_runs string, n_bytes int, lo string, d string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "c", "c", 1, "c", "c") for i, t in rows], SCHEMA).repartition(4)


def prose(rng, n, vocabulary=300):
    return " ".join(rng.choice(["Ärger", "Zug", "alpha", "beta", "x1", "日本"]) + str(rng.randrange(vocabulary)) + rng.choice(["", "", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([1, 8, 40, 200])) for _ in range(60)]
    passage = prose(rng, 30)
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "a"), (4, "ab " * 4000), (5, "x" * 5000), (6, "long " + prose(rng, 60000, 5000))]
    out += [(10 + k, b) for k, b in enumerate(base)]
    out += [(100 + k, base[k % 7]) for k in range(20)]
    out += [(200 + k, prose(rng, 10) + " " + passage + " " + prose(rng, 12)) for k in range(40)]
    out += [(300 + k, base[3][: 40 * k] + "!" + base[3][40 * k :]) for k in range(10)]
    out += [(400, base[5] + "|" + base[5]), (401, "q r s " * 40 + "q r t " * 9 + "q r s")]
    return [*out, out[20], out[20], (None, "null " + base[3]), (None, "null id")]


def ranked(docs, items, k=50):
    terms = {}
    stats = []
    for i, t in docs:
        found = TERM.findall((t or "").translate(LOW))
        counts = {}
        for w in found:
            counts[w] = counts.get(w, 0) + 1
        stats.append((i, len(found), counts))
        for w in counts:
            terms[w] = terms.get(w, 0) + 1
    many, total = sum(n > 0 for _, n, _ in stats), sum(n for _, n, _ in stats)
    out = []
    for item, text in sorted(set(items), key=str):
        asked = set(TERM.findall((text or "").translate(LOW)))
        scores = []
        for i, n, counts in stats:
            m = 100 - 50 + (50 * n * many) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * terms[w] + 1))) * ((10**9 * counts[w]) // (1000 * counts[w] + 20 * m)) for w in asked if w in counts)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if gone else i, -s) for r, (s, gone, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_search(spark, rows, monkeypatch):
    monkeypatch.setattr(ball_search, "BLOCK_QUERIES", 3)
    rng = random.Random(8)
    items = [(k, prose(rng, 12)) for k in range(6)] + [(7, rows[30][1]), (8, None), (9, "..."), (10, "nowhere found"), (7, rows[30][1]), (11, "ALPHA1 alpha1 AB")]
    queries = spark.createDataFrame([(i, t, "c", 3) for i, t in items], "item_id long, text string, doc_id string, item int")
    for k in (50, 3):
        got = sorted((tuple(r) for r in ball_search.ball_search(frame(spark, rows), queries, k).collect()), key=str)
        assert got == ranked(rows, items, k)
    assert ball_search.ball_search(frame(spark, []), queries).count() == 0
    assert ball_search.ball_search(frame(spark, rows), queries.limit(0)).count() == 0


def test_search_leaves_balls_out():
    rng = np.random.default_rng(2)
    topics, docs, terms = 40, 4000, 2000
    term = np.concatenate([rng.choice(50, 12, replace=False) + 50 * (d % topics) for d in range(docs)])
    value = rng.integers(1, 10**6, len(term))
    tree = ball_search.Tree(ball_search.Vectors(np.arange(docs + 1) * 12, term, value), np.full(terms, 900))
    asked, best, query = np.zeros(terms, bool), [], np.arange(100, 130)
    scored = tree.search(query, asked, best, 10, np.arange(docs))
    every = np.bincount(np.repeat(np.arange(docs), 12), np.where((term >= 100) & (term < 130), value, 0))
    assert sorted(-e[0] for e in best) == sorted(-every)[:10]
    assert scored < docs / 2


def brute_runs(x):
    out = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            n = j + q - i
            if n >= max(6, 4 * q) and not any(all(x[i + t] == x[i + t + r] for t in range(n - r)) for r in range(1, q)):
                out.append((i, n, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_and_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(800):
        letters = rng.choice([1, 2, 3])
        x = [rng.randrange(1, letters + 1) for _ in range(rng.randrange(1, 50))]
        if rng.random() < 0.5:
            x = (x[:5] + [rng.randrange(1, letters + 1) for _ in range(rng.randrange(1, 6))] * 10)[:50] + x[:3]
        ids = np.array([0, *x, 0])
        longest = [next((j for j in range(i + 1, len(x)) if x[i:] >= x[j:]), len(x)) - i for i in range(len(x))]
        assert periodic_runs.lyndon_array(ids)[1:-1].tolist() == longest
        got = np.stack(periodic_runs.runs_of(ids), 1)
        assert [(s - 1, n, q) for s, n, q in got.tolist()] == brute_runs(x)


def test_periodic_runs(spark, rows):
    small = [r for r in rows if len(r[1] or "") < 3000] + [(401, "q r s " * 40)] + [(k, prose(random.Random(k), 60)) for k in range(500, 560)]
    want = []
    for i, t in small:
        words = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (j - a) % p] if j >= a else words[j] for j in range(n)]
        runs = brute_runs(words)
        gone = {w for s, m, q in runs for w in range(s + q, s + m)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        want.append((i, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    got = [tuple(r) for r in periodic_runs.periodic_runs(frame(spark, small)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 5
    assert periodic_runs.periodic_runs(frame(spark, [])).count() == 0


def test_repeated_strings(spark, rows):
    first, span = {}, 100
    texts = [(-(2**63) if i is None else i, i, (t or "").encode()) for i, t in rows]
    for d, _, body in sorted(texts, key=lambda r: r[0]):
        for j in range(len(body) - span + 1):
            w = body[j : j + span]
            first[w] = min(first.get(w, (d, j)), (d, j))
    want = []
    for d, i, body in texts:
        gone = np.zeros(len(body) + 1, bool)
        for j in range(len(body) - span + 1):
            if first[body[j : j + span]] < (d, j):
                gone[j : j + span] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0)) if len(body) else 0
        kept = bytes(b for b, g in zip(body, gone) if not g)
        want.append((i, len(body), int(gone.sum()), spans, sha(kept)))
    got = [tuple(r) for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0


def test_long_texts_are_taken_in_pieces(spark, rows, monkeypatch):
    whole = sorted(map(tuple, suffix_dedup.suffix_dedup(frame(spark, rows)).collect()), key=str)
    body = np.frombuffer(b"abcdefghij" * 90 + rows[6][1].encode()[:5000], np.uint8)
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([0]), pa.array([body.tobytes()], pa.binary())], names=["d", "x", "lo", "body"])
    seen = []
    for found, begin, data, bounds in suffix_dedup._pieces(batch, 100):
        piece, first, many, _, _ = suffix_dedup.contexts(data, bounds, 24, 100)
        seen += [int(begin[p] + f - bounds[p] + k) for p, f, n in zip(piece, first, many) for k in range(n)]
    assert seen == list(range(len(body) - 99))
    assert len(whole) == len(rows)
