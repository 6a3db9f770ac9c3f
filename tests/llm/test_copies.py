"""Exact and near copies against brute force, with nulls, empties, repeats and clashing columns."""

import hashlib
import random
import re

import pytest

from tempora.llm import components, exact_dedup, line_dedup, minhash_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, kept int, keep_id string"


def words(n, rng):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [words(rng.choice([3, 4, 5, 60, 120]), rng) for _ in range(12)]
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "a"), (4, "A"), (5, "a b c d"), (6, "A  B\nc D"), (7, "x " * 30000)]
    for k, b in enumerate(base):
        out.append((10 + 20 * k, " ".join(b)))
        for j in range(1, 12):
            copy = list(b)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = words(1, rng)[0]
            out.append((10 + 20 * k + j, (" " if j % 3 else "\n").join(copy).upper() if j % 4 == 0 else " ".join(copy)))
    return [*out, out[20], out[20], (None, "null id"), (None, "null id")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], SCHEMA).repartition(5)


def test_exact(spark, rows):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"] or -1, r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(frame(spark, rows), salts=3).collect())
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    want = []
    for i, t in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[body], key=lambda g: (g[0], g[1], g[2] or 0))[2]
        want.append((i is None, i or 0, keep or -1 if keep != 0 else -1, len(groups[body]), i == keep, hashlib.sha256(body.encode()).hexdigest()))
    assert got == sorted(want)
    assert exact_dedup.exact_dedup(frame(spark, []).limit(0)).count() == 0


def brute_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [i for i in sets if sets[i] and i is not None]
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_copies(spark, rows):
    got = minhash_dedup.near_duplicates(frame(spark, rows)).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert minhash_dedup.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_near_copies_that_meet_in_giant_buckets_only(spark):
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, docs = new(400), []
    for k in range(200):  # two texts of a pair have 0.76 of their shingles in common, others 0.73
        own = new(4)
        docs += [(2 * k + j, " ".join(template[:100] + own + template[104:200] + new(50) + template[250:])) for j in range(2)]
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(frame(spark, docs)).collect()}
    assert got == {k: k - k % 2 for k in range(400)}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["root"] for r in components.contract(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for pair in links if pair[0] != pair[1] for i in pair}


def test_line_dedup(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join(words(rng.randrange(4, 9), rng)).capitalize() + rng.choice([".", ".\n", ",", "."])
    text = lambda n: " ".join(sentence() for _ in range(n))
    passage = text(14).replace("\n", " ")
    docs = [(k, f"{text(9)} host{k} {passage} tail{k} {text(9)}") for k in range(6)]
    clean = [(20 + k, text(20)) for k in range(6)]
    odd = [(40, None), (41, ""), (42, "one line"), (43, "word " * 3000), (None, "no id at all, but text."), docs[5]]
    got = {r["doc_id"]: (r["text"], r["removed_words"]) for r in line_dedup.dedup_lines(frame(spark, docs + clean + odd)).collect()}
    assert len(got) == 6 + 6 + 5
    assert got[0] == (docs[0][1], 0) and all(got[i][0] == t for i, t in clean)
    for k in range(1, 6):
        text_, removed = got[k]
        assert passage not in text_ and removed >= len(passage.split()) - 4
        assert f"host{k}" in text_ and f"tail{k}" in text_
    assert got[40][0] is None and got[41][0] == "" and got[42][0] == "one line"
    assert line_dedup.dedup_lines(frame(spark, []).limit(0)).count() == 0


def sentences(rng, n, sep=" "):
    return sep.join(" ".join(words(rng.randrange(4, 9), rng)).capitalize() + rng.choice([".", ",", "."]) for _ in range(n))


def test_line_dedup_tells_letter_cases_apart(spark):
    """A copy in capitals with the smallest id hides no copies of the other case."""
    rng = random.Random(8)
    passage = sentences(rng, 14)
    docs = [(1, passage.upper() + " " + sentences(rng, 9)), (2, passage + " " + sentences(rng, 9)), (3, sentences(rng, 9) + " " + passage)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert got[1]["removed_words"] == got[2]["removed_words"] == 0
    assert got[3]["removed_words"] >= len(passage.split()) - 2 and "clash" == got[3]["keep_id"]


def test_line_dedup_inside_one_text(spark):
    """Repeats inside one text go but for the first, whole; nothing of the first goes, even where copies touch."""
    rng = random.Random(21)
    passage = sentences(rng, 10)
    docs = [(1, sentences(rng, 7) + " one " + passage + " two " + sentences(rng, 7) + " three " + passage + " four"), (2, passage.replace("a", "u") * 3 + "."), (3, "word " * 2000), (4, "ab cd, " * 300)]
    got = {r["doc_id"]: (r["text"], r["removed_words"]) for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert got[1][0].count(passage) == 1 and len(passage.split()) - 2 <= got[1][1] <= len(passage.split()) + 1
    assert got[1][0].endswith(" four") and " three " in got[1][0]
    once = docs[1][1].split()
    assert got[2][0].split()[: len(once) // 3] == once[: len(once) // 3] and got[2][1] > len(once) // 3
    assert got[4][0].startswith("ab cd, ab cd") and got[3][0].startswith("word word")


def test_line_dedup_of_repeated_ids_and_long_texts(spark):
    rng = random.Random(13)
    passage, long = sentences(rng, 14), sentences(rng, 3000)
    docs = [(1, passage), (1, sentences(rng, 5) + " " + passage), (1, passage), (None, sentences(rng, 3) + " " + passage), (2, long), (3, sentences(rng, 40) + " " + long)]
    rows = line_dedup.dedup_lines(frame(spark, docs)).collect()
    assert len(rows) == 6 and sum(passage in r["text"] for r in rows) == 1  # the null id comes first
    assert next(r for r in rows if r["doc_id"] == 2)["removed_words"] == 0
    assert next(r for r in rows if r["doc_id"] == 3)["removed_words"] >= len(long.split()) - 2


def repeated_runs(texts, n):
    """How many runs of ``n`` words stand in two texts or more: by brute force."""
    seen, where = {}, []
    for d, t in enumerate(texts):
        w = (t or "").split()
        where += [(d, hash(tuple(w[k : k + n]))) for k in range(len(w) - n + 1)]
    for d, h in where:
        seen[h] = d if seen.get(h, d) == d else -1
    return sum(seen[h] == -1 for _, h in where)


def test_line_dedup_against_all_repeated_runs(spark, sf_dir):
    """Of all runs of fifty words that repeat over the table's texts, next to none are left."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    runs = repeated_runs([r["text"] for r in docs.collect()], 50)
    left = repeated_runs([r["text"] for r in line_dedup.dedup_lines(docs).collect()], 50)
    assert runs > 1000 and left <= 0.01 * runs


def test_documents_of_one_template_make_few_pairs(spark, monkeypatch):
    """600 documents that share 0.35 to 0.8 of a template's shingles: the components of all pairs, and few rows of pairs on the way."""
    rng = random.Random(12)
    base = words(150, rng)
    docs = []
    for d in range(600):
        copy, edits = list(base), rng.choice([3, 4, 6, 8, 10, 12, 14])
        for at in rng.sample(range(150), edits):
            copy[at] = f"w{rng.randrange(10**9)}"
        docs.append((d, " ".join(copy)))
    made = []
    kept = minhash_dedup.write_table

    def counted(df, name):
        out = kept(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(minhash_dedup, "write_table", counted)
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 100)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(frame(spark, docs)).collect()}
    root = {i: c for i, (_, c) in brute_components(docs).items()}
    assert got == root
    assert len(set(root.values())) > 50
    assert sum(n for name, n in made if name in ("pairs", "links")) < 25 * len(docs)  # of 299 a document in all
    assert any(name == "apart-blocks" for name, _ in made)
