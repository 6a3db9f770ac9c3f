"""Chat formatting, packing, PII, toxicity, URLs, decontamination and licences on small tables."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempora import llm
from tempora.llm import chat_format, decontaminate, kernels, license_scan, packing, pii, toxicity, url_filter
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(llm.registered("ORACLE_SQL")))
def test_sql(name, spark, duck, sf_dir):
    same(llm.registered("QUERIES")[name](spark, sf_dir), duck, llm.registered("ORACLE_SQL")[name])


def test_words_and_ngrams():
    texts = ["One two\tthree four  five six", "", None, "\x0bONE TWO three four five", "élan é"]
    rows = {}
    for lo, hi, data, bounds in kernels.text_slices(pa.array(texts), 8):
        words = kernels.words_of(data, bounds)
        first = words.first()
        for d in range(hi - lo):
            rows[lo + d] = [bytes(data[words.start[i] : words.end[i]]).decode() for i in range(first[d], first[d + 1])]
    assert rows == {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in enumerate(texts)}
    (_, _, data, bounds), = kernels.text_slices(pa.array(["a b a b a a b", "b a b a a"]))
    grams, at = kernels.ngrams(kernels.words_of(data, bounds), 4)
    assert len(at) == 6 and len(set(grams.tolist())) == 4


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [None, "", " ", "It's <|endoftext|> x", "ΣΑΣ İ ﬁ é"] + [" ".join(rng.choice(["lorem", "Ipsum,", "dólar.", "3rd", "sit"]) for _ in range(rng.choice([5, 80, 900, 3000]))) for _ in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(7, texts[7])], "doc_id long, text string")
    got = packing.pack(docs).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for k, t in [*enumerate(texts), (7, texts[7])]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(k, p, s, len(x := ids[s : s + 2048]), zlib.crc32(np.array(x, "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_evolved_packing_beats_or_equals_best_fit():
    rng = random.Random(4)
    lengths = [rng.randrange(500, 1100) for _ in range(300)]
    plain = packing.Packing(lengths, [], 2048).best_fit(sorted(range(300), key=lambda i: -lengths[i]))
    bins, crossed = packing.evolve(lengths, 2048, 1, [], generations=40)
    fill = np.bincount(bins, lengths)
    assert max(fill) <= 2048 and len(fill) <= len(plain.bins) and len(bins) == 300 and crossed > 10


def test_evolution_improves_packings_that_begin_weak():
    rng = random.Random(7)
    lengths = [min(2047, int(rng.lognormvariate(6, 1))) + 1 for _ in range(3000)]
    bound = -(-sum(lengths) // 2048)
    first, _ = packing.evolve(lengths, 2048, 1, [], generations=0)
    last, crossed = packing.evolve(lengths, 2048, 1, [], generations=30)
    assert max(first) + 1 > bound + 3 and max(last) + 1 <= bound + 1 and crossed >= 5


def test_islands_cross_and_exchange_their_elite(spark):
    rng = random.Random(5)
    pieces = spark.createDataFrame([(k, min(2047, int(rng.lognormvariate(6, 1))) + 1) for k in range(3000)], "item long, length int").filter("length < 2048")
    rows = packing.evolved(pieces, 2, 2048).collect()
    assert len(rows) == 2 * packing.ISLANDS and all(r["crossovers"] > 0 and r["migrants"] == packing.EPOCHS - 1 for r in rows)
    placed = packing.place(pieces.withColumn("length", F.col("length").cast("long")), shard_pieces=400).join(pieces, "item").collect()
    assert len(placed) == pieces.count()
    total, sequences = sum(r["length"] for r in placed), {r["sequence_id"] for r in placed}
    assert len(sequences) <= -(-total // 2048) * 1.01 + 1
    for s in sequences:
        at = 0
        for offset, length in sorted((r["offset"], r["length"]) for r in placed if r["sequence_id"] == s):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_of_null_ids_and_other_columns(spark):
    docs = spark.createDataFrame([(None, "a b", 5, 6), (None, "c", 7, 8)], "doc_id long, text string, piece int, item int")
    assert sorted((r["doc_id"], r["piece"], r["start"]) for r in packing.pack(docs).collect()) == [(None, 0, 0), (None, 0, 0)]


def test_surrogates(spark):
    texts = ["Mail Ann.Lee7@site.example or +1 (212) 555-0100, 4111 1111 1111 1111.", "ann.lee7@site.example ANN.LEE7@SITE.EXAMPLE 10.1.2.3", "Frau Anna Schmidt met Mr. Schmidt; Госпожа Анна", 'token = "0123456789abcdef0123456789abcdef01234567"', "nothing here", None, "", "12125550100"]
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)] + [(None, "call +1 (212) 555-0100", 5)], "doc_id long, text string, n_entities int")
    rows = {r["doc_id"]: r for r in pii.replace_entities(docs).collect()}
    out = {k: r["text"] for k, r in rows.items()}
    assert out[4] == "nothing here" and out[5] is None and out[6] == "" and rows[4]["n_entities"] == 0
    mail = re.search(r"\S+@\S+", out[0]).group()
    assert re.fullmatch(r"[A-Za-z]{3}\.[A-Za-z]{3}\d@[a-z]{4}\.example", mail) and "ee7@site" not in out[0]
    assert out[1].split()[0] == mail.lower() and out[1].split()[1] == mail.upper()
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[0]).group()
    assert phone != "+1 (212) 555-0100" and phone in out[None]
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", out[0]).group()
    assert pii.luhn_valid(card.replace(" ", "")) and card != "4111 1111 1111 1111"
    assert "Schmidt" not in out[2] and re.search(r"[А-Я][а-я]+$", out[2]) and "Анна" not in out[2]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[3]) and out[3] != texts[3]


def test_cheap_test_sees_what_the_pattern_sees(spark):
    digits = [chr(c) for c in range(0x110000) if re.match(r"\d", chr(c))]
    texts = [f"{d * 9}" for d in digits] + ['api_key = "CorrectHorseBattery"', 'db_password = "hunterhunter"', "+٩٦٦ ٥٥ ١٢٣ ٤٥٦٧", "²sk-abcdefghijklm", "-AKIAABCDEFGHIJKL", "ghp_abcdefghijklm", "a@b.cc", "Mrs. Holt", "x\nHerr Holt", "(Госпожа Белова)", "192.0.2.1", "123-45-6789", "GB82 WEST 1234 5698 7654 32", "(030) 1234 5678"]
    seen = {r["t"] for r in spark.createDataFrame([(t,) for t in texts], "t string").filter(F.col("t").rlike(pii.SUSPECT)).collect()}
    assert [t for t in texts if list(pii.mentions(t)) and t not in seen] == []
    assert {'api_key = "CorrectHorseBattery"', 'db_password = "hunterhunter"', "+٩٦٦ ٥٥ ١٢٣ ٤٥٦٧"} <= seen


def test_bare_names_are_found_wherever_they_stand():
    text = "Holt wrote a@b.cc. Mr Adam Holt met Dr Fox. HOLT's friend Adam, Holton and holt left; Fox@holt.com too."
    got = [(text[a:b], kind) for a, b, kind, _ in pii.mentions(text)]
    assert got == [("Holt", "surname"), ("a@b.cc", "email"), ("Adam", "given_m"), ("Holt", "surname"), ("Fox", "surname"), ("HOLT", "surname"), ("Adam", "given_m"), ("Fox@holt.com", "email")]


def test_surrogates_end_and_stay_apart(spark):
    """Values without letters or digits, and forms with fewer surrogates than entities: all end, all differ, none is real."""
    odd = [f'password = "{c * 8}"' for c in "*-._~"] + ["_@_._ wrote"]
    short = [f"{a}{b}@{c}.co" for a in "abcdefghijklm" for b in ("", *"nopqrst") for c in "abcdefghijklmnopqrst"][:2000] + [f"{a}@{b}.co" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    texts = odd + short
    out = pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    got = [r["text"] for r in out]
    assert all(r["n_entities"] == 1 for r in out) and not set(got) & set(texts) and len(set(got)) == len(set(texts))


def test_surrogates_keep_script_gender_and_coreference(spark):
    texts = ["Mr. John Smith came. John Smith left; Smith's dog stayed.", "MRS. ANNA SCHMIDT", "Κυρία Παππά", "Dr 王伟", "Mrs Anna Jones and Smith", "fe80:0:0:0:1a2b:3c4d:5e6f:1", "", None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.replace_entities(docs).collect()}
    first, last = re.match(r"Mr\. (\w+) (\w+) came", got[0]).groups()
    assert got[0] == f"Mr. {first} {last} came. {first} {last} left; {last}'s dog stayed." and "Smith" not in got[0]
    stems, endings, *_ = pii.NAMES["latin"]
    assert any(first.lower() == s + e for s in stems for e in endings["m"])
    assert got[1].isupper() and "ANNA" not in got[1] and any(got[1].split()[1].lower() == s + e for s in stems for e in endings["f"])
    assert got[1].split()[1].lower() == got[4].split()[1].lower()  # one Anna everywhere
    assert pii.script_of(got[2].split()[1]) == "greek" and pii.script_of(got[3].split()[1]) == "han"
    assert re.fullmatch(r"[0-9a-f]{4}(:[0-9a-f]){3}(:[0-9a-f]{4}){3}:[0-9a-f]", got[5]) and got[5] != texts[5] and got[6] == "" and got[7] is None
    other = {r["doc_id"]: r["text"] for r in pii.replace_entities(docs, b"another key").collect()}
    assert other[0] != got[0]


def test_surrogates_by_brute_force(spark, sf_dir):
    """Over a whole table: one surrogate for each entity, wherever and however it is written, and no two alike."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    chosen: dict[tuple[str, str], set] = {}
    for r in pii.replace_entities(docs).collect():
        parts, at, new = [], 0, r["text"]
        for start, stop, kind, value in pii.mentions(rows[r["doc_id"]] or ""):
            parts.append((rows[r["doc_id"]][at:start], kind, value))
            at = stop
        place = 0
        for k, (between, kind, value) in enumerate(parts):
            assert new.startswith(between, place)
            place += len(between)
            after = parts[k + 1][0] if k + 1 < len(parts) else rows[r["doc_id"]][at:]
            stop = new.index(after, place) if after else (len(new) if k + 1 == len(parts) else place)
            if after.strip():  # what lies between two mentions tells where the surrogate ends
                chosen.setdefault((kind, value), set()).add(pii.canonical(kind, new[place:stop]).lower())
            place = stop
    assert len(chosen) > 20 and all(len(c) == 1 for c in chosen.values())
    assert len({(k[0], *c) for k, c in chosen.items()}) == len(chosen)
    assert not {(k[0], *c) for k, c in chosen.items()} & {(k, v.lower()) for k, v in chosen}


def test_surrogates_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "x " * 60000 + "ann@site.example", 9), (1, "x " * 60000 + "ann@site.example", 9), (1, "bob@site.example", 9)], "doc_id long, text string, n_entities int")
    rows = pii.replace_entities(docs).collect()
    assert sorted(r["n_entities"] for r in rows) == [1, 1, 1] and len({r["text"] for r in rows}) == 2 and not any("ann@" in r["text"] for r in rows)
    assert pii.replace_entities(docs.limit(0)).count() == 0


def test_no_two_entities_share_a_surrogate(spark):
    entities = spark.createDataFrame([("surname", f"name{k}") for k in range(700)] + [("ip", "1.2.3.4")], "kind string, value string")
    rows = pii.choose_surrogates(entities).collect()
    assert len({(r["kind"], r["chosen"]) for r in rows}) == 701 and not {r["chosen"] for r in rows} & {r["value"] for r in rows}


def test_toxicity_on_held_out_labels(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.1")  # with 97 toxic texts held out; smaller ones have a handful
    rows = toxicity.op6_toxicity(spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good = [r["score"] for r in rows if r["toxic"] == 1]
    clean = [r["score"] for r in rows if r["toxic"] == 0]
    auc = np.mean([(g > c) + 0.5 * (g == c) for g in good for c in clean])
    assert auc > 0.9 and np.mean([c >= 0.5 for c in clean]) < 0.05
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (None, "x"), (4, "word " * 50000)], "doc_id long, text string")
    scored = toxicity.score_toxicity(odd, toxicity.SubwordSoftmax()).collect()
    assert all(0 <= r["score"] <= 1 for r in scored) and len({r["score"] for r in scored if not (r["text"] or "").strip()}) == 1
    clash = spark.createDataFrame([(1, "same text", 5.0, "x"), (1, "same text", 6.0, "y")], "doc_id long, text string, score double, predicted string")
    again = toxicity.score_toxicity(clash, toxicity.SubwordSoftmax()).collect()
    assert len(again) == 2 and again[0]["score"] == again[1]["score"] <= 1 and again[0]["predicted"] in (0, 1)
    assert toxicity.score_toxicity(clash.limit(0), toxicity.SubwordSoftmax()).count() == 0


def test_a_text_is_scored_by_all_its_words():
    """The slices' sums against the textbook, word by word; a text that turns bad late counts."""
    buckets = np.random.default_rng(0).normal(size=toxicity.BUCKETS)
    texts = ["One two two", "", "a " * 900 + "Vile", "élan vital"]
    want = []
    for text in texts:
        total = 0.0
        for word in text.split():
            data = np.frombuffer((" " + word + " ").encode(), np.uint8)
            _, bucket = toxicity.word_grams(data, np.array([1]))
            total += buckets[bucket].mean()
        want.append(total / (len(text.split()) + toxicity.NEUTRAL_WORDS) + 0.5)
    assert np.allclose(toxicity.text_logits(pa.array(texts), buckets, 0.5), want)
    (_, _, data, bounds), = kernels.text_slices(pa.array(texts))
    bags = list(toxicity.text_bags(data, bounds))
    assert np.allclose([(buckets[ids] * share).sum() + 0.5 for ids, share, _ in bags], want, atol=1e-3) and [b[2] for b in bags] == [3, 0, 901, 2]


def test_urls(spark):
    pages = [(1, "HTTP://A.Org/x?q"), (2, "http://example.org/en/15"), (3, "http://x.example.org/es/"), (4, "https://b.net/l/#t"), (5, "https://www.b.net/l"), (6, "nothing"), (7, None), (8, "http://evil.com"), (8, "http://evil.com/de/a")]
    rows = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([("b.net/l",), (None,), ("b.net/l",)], "url string"), url_filter.RULES)
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows.collect())
    assert got[0] == (1, "a.org", "/x", "org/", "allow") and got[1][3:] == ("example.org/en/1", "block") and got[2][3:] == ("example.org/es/", "block")
    assert [g[4] for g in got[3:7]] == ["block", "block", "allow", "allow"] and got[6][1:3] == ("", "")
    assert got[7] == (8, "evil.com", "", None, "allow") and got[8][3] == "com/de/"
    none = spark.createDataFrame([], "url string")
    assert url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), none, []).filter("verdict = 'block'").count() == 0


def slow_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_alignment_equals_the_textbook():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = (rng.integers(0, 5, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        assert decontaminate.align(a, b)[0] == slow_alignment(a.tolist(), b.tolist())


def test_leaks(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(k, text(30)) for k in range(5)] + [(90, None), (91, "too short")]
    edited = items[1][1].split()
    for k in (5, 12, 20):
        edited[k] = "changed"
    docs = [(0, text(200) + " " + items[0][1] + " " + text(100)), (1, text(50) + " " + " ".join(edited).upper()), (2, text(400)), (3, None), (4, ""), (5, items[2][1]), (5, items[2][1]), (None, items[3][1])]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(0, 0), (1, 1), (5, 2), (None, 3)} and len(got) == 4
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contaminated(tables[0], tables[1].limit(0)).count() == 0
    assert {r["doc_id"]: r["score"] for r in got}[0] == 1.0
    assert decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_leaks_of_repeated_item_ids_short_items_and_long_texts(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    one, two = text(20), text(25)
    items = [(7, one, "x"), (7, two, "y"), (8, "zebra", "z"), (9, "Blue, whale", "z"), (10, "", "z"), (None, text(9), "z")]
    docs = [(1, f"{text(30)} {one}", "a"), (2, two, "b"), (3, "a blue whale, a zebra", "c"), (4, f"{text(40000)} {two} {text(20000)}", "d"), (5, "blue", "e")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, score string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 7), (2, 7), (4, 7), (3, 8), (3, 9)}
    assert all(r["score"] == 1.0 for r in got) and next(r["end_word"] for r in got if r["doc_id"] == 4) == 40025


def test_leaks_against_all_alignments(spark):
    """Copies with every fourth word changed, and with a tenth to a third of all words changed, left out or put in: all pairs aligned by brute force."""
    rng = random.Random(6)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 3000}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(14, 60)))) for k in range(40)]
    docs = []
    for k in range(400):
        w = items[k % 40][1].split()
        if k < 40:
            w = [word() if i % 4 == 3 else x for i, x in enumerate(w)]
        else:
            share = rng.uniform(0.1, 0.34)
            w = [y for x in w for y in ([x] if rng.random() > share else rng.choice([[word()], [], [x, word()]]))]
        docs.append((k, " ".join([*(word() for _ in range(rng.randrange(60))), *w, *(word() for _ in range(rng.randrange(60)))])))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    hashed = [{k: decontaminate._one(t) for k, t in rows} for rows in (docs, items)]
    want = {(d, i): s for d, x in hashed[0].items() for i, y in hashed[1].items() if (s := decontaminate.align(y, x)[0] / (2 * len(y))) >= 0.5}
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(want) > 300 and len(got) >= 0.98 * len(want) and {(k, k) for k in range(40)} <= set(got)


def found_licences(spark, docs):
    rows = license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string, license string"))
    return {(r["doc_id"], r["license"], r["scope"]): r["matches"] for r in rows.collect()}


def test_licences(spark):
    whole = "Copyright (c) 2020 Somebody\n\n" + license_scan._MIT.upper().replace("SUBLICENSE", "SUBLICENCE")
    docs = [(1, whole), (2, "Some text\n  ** RELEASED under the MIT licence **\nmore"), (3, "Released under"), (4, None), (5, ""), (None, "Licensed under CC BY-NC 4.0."), (6, "SPDX-License-Identifier: GPL-2.0-or-later\n" * 2), (6, "SPDX-License-Identifier: GPL-2.0+")]
    got = found_licences(spark, [(*d, "clash") for d in docs])
    assert {k for k in got if k[0] != 6} == {(1, "MIT", "text"), (1, "MIT", "block"), (2, "MIT", "line"), (None, "CC-BY-NC-4.0", "text"), (None, "CC-BY-NC-4.0", "line")}
    assert got[6, "GPL-2.0", "line"] == 3 and found_licences(spark, []) == {}


def test_licences_inside_files(spark):
    isc = next(t for name, t in license_scan.KNOWN if name == "ISC")
    paragraphs = license_scan._MIT.split("\n")
    wrapped = "\n".join(" * " + " ".join(p.split()[k : k + 9]) for p in paragraphs for k in range(0, len(p.split()), 9))
    spread = "\n#\n".join("# " + "\n# ".join(" ".join(p.split()[k : k + 9]) for k in range(0, len(p.split()), 9)) for p in paragraphs)
    docs = [(1, f"int a;\n\n/*\n{wrapped}\n */\n\nint b;"), (2, f"x = 1\n\n# Copyright 2020\n\n{spread}\n\ny = 2"), (3, "x = 1\n\n" + "\n\n".join(paragraphs[:2])), (4, "z\n\n" * 30000 + isc), (5, isc)]
    got = found_licences(spark, [(*d, None) for d in docs])
    assert got == {(1, "MIT", "block"): 1, (2, "MIT", "block"): 1, (4, "ISC", "block"): 1, (5, "ISC", "text"): 1, (5, "ISC", "block"): 1}


def test_full_licence_texts(spark):
    """The table's digests are those of the texts themselves, where a system has them."""
    import os

    folder, names = "/usr/share/common-licenses", {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    names = {f: n for f, n in names.items() if os.path.exists(f"{folder}/{f}")}
    if not names:
        pytest.skip("no licence texts on this system")
    docs = [(k, open(f"{folder}/{f}", encoding="utf-8").read().upper(), None) for k, f in enumerate(names)]
    assert {k[:2] for k in found_licences(spark, docs) if k[2] == "text"} == set(enumerate(names.values()))


def test_chats(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    lines = chat_format.placed_lines(turns)
    model = chat_format.train(lines)
    states = chat_format.label_lines(lines, model)
    joined = lines.join(states, ["conv_id", "place"])
    right = joined.agg(F.avg((chat_format._state(F.col("role"), F.col("line") == 0) == F.col("state")).cast("int"))).first()[0]
    assert right > 0.8
    small = chat_format.label_lines(lines.withColumn("block", F.shiftright("place", 1)), model)
    assert small.exceptAll(states).count() == 0
    marked = spark.createDataFrame([(-5, 0, None, "System: be kind\nUser: hello there\nhow are you?\nAssistant: fine\nthanks"), (-5, None, None, None), (None, 1, "user", "")], "conv_id long, turn long, role string, text string")
    got = chat_format.parsed_turns(chat_format.placed_lines(marked.filter("turn = 0 AND conv_id IS NOT NULL")), model).orderBy("first_line").collect()
    assert [(r["role"], r["n_lines"]) for r in got] == [("system", 1), ("user", 2), ("assistant", 2)]
    assert got[1]["rendered"] == "<|user|>\nhello there\nhow are you?\n<|end|>"
    assert chat_format.format_chats(turns.unionByName(marked.select(*turns.columns))).count() > 0


def random_model(rng):
    counts = lambda *shape: rng.integers(0, 30, shape).astype(float)
    s = chat_format.STATES
    return chat_format.TurnModel(counts(s), counts(s, s), counts(s, 4), counts(s, chat_format.LENGTHS), counts(s, 5), counts(s, 2))


def test_viterbi_against_all_state_paths(spark):
    """Whatever the blocks, a conversation gets the best of all its state paths, tried one by one."""
    from itertools import product

    rng = np.random.default_rng(3)
    model, rows, place = random_model(rng), [], 0
    for conv, n in enumerate([1, 2, 5, 6, 1, 4, 6, 3]):
        for _ in range(n):
            rows.append((conv, place, int(rng.integers(4)), int(rng.integers(chat_format.LENGTHS)), int(rng.integers(5)), int(rng.integers(2))))
            place += 1
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=["conv_id", "place", "mark", "size", "ending", "head"])
    seen = model.emissions(pdf)

    def score(at, path):
        return model.start[path[0]] + sum(seen[i, s] for i, s in zip(at, path)) + sum(model.move[a, b] for a, b in zip(path, path[1:]))

    lines = spark.createDataFrame(pdf)
    for bits, fan in ((0, 12), (1, 1), (2, 12), (12, 12)):
        got = {r["place"]: r["state"] for r in chat_format.label_lines(lines.withColumn("block", F.shiftright("place", bits)), model, fan).collect()}
        for conv, part in pdf.groupby("conv_id"):
            at = part["place"].tolist()
            best = max(score(at, p) for p in product(range(chat_format.STATES), repeat=len(at)))
            assert abs(score(at, [got[i] for i in at]) - best) < 1e-9


def test_chats_on_held_out_conversations(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/conversations.parquet")
    lines = chat_format.placed_lines(turns)
    held = F.crc32(F.col("conv_id").cast("string")) % 5 == 0
    model = chat_format.train(lines.filter(~held))
    joined = lines.filter(held & F.col("role").isin(*chat_format.ROLES)).join(chat_format.label_lines(lines, model), ["conv_id", "place"])
    assert joined.agg(F.avg((F.floor(F.col("state") / 2) == F.floor(chat_format._state(F.col("role"), F.lit(True)) / 2)).cast("int"))).first()[0] > 0.85


def test_chats_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, place string, state string"
    long = "\n".join(f"line {k}" for k in range(5000))
    turns = spark.createDataFrame([(1, 0, "user", "User: hi", "x", "y"), (1, 0, "user", "User: hi", "x", "y"), (2, 0, "user", "User: " + long, "x", "y"), (None, None, None, None, None, None)], schema)
    rows = chat_format.format_chats(turns).collect()
    assert sum(r["n_lines"] for r in rows) == 5003 and all(r["n_lines"] <= 1 << chat_format.BLOCK_BITS for r in rows)
    whole = "\n".join(r["rendered"] for r in sorted((r for r in rows if r["conv_id"] == 2), key=lambda r: r["first_line"]))
    assert whole.replace("<|end|>\n", "").count("\nline ") >= 4998 and whole.startswith("<|") and whole.endswith("<|end|>")
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name


def test_long_texts_keep_their_small_shares():
    """A word that stands once in three million still has its share, to a thousandth of it."""
    data = np.frombuffer(b"common words " * 1_500_000 + b"zyzzyva", np.uint8)
    (ids, shares, words), = toxicity.text_bags(data, np.array([0, len(data)]))
    (rare, _, _), = toxicity.text_bags(data[-7:], np.array([0, 7]))
    got = dict(zip(ids.tolist(), np.sqrt(shares).astype(np.float16).astype(float) ** 2))  # as tasks send them
    assert words == 3_000_001 and len(rare) > 5
    assert all(abs(got[k] * len(rare) * (words + toxicity.NEUTRAL_WORDS) - 1) < 2e-3 for k in rare.tolist())


def test_training_sample_is_bounded_by_entries(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(50))) for k in range(60)] + [(7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    whole = toxicity.training_bags(docs, labels)
    each = max(len(b[0]) for b, _ in whole)
    few = toxicity.training_bags(docs, labels, entries=10 * each)
    assert len(whole) == sum(zlib.crc32(str(k).encode()) % 5 > 0 for k in range(60))
    assert all(5 <= sum(y == k for _, y in few) < 10 for k in (0, 1)) and len(toxicity.training_bags(docs, labels, entries=1)) == 2


def test_packing_needs_no_more_than_plain_best_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = packing.pack(docs).select("length", "sequence_id").toPandas()
    loose = rows.length[rows.length < packing.CAPACITY].tolist()
    plain = max(packing.largest_first(loose, packing.CAPACITY)) + 1 + int((rows.length == packing.CAPACITY).sum())
    assert rows.sequence_id.nunique() <= plain


def test_one_number_has_one_surrogate_however_it_is_written(spark):
    texts = ["call +1 (212) 555-0100 or 12125550100 now", "Write to Ann.Lee@Site.example, ann.lee@site.example", "ssn 123-45-6789 and 123-45-6789"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.replace_entities(docs).collect()}
    digits = lambda t: re.sub(r"\D", "", t)
    one, two = re.search(r"call (.*) or (\S+) now", out[0]).groups()
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", one) and digits(one) == two != "12125550100"
    mails = re.findall(r"[\w.]+@[\w.]+\w", out[1])
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}@[A-Z][a-z]{3}\.example", mails[0]) and mails[1] == mails[0].lower() and "Lee" not in out[1]
    first, again = re.findall(r"\d{3}-\d{2}-\d{4}", out[2])
    assert first == again != "123-45-6789"
