"""PII: keyed, type-consistent surrogates for detected entities.

Entities are e-mail addresses, telephone numbers, IP addresses, card, account and social security
numbers, secrets, names after a title, and the same names anywhere else in the text.  A surrogate comes from a keyed hash of the entity's
type and canonical value, so that an entity gets the same one wherever and however it is written.
It keeps length, layout, letter case and script, a card number's check digit, and a name's gender.
All surrogates of the corpus are checked: none may be shared by two entities or equal to a real one;
those that are get another, until none is left.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, table, whole_batches, write_table

#: Used where neither an argument nor the session's ``tempora.pii.key`` gives a key: results then are only as secret as this file.
KEY = b"a key for tests; production passes its own"
#: From this attempt on a surrogate may leave its length and layout, so that there are always more surrogates than entities.
CROWDED = 4
BROADCAST_KEYS = 1_000_000
_NO_ID = -(2**63)

# Titles that precede a name, by gender, and the syllables that surrogate names are made of, by script.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Doña", "Госпожа", "Κυρία"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"], "x": ["Dr", "Prof"]}
#: Of a script: given-name stems, their endings by gender, and the two halves of surnames.
NAMES = {
    "latin": (["adal", "bern", "cor", "dani", "emil", "flor", "gabri", "hel", "isid", "jul", "klar", "leon", "marc", "nor", "oliv", "paul", "rob", "silv", "tob", "valer"], {"f": ["a", "ina", "ia", "ette", "ene"], "m": ["o", "us", "in", "ert", "ias"], "x": ["i", "e", "ey", "is", "en"]}, ["al", "bar", "cor", "dor", "el", "fer", "gal", "hol", "kar", "lin", "mar", "nor", "pel", "ros", "sal", "tor", "ul", "ven", "wal", "zel"], ["berg", "den", "field", "ford", "hart", "land", "ley", "man", "mer", "ner", "rick", "sen", "son", "stein", "ton", "veld", "well", "wood"]),
    "cyrillic": (["ад", "бор", "вал", "ген", "ев", "зин", "ир", "лад", "мар", "ник", "ол", "рост", "свет", "юл"], {"f": ["а", "ина", "ия"], "m": ["ей", "ий", "ислав"], "x": ["я", "и"]}, ["бел", "вол", "гор", "дуб", "зор", "кар", "лес", "мар", "нев", "пет", "сид", "тих"], ["ин", "ов", "ский", "енко", "ев", "ак"]),
    "greek": (["αλεξ", "βασιλ", "γεωργ", "δημ", "ελεν", "θεοδ", "κωστ", "μαρ", "νικ", "στελ"], {"f": ["α", "ία", "ούλα"], "m": ["ος", "ης", "άκης"], "x": ["ι", "ις"]}, ["αθαν", "βλαχ", "γαβρ", "δραγ", "καλ", "λαμπρ", "μακρ", "παππ", "σταυρ", "φωτ"], ["όπουλος", "άκης", "ίδης", "άτος", "άς"]),
    "hebrew": (["אב", "דנ", "יעק", "מיכ", "נע", "רונ", "של"], {"f": ["ה", "ית"], "m": ["ל", "ון"], "x": ["י", "ם"]}, ["אלמ", "ברק", "גול", "כהנ", "לב", "מזר"], ["ן", "ני", "ובי", "מן"]),
    "arabic": (["أم", "جم", "حس", "سم", "كر", "ناد"], {"f": ["ية", "اء"], "m": ["ال", "ير"], "x": ["ان", "ين"]}, ["الحد", "الراش", "السال", "الكر", "المنص"], ["اد", "دي", "مي", "يم", "ور"]),
    "han": (["嘉", "文", "明", "雨", "志", "思", "子", "佳"], {"f": ["娜", "芳", "婷"], "m": ["伟", "强", "军"], "x": ["宁", "安", "平"]}, ["陈", "林", "黄", "吴", "周", "徐", "孙", "郭"], ["", "远", "恒"]),
    "hangul": (["민", "서", "지", "현", "수", "은"], {"f": ["희", "아", "영"], "m": ["호", "석", "철"], "x": ["우", "원", "진"]}, ["강", "노", "문", "배", "송", "윤"], ["", "림", "한"]),
    "kana": (["あき", "かず", "さち", "とも", "なお", "ひろ"], {"f": ["こ", "み", "え"], "m": ["お", "し", "ろう"], "x": ["る", "き"]}, ["いし", "おか", "きた", "しま", "なか", "もり"], ["だ", "やま", "かわ", "もと"]),
}
_SCRIPTS = {"cyrillic": ("Ѐ", "ӿ"), "greek": ("Ͱ", "Ͽ"), "hebrew": ("\u0590", "\u05ff"), "arabic": ("\u0600", "\u06ff"), "han": ("一", "鿿"), "hangul": ("가", "힣"), "kana": ("\u3041", "ヿ")}

_TITLE = "|".join(form for g in TITLES.values() for t in sorted(g, key=len, reverse=True) for form in (t, t.upper()))
_GENDER = {t.lower(): g for g, ts in TITLES.items() for t in ts}
PATTERN = re.compile(
    rf"""(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)
    |(?P<secret>(?:(?<=token\ =\ ")|(?<=secret\ =\ ")|(?<=key\ =\ ")|(?<=password\ =\ "))[^"\s]{{8,}}|\b(?:AKIA|ghp_|sk-)\w{{12,}}|\b(?=\w*\d)(?=\w*[a-f])[0-9a-f]{{32,}}\b)
    |(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![\w:]))
    |(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))
    |(?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
    |(?P<phone>(?<![\w+])\+\d{{1,3}}[ .-]?(?:\(\d{{1,5}}\)|\d{{1,5}})(?:[ .-]?\d{{2,5}}){{1,4}}(?!\w)|(?<!\w)\(\d{{2,5}}\)[ ]?\d{{3,4}}[ .-]?\d{{3,5}}(?!\w)|(?<![\w-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?![\w-]))
    |(?P<iban>(?<!\w)[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{3,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?!\w))
    |(?P<number>(?<![\w.])\d(?:[ -]?\d){{12,18}}(?!\w)|(?<![\w.])\d{{9,}}(?!\w))
    |(?P<person>(?<!\w)(?P<title>{_TITLE})\.?[ ](?P<names>[^\W\d_][\w'’-]*(?:[ ][^\W\d_a-zà-öø-ÿа-яα-ώ][\w'’-]*)?))""",
    re.X,
)
#: Cheap test for rows that can hold an entity: wider than PATTERN, whatever it finds. Three ranges are digits that older JVMs don't know.
SUSPECT = rf"[0-9@\p{{Nd}}\x{{16AC0}}-\x{{16AC9}}\x{{11F50}}-\x{{11F59}}\x{{1E4F0}}-\x{{1E4F9}}]|(?:AKIA|ghp_|sk-)\S{{12}}|(?:token|secret|key|password) = \"|(?:^|\P{{L}})(?:{_TITLE})[. ]"
_WORD = re.compile(r"(?<!\w)[^\W\d_][\w'’-]*")


def mentions(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, type, canonical value) of the entities of a text, in order and apart: those of PATTERN, and bare mentions of its names anywhere."""
    found = list(_matched(text))
    names: dict[str, str] = {}
    for _, _, kind, value in found:
        if (kind == "surname" or kind.startswith("given_")) and len(value) > 1:  # initials aren't looked for
            names.setdefault(value, kind)
    if not names:
        yield from found
        return
    k = 0
    for m in _WORD.finditer(text):
        while k < len(found) and found[k][1] <= m.start():
            yield found[k]
            k += 1
        if not m.group()[0].isupper() and m.group()[0].islower():
            continue
        for word in (m.group(), re.split("['’]", m.group())[0]):
            end = m.start() + len(word)
            if word.lower() in names and (k == len(found) or end <= found[k][0]):
                yield m.start(), end, names[word.lower()], word.lower()
                break
    yield from found[k:]


def _matched(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in PATTERN.finditer(text):
        kind = m.lastgroup if m.lastgroup not in ("title", "names") else "person"
        kind = next(k for k in ("email", "secret", "ipv6", "ip", "ssn", "phone", "iban", "number", "person") if m.group(k) is not None)
        if kind != "person":
            # Phones, cards and other numbers are known by their digits, however they are written.
            yield m.start(), m.end(), "number" if kind in ("phone", "ssn") else kind, canonical(kind, m.group())
        elif not m.group("names")[0].islower():
            start, names = m.start("names"), m.group("names").split(" ")
            if len(names) == 2:
                yield start, start + len(names[0]), "given_" + _GENDER[m.group("title").lower()], names[0].lower()
                start += len(names[0]) + 1
            yield start, start + len(names[-1]), "surname", names[-1].lower()


def canonical(kind: str, value: str) -> str:
    if kind in ("email", "ipv6"):
        return value.lower()
    if kind in ("phone", "ssn", "number"):
        return re.sub(r"\D", "", value)
    return value.replace(" ", "") if kind == "iban" else value


def _stream(key: bytes, *parts: object) -> Iterator[int]:
    """Keyed bytes without end."""
    block = 0
    while True:
        yield from hmac.new(key, "\x1f".join(map(str, (*parts, block))).encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        block += 1


def _like(char: str, byte: int) -> str:
    """A character of the same kind: digit, or letter of the same case and script; any other stays."""
    if char.isdigit():
        return chr(ord(char) - int(char) + byte % 10) if char.isdecimal() else char
    if not char.isalpha():
        return char
    for first, size in (("a", 26), ("A", 26), ("а", 32), ("А", 32), ("α", 17), ("Α", 17), ("א", 27), ("ا", 26), ("あ", 80), ("ア", 80), ("一", 256), ("가", 256)):
        if 0 <= ord(char) - ord(first) < size:
            return chr(ord(first) + byte % size)
    return "aeiou"[byte % 5] if char.islower() else "AEIOU"[byte % 5] if char.isupper() else char


def luhn_valid(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def script_of(value: str) -> str:
    """The script of a value's first letter that has one of its own in ``NAMES``; Latin otherwise."""
    return next((name for c in value for name, (first, last) in _SCRIPTS.items() if first <= c <= last), "latin")


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The canonical form of an entity's surrogate; later attempts give others, from ``CROWDED`` on out of a pool that grows."""
    bytes_ = _stream(key, kind, value, attempt)
    pick = lambda pool: pool[(next(bytes_) << 8 | next(bytes_)) % len(pool)]
    if kind in ("surname", "given_f", "given_m", "given_x"):
        stems, endings, halves, closings = NAMES[script_of(value)]
        name = pick(halves) + pick(closings) if kind == "surname" else pick(stems) + pick(endings[kind[-1]])
        return "".join(pick(halves) for _ in range(attempt)) + name
    chosen = _same_form(kind, value, bytes_)
    if attempt < (16 * CROWDED if kind.startswith("ip") else CROWDED) and any(c.isalnum() for c in value):
        return chosen
    more = "".join(pick("abcdefghijklmnopqrstuvwxyz" if kind in ("email", "secret") else "0123456789") for _ in range(1 + attempt))
    local, at, domain = chosen.partition("@")
    grown = local + more + at + domain
    return _checked(grown) if kind == "number" and luhn_valid(value) else grown


def _checked(digits: str) -> str:
    """With the last digit that makes a valid card number."""
    return next(x for d in "0123456789" if luhn_valid(x := digits[:-1] + d))


def _same_form(kind: str, value: str, bytes_: Iterator[int]) -> str:
    if kind == "ip":
        return ".".join(str(1 + next(bytes_) % 254) for _ in range(4))
    if kind == "ipv6":
        return "".join("0123456789abcdef"[next(bytes_) % 16] if c.isalnum() else c for c in value)
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        return "".join(_like(c, next(bytes_)) for c in local) + "@" + ".".join(["".join(_like(c, next(bytes_)) for c in x) for x in labels[:-1]] + labels[-1:])
    if kind == "secret":
        if re.fullmatch("[0-9a-f]+", value):
            return "".join("0123456789abcdef"[next(bytes_) % 16] for _ in value)
        lead = re.match("AKIA|ghp_|sk-", value)
        cut = lead.end() if lead else 0
        return value[:cut] + "".join(_like(c, next(bytes_)) for c in value[cut:])
    if kind == "iban":
        return value[:2] + "".join(_like(c, next(bytes_)) for c in value[2:])
    digits = value[:1] + "".join(str(next(bytes_) % 10) for _ in value[1:])
    if kind == "number" and 13 <= len(value) <= 19 and luhn_valid(value):
        digits = _checked(digits)
    return digits


def in_form_of(kind: str, chosen: str, mention: str) -> str:
    """A surrogate written the way the mention is."""
    if kind in ("number", "iban"):
        left = iter(chosen)
        return "".join([*(next(left, "") if c.isalnum() else c for c in mention), *left])
    if mention.isupper() and kind != "secret" and kind != "ip":
        return chosen.upper()
    if kind in ("email", "ipv6"):  # letter for letter; what a grown surrogate adds stays as it is
        return "".join(c.upper() if m.isupper() else c for c, m in zip(chosen, mention)) + chosen[len(mention) :]
    return "-".join(p[:1].upper() + p[1:] for p in chosen.split("-")) if kind == "surname" or kind.startswith("given") else chosen


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, *m) for k, text in enumerate(batch.column(2).to_pylist()) for m in mentions(text)]
        at = pa.array([r[0] for r in rows], pa.int64())
        columns = [pa.array([r[c] for r in rows], t) for c, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.string()), (4, pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["rid", "key", "start", "stop", "kind", "value"])


def choose_surrogates(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, value, chosen) for distinct entities (kind, value): chosen is unique in its kind and no real value of it.

    Rounds end, as a surrogate that collides grows: from ``CROWDED`` attempts on each one adds a
    random character, so that the pool soon outnumbers the entities however few their own form allows.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            chosen = pa.array([surrogate(key, r["kind"], r["value"], r["attempt"]) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), chosen], names=["kind", "value", "attempt", "chosen"])

    make = lambda df: df.select("kind", "value", "attempt").mapInArrow(made, "kind string, value string, attempt int, chosen string")
    real = entities.select("kind", F.col("value").alias("chosen"))
    current = write_table(make(entities.withColumn("attempt", F.lit(0))), "surrogates")
    while True:
        shared = current.groupBy("kind", "chosen").agg(F.count(F.lit(1)).alias("n"), F.max("attempt").alias("oldest"), F.min("value").alias("keeper")).filter("n > 1")
        losers = current.join(shared, ["kind", "chosen"]).filter("value <> keeper").select("kind", "value", "attempt")
        losers = write_table(losers.unionByName(current.join(real, ["kind", "chosen"], "left_semi").select("kind", "value", "attempt")).distinct(), "collisions")
        if losers.isEmpty():
            return current
        again = make(losers.withColumn("attempt", F.col("attempt") + 1))
        current = write_table(current.join(losers.select("kind", "value"), ["kind", "value"], "left_anti").unionByName(again), "surrogates")


def session_key(spark: SparkSession) -> bytes:
    key = spark.conf.get("tempora.pii.key", None)
    return key.encode() if key else KEY


def replace_entities(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities``; all rows and columns stay.

    Null and empty texts stay as they are, with no entities.  Rows that repeat doc_id and text are
    changed alike; null ids do no harm; a clashing column ``n_entities`` is replaced; an empty table
    gives no rows.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    rows = whole_batches(docs).select(*names, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_rid"), F.xxhash64("text").alias("_key"))
    slim = rows.select(F.col("_rid").alias("rid"), F.col("_key").alias("key"), "text")
    found = write_table(slim.filter(F.col("text").rlike(SUSPECT)).mapInArrow(_found, "rid long, key long, start int, stop int, kind string, value string"), "mentions")
    entities = write_table(found.select("kind", "value").distinct(), "entities")
    known = found.join(choose_surrogates(entities, key).drop("attempt"), ["kind", "value"])
    edits = known.groupBy("rid", "key").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "kind", "chosen"))).alias("edits"))  # bounded by the text

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for row in batch.to_pylist():
                parts, at = [], 0
                for e in row["edits"]:
                    parts += [row["text"][at : e["start"]], in_form_of(e["kind"], e["chosen"], row["text"][e["start"] : e["stop"]])]
                    at = e["stop"]
                texts.append("".join([*parts, row["text"][at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(e) for e in batch.column(3)], pa.int64())], names=["rid", "key", "new_text", "n_entities"])

    touched = write_table(found.select("rid", "key").distinct(), "touched")
    hinted = bounded_broadcast(touched, touched.count(), BROADCAST_KEYS)
    mine = slim.join(hinted, ["rid", "key"], "left_semi").dropDuplicates(["rid", "key"])
    changed = mine.join(edits, ["rid", "key"]).select("rid", "key", "text", "edits").mapInArrow(applied, "rid long, key long, new_text string, n_entities long")
    on = (F.col("_rid") == F.col("rid")) & (F.col("_key") == F.col("key"))
    whole = rows.join(hinted, on, "left_anti").select(*names, F.lit(0).cast("long").alias("n_entities"))
    parts = rows.join(hinted, on, "left_semi").drop("text").join(changed, on)
    return whole.unionByName(parts.select(*[F.col("new_text").alias("text") if c == "text" else F.col(c) for c in names], "n_entities"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))


QUERIES = {"op5_pii": op5_pii}
ORACLE_SQL: dict = {}
