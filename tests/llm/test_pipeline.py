"""The pipeline's stages, one after the other and by themselves, with nulls, repeated ids, empty tables and labelled passages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tempora.llm import decontaminate, line_dedup, minhash_dedup, packing, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The documents of sf0.01 with rows of null ids, null and empty texts, a repeated id, exact and near copies, and a benchmark passage."""
    path = str(tmp_path_factory.mktemp("corpus"))
    given = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{given}/documents.parquet")
    clean = "the quiet harbour keeps its lamps lit while boats return with nets and stories of calm water beyond the last pier and its old stone wall"
    item = "a tall mason carried seven green bottles over the frozen canal before dawn and sold them to an astonished violin teacher"
    kinds = dict(docs.dtypes)
    rows = [(None, None), (None, clean + " one"), (900001, None), (900002, ""), (900003, clean + " two three four"), (900004, clean + " two three four"), (900005, clean + " two three five"), (900006, "short"), (900006, "other words under one id"), (900007, f"before it {item} after it")]
    more = spark.createDataFrame([(i, t, "en", "made", len(t) if t else 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more.select(*[F.col(c).cast(kinds[c]).alias(c) for c in docs.columns])).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{given}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    items = spark.read.parquet(f"{given}/benchmark.parquet")
    items.select("item_id", "text").unionByName(spark.createDataFrame([(900000, item), (900001, None)], "item_id long, text string")).write.parquet(f"{path}/benchmark.parquet")
    return path


def counted(df):
    out = {}
    for r in df.select(*COLUMNS).collect():
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


def test_every_stage_does_its_operators_work(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        after[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = after[name][1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "pack"]

    given, kept = after["toxicity"]
    model = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert counted(kept) == counted(toxicity.score_toxicity(given, model).filter("predicted = 0"))
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in given.join(kept.select("doc_id").distinct(), "doc_id", "left_anti").collect() if r["doc_id"] is not None}
    assert sum(labels.get(i) == 1 for i in gone) > 0.5 * sum(v == 1 for v in labels.values())

    given, kept = after["line_dedup"]
    assert kept.columns == given.columns and kept.count() == given.count()
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert texts(kept) == texts(line_dedup.dedup_lines(given).select("doc_id", "text"))

    given, kept = after["near_dedup"]
    groups = minhash_dedup.near_duplicates(given)
    drop = {r["doc_id"] for r in groups.filter("NOT kept").collect()}
    assert counted(kept) == {r: n for r, n in counted(given).items() if r[0] not in drop}
    assert drop
    components = {r["component_id"] for r in groups.filter("component_id IS NOT NULL").select("component_id").distinct().collect()}
    assert components <= {r[0] for r in counted(kept)}  # a document of every group stays
    of = lambda df, i: sum(n for r, n in counted(df).items() if r[0] == i)
    assert of(kept, None) == of(given, None) and of(kept, 900006) == of(given, 900006)

    given, kept = after["decontaminate"]
    hit = {r["doc_id"] for r in decontaminate.contaminated(given, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert hit and (900007 in hit) == (of(given, 900007) > 0) and counted(kept) == {r: n for r, n in counted(given).items() if r[0] not in hit}

    given, packed = after["pack"]
    whole = packing.pack(given)
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, packed.select(*same).collect())) == sorted(map(str, whole.select(*same).collect()))
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= packing.CAPACITY


def test_run_is_the_chain(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    ids = {r["doc_id"] for r in rows.select("doc_id").distinct().collect()}
    assert len(ids) > 500 and 900007 not in ids


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0, name
        docs = out if name != "pack" else docs
