"""Registered queries against their SQL, and the pipeline's stages against brute force."""

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F
from test_rows import brute_groups, brute_scan, reference

import corpus_pipeline
from postmill.llm import decontam, langid, toxicity
from postmill.llm.catalog import ORACLES, QUERIES
from postmill.llm.learning import held_out


@pytest.fixture(scope="module")
def con(small):
    return oracle.duck(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = oracle.bag(df.select(*columns).collect())
    assert got
    if name in ORACLES:
        found = con.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == oracle.bag([tuple(row[i] for i in order) for row in found.fetchall()])


def test_held_out_labels_are_found(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    english = QUERIES["op10_toxicity_pu"](spark, sf).filter("held_out").join(labels.filter("lang = 'en'"), "doc_id")
    right, n = english.agg(F.count_if(F.col("predicted") == F.col("toxic")), F.count("*")).first()
    assert right / n > 0.95
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right, n = QUERIES["op6_language_codes"](spark, sf).filter("held_out").join(docs, "doc_id").agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n > 0.99


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, docs
    rows, after = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        rows[name] = kept.select("doc_id", "text").collect()
        kept = spark.createDataFrame(stage(spark, kept, small).toPandas())
        after[name] = {r.doc_id for r in kept.collect()}
        if name != "tokens":
            assert kept.columns == columns
    out = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs.filter(~out), spark.read.parquet(f"{small}/labels.parquet").filter(~out))
    assert after["toxicity"] == {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 0").collect()}
    left = docs.filter(F.col("doc_id").isin(sorted(after["toxicity"])))
    known = langid.predict(left, langid.train(left.filter(~held_out(F.col("doc_id"), 3, 1))))
    assert after["language"] == {r.doc_id for r in known.filter("not ambiguous").collect()}
    assert after["near_duplicates"] == {g[0] for g in brute_groups([tuple(r) for r in rows["near_duplicates"]], 80) if g[3]}
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    assert after["decontamination"] == {s[0] for s in brute_scan([tuple(r) for r in rows["decontamination"]], items) if not s[-1]}
    real = reference()
    for row in kept.join(docs, "doc_id").collect():
        assert np.frombuffer(row.ids, "<u4").tolist() == real.encode(row.text or "", add_special_tokens=False).ids


def test_whole_run(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.columns == ["doc_id", "n_tokens", "ids"] and 0 < got.count() < 200


def test_near_duplicates_from_four_fifths_on(spark, small):
    base = [f"v{i}" for i in range(400)]
    texts = [(1, " ".join(base)), (2, " ".join(w if i % 50 != 25 else f"x{i}" for i, w in enumerate(base))), (3, "something else")]
    near = brute_groups(texts, 80)
    assert [g[3] for g in near] == [True, False, True] and all(g[3] for g in brute_groups(texts))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, small).collect()} == {g[0] for g in near if g[3]}


def test_near_duplicates_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    near = brute_groups([tuple(r) for r in docs.select("doc_id", "text").collect()], 80)
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, small).collect()} == {g[0] for g in near if g[3]}


def test_near_duplicates_are_dropped_row_by_row(spark, small):
    copy, other = " ".join(f"v{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    texts = [(1, copy), (1, copy), (None, copy), (None, copy), (7, copy), (7, other), (8, other), (None, "only without an id here"), (9, None), (9, None), (10, ""), (10, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("id", F.lit(None).cast("int"))
    got = corpus_pipeline.one_of_each(spark, df, small)
    assert got.columns == df.columns
    want = [(1, copy), (7, other), (None, "only without an id here"), (9, None), (9, None), (10, ""), (10, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


HARD = [(1, "plain words of one kind"), (1, "plain words of one kind"), (2, None), (3, ""), (None, "no id"), (None, None), (4, "lorem ipsum dolor " * 30_000), (5, "123 !!")]


def test_stages_on_hard_rows(spark, small):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in HARD], "doc_id long, text string, lang string, source string, n_chars long")
    extra = df.withColumn("id", F.lit(1)).withColumn("key", F.lit("k")).withColumn("score", F.lit("x")).withColumn("_row", F.lit(0))
    count = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, extra, small)
        rows = got.collect()
        assert name == "tokens" or got.columns == extra.columns
        count[name] = len(rows)
        assert stage(spark, extra.limit(0), small).count() == 0
    assert count["tokens"] == count["decontamination"] == len(HARD)
    assert count["near_duplicates"] == len(HARD) - 1 and count["language"] <= len(HARD)


def test_language_and_window_filters_on_hard_rows(spark):
    en, fr = "the cat sat on the mat and the dog was there with them", "le chat est sur la table et le chien est avec nous ici"
    many = spark.createDataFrame([(i, f"{t} {i}", lang) for i in range(40) for t, lang in ((en, "en"), (fr, "fr"))], "doc_id long, text string, lang string")
    rows = [(1, en), (1, en), (None, en), (2, fr), (3, None), (4, ""), (5, "123 456 !?"), (6, en + " " + fr * 500)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, languages string, n_hit int")
    model = langid.train(many)
    kept = langid.keep_known(df, model, allowed=("en",))
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect() if r.doc_id != 6) == ["1", "1", "None"]
    nothing = langid.train(many.filter("lang is null"))
    assert langid.keep_known(df, nothing).count() == 0 and langid.keep_known(df.limit(0), model).count() == 0

    items = spark.createDataFrame([("a", "one two three"), ("a", "one two three"), ("b", None), ("c", ""), ("d", " ".join(f"w{i}" for i in range(12)))], "item_id string, text string")
    texts = [(1, "ONE two, three!"), (1, "ONE two, three!"), (2, "one two"), (3, None), (4, ""), (None, "x " * 9000 + " ".join(f"w{i}" for i in range(1, 11))), (5, "w0 w1 w2 w3 w4 w5 w6 w7 w8 other")]
    docs = spark.createDataFrame([(*t, "z") for t in texts], "doc_id long, text string, item_id string")
    left = decontam.remove(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5]
    assert decontam.remove(docs, items.limit(0)).count() == len(texts) and decontam.remove(docs.limit(0), items).count() == 0
