"""The stages of the corpus pipeline against plain versions, and their defined cases."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from gridscan.llm import pieces, quality_model, secret_scan, source_mix
from gridscan.llm.common import table
from gridscan.llm.queries import MIX, PIECE_MODEL, domain_of
from plain import similar_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


@pytest.fixture(scope="module")
def tables(spark):
    return "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns of names that stages use themselves."""
    rows = [
        (1, TEXT, "en", "s", 80), (1, TEXT, "en", "s", 80), (2, TEXT + ".", None, None, None), (None, None, None, None, None),
        (None, TEXT, "de", "s", 1), (3, "", "en", "t", 0), (4, "word " * 60_000, "en", "t", 300_000), (5, " \n ", "en", "", 3),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "score", "predicted", "key", "hash", "found", "findings", "full", "slot", "mix_doc", "anchors"):
        df = df.withColumn(name, F.lit("x"))
    return df.withColumn("more", F.create_map(F.lit("k"), F.col("doc_id")))


def test_quality_keeps_what_the_model_predicts_good(spark, tables):
    docs = table(spark, tables, "documents")
    model = quality_model.fit_on_labels(docs, table(spark, tables, "labels"))
    kept = P.quality(spark, docs, tables)
    good = [r for r in docs.collect() if model.score([quality_model.measure(r["text"])])[0] >= 0.7]
    assert kept.columns == docs.columns
    assert rows_of(kept) == sorted((tuple(r) for r in good), key=repr) and 0 < len(good) < docs.count()


def test_near_duplicates_keep_the_first_of_each_group(spark, tables):
    docs = table(spark, tables, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = {component for _, component in similar_groups(texts, 5, 80).values()}
    kept = P.near_duplicates(spark, docs, tables)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == first
    assert kept.count() == len(first) < len(texts)


def test_secrets_are_masked_and_lengths_follow(spark, tables):
    docs = table(spark, tables, "documents")
    kept = P.secrets(spark, docs, tables)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    found = {r["doc_id"]: r for r in secret_scan.scan_secrets(docs).collect()}
    changed = 0
    for r in kept.collect():
        spans = [(f["start"], f["end"]) for f in found[r["doc_id"]]["findings"]]
        text = found[r["doc_id"]]["text"]
        if spans:
            changed += 1
            assert not any(text[a:b] in (r["text"] or "") for a, b in spans if b - a >= 12)
            assert r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == text
    assert changed


def test_mix_equals_the_operator_alone(spark, tables):
    docs = table(spark, tables, "documents")
    kept = P.mix(spark, docs, tables)
    alone = source_mix.mix_sources(docs, MIX, domain_of(F.col("source")))
    assert kept.columns == docs.columns
    assert rows_of(kept) == rows_of(alone.select(*docs.columns)) != []


def test_pieces_decode_to_the_text(spark, tables):
    docs = table(spark, tables, "documents")
    out = P.encode(spark, docs, tables).collect()
    assert len(out) == docs.count() and all(r["round_trip"] and r["n_pieces"] == len(r["pieces"]) for r in out)


@pytest.mark.parametrize("name", [name for name, _ in P.STAGES])
def test_stages_take_awkward_tables(spark, tables, name):
    stage, docs = dict(P.STAGES)[name], awkward(spark)
    out = stage(spark, docs, tables)
    empty = stage(spark, docs.limit(0), tables)
    assert empty.count() == 0 and empty.columns == out.columns
    if name == "encode":
        assert out.count() == 8 and out.where("not round_trip").count() == 0
        return
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is None) for r in out.collect())
    # Texts without a word are groups of their own, as are the two nulls of an id.
    if name == "near_duplicates":
        assert got == [(False, 0, True), (True, 1, False), (True, 3, False), (True, 4, False), (True, 5, False)]
    if name == "secrets":
        assert rows_of(out.drop("more")) == rows_of(docs.drop("more"))
    if name == "mix":
        assert set(got) <= {(r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is None) for r in docs.collect()}


def test_the_run_is_its_stages(spark, tables):
    docs = table(spark, tables, "documents")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, tables)
    again = P.run(spark, tables)
    assert again.columns == docs.columns
    assert rows_of(again) == rows_of(docs) != []


def test_workers_do_not_keep_the_words_of_a_task(spark):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.hex(F.xxhash64("id", i))))
    texts = spark.range(0, 300, numPartitions=1).select(words.alias("text"))
    pieces.encode_texts(texts, PIECE_MODEL).write.format("noop").mode("overwrite").save()

    def kept(batches):
        for _ in batches:
            pass
        time.sleep(0.5)  # so that every worker takes part
        yield pd.DataFrame({"n": [len(pieces.load_model(PIECE_MODEL).memory)]})

    held = spark.range(0, 32, numPartitions=32).mapInPandas(kept, "n long").collect()
    assert max(r.n for r in held) <= pieces.HELD
