"""A corpus pipeline over documents: quality, near duplicates, secrets, source mix, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last
return the columns of their input.

Defined cases, in every stage: a null text counts as empty and stays null; an empty table gives an empty
one; further columns are carried along, whatever their names; rows that are equal in all columns are
separate documents except in ``near_duplicates``, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscan.llm import jaccard_join, pieces, quality_model, secret_scan, source_mix
from gridscan.llm.common import ready, table, written
from gridscan.llm.queries import MIX, PIECE_MODEL, domain_of

SIMILAR = jaccard_join.Similar(words=5, percent=80)


def _boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as one column, out of reach of other names."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def _unboxed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def _hashable(value: Column, kind: T.DataType) -> Column:
    """A column as it is, or as JSON if it holds a map, which has no hash."""
    return F.to_json(F.struct(value)) if "map<" in kind.simpleString() else value


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier predicts to be of label 1."""
    ready(spark)
    model = quality_model.fit_on_labels(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    # The text is there once: the scores' batches hold it beside the other columns.
    rest = F.struct(F.lit(0), *(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    good = quality_model.score(docs.select("text", rest), model).where("predicted = 1")
    return good.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: that of the smallest id, null ids last."""
    ready(spark)
    fields = [_hashable(F.col(f"`{f.name}`"), f.dataType) for f in docs.schema]
    # Rows are told apart by 128 bits; rows that agree in them are equal.
    key = F.struct(
        F.col("doc_id").isNull().alias("unnamed"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(*fields).alias("hash"),
        F.xxhash64(F.lit("second"), *fields).alias("other"),
    )
    groups = jaccard_join.similar_groups(docs.select(key.alias("doc_id"), "text"), SIMILAR)
    parts = ["unnamed", "id", "hash", "other"]
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id.*").distinct()
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(key.alias("key"), whole.alias("row")).select("key.*", "row")
    return _unboxed(rows.join(first, parts, "left_semi").dropDuplicates(parts), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask what the secret scan finds; n_chars follows the text."""
    ready(spark)
    masked = secret_scan.mask_secrets(_boxed(docs))
    changed = ~F.col("text").eqNullSafe(F.col("row")["text"])

    def column(name: str):
        if name == "text":
            return F.col("text").alias(name)
        old = F.col("row")[name]
        if name == "n_chars":
            old = F.when(changed, F.length("text").cast(docs.schema[name].dataType)).otherwise(old)
        return old.alias(name)

    return masked.select(*(column(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents to the target weights; one read in several epochs is as many rows."""
    ready(spark)
    rows = _boxed(docs).withColumns({"lang": F.col("row")["lang"], "source": F.col("row")["source"]})
    return _unboxed(source_mix.mix_sources(rows, MIX, domain_of(F.col("source"))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, pieces, n_pieces, and whether the pieces decode to the text."""
    ready(spark)
    encoded = pieces.encode_texts(docs.select("doc_id", "lang", "source", "text"), PIECE_MODEL)
    back = pieces.decode_pieces(encoded, PIECE_MODEL)
    n = F.when(F.col("pieces").isNotNull(), F.size("pieces")).otherwise(0).cast("long").alias("n_pieces")
    exact = F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip")
    return back.select("doc_id", "lang", "source", "pieces", n, exact)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mix", mix),
    ("encode", encode),
]

# The classifier and the pieces are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
