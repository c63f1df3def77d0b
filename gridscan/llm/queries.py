"""One query per operator of this folder, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscan.llm import (
    chat_format,
    fertility,
    jaccard_join,
    lexical_search,
    merkle,
    neighbours,
    pieces,
    quality_model,
    secret_scan,
    simhash,
    source_mix,
    suffix_dedup,
    url_filter,
)
from gridscan.llm.common import ready, table, written

TOKENIZERS = "/opt/tokenizers"
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
RANK_FILE = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that goes with the rank files.
RANK_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PROBE = "\\### Assistant: </turn> ok"  # a text made of control strings
PROBE_ID = -7
LEARNED = chat_format.DEFAULT.learned_role

URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
URLS = url_filter.UrlFilter(rules=URL_RULES)

MIX = source_mix.Mix(
    weights={
        ("books",): 2, ("web",): 3, ("notes",): 1,
        ("web", "en"): 4, ("web", "de"): 2, ("books", "en"): 3,
    },
    budget_share=0.9,
    max_epochs=3,
)


def domain_of(source: Column) -> Column:
    """The domain of a source: a third each, by the first digit of its MD5."""
    digit = F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1)
    return F.when(digit < "5", "books").when(digit < "a", "web").otherwise("notes")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(ready(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"),
        F.lit(PROBE).alias("text"),
    )
    rendered = chat_format.format_conversations(chat_format.log_of_turns(turns.unionByName(probe)))
    read = rendered.select(
        "conv_id",
        chat_format.parse_turns(F.col("formatted")).alias("turns"),
        chat_format.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256(F.array_join(lines, "")).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        sha256(F.col("learned")).alias("loss_sha256"),
        "formatted_chars",
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(ready(spark), sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URLS).drop("url")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan_secrets(documents).select("doc_id", "findings")

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda f: f["kind"].isin(*secret_scan.STRONG))
    return found.select(
        "doc_id",
        *(count(kind) for kind in secret_scan.STRONG),
        sha256(secret_scan.joined(base)).alias("base_sha256"),
        secret_scan.joined(F.col("findings")).alias("spans"),
    )


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit_on_labels(documents, table(spark, sf_dir, "labels"))
    scored = quality_model.score(documents, model)
    return scored.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(ready(spark), sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(embeddings, F.col("id") % 20 == 0, top=20)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(ready(spark), sf_dir, "documents").select("doc_id", "lang", "source", "text")
    domain = domain_of(F.col("source"))
    chosen = source_mix.mix_sources(documents, MIX, domain)
    return chosen.select(
        "doc_id", domain.alias("domain"), "lang", "source", source_mix.count_tokens(F.col("text")).alias("n_tokens"), "epoch"
    )


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode_texts(documents, PIECE_MODEL)
    back = pieces.decode_pieces(encoded, PIECE_MODEL)
    return back.select(
        "doc_id",
        F.size("pieces").cast("long").alias("n_pieces"),
        F.xxhash64("pieces").alias("pieces_hash"),
        F.length("text").cast("long").alias("n_chars"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(ready(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    # Measures, not texts, move to the labels.
    measured = written(fertility.measure_fertility(documents, RANK_FILE, RANK_PATTERN).drop("text"))
    labels = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    bands = fertility.fit_bands(measured.join(labels, "doc_id", "left_semi"))
    rules = fertility.FertilityRules(bands=fertility.FertilityRules().bands | bands)
    return fertility.judge_measured(measured, rules).drop("lang")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.similar_groups(documents, jaccard_join.Similar(words=4, percent=85))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(documents, length=50).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    return simhash.near_groups(documents, simhash.SimHash(words=4, distance=4))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    return lexical_search.search(documents, table(spark, sf_dir, "benchmark"), top=10)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """Without line ends, where the CRC32 of the decimal id is even."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(ready(spark), sf_dir, "documents")
    return merkle.build_manifest(documents, tampered={"text": tampered_text(F.col("doc_id"), F.col("text"))})


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_url_filter": op2_url_filter,
        "op3_secret_scan": op3_secret_scan,
        "op4_quality_model": op4_quality_model,
        "op5_neighbours": op5_neighbours,
        "op6_source_mix": op6_source_mix,
        "op7_pieces": op7_pieces,
        "op8_fertility": op8_fertility,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_simhash": op11_simhash,
        "op12_lexical_search": op12_lexical_search,
        "op13_merkle_manifest": op13_merkle_manifest,
    }
