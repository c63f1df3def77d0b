"""Operators against plain versions and on the cases that their docstrings define."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscan.llm import (
    chat_format, fertility, jaccard_join, lyndon_sort, neighbours, pieces, quality_model, secret_scan, source_mix,
    suffix_dedup, url_filter,
)
from gridscan.llm import queries as q
from gridscan.llm.components import components
from tests.llm import plain

DOCS = "doc_id long, text string"


def words_of(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies(rng):
    """Texts with exact copies, chains of near copies and a hub of variants."""
    texts = [" ".join(words_of(rng, n)) for n in (0, 1, 2, 3, 5, 30, 60, 120, 300)]
    for n, share in ((200, 0.01), (80, 0.02), (150, 0.005)):
        base = words_of(rng, n)
        for _ in range(30):
            texts.append(" ".join(f"x{rng.random()}" if rng.random() < share else w for w in base))
        for _ in range(8):
            base = list(base)
            base[rng.randrange(n)] = f"y{rng.random()}"
            texts.append(" ".join(base).upper())
    texts += texts[:4] + texts[20:24] + [None, "", "  \n"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_join_equals_all_pairs(spark, k, percent):
    docs = near_copies(random.Random(k))
    df = spark.createDataFrame(list(docs.items()), DOCS).repartition(3)
    found = jaccard_join.similar_groups(df, jaccard_join.Similar(k, percent)).collect()
    want = plain.similar_groups(docs, k, percent)
    assert {r[0]: tuple(r[1:]) for r in found} == want
    assert len(set(want.values())) < len(want)


def test_jaccard_join_large_groups(spark, monkeypatch):
    """Groups cut into several blocks give the same components."""
    monkeypatch.setattr(jaccard_join, "CHUNK_TOKENS", 500)
    docs = near_copies(random.Random(9))
    found = jaccard_join.similar_groups(spark.createDataFrame(list(docs.items()), DOCS)).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == plain.similar_groups(docs, 5, 80)


def test_jaccard_join_repeats_nulls_and_empty_table(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A B c d e"), (3, None)]
    found = jaccard_join.similar_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(
        [(1, 1, 1), (1, 1, 1), (None, 1, 1), (2, 1, 1), (3, 0, 3)], key=repr
    )
    assert jaccard_join.similar_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + rng.randrange(1, 50)) for _ in range(60)] + [(7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(found[i] == 0 for i in range(41))
    assert all(c == 100 for n, c in found.items() if n >= 100)


def test_suffix_order():
    rng = random.Random(1)
    for alphabet in (1, 2, 3, 250):
        for n in (0, 1, 2, 5, 40, 300):
            data = np.array([rng.randrange(alphabet) for _ in range(n)], dtype=np.uint8)
            raw = data.tobytes()
            assert list(lyndon_sort.suffix_array(data)) == sorted(range(n), key=lambda i: raw[i:])


def test_suffix_order_of_blocks():
    """Blocks of several texts, as contexts of anchors come."""
    rng = random.Random(2)
    texts = [(b, bytes(rng.randrange(3) for _ in range(rng.randrange(1, 30)))) for b in range(40) for _ in range(rng.randrange(1, 9))]
    symbols = np.array([0, *(x for _, t in texts for x in [*(c + 1 for c in t), 0])])
    block = np.array([0, *(b for b, t in texts for _ in range(len(t) + 1))])
    suffixes, at = [], 1
    for b, t in texts:
        suffixes += [(b, t[i:]) for i in range(len(t))]
        at += len(t) + 1
    order = lyndon_sort.suffix_order(symbols, block)
    ends = np.flatnonzero(symbols == 0)
    found = [(int(block[p]), bytes((symbols[p : ends[np.searchsorted(ends, p)]] - 1).tolist())) for p in order]
    assert found == sorted(suffixes) and len(set(order.tolist())) == len(order)
    assert len(lyndon_sort.suffix_order(np.array([0]), np.array([0]))) == 0


def test_contexts_of_one_anchor():
    """Contexts that are cut back to what others share lose what all strings say."""
    rng = random.Random(4)
    rows = []
    for key in range(300):
        for i in range(rng.randrange(1, 7)):
            left = bytes(rng.choice(b"ab") for _ in range(rng.randrange(19)))[-18:]
            right = bytes(rng.choice(b"ab") for _ in range(max(18 - len(left), rng.randrange(19))))
            rows.append((key, b"ab" * 9 if i > 3 else left, right, rng.randrange(5), key * 10 + i, 100, 132 + len(left) + len(right)))
    frame = pd.DataFrame(rows, columns=["key", "left", "right", "id", "class", "start", "end"])
    found = {}
    for c, a, b in suffix_dedup.contexts_matches(frame, 50)[["class", "start", "end"]].itertuples(index=False):
        found.setdefault(c, set()).update(range(a, b))
    anchor, wanted = bytes(range(200, 232)), {}
    for key, left, right, own, text, start, _ in rows:
        whole = left + anchor + right
        for i in range(len(whole) - 49):
            if any(k == key and o < own and whole[i : i + 50] in x + anchor + y for k, x, y, o, *_ in rows):
                wanted.setdefault(text, set()).update(range(start + i, start + i + 50))
    assert found == wanted and wanted


def repeats(rng):
    passages = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (50, 55, 90, 200)]
    docs = {}
    for d in range(60):
        parts = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(80))) for _ in range(3)]
        docs[d] = parts[0] + rng.choice(passages) + parts[1] + rng.choice(["", *passages]) * 2 + parts[2]
    docs |= {60: docs[3], 61: docs[3], 62: None, 63: "", 64: "x" * 120, 65: "x" * 49, 66: "x" * 50, 67: "x" * 300}
    return docs


@pytest.mark.parametrize("large", [suffix_dedup.LARGE, 2])
def test_suffix_dedup_equals_all_strings(spark, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    docs = repeats(random.Random(5))
    found = suffix_dedup.remove_repeats(spark.createDataFrame(list(docs.items()), DOCS).repartition(3), length=50)
    found = found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert {r[0]: tuple(r[1:]) for r in found} == plain.remove_repeats(docs, 50)


def test_suffix_dedup_nulls_and_empty_table(spark):
    rows = [(None, "y" * 60, 1), (4, "y" * 60, 2), (4, "y" * 60, 2), (5, None, 3)]
    df = spark.createDataFrame(rows, DOCS + ", n_bytes int")
    found = sorted(((r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(df).collect()), key=repr)
    assert found == [(4, 0), (4, 0), (5, 0), (None, 60)]
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_neighbours_find_the_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[200:260] = x[200]  # copies
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [1.0, None]), (2003, [float("nan")]), (2004, [float("inf")]),
           (None, [1.0]), (2006, [])]
    df = spark.createDataFrame([*rows, *bad, rows[40]], "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    found = neighbours.nearest(df, F.col("id") % 20 == 0, top=20).toPandas()
    assert found["query_id"].nunique() == 75 and len(found) == 75 * 20
    hits = 0
    for query, rows_ in found.sort_values("rank").groupby("query_id"):
        scores = x @ x[query]
        assert np.allclose(rows_["score"], scores[rows_["vec_id"]], atol=1e-12)
        assert list(rows_["rank"]) == list(range(1, 21)) and query not in set(rows_["vec_id"])
        keys = list(zip(-rows_["score"], rows_["vec_id"]))
        assert keys == sorted(keys)
        scores[query] = -np.inf
        hits += len(set(rows_["vec_id"]) & set(np.lexsort((np.arange(1500), -scores))[:20]))
    assert hits / (75 * 20) >= 0.9


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_neighbours_of_few(spark, n):
    rows = [(20 * i, [1.0, float(i)]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert neighbours.nearest(df, F.col("id") % 20 == 0).count() == n * (n - 1)


def test_neighbours_all_equal(spark):
    df = spark.range(100).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.lit(0.5)).alias("embedding"))
    found = neighbours.nearest(df, F.col("id") % 20 == 0, top=20).collect()
    assert sorted(r["vec_id"] for r in found if r["query_id"] == 0) == list(range(1, 21))
    assert sorted(r["vec_id"] for r in found if r["query_id"] == 40) == list(range(20))


def log(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string")


def test_chat_fold(spark):
    rows = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "delta", "assistant", "he"), (1, 3, 1, "delta", None, "llo"),
        (1, 4, 1, "regenerate", "assistant", None), (1, 5, 1, "delta", None, "good "), (1, 6, 1, "delta", None, "day"),
        (1, 7, 0, "edit", "user", "hello"), (2, 1, None, None, None, None),
    ]
    made = chat_format.format_conversations(log(spark, rows))
    read = made.select("conv_id", chat_format.parse_turns(F.col("formatted")).alias("t"),
                       chat_format.learned_text(F.col("formatted"), F.col("loss_spans")).alias("l"))
    found = {r["conv_id"]: ([tuple(t) for t in r["t"]], r["l"]) for r in read.collect()}
    assert found == {1: ([("user", "hello"), ("assistant", "good day")], "good day"), 2: ([("", "")], "")}
    assert chat_format.format_conversations(log(spark, [])).count() == 0


def test_chat_texts_of_control_strings(spark):
    rng = random.Random(2)
    parts = ["\\", "#", "##", "### ", "</turn>", "<\\/turn>", "\n", ":\n", ":\\", "a", "é😀", "assistant"]
    rows = []
    for conv in range(60):
        for turn in range(3):
            role = rng.choice(["user", "assistant", "".join(rng.choices(parts, k=3))])
            rows.append((conv, 0, turn, "message", role, "".join(rng.choices(parts, k=rng.randrange(9)))))
    made = chat_format.format_conversations(log(spark, rows))
    read = made.select("conv_id", chat_format.parse_turns(F.col("formatted")).alias("t"),
                       chat_format.learned_text(F.col("formatted"), F.col("loss_spans")).alias("l"))
    for r in read.collect():
        turns = [(x[4], x[5]) for x in rows if x[0] == r["conv_id"]]
        assert [tuple(t) for t in r["t"]] == turns
        assert r["l"] == "".join(t for role, t in turns if role == "assistant")


def test_url_rules_and_terms(spark):
    urls = [
        None, "", "no scheme", "HTTP://WWW.Example.COM/en/a?b", "http://example.com/en/", "http://a.net/es/x", "http://net/fr/",
        "http://a.org/casino-win", "http://a.org/free-bonus", "http://a.org/free-free", "http://a.org/freedom/hotel",
        "x://y.org/" + "z" * 50_000, "http://xexample.com/en/", "http://example.com/EN/", "http://sussex.org/",
    ]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    rows = url_filter.judge_urls(df, q.URLS).orderBy("page_id").collect()
    assert [r["rule"] for r in rows] == [
        None, None, None, "www.example.com/en/", "example.com/en/", "net/es/", "net/fr/", None, None, None, None, None,
        "com/", "com/", None,
    ]
    assert [r["verdict"] for r in rows] == ["allow"] * 4 + ["block"] * 5 + ["allow"] * 6
    assert rows[3]["host"] == "www.example.com" and rows[3]["path"] == "/en/a"
    assert url_filter.judge_urls(df.limit(0), q.URLS).count() == 0


def test_secret_parts():
    key, secret = "AKIA" + "A1B2C3D4E5F6G7H8", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
    alone = secret_scan.scan_text(f"a bare {secret} here")
    assert alone == []
    both = secret_scan.scan_text(f"id {key} and {secret} here")
    assert [s[0] for s in both] == ["access", "secret"]
    assert [s[0] for s in secret_scan.scan_text(f"id {key}\n\n{secret} here")] == ["access"]  # another scope
    assert [s[0] for s in secret_scan.scan_text(f"id {key} {'x ' * 300}{secret}")] == ["access"]  # too far
    near = secret_scan.scan_text(f"https://db.example.org/x user=bob password={'p' * 12}")
    assert [s[0] for s in near] == ["endpoint", "identifier", "assign"]
    assert secret_scan.scan_text("see https://db.example.org/x, user: bob") == []
    assert secret_scan.mask_text("a key b", [("hex", 2, 5), ("assign", 2, 4)]) == "a [secret] b"


def test_secret_base_spans(spark):
    rng = random.Random(4)
    parts = ["password", "Token", "api_key", "=", ": ", '"', "AKIA", "AKIA" + "X" * 20, "deadbeef" * 3, "0123456789abcdef", " ",
             "\n", "\n\n", "é", "x" * 12, "user=joe", "ſecret=" + "b" * 13, "A" * 40]
    texts = [None, ""] + ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("findings", F.lit(1))
    for r in secret_scan.scan_secrets(df).collect():
        strong = [(f["kind"], f["start"], f["end"]) for f in r["findings"] if f["kind"] in secret_scan.STRONG]
        assert strong == plain.base_spans(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_quality_of_unseen_labels(spark, sf_dir):
    rows = q.op4_quality_model(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id"
    ).where("held_out").select("score", "predicted", "quality").toPandas()
    right = ((rows["score"] >= 0.5).astype(int) == rows["quality"]).mean()
    assert len(rows) > 50 and right > 0.9
    assert rows["score"].between(0, 1).all()


def test_quality_model_without_labels(spark):
    df = spark.createDataFrame([("a b", 1), (None, 1), ("", None)], "text string, quality int")
    one = quality_model.fit(df)
    assert [r["score"] for r in quality_model.score(df, one).collect()] == [1.0] * 3
    none = quality_model.fit(df.limit(0))
    assert [r["predicted"] for r in quality_model.score(df, none).collect()] == [0] * 3
    assert quality_model.score(df.limit(0), none).count() == 0


def test_quality_scores_are_log_density_differences():
    rng = np.random.default_rng(1)
    d = len(quality_model.STATISTICS)
    x = {k: rng.standard_normal((60, d)) + k for k in (0, 1)}
    model = quality_model.from_moments({k: (60, v.sum(0), v.T @ v) for k, v in x.items()}, shrinkage=0.3, ridge=0.01)
    pooled = np.diag(sum(np.cov(v.T, bias=True) for v in x.values()) / 2)
    probe = rng.standard_normal((5, d))
    odds = 0.0
    for k, sign in ((1, 1), (0, -1)):
        cov = 0.7 * np.cov(x[k].T, bias=True) + 0.3 * np.diag(pooled) + 0.01 * np.eye(d)
        away = probe - x[k].mean(0)
        odds = odds - sign * 0.5 * (np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away) + np.linalg.slogdet(cov)[1])
    assert np.allclose(model.score(probe), 1 / (1 + np.exp(-odds)))


def test_fertility_base_counts():
    rng = random.Random(6)
    parts = ["a", "b", "ab", "\n", "\t", "#", "<|>", "é", " ", "\u00a0", "\x0b", "\r\n", "\u2028", "c"]
    for text in [None, "", " ", *("".join(rng.choices(parts, k=rng.randrange(80))) for _ in range(500))]:
        assert fertility.base_counts(text) == plain.base_counts(text), repr(text)


def test_fertility_bands(spark):
    long = (
        "Early in the morning a small boat left the harbour and sailed along the coast. The crew watched gulls circle "
        "above the mast while wind filled both sails. By noon they had reached an island with white cliffs, where "
        "fishermen were mending nets beside their huts. An old man offered bread, cheese and fresh water, then told "
        "stories about storms that had swept many ships onto hidden rocks. Before evening everyone returned aboard, "
        "raised the anchor and turned home under a clear sky full of stars."
    )
    noise = " ".join("".join(chr(0x100 + (i * 37 + j * 91) % 400) for j in range(6)) for i in range(120))
    rows = [(1, long, "en"), (2, noise, "en"), (3, None, None), (4, "", "en"), (5, "same " * 200, "en"), (6, long, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in fertility.judge_fertility(df, q.RANK_FILE, q.RANK_PATTERN).collect()}
    assert {k: (r["base_failed"], r["kept"]) for k, r in found.items()} == {
        1: (False, True), 2: (False, False), 3: (True, False), 4: (True, False), 5: (True, False), 6: (False, True)
    }


def test_fertility_of_long_runs(spark):
    encoding, partial = fertility.load_vocabulary(q.RANK_FILE, q.RANK_PATTERN)
    rng = random.Random(3)
    parts = ["a", "word", "  ", " ", "\n", "\t", "\u3000", "\x85", "1", "!", "é", "\x1c", "\xa0"]
    short = re.compile(fertility.LONG_RUN.pattern.replace("1000", "3"))
    for text in ("".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(500)):
        plain_ids = encoding.encode_ordinary(text)
        assert fertility.encode(text, encoding) == plain_ids
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(fertility, "LONG_RUN", short)
            assert fertility.encode(text, encoding) == plain_ids
    rows = [(1, "a" + " " * 1_000_000 + "b", "en"), (2, " " * 10_000_000, "en"), (3, "x" * 1_000_000, "en"), (4, "\n" * 1_000_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = fertility.judge_fertility(df, q.RANK_FILE, q.RANK_PATTERN).collect()
    assert {r["doc_id"]: r["base_failed"] for r in found} == {1: True, 2: True, 3: True, 4: True}
    assert all(r["n_tokens"] > 1000 for r in found)


def test_fertility_measures():
    encoding, partial = fertility.load_vocabulary(q.RANK_FILE, q.RANK_PATTERN)
    for text in ("a", "the cat and the dog and the cat", "日本語 é 😀 mixed", "…" * 5):
        ids = encoding.encode_ordinary(text)
        shares = [ids.count(i) / len(ids) for i in set(ids)]
        broken = 0
        for i in ids:
            try:
                encoding.decode_single_token_bytes(i).decode()
            except UnicodeDecodeError:
                broken += 1
        n, chars, share, entropy = fertility.measures(text, encoding, partial)
        assert (n, chars, share) == (len(ids), len(text) / len(ids), broken / len(ids))
        assert entropy == pytest.approx(-sum(p * math.log2(p) for p in shares), abs=1e-9)


def test_fertility_bands_of_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    measured = fertility.measure_fertility(good, q.RANK_FILE, q.RANK_PATTERN)
    bands = fertility.fit_bands(measured)
    assert {"en", "de", "fr", "es"} <= set(bands)
    text = next(r["text"] for r in good.where("lang = 'en'").orderBy(F.length("text").desc()).limit(1).collect())
    words = text.split()[:300]
    rng = random.Random(4)
    gibberish = " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz#$%", k=9)) for _ in range(200))
    other = " ".join("".join(chr(0x430 + rng.randrange(32)) for _ in range(6)) for _ in range(200))
    run_on = " ".join("".join(words[i : i + 12]).lower() + "QzJx" * 9 for i in range(0, 290, 4))
    rows = [(1, " ".join(words), "en"), (2, gibberish, "en"), (3, other, "en"), (4, run_on, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rules = fertility.FertilityRules(bands=bands)
    found = {r["doc_id"]: r for r in fertility.judge_fertility(df, q.RANK_FILE, q.RANK_PATTERN, rules).collect()}
    assert not any(r["base_failed"] for r in found.values())
    assert {k: r["kept"] for k, r in found.items()} == {1: True, 2: False, 3: False, 4: False}
    kept = fertility.judge_fertility(good, q.RANK_FILE, q.RANK_PATTERN, rules).where("not base_failed")
    assert kept.where("not kept").count() <= 0.02 * kept.count()
    assert fertility.fit_bands(measured.limit(0)) == {}


@pytest.mark.parametrize("filler", [0, 200, 5000])
def test_longest_run_at_every_length(filler):
    words = [b"w%d" % i for i in range(filler)]
    assert quality_model.longest_run([*words, *[b"same"] * 400, *words[:3]]) == 400
    assert quality_model.longest_run(words) == min(1, filler)
    text = b" ".join([*words, *[b"same"] * 400]).decode()
    assert quality_model.measure(text)[quality_model.STATISTICS.index("log_longest_run")] == math.log1p(400)


def test_columns_of_clashing_names_stay(spark):
    rows = [(1, "x" * 60, "en", "s", "https://a.com/b"), (2, "x" * 60, "en", "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string")
    names = ["found", "row", "key", "anchors", "Frequent", "rd_class", "rd_first", "rd_stretches", "mix_tokens", "mix_doc", "mix_lang"]
    for name in names:
        df = df.withColumn(name, F.lit(f"own {name}"))
    for out in (
        url_filter.judge_urls(df, q.URLS),
        source_mix.mix_sources(df, source_mix.Mix(), F.lit("d")),
        suffix_dedup.remove_repeats(df, 50),
        quality_model.score(df, quality_model.Discriminant(None, None)),
        secret_scan.scan_secrets(df),
    ):
        got = out.collect()
        assert len(got) == 2 and all(r[name] == f"own {name}" for r in got for name in names)


@pytest.fixture(scope="module")
def model():
    return pieces.load_model(q.PIECE_MODEL)


def test_pieces_round_trip_and_best_score(model):
    rng = random.Random(8)
    parts = ["the ", "ing", " ", "  ", "\n", "é", "日本", "😀", "\u2581", "x" * 50, "qzj", "\t", "Straße ", "\ufffd", "\x00"]
    scores = {p: s for p, s in zip(pieces_by_id(model), model.scores) if p}
    for text in ["", " ", "a", *("".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(200))]:
        ids = model.encode(text)
        assert model.decode(ids) == text
        if text and pieces.MARK not in text and len(text) < 60:
            want = plain.best_score(" ".join(["", text]).replace(" ", pieces.MARK), scores, model.byte_score)
            total = sum(model.byte_score if int(i) in set(model.byte_ids) else model.scores[i] for i in ids)
            assert total == pytest.approx(want)


def pieces_by_id(model):
    words = {i: p for p, (_, _, i) in model.automaton.items()}
    return [words.get(i, "") for i in range(len(model.scores))]


def test_pieces_of_small_vocabulary():
    own = pieces.PieceModel([("a", -3.0), ("b", -3.0), ("ab", -1.0), ("bab", -1.5), *[("", 0.0)] * 256], list(range(4, 260)))
    ids = own.best_split("abab")
    assert ids == [2, 2] and own.best_split("bab") == [3]
    assert own.decode(own.encode("ab c\u2581é")) == "ab c\u2581é"


def test_pieces_frames(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a  b\n", "z"), (3, "a  b\n", "z"), (4, "word " * 50_000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    back = pieces.decode_pieces(pieces.encode_texts(df, q.PIECE_MODEL), q.PIECE_MODEL)
    assert back.where(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0
    assert back.where("pieces is null").count() == 1 and back.count() == 5
    assert pieces.encode_texts(df.limit(0), q.PIECE_MODEL).count() == 0


def leaf_model(leaves, weights, budget):
    """(domain, lang, source) -> share, by filling children one after the other."""

    def give(paths, depth, budget):
        if depth == 3:
            return {paths[0]: budget}
        children = {}
        for p in paths:
            children.setdefault(p[depth], []).append(p)
        weight = {c: weights.get(v[0][: depth + 1], 1) for c, v in children.items()}
        cap = {c: sum(leaves[p] for p in v) for c, v in children.items()}
        order = sorted((c for c in children if weight[c] > 0), key=lambda c: (cap[c] / weight[c], cap[c], c))
        out, left, total = {}, budget, sum(weight[c] for c in order)
        share = {}
        for i, c in enumerate(order):
            if cap[c] * total > weight[c] * left:
                share |= {d: weight[d] * left // total for d in order[i:]}
                break
            share[c] = cap[c]
            left -= cap[c]
            total -= weight[c]
        for c in order:
            out |= give(children[c], depth + 1, share[c])
        return out

    return give(sorted(leaves), 0, budget)


def test_mix_shares(spark):
    rng = random.Random(12)
    leaves = {(d, lang, f"s{i}"): rng.randrange(1, 900) for d in "abc" for lang in ("de", "en") for i in range(rng.randrange(1, 5))}
    weights = {("a",): 5, ("b",): 1, ("c",): 2, ("a", "en"): 3, ("a", "de", "s0"): 4, ("c", "de"): 0}
    for budget in (0, 10, 700, 4000, 10**6):
        mix = source_mix.Mix(weights=weights, budget=budget, max_epochs=2)
        rows = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "mix_domain string, mix_lang string, mix_source string, tokens long")
        found = {tuple(r)[:3]: r["share"] for r in source_mix.leaf_shares(rows, mix).collect() if r["share"]}
        want = {k: v for k, v in leaf_model({k: 2 * v for k, v in leaves.items()}, weights, budget).items() if v}
        assert found == want


def test_mix_defined_cases(spark):
    schema = "doc_id long, text string, lang string, source string, epoch int, Mix_Lang int"
    rows = [(1, "a b c", "en", "s", 9, 1), (2, None, "en", "s", 9, 1), (3, "a b", None, None, 9, 1), (3, "a b", None, None, 9, 1)]
    df = spark.createDataFrame(rows, schema)
    whole = source_mix.mix_sources(df, source_mix.Mix(budget_share=2.0, max_epochs=2), F.lit("d"))
    found = sorted((r["doc_id"], r["epoch"]) for r in whole.collect())
    assert [x for x in found if x[0] != 2] == [(1, 0), (1, 1), (3, 0), (3, 0), (3, 1), (3, 1)]
    part = source_mix.mix_sources(df, source_mix.Mix(budget=0), F.lit("d"))
    assert part.count() == 0
    assert source_mix.mix_sources(df.limit(0), source_mix.Mix(), F.lit("d")).count() == 0


@pytest.mark.parametrize("module", [chat_format, source_mix])
def test_native_operators_run_no_python(module):
    source = open(module.__file__).read()
    assert not any(w in source for w in ("udf", "InPandas", "InArrow", "rdd", "toPandas", "collect()"))


def test_types(spark):
    assert isinstance(quality_model.statistics.returnType, T.ArrayType)
