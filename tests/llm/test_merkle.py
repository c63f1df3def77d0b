import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gridscan.llm import merkle as M
from gridscan.llm.queries import tampered_text

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """The root and each leaf's siblings per level as (before, after)."""
    nodes = [(h, [i]) for i, h in enumerate(leaves)]
    paths = [[] for _ in leaves]
    while len(nodes) > 1:
        above = []
        for start in range(0, len(nodes), 3):
            run = nodes[start : start + 3]
            for k, (_, members) in enumerate(run):
                step = ("".join(h for h, _ in run[:k]), "".join(h for h, _ in run[k + 1 :]))
                for i in members:
                    paths[i].append(step)
            above.append((digest("".join(h for h, _ in run)), [i for _, members in run for i in members]))
        nodes = above
    return nodes[0][0], paths


def expected(rows):
    if not rows:
        return []
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: [r for r in ordered if r[1] == s] for s in sources}
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for row, path in zip(groups[s], trees[s][1]):
            path = path + top
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            h = leaf((*row[:4], text))
            for before, after in path:
                h = digest(before + h + after)
            proof = digest("".join(a + b for a, b in path))
            out.append((row[0], leaf(row), trees[s][0], root, proof, h, h == root))
    return sorted(out, key=repr)


def built(df):
    out = M.build_manifest(df, tampered={"text": tampered_text(F.col("doc_id"), F.col("text"))})
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def rows_of(rng, n, sources):
    return [(rng.randrange(n), rng.choice(sources), rng.choice((None, "en")), rng.randrange(9), rng.choice(("é\nb", "a", None, "", "\n"))) for _ in range(n)]


@pytest.mark.parametrize("n, sources", [(1, ["a"]), (2, ["a"]), (3, [None, ""]), (10, ["a"]), (28, ["b", "a", None]), (150, list("abcdefghij"))])
def test_equals_plain(spark, n, sources):
    rows = rows_of(random.Random(n), n, sources)
    assert built(spark.createDataFrame(rows, SCHEMA).repartition(3)) == expected(rows)


def test_several_stages(spark, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 1)
    rows = rows_of(random.Random(5), 90, ["hot", "hot", "hot", "x", "é", "z"])
    assert built(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_defined_cases(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "", 0, ""), (1, "", "", 0, ""), (2, "s", "l", 1, "x\n" * 200_000)]
    assert built(spark.createDataFrame(rows, SCHEMA)) == expected(rows)
    assert built(spark.createDataFrame([], SCHEMA)) == []


def test_further_columns_are_ignored(spark):
    rows = rows_of(random.Random(6), 12, ["a", "b"])
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("hash", "place", "total", "block", "named", "name", "id", "found", "row", "part", "path", "root"):
        df = df.withColumn(name, F.lit("x"))
    assert built(df) == expected(rows)


def test_a_changed_row_fails_alone(spark):
    rows = [(i, "s", "en", 1, f"text {i}") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    changed = F.when(F.col("doc_id") == 17, F.lit("other")).otherwise(F.col("text"))
    out = M.build_manifest(df, tampered={"text": changed}).collect()
    assert [r.doc_id for r in out if not r.verified] == [17]
