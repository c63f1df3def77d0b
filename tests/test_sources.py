import pytest
from pyspark.sql import functions as F

from gridscan.operators.batch import dedup_batch
from gridscan.sources.points import parse_points, points_from, read_points_text

GOOD = ["1.5,2.5", " 1.5 , 2.5 ", "1.5,2.5,extra", "NaN,0"]


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_parse_keeps_good_lines(spark):
    got = [(r.x, r.y) for r in parse_points(lines(spark, GOOD)).collect()]
    assert got[:3] == [(1.5, 2.5)] * 3 and got[3][0] != got[3][0]


@pytest.mark.parametrize("bad", ["abc,1", "7", "", "1,"])
def test_parse_fails_on_bad_lines(spark, bad):
    with pytest.raises(Exception, match="not a coordinate"):
        parse_points(lines(spark, GOOD + [bad])).collect()


def test_parse_drops_bad_lines_on_request(spark):
    assert parse_points(lines(spark, GOOD + ["abc,1", "7"]), on_error="drop").count() == len(GOOD)
    with pytest.raises(ValueError):
        parse_points(lines(spark, GOOD), on_error="ignore")


def test_read_batch_files(spark, tmp_path):
    (tmp_path / "batch_0.txt").write_text("1,2\n1,2\n3,4\n")
    (tmp_path / "batch_11.txt").write_text("5,6,x\n")
    folder = tmp_path / "batch_2.txt"
    folder.mkdir()
    (folder / "part-00000").write_text("7,8\n")
    points = read_points_text(spark, [str(tmp_path / f"batch_{i}.txt") for i in (0, 2, 11)])
    rows = points.collect()
    assert sorted((r.batch_id, r.x, r.y) for r in rows) == [(0, 1, 2), (0, 1, 2), (0, 3, 4), (2, 7, 8), (11, 5, 6)]
    assert len({r.point_id for r in rows}) == 5
    assert dedup_batch(points).count() == 4


def test_points_from_any_table(spark):
    df = spark.range(3).select("id", F.col("id").cast("string").alias("a"))
    rows = points_from(df, "a", F.lit(2), "id", F.col("id") % 2).collect()
    assert sorted((r.point_id, r.batch_id, r.x, r.y) for r in rows) == [(0, 0, 0.0, 2.0), (1, 1, 1.0, 2.0), (2, 0, 2.0, 2.0)]
