"""Parsing rules B1-B8 and the text sources (FIXTURES.md sections 1-4)."""

from pyspark.sql import functions as F

from kestrel.functions.parse import (
    parse_point_fields, parse_rating_fields, parse_tuple_point, trim_controls)
from kestrel.sources.text import clean_rating_lines, read_points_csv, read_ratings


def _rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_noisy_line_stream(spark):
    # fixed 1400-byte style buffers: NUL padding, packed lines, a short fragment
    sends = spark.createDataFrame(
        [("\x00\x00 1::2::3",), ("4::5::1\n6::7::2\x00\x00\x00",), ("9::8\x00",), ("12\x00\x00",)],
        "value string")
    out = clean_rating_lines(sends)
    good = sorted((r["user"], r["item"], r["rating"]) for r in
                  out.filter("reject IS NULL").collect())
    assert good == [(1, 2, 3.0), (4, 5, 1.0), (6, 7, 2.0)]
    rejects = sorted(r["reject"] for r in out.filter("reject IS NOT NULL").collect())
    assert rejects == ["fragment", "fragment"]


def test_trim_removes_nul_but_f_trim_does_not(spark):
    df = spark.createDataFrame([("\x00\x00 1::2::3 \x01",)], "v string")
    r = df.select(trim_controls("v").alias("a"), F.trim("v").alias("b")).first()
    assert r["a"] == "1::2::3"
    assert r["b"] != "1::2::3"


def test_point_stream_arity_rules(spark):
    d = 3
    lines = ["1,5,6,7", "0,5,6", "2.7,5,6,7,99", "-1,5,6,7", "1,5,6,7,8,9", "1,5,x,7",
             "bad,1,2,3", "1,5,6,7,"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, v string")
    out = {r["i"]: r["p"] for r in
           df.select("i", parse_point_fields(F.col("v"), d, mode="stream").alias("p")).collect()}
    assert out[0]["x"] == [5.0, 6.0, 7.0, 1.0] and out[0]["y"] == 1.0
    assert out[1]["x"] == [5.0, 6.0, 0.0, 1.0] and out[1]["y"] == -1.0   # short row keeps 0.0
    assert out[2]["x"] == [5.0, 6.0, 7.0, 1.0] and out[2]["y"] == -1.0   # d+1: extra dropped; 2.7 -> 2
    assert out[2]["reject"] is None
    assert out[3]["y"] == 1.0                                           # JVM remainder: -1 is odd
    assert out[4]["reject"] == "too_many_fields"
    assert out[5]["reject"] == "bad_feature"
    assert out[6]["reject"] == "bad_label"
    assert out[7]["reject"] is None and out[7]["x"] == [5.0, 6.0, 7.0, 1.0]  # trailing comma


def test_length_guard_optional(spark):
    df = spark.createDataFrame([("1,1,1",)], "v string")
    p = df.select(parse_point_fields(F.col("v"), 2, min_length=12).alias("p")).first()["p"]
    assert p["reject"] == "short_line"
    p = df.select(parse_point_fields(F.col("v"), 2).alias("p")).first()["p"]
    assert p["reject"] is None


def test_point_file_mode_exact_arity(spark):
    df = spark.createDataFrame([("1,2,3",), ("1,2",), ("1,2,3,4",)], "v string")
    rej = [r["p"]["reject"] for r in
           df.select(parse_point_fields(F.col("v"), 2, mode="file").alias("p")).collect()]
    assert rej == [None, "arity", "arity"]


def test_tuple_points(spark):
    df = spark.createDataFrame([("(1.5,[2.0,3.0])",), ("bad",), ("(2,[1,x])",), ("0.5,1 2",)],
                               "v string")
    out = [r["p"] for r in df.select(parse_tuple_point(F.col("v"), 2).alias("p")).collect()]
    assert out[0]["y"] == 1.5 and out[0]["x"] == [2.0, 3.0] and out[0]["reject"] is None
    assert out[1]["y"] is None and out[1]["reject"] is not None
    assert out[2]["reject"] == "bad_feature"
    assert out[3]["x"] == [1.0, 2.0] and out[3]["reject"] is None


def test_rating_fields(spark):
    df = spark.createDataFrame([("196::242::3",), ("1::2::3::extra",), ("1.5::2::3",),
                                ("1::2",), ("1::2::x",)], "v string")
    out = [r["p"] for r in df.select(parse_rating_fields(F.col("v")).alias("p")).collect()]
    assert (out[0]["user"], out[0]["item"], out[0]["rating"]) == (196, 242, 3.0)
    assert out[1]["reject"] is None and out[1]["rating"] == 3.0
    assert [o["reject"] for o in out[2:]] == ["bad_field", "arity", "bad_field"]


def test_bounded_files(spark, scratch):
    pts = f"{scratch}/pts.txt"
    with open(pts, "w") as fh:
        fh.write("0,5,1,1\n1,2,3,4\n1,2,3\n")
    good, bad = read_points_csv(spark, pts, 3, with_rejects=True)
    g = sorted((r["seq"], r["y"], tuple(r["x"])) for r in good.collect())
    assert g == [(0, -1.0, (5.0, 1.0, 1.0, 1.0)), (1, 1.0, (2.0, 3.0, 4.0, 1.0))]
    assert [r["reject"] for r in bad.collect()] == ["arity"]
    rt = f"{scratch}/ratings.txt"
    with open(rt, "w") as fh:
        fh.write("196::242::3\n186::302::3\n22::377::1\n")
    assert read_ratings(spark, rt).count() == 3
