"""Text sources: bounded files (A1, A3), directory and socket streams (A2, A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.parse import (
    parse_once, parse_point_fields, parse_ratings, parse_tuple_point, trim_controls)


MAX_BROADCAST_FILES = 100_000
#: What a file source tells of a line's arrival: file time, file, and place of its block in the file.
ARRIVAL = ("_file_time", "_file_path", "_file_block")


def with_arrival(lines: DataFrame) -> DataFrame:
    """Add the ``ARRIVAL`` columns to lines read from files."""
    return lines.select("*", F.col("_metadata.file_modification_time").alias("_file_time"),
                        F.col("_metadata.file_path").alias("_file_path"),
                        F.col("_metadata.file_block_start").alias("_file_block"))


def _arrival(df: DataFrame) -> list[str]:
    return [c for c in ARRIVAL if c in df.columns]


def _split_rejects(parsed: DataFrame, keep: list) -> tuple[DataFrame, DataFrame]:
    good = parsed.filter(F.col("reject").isNull()).select(*keep)
    bad = parsed.filter(F.col("reject").isNotNull())
    return good, bad


def read_points_csv(spark: SparkSession, path: str, d: int,
                    with_rejects: bool = False):
    """A1: bounded ``label,f1,...,fd`` file -> (seq, y, x) with bias; rows out of arity rejected.

    ``seq`` is the line's position within the file set (file name, then offset)
    through the ordinal operator, so it is stable for a given input.
    """
    from kestrel.operators.ordinal import with_ordinal
    raw = (spark.read.text(path)
           .select(F.col("value"), F.col("_metadata.file_path").alias("_file"),
                   F.monotonically_increasing_id().alias("_mid")))
    parsed = parse_once(raw, parse_point_fields(F.col("value"), d, mode="file"),
                        "value", "_file", "_mid")
    good, bad = _split_rejects(parsed, ["_file", "_mid", "y", "x"])
    # files in name order, lines in file order: rank the (few) file names, then
    # number rows by (file rank, position)
    files = sorted(r["_file"] for r in raw.select("_file").distinct().collect())
    ranks = spark.createDataFrame(list(enumerate(files)), "_frank long, _file string")
    # one row per input file: broadcast only while that is small, else let AQE choose
    good = good.join(F.broadcast(ranks) if len(files) <= MAX_BROADCAST_FILES else ranks, "_file")
    # bucket on a key monotone in (file rank, position) so one big file still
    # spreads over all buckets; ties in the double key are ordered by the columns
    key = F.col("_frank").cast("double") * F.lit(float(2 ** 54)) + F.col("_mid").cast("double")
    good = with_ordinal(good, ["_frank", "_mid"], out="seq", bucket_key=key) \
        .select("seq", "y", "x")
    if with_rejects:
        return good, bad.select("value", "reject")
    return good


def read_ratings(spark: SparkSession, path: str, sep: str = "::",
                 with_rejects: bool = False):
    """A3: bounded ``user::item::rating`` file -> (user, item, rating)."""
    parsed = parse_ratings(spark.read.text(path), "value", sep, keep=["value"])
    good, bad = _split_rejects(parsed, ["user", "item", "rating"])
    if with_rejects:
        return good, bad.select("value", "reject")
    return good


def read_points_stream(spark: SparkSession, directory: str,
                       num_features: int | None = None) -> DataFrame:
    """A2: watch a directory; every line ``(y,[x1,...,xn])`` of a new file is a point.

    Returns a streaming frame (value, y, x, reject and the ``ARRIVAL`` columns, which
    order a micro-batch); callers route ``reject IS NOT NULL`` rows to a reject sink.
    """
    raw = with_arrival(spark.readStream.format("text").load(directory))
    return parse_once(raw, parse_tuple_point(F.col("value"), num_features), "value", *ARRIVAL)


def read_lines_stream(spark: SparkSession, host: str = "localhost", port: int = 9999,
                      fmt: str = "socket", path: str | None = None) -> DataFrame:
    """A4: unbounded newline text.

    ``fmt="socket"`` is the reference's transport (not fault tolerant; for demos);
    ``fmt="text"`` watches ``path`` (replayable, the production choice).  The
    frame is built lazily; nothing connects until a query starts.
    """
    if fmt == "socket":
        return (spark.readStream.format("socket")
                .option("host", host).option("port", port).load())
    if fmt == "text":
        if path is None:
            raise ValueError("path is required for a file-backed line stream")
        return with_arrival(spark.readStream.format("text").load(path))
    raise ValueError(f"unknown line stream format {fmt!r}")


def points_from_lines(lines: DataFrame, d: int, value: str = "value",
                      min_length: int | None = None) -> DataFrame:
    """A4 + B1-B7 for the points wire (V1 stream path): packed lines are split,
    control padding trimmed, each line parsed with the stream arity rules.

    A text line has no order key: :class:`StreamingGLM` numbers each micro-batch
    by arrival (file time, file, place) and continues the global ordinal from the rows
    already seen.  Output: y, x, reject and the ``ARRIVAL`` columns that the lines have.
    """
    here = _arrival(lines)
    exploded = lines.select(F.explode(F.split(F.col(value), "\n")).alias("raw"), *here)
    trimmed = exploded.select(trim_controls(F.col("raw")).alias("line"), *here)
    return parse_once(trimmed.filter(F.length("line") > 0),
                      parse_point_fields(F.col("line"), d, mode="stream", min_length=min_length), *here)


def clean_rating_lines(lines: DataFrame, value: str = "value", min_length: int = 5) -> DataFrame:
    """B1 + B3 + B2 + B4 for the noisy ratings wire: explode packed lines, trim
    control padding, drop fragments shorter than ``min_length``, parse."""
    exploded = lines.select(F.explode(F.split(F.col(value), "\n")).alias("raw"))
    trimmed = exploded.select(trim_controls(F.col("raw")).alias("line"))
    return parse_ratings(trimmed, "line", "::", min_length, keep=["line"])
