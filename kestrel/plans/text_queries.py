"""Registered parser queries over text lines derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.parse import parse_once, parse_point_fields, parse_ratings
from kestrel.plans import params as P
from kestrel.session import remove_scratch, scratch_path
from kestrel.sources.buffers import BUFFER_BYTES, SLICE_BUFFERS, BufferSource
from kestrel.sources.replay import batch_rows
from kestrel.sources.tables import ratings_from_orders, read_table, text_point_lines, text_rating_lines
from kestrel.sources.text import clean_rating_lines
from kestrel.streaming.modelstore import write_part


def points_parse_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 rules on ``label,f1,f2`` lines: exact arity, +-1 label, bias appended."""
    lines = text_point_lines(spark, sf_dir)
    p = parse_once(lines, parse_point_fields(F.col("value"), P.TEXT_D, mode="file"), "seq")
    good = p.filter(F.col("reject").isNull())
    return good.select("seq", "y", *[F.col("x")[i].alias(f"x{i + 1}") for i in range(P.TEXT_D + 1)])


def points_reject_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 + B4 + B7 on the stream path: length guard 10 + d, arity, castability."""
    lines = text_point_lines(spark, sf_dir)
    p = parse_once(lines, parse_point_fields(F.col("value"), P.TEXT_D, mode="stream",
                                             min_length=10 + P.TEXT_D))
    return (p.select(F.coalesce(F.col("reject"), F.lit("ok")).alias("reason"))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines")))


def packed_sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy sender buffers: NUL/blank padding, the line, then a short fragment."""
    nul = "\u0000"
    lines = text_rating_lines(spark, sf_dir)
    return lines.select(F.concat(
        F.lit(nul + nul + " "), F.col("value"), F.lit("\n"),
        F.substring(F.col("value"), 1, 3), F.lit(nul + nul)).alias("value"))


def lines_explode_trim_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 + B3 + B2: explode packed sends, trim control padding, drop fragments."""
    parsed = clean_rating_lines(packed_sends(spark, sf_dir))
    return parsed.filter(F.col("reject").isNull()).select("line")


def ratings_parse_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 + B4: ``user::item::rating`` lines -> typed ratings."""
    lines = text_rating_lines(spark, sf_dir)
    p = parse_ratings(lines, "value", "::")
    return p.filter(F.col("reject").isNull()).select("user", "item", "rating")


def odd_point_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, value): point lines of every arity and fault, by ``event_id % 8``."""
    ev = read_table(spark, sf_dir, "events")
    label = F.when(F.col("event_type") == "purchase", F.lit("1")).otherwise(F.lit("0"))
    a, b, kind = (F.col("user_id") % 10).cast("string"), F.col("value").cast("string"), F.col("event_id") % 8
    line = (F.when(kind == 1, F.concat_ws(",", label, a))
            .when(kind == 2, F.concat_ws(",", label, a, b, F.lit("7.5")))
            .when(kind == 3, F.concat_ws(",", label, a, b, F.lit("7.5"), F.lit("8.5")))
            .when(kind == 4, F.concat_ws(",", F.lit("none"), a, b))
            .when(kind == 5, F.concat_ws(",", label, F.lit("n/a"), b))
            .when(kind == 6, label)
            .when(kind == 7, F.lit(None).cast("string"))
            .otherwise(F.concat_ws(",", label, a, b)))
    return ev.select(F.col("event_id").alias("seq"), line.alias("value"))


def points_arity_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every outcome of the stream's arity rules, with the values that accepted lines get."""
    p = parse_once(odd_point_lines(spark, sf_dir),
                   parse_point_fields(F.col("value"), P.TEXT_D, mode="stream", min_length=P.ARITY_LENGTH), "seq")
    ok = F.col("reject").isNull()
    return p.select("seq", F.coalesce("reject", F.lit("ok")).alias("outcome"), F.when(ok, F.col("y")).alias("y"),
                    *[F.when(ok, F.col("x")[i]).alias(f"x{i + 1}") for i in range(P.TEXT_D + 1)])


def ratings_rejects_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating lines by outcome, rejected ones among them, and the sum of the accepted ratings."""
    r, kind = ratings_from_orders(spark, sf_dir), F.col("orderkey") % 7
    user, item, rating = (F.col(c).cast("string") for c in ("user", "item", "rating"))
    lines = r.select((F.when(kind == 1, F.concat_ws("::", user, item))
                      .when(kind == 2, F.concat_ws("::", user, F.lit("item"), rating))
                      .when(kind == 3, F.concat_ws("::", user, item, F.lit("five")))
                      .when(kind == 4, F.substring(rating, 1, 2))
                      .when(kind == 5, F.concat_ws("::", user, item, rating, F.lit("978300760")))
                      .otherwise(F.concat_ws("::", user, item, rating))).alias("value"))
    p = parse_ratings(lines, "value", "::", min_length=5)
    return (p.groupBy(F.coalesce("reject", F.lit("ok")).alias("outcome"))
            .agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.when(F.col("reject").isNull(), F.col("rating"))).alias("rating_sum")))


def stream_lines_clean_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 through a stream that can be replayed: buffers of fixed size, cleaned batch by batch."""
    spark.dataSource.register(BufferSource)
    sent, out = scratch_path(spark, "buffers"), scratch_path(spark, "lines")
    # a buffer: the packed lines and NULs up to its size; the separator is its last byte.  Files are gzipped, as NULs are
    # most of them, and hold what a task reads at a time
    written = Observation()
    (packed_sends(spark, sf_dir).select(F.rpad("value", BUFFER_BYTES - 1, "\u0000").alias("value"))
     .observe(written, F.count(F.lit(1)).alias("n"))
     .write.option("compression", "gzip").option("maxRecordsPerFile", SLICE_BUFFERS).text(sent))
    stream = (spark.readStream.format("buffers").option("path", sent)
              .option("maxBuffersPerTrigger", batch_rows(written.get["n"])).load())

    def clean(batch: DataFrame, batch_id: int) -> None:
        lines = clean_rating_lines(batch).filter(F.col("reject").isNull()).select("line")
        write_part(lines, out, f"{batch_id:09d}")

    query = (stream.writeStream.foreachBatch(clean).option("checkpointLocation", scratch_path(spark, "ckpt"))
             .trigger(processingTime="0 seconds").start())
    query.processAllAvailable()
    query.stop()
    remove_scratch(spark, sent)
    return spark.read.schema("line string").parquet(out).select("line")
