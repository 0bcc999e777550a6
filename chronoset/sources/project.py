"""Timed-event tables as projections of the driver's tables: one hour is one unit of time.

notes(track, note_id, onset, duration, pitch, confidence, source), beats(track, beat_idx, t), frames(track, frame, pitch,
periodicity, level). SQL holds the same projections as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Units between beats, and beats of a track.
PERIOD, BEATS = 12.0, 61
LONGEST = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a window's task, about.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, count: int, key: str) -> DataFrame:
    """rows by key in as many partitions as `count` rows need, so that what a task sorts doesn't grow with the table; a table that few
    partitions hold stays as it is."""
    parts = count // TASK_ROWS
    return rows.repartition(parts, key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int")
    e = e.select(F.col("user_id").alias("track"), F.col("event_id").alias("note_id"), (micros / F.lit(3.6e9)).alias("onset"), (F.lit(48) + F.pmod(k, F.lit(12))).alias("pitch"), (F.col("value") / (F.lit(1.0) + F.col("value"))).alias("confidence"), F.col("event_type").alias("source"))
    gap = F.lead("onset").over(Window.partitionBy("track").orderBy("onset", "note_id")) - F.col("onset")
    return e.withColumn("duration", F.least(F.coalesce(gap, F.lit(LONGEST)), F.lit(LONGEST)))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by key in a fixed count of partitions: few bytes may be long work, and partitions are else merged by their bytes."""
    context = rows.sparkSession.sparkContext
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), context.defaultParallelism), *keys)


def beats(spark: SparkSession, sf_dir: str, apart: bool = False) -> DataFrame:
    """A regular grid for each track, shifted a little by track; apart: a track's beats are made where spread() puts it."""
    tracks = table(spark, sf_dir, "events").select(F.col("user_id").alias("track"))
    tracks = (spread(tracks, "track") if apart else tracks).distinct()
    grid = tracks.select("track", F.explode(F.sequence(F.lit(0), F.lit(BEATS - 1))).alias("beat_idx"))
    return grid.withColumn("t", F.pmod("track", F.lit(7)) * 0.5 + F.col("beat_idx") * PERIOD)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    li = dealt(li.select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_discount"), li.count(), "l_suppkey")
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return li.select(F.col("l_suppkey").alias("track"), (F.row_number().over(order) - 1).alias("frame"), F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("pitch"), F.col("l_discount").alias("periodicity"), F.col("l_extendedprice").alias("level"))


SQL = {
    "notes": """notes AS (
      SELECT user_id AS track, event_id AS note_id, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS onset,
             48 + regexp_extract(props, '"k": *(\\d+)', 1)::INT % 12 AS pitch, value / (1.0 + value) AS confidence, event_type AS source,
             least(coalesce(lead((epoch_us(ts) - 1704067200000000) / 3.6e9) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                            - (epoch_us(ts) - 1704067200000000) / 3.6e9, 0.5), 0.5) AS duration
      FROM events)""",
    "beats": """beats AS (
      SELECT track, beat_idx::INT AS beat_idx, (track % 7) * 0.5::DOUBLE + beat_idx * 12.0::DOUBLE AS t
      FROM (SELECT DISTINCT user_id AS track FROM events), range(61) r(beat_idx))""",
    "frames": """frames AS (
      SELECT l_suppkey AS track, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
             l_quantity, l_extendedprice) - 1)::INT AS frame, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS pitch,
             l_discount AS periodicity, l_extendedprice AS level FROM lineitem)""",
}


def with_sql(*names: str) -> str:
    """WITH and the named projections, for more expressions to follow."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
