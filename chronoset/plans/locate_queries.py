"""Queries that find excerpts in pages and scores in recordings, and place scores on anchors; all derived from the notes of tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clocks, locate
from ..sources.project import SQL, notes
from .registry import query


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, place, n, note_id, onset, pitch, confidence): a track's notes in order."""
    w = Window.partitionBy("track")
    n = notes(spark, sf_dir).withColumn("place", F.row_number().over(w.orderBy("onset", "note_id")) - 1).withColumn("n", F.count("*").over(w))
    return n.select("track", "place", "n", "note_id", "onset", "pitch", "confidence")


def _renumbered(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("place")) - 1)


def pages_and_excerpts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A page is a track in eighths. An excerpt is its middle half, transposed, without some notes, counted from a bar of its own; of
    odd tracks, its second part is a bar later than on the page, which leaves that bar out."""
    line = _lines(spark, sf_dir)
    pages = line.select(F.col("track").alias("page"), "place", (F.col("place") * 0.5).alias("position"), "pitch", (F.floor(F.col("place") / 8) + 1).alias("bar"))
    half = line.where((F.col("place") >= F.floor(F.col("n") / 4)) & (F.col("place") < F.floor(F.col("n") * 0.75)) & (F.col("note_id") % 11 != 0))
    late = F.when((F.col("track") % 2 == 1) & (F.col("place") >= F.floor(F.col("n") / 2)), 4.0).otherwise(0.0)
    own = half.select(F.col("track").alias("excerpt"), "place", (F.col("place") * 0.5 - 6 + late).alias("position"), (F.col("pitch") - F.col("track") % 5 + 2).alias("pitch"))
    return pages, _renumbered(own, "excerpt")


@query()
def locate_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page, transposition and window of each excerpt, found among all pages."""
    pages, own = pages_and_excerpts(spark, sf_dir)
    out = locate.locate(own, pages, "excerpt", "page")
    return out.select("excerpt", "page", "transposition", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "clock_share", "coverage", "recall")], "matched", "page_notes", "first_bar", "last_bar", "same_take")


@query()
def crop_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of the pages within the excerpts' windows."""
    pages, own = pages_and_excerpts(spark, sf_dir)
    return locate.crop(pages, locate.locate(own, pages, "excerpt", "page"), "excerpt", "page").select("excerpt", "page", "place", "position", "pitch", "bar")


def scores_and_recordings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A recording is a track; a score its middle half, three semitones lower, at two quarters a unit of time from its first note on,
    without some notes and with some that aren't played."""
    line = _lines(spark, sf_dir)
    half = line.where((F.col("place") >= F.floor(F.col("n") / 4)) & (F.col("place") < F.floor(F.col("n") * 0.75)) & (F.col("note_id") % 13 != 0))
    first = F.min("onset").over(Window.partitionBy("track"))
    score = half.select(F.col("track").alias("score"), "place", F.round((F.col("onset") - first) * 2, 3).alias("position"), (F.col("pitch") - 3 + F.when(F.col("note_id") % 17 == 0, 5).otherwise(0)).alias("pitch"))
    size = score.groupBy("score").agg(F.ceil(F.max("position") + 1).cast("double").alias("quarters"))
    return _renumbered(score, "score"), line.select(F.col("track").alias("rec"), "place", "onset", "pitch"), size


@query()
def locate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each score begins and ends in its recording, by its clock."""
    scores, recordings, size = scores_and_recordings(spark, sf_dir)
    out = locate.locate_score(scores, recordings, "score", "rec", size)
    return out.select("score", "rec", "transposition", "matched", "anchors", "votes", "trusted", *[F.round(c, 6).alias(c) for c in ("start", "end", "seconds_per_quarter", "on_line", "placed", "residual")])


#: The offbeat of the anchors is late by this much, a quarter lasts so long, and every so many anchors is a chance match.
LATE, QUARTER, CHANCE = 0.17, 0.3, 23
_ANCHORS = "WITH " + SQL["notes"] + f""", ln AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY onset, note_id) - 1 AS place FROM notes),
an AS (SELECT track, place * 0.5::DOUBLE AS position, (floor(place / 2) + CASE WHEN place % 2 = 1 THEN 0.5 + {LATE} ELSE 0.0 END) * {QUARTER}::DOUBLE + round(confidence * 0.02, 6) + CASE WHEN note_id % {CHANCE} = 0 THEN 0.9 ELSE 0.0 END AS t FROM ln WHERE note_id % 3 <> 1)"""


def anchors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighths of a track with the time at which two thirds of them were heard."""
    line = _lines(spark, sf_dir).where("note_id % 3 != 1")
    heard = (F.floor(F.col("place") / 2) + F.when(F.col("place") % 2 == 1, 0.5 + LATE).otherwise(0.0)) * QUARTER
    return line.select("track", (F.col("place") * 0.5).alias("position"), (heard + F.round(F.col("confidence") * 0.02, 6) + F.when(F.col("note_id") % CHANCE == 0, 0.9).otherwise(0.0)).alias("t"))


@query(_ANCHORS + """, tr AS (SELECT track, d, floor(position) + CASE WHEN position - floor(position) <= 0.5 THEN (position - floor(position)) * (0.5 + d) / 0.5 ELSE 0.5 + d + (position - floor(position) - 0.5) * (0.5 - d) / 0.5 END AS x, t FROM an, (SELECT k / 100.0::DOUBLE AS d FROM range(21) r(k))),
di AS (SELECT track, d, x, min(t) AS t FROM tr GROUP BY track, d, x),
er AS (SELECT track, d, lag(t) OVER w + (lead(t) OVER w - lag(t) OVER w) * (x - lag(x) OVER w) / (lead(x) OVER w - lag(x) OVER w) - t AS e FROM di WINDOW w AS (PARTITION BY track, d ORDER BY x)),
co AS (SELECT track, d, round(coalesce(avg(abs(e)), 0.0), 12) AS cost FROM er GROUP BY track, d), be AS (SELECT track, arg_min(d, (cost, d)) AS delay FROM co GROUP BY track), si AS (SELECT track, count(*) AS n FROM an GROUP BY track)
SELECT track, CASE WHEN n >= 20 THEN delay ELSE 0.0 END AS delay FROM be JOIN si USING (track)""")
def offbeat_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delay of the offbeat under which a track's anchors place each other best."""
    return locate.fit_delay(anchors_of(spark, sf_dir), "track")


@query()
def tame_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track's anchors without those that their neighbours put elsewhere."""
    return locate.drop_wild(anchors_of(spark, sf_dir).withColumnRenamed("position", "x"), "track").select("track", "x", F.round("t", 6).alias("t"))


@query()
def notes_on_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note of a track in seconds, on the lines between its anchors."""
    n = _lines(spark, sf_dir).select("track", F.col("note_id").alias("note"), (F.col("place") * 0.5).alias("position"), F.lit(0.25).alias("duration"))
    out = locate.place_on_anchors(n, anchors_of(spark, sf_dir), "track")
    return out.select("track", "note", *[F.round(c, 6).alias(c) for c in ("onset", "duration")], "delay", F.round("seconds_per_quarter", 6).alias("seconds_per_quarter"))


@query()
def affine_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset and rate of each recording's second issue: its notes at another speed, some of them missing and some others added."""
    n = notes(spark, sf_dir).select(F.floor(F.col("track") / 10).alias("rec"), F.col("note_id").alias("id"), "onset", "pitch", "confidence")
    rate, offset = 0.95 + (F.col("rec") % 11) / 100, (F.col("rec") % 7) * 1.5 - 4
    heard = n.where("id % 5 != 0").select("rec", (F.col("onset") * rate + offset + (F.col("confidence") - 0.5) * 0.02).alias("onset"), (F.col("pitch") + F.when(F.col("id") % 13 == 0, 1).otherwise(0)).alias("pitch"))
    out = clocks.fit_affine(n.drop("confidence"), heard, "rec")
    return out.select("rec", F.round("offset", 4).alias("offset"), F.round("rate", 6).alias("rate"), "hits")
