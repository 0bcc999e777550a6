"""Chords made of a line and what was struck with it, and notes that were split joined again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .islands import anchored_clusters, by, island_id
from .joins import asof_join, band_join, nearest_join

_NOTE = ["note_id", "onset", "duration", "pitch"]


def with_chords(line: DataFrame, extras: DataFrame, tolerance: float, longest: bool = False) -> DataFrame:
    """(track, note_id, onset, duration, pitch, chord): the line's notes with the extras struck within the tolerance of them.

    Extras are taken in time. One without a host so near becomes a host itself, for those after it; hosts among the extras are so
    more than the tolerance apart, and the last of them is the only one that can be near, which makes them the first rows of anchored
    clusters of the extras that no line note is near. An extra joins the nearest host: of equally near ones the line's, the earlier.
    chord holds the members' other pitches, ascending; a member of the host's own pitch adds nothing. The host's duration stays, or is
    that of the longest member. note_id is unique; both sides are (track, note_id, onset, duration, pitch).
    """
    line, extras = line.select("track", *_NOTE), extras.select("track", *_NOTE)
    hosts = line.select("track", F.col("onset").alias("h_onset"), F.struct(*_NOTE).alias("host"))
    near = nearest_join(extras, hosts, ["track"], "onset", "h_onset", ["host"], tolerance)
    near = near.withColumn("far", F.col("distance")).drop("distance")
    free = near.where("host is null").select("track", *_NOTE)
    heads = anchored_clusters(free, tolerance).groupBy("track", "cluster").agg(F.min_by(F.struct(*_NOTE), F.struct("onset", "note_id")).alias("head"))
    at = asof_join(near, heads.withColumnRenamed("cluster", "head_onset"), ["track"], "onset", "head_onset", ["head"])
    since = F.col("onset") - F.col("head.onset")
    mine = (since <= tolerance) & (F.col("far").isNull() | (since < F.col("far")))
    at = at.withColumn("to", F.when(mine, F.col("head")).otherwise(F.col("host")))
    every = line.union(heads.select("track", "head.*"))
    members = at.where(F.col("to.note_id") != F.col("note_id")).where(F.col("to.pitch") != F.col("pitch")).groupBy(F.col("to.note_id").alias("note_id")).agg(F.sort_array(F.collect_set("pitch")).alias("chord"), F.max("duration").alias("long"))
    out = every.join(members, "note_id", "left")
    size = F.greatest("duration", "long") if longest else F.col("duration")
    none = F.array().cast(f"array<{dict(line.dtypes)['pitch']}>")
    return out.select("track", "note_id", "onset", size.alias("duration"), "pitch", F.coalesce("chord", none).alias("chord"))


def rejoin_splits(notes: DataFrame, frames: DataFrame, attacks: DataFrame, hop: float, touch: float, hold: float, struck: float, agree: float = 0.5) -> DataFrame:
    """(track, note_id, onset, duration, pitch, confidence, joined): touching notes of one pitch as one, where nothing parts them.

    Two neighbours in time are one note if the second begins within `touch` of the first's end, all frames (track, frame, pitch) from
    `hold` before its onset to `hold` after it are there and within `agree` of the pitch, and no attack (track, t) is within `struck`
    of it. The first note of a chain lasts to the end of its last, with the best confidence; joined counts them.
    """
    w = by("track", "onset", "note_id")
    n = notes.withColumn("__end", F.lag(F.col("onset") + F.col("duration")).over(w)).withColumn("__pitch", F.lag("pitch").over(w))
    joins = n.where((F.col("__pitch") == F.col("pitch")) & (F.abs(F.col("__end") - F.col("onset")) <= touch)).select("track", "note_id", F.col("onset").alias("at"), F.col("pitch").alias("p"))
    span = F.sequence(F.bround((F.col("at") - hold) / hop).cast("long"), F.bround((F.col("at") + hold) / hop).cast("long"))
    asked = joins.withColumn("frame", F.explode(span))  # a few frames a join
    same = asked.join(frames.select("track", "frame", F.col("pitch").alias("f")), ["track", "frame"], "left").groupBy("track", "note_id", "at").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("f") - F.col("p")) < agree).alias("held"))
    same = same.where("n = held")
    hits = attacks.select(F.col("track").alias("a_track"), F.col("t").alias("a_t"))
    same = band_join(same, hits, [("track", "a_track")], "at", "a_t", struck, "left_anti").select("note_id", F.lit(True).alias("__goes_on"))
    n = notes.join(same, "note_id", "left").withColumn("chain", island_id(F.col("__goes_on").isNull(), w))
    out = n.groupBy("track", "chain").agg(F.min_by(F.struct("note_id", "onset", "pitch"), F.struct("onset", "note_id")).alias("x"), F.max_by(F.col("onset") + F.col("duration"), F.struct("onset", "note_id")).alias("end"), F.max("confidence").alias("confidence"), F.count("*").alias("joined"))
    return out.select("track", "x.note_id", "x.onset", (F.col("end") - F.col("x.onset")).alias("duration"), "x.pitch", "confidence", "joined")
