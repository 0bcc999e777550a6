"""Set operations, dedupe, sampling, splits and generated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_share
from .islands import by
from .joins import band_join


def salted_split(rows: DataFrame, key: str, salt: str, share: float) -> DataFrame:
    """rows with `is_test`: whether the salted digest of the key falls in the share."""
    return rows.withColumn("is_test", hash_share(F.col(key).cast("string"), salt) < share)


def duplicate_groups(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(digest, key, n, keeper) of rows whose content others have too: by size first, then by digest; the least key is kept.

    Sizes narrow what is hashed to rows that can have a copy.
    """
    sized = rows.select(key, content, F.length(content).alias("size"))
    sizes = sized.groupBy("size").count().where("count > 1").select("size")
    digested = sized.join(sizes, "size", "left_semi").select(key, F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    groups = digested.groupBy("digest").agg(F.count("*").alias("n"), F.min(key).alias("keeper")).where("n > 1")
    return digested.join(groups, "digest").select("digest", key, "n", "keeper")


def top_k(rows: DataFrame, value: str, k: int) -> DataFrame:
    """(value, n): the k most frequent values, ties in order of the value."""
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)


def round_robin(rows: DataFrame, stratum: list[str], order: list, k: int) -> DataFrame:
    """k rows, a row of each stratum in turn, scarce strata first."""
    turn = F.row_number().over(Window.partitionBy(*stratum).orderBy(*order))
    size = F.count("*").over(Window.partitionBy(*stratum))
    out = rows.withColumn("turn", turn).withColumn("size", size)
    return out.orderBy("turn", "size", *stratum, *order).limit(k)


def sample(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows by the least salted digests of their keys."""
    return rows.withColumn("__d", F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"), 256)).orderBy("__d", key).limit(n).drop("__d")


def recent(rows: DataFrame, key: str, time: str, k: int) -> DataFrame:
    """(key, time): each key's latest time, the k latest keys."""
    return rows.groupBy(key).agg(F.max(time).alias(time)).orderBy(F.desc(time), key).limit(k)


def pool(candidates: DataFrame, notes: DataFrame, tolerance: float) -> DataFrame:
    """Candidates without a note of their track and pitch within the tolerance."""
    there = notes.select(F.col("track").alias("__track"), F.col("pitch").alias("__pitch"), F.col("onset").alias("__onset"))
    return band_join(candidates, there, [("track", "__track"), ("pitch", "__pitch")], "onset", "__onset", tolerance, "left_anti")


def halve_beats(beats: DataFrame) -> DataFrame:
    """(track, t, implied): beats and the middles between them."""
    nxt = F.lead("t").over(by("track", "t"))
    both = beats.select("track", "t", nxt.alias("n")).select("track", F.explode(F.array(F.struct(F.col("t").alias("t"), F.lit(False).alias("implied")), F.struct(((F.col("t") + F.col("n")) / 2).alias("t"), F.lit(True).alias("implied")))).alias("x"))
    return both.select("track", "x.t", "x.implied").where("t is not null")


def merge_chords(notes: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of the keys: the longest note's pitch, its duration, and all pitches in order."""
    return notes.groupBy(*keys).agg(F.max_by("pitch", F.struct("duration", "pitch")).alias("pitch"), F.max("duration").alias("duration"), F.array_sort(F.collect_set("pitch")).alias("chord"))


def unpivot(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return rows.unpivot(keys, values, "name", "value")


def merge_outer(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A full outer merge: the left value, or else the right one, and where it comes from."""
    a, b = left.select(*keys, F.col(value).alias("__a")), right.select(*keys, F.col(value).alias("__b"))
    out = a.join(b, keys, "full")
    side = F.when(F.col("__a").isNull(), "right").when(F.col("__b").isNull(), "left").otherwise("both")
    return out.select(*keys, F.coalesce("__a", "__b").alias(value), side.alias("side"))
