"""Two voices: triples that sound at once, tails under a new chord, crossings, and records resolved against notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import band_join, stabbing_join


def triples(pairs: DataFrame, least: float = 0.06, share: float = 0.3) -> DataFrame:
    """(a, b, c) of three notes that all hold a meaningful stretch together, from the pairs that overlap.

    pairs: a and b, structs of id, on, end and what else is wanted; each pair once, by smaller id first.
    """
    x = pairs.select(F.col("a.id").alias("p"), F.col("b.id").alias("q"), "a", "b")
    wedge = x.select("p", F.col("q").alias("q1"), "a", F.col("b").alias("b1")).join(x.select("p", F.col("q").alias("q2"), F.col("b").alias("b2")), "p").where("q1 < q2")
    closed = wedge.join(x.select(F.col("p").alias("q1"), F.col("q").alias("q2")), ["q1", "q2"]).select("a", F.col("b1").alias("b"), F.col("b2").alias("c"))
    each = ("a", "b", "c")
    shared = F.least(*[F.col(f"{v}.end") for v in each]) - F.greatest(*[F.col(f"{v}.on") for v in each])
    shortest = F.least(*[F.col(f"{v}.end") - F.col(f"{v}.on") for v in each])
    return closed.where((shared > 0) & ((shared >= least) | (shared >= share * shortest)))


def weakest(found: DataFrame) -> DataFrame:
    """(id): the least confident note of each triple, of equals the shorter, then the later.

    Going through all notes from the weakest on, each triple meets its own weakest member first, so no triple saves another's.
    """
    rank = lambda v: F.struct(F.col(f"{v}.conf"), (F.col(f"{v}.end") - F.col(f"{v}.on")).alias("d"), (-F.col(f"{v}.on")).alias("o"), F.col(f"{v}.id").alias("id"))
    return found.select(F.least(rank("a"), rank("b"), rank("c"))["id"].alias("id")).distinct()


def trim_at_chords(notes: DataFrame, chord: float, cell: float) -> DataFrame:
    """notes (voice, id, onset, end, pitch) with `end` no later than the first new chord: two pitches struck within `chord` of each
    other, more than that after the note began."""
    a = notes.select("voice", "id", "onset", "pitch")
    b = notes.select(F.col("voice").alias("b_voice"), F.col("id").alias("b_id"), F.col("onset").alias("b_on"), F.col("pitch").alias("b_pitch"))
    struck = band_join(a, b, [("voice", "b_voice")], "onset", "b_on", chord).where("pitch != b_pitch and (b_on > onset or (b_on = onset and b_id > id))")
    starts = struck.select(F.col("voice").alias("s_voice"), F.col("onset").alias("start")).distinct()
    spans = notes.select("voice", "id", F.col("onset").alias("lo"), "end")
    first = stabbing_join(starts, spans, [("s_voice", "voice")], "start", ("lo", "end"), cell).where(F.col("lo") < F.col("start") - chord).groupBy("id").agg(F.min("start").alias("first"))
    return notes.join(first, "id", "left").withColumn("end", F.least("end", F.coalesce("first", "end"))).drop("first")


def crossing(pairs: DataFrame, keys: list[str], low: Column, high: Column, shared: Column) -> DataFrame:
    """(keys, share, interval): the part of the time that two voices share in which the lower is above the upper, and the median
    interval between them, weighed by time."""
    from .pages import weighted_median

    p = pairs.select(*keys, (high - low).alias("step"), shared.alias("w"))
    share = p.groupBy(*keys).agg((F.sum(F.when(F.col("step") < 0, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("share"))
    return share.join(weighted_median(p.withColumn("step", F.abs("step")), keys, "step", "w").withColumnRenamed("median", "interval"), keys)


def resolve(records: DataFrame, pairs: DataFrame, notes: DataFrame, span: tuple[float, float], tolerance: float) -> DataFrame:
    """(id, status) of records (rec, id, onset): matched ones are silenced; others outside the span are carried; of the rest those
    with any note near are moved, and the others vanished."""
    near = band_join(records.select("rec", "id", "onset"), notes.select(F.col("rec").alias("n_rec"), F.col("onset").alias("n_on")), [("rec", "n_rec")], "onset", "n_on", tolerance, "left_semi").select("id", F.lit(True).alias("near"))
    out = records.join(pairs.select("id", F.lit(True).alias("matched")), "id", "left").join(near, "id", "left")
    return out.select("id", F.when(F.col("matched"), "silenced").when(~F.col("onset").between(*span), "carried").when(F.col("near"), "moved").otherwise("vanished").alias("status"))


