"""Queries of chords, of joined splits, and of what a file's clock says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import chords, engrave
from ..sources.project import SQL, notes
from .registry import query

_CHORDS = "WITH RECURSIVE " + SQL["notes"] + """, n AS (SELECT track // 50 AS rec, note_id AS id, onset, duration, pitch, source FROM notes
), line AS (SELECT * FROM n WHERE source = 'view'), ex AS (SELECT * FROM n WHERE source = 'click'
), lh AS (
  SELECT e.id, arg_min(l.id, (abs(l.onset - e.onset), l.onset, l.id)) AS host, min(abs(l.onset - e.onset)) AS d FROM ex e JOIN line l ON l.rec = e.rec AND abs(l.onset - e.onset) <= 0.1 GROUP BY e.id
), free AS (SELECT ex.* FROM ex ANTI JOIN lh USING (id)
), heads AS (
  SELECT rec, min(onset) AS onset FROM free GROUP BY rec
  UNION ALL SELECT rec, onset FROM (SELECT f.rec, f.onset, row_number() OVER (PARTITION BY f.rec ORDER BY f.onset) AS k FROM heads h JOIN free f ON f.rec = h.rec AND f.onset - h.onset > 0.1) WHERE k = 1
), head AS (SELECT h.rec, h.onset, min(f.id) AS id FROM heads h JOIN free f ON f.rec = h.rec AND f.onset = h.onset GROUP BY h.rec, h.onset
), near AS (SELECT e.id, e.pitch, e.duration, e.onset, lh.host, lh.d, h.id AS head, e.onset - h.onset AS since FROM ex e LEFT JOIN lh ON lh.id = e.id ASOF LEFT JOIN head h ON h.rec = e.rec AND h.onset <= e.onset
), too AS (SELECT id, pitch, duration, CASE WHEN since <= 0.1 AND (d IS NULL OR since < d) THEN head ELSE host END AS host FROM near
), every AS (SELECT * FROM line UNION ALL SELECT ex.* FROM ex JOIN head USING (id)
), members AS (SELECT t.host AS id, list_sort(list(DISTINCT t.pitch)) AS chord, max(t.duration) AS long FROM too t JOIN every h ON h.id = t.host WHERE t.id <> t.host AND t.pitch <> h.pitch GROUP BY t.host)"""


@query(_CHORDS + """
SELECT id AS note_id, round(greatest(duration, long), 6) AS duration, pitch, coalesce(array_to_string(chord, ' '), '') AS chord FROM every LEFT JOIN members USING (id)""")
def folded_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of a line and, struck with them, those of another detector; what has no host becomes one."""
    n = notes(spark, sf_dir).select(F.floor(F.col("track") / 50).alias("track"), "note_id", "onset", "duration", "pitch", "source")
    out = chords.with_chords(n.where("source = 'view'"), n.where("source = 'click'"), 0.1, longest=True)
    return out.select("note_id", F.round("duration", 6).alias("duration"), "pitch", F.array_join(F.col("chord").cast("array<string>"), " ").alias("chord"))


#: Seconds of a frame, how near touching notes are, how long a pitch must hold, and how near an attack parts them.
HOP, TOUCH, HOLD, STRUCK = 0.05, 0.03, 0.1, 0.04
_SPLITS = "WITH " + SQL["notes"] + f""", n AS (SELECT track, note_id, onset, duration, pitch - pitch % 4 AS pitch, confidence, source FROM notes
), lagged AS (SELECT *, lag(onset + duration) OVER w AS was, lag(pitch) OVER w AS before FROM n WINDOW w AS (PARTITION BY track ORDER BY onset, note_id)
), jo AS (SELECT track, note_id, onset AS spot, pitch AS p FROM lagged WHERE before = pitch AND abs(was - onset) <= {TOUCH}
), fr AS (SELECT *, unnest(range(round_even((spot - {HOLD}) / {HOP}, 0)::BIGINT, round_even((spot + {HOLD}) / {HOP}, 0)::BIGINT + 1)) AS frame FROM jo
), df AS (SELECT DISTINCT track, frame, frame * {HOP}::DOUBLE AS t FROM fr
), sounding AS (SELECT f.track, f.frame, CASE WHEN (f.frame + f.track) % 23 <> 0 AND f.t < n.onset + n.duration THEN n.pitch + CASE WHEN (f.frame * 7 + f.track) % 31 = 0 THEN 1 ELSE 0 END END AS f FROM df f ASOF JOIN n ON n.track = f.track AND n.onset <= f.t
), held AS (SELECT r.track, note_id, spot FROM fr r LEFT JOIN sounding s ON s.track = r.track AND s.frame = r.frame GROUP BY ALL HAVING count(*) = count(*) FILTER (WHERE abs(f - p) < 0.5)
), attack AS (SELECT track, onset + CASE WHEN note_id % 2 = 0 THEN 0.02 ELSE 0.3 END AS t FROM n WHERE source = 'purchase'
), one AS (SELECT note_id FROM held h WHERE NOT EXISTS (SELECT 1 FROM attack a WHERE a.track = h.track AND abs(a.t - h.spot) <= {STRUCK})
), ch AS (SELECT n.*, sum(CASE WHEN o.note_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY onset, n.note_id ROWS UNBOUNDED PRECEDING) AS chain FROM n LEFT JOIN one o ON o.note_id = n.note_id)"""


@query(_SPLITS + """
SELECT arg_min(note_id, (onset, note_id)) AS note_id, round(arg_max(onset + duration, (onset, note_id)) - min(onset), 6) AS duration, round(max(confidence), 6) AS confidence, count(*) AS joined FROM ch GROUP BY track, chain""")
def rejoined_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touching notes of one pitch as one where the trace holds it across the join and nothing is struck there."""
    n = notes(spark, sf_dir).withColumn("pitch", F.col("pitch") - F.col("pitch") % 4)
    w = Window.partitionBy("track").orderBy("onset", "note_id")
    at = n.withColumn("was", F.lag(F.col("onset") + F.col("duration")).over(w)).withColumn("before", F.lag("pitch").over(w)).where((F.col("before") == F.col("pitch")) & (F.abs(F.col("was") - F.col("onset")) <= TOUCH))
    # the trace around the joins: the sounding note's pitch, now and then nothing or a semitone off
    f = at.select("track", F.explode(F.sequence(F.bround((F.col("onset") - HOLD) / HOP).cast("long"), F.bround((F.col("onset") + HOLD) / HOP).cast("long"))).alias("frame")).distinct().withColumn("t", F.col("frame") * HOP)
    from ..operators.joins import asof_join

    f = asof_join(f, n.select("track", F.col("onset").alias("n_on"), (F.col("onset") + F.col("duration")).alias("end"), F.col("pitch").alias("p")), ["track"], "t", "n_on", ["end", "p"])
    heard = ((F.col("frame") + F.col("track")) % 23 != 0) & (F.col("t") < F.col("end"))
    f = f.select("track", "frame", F.when(heard, F.col("p") + F.when((F.col("frame") * 7 + F.col("track")) % 31 == 0, 1).otherwise(0)).alias("pitch"))
    attacks = n.where("source = 'purchase'").select("track", (F.col("onset") + F.when(F.col("note_id") % 2 == 0, 0.02).otherwise(0.3)).alias("t"))
    out = chords.rejoin_splits(n, f, attacks, HOP, TOUCH, HOLD, STRUCK)
    return out.select("note_id", F.round("duration", 6).alias("duration"), F.round("confidence", 6).alias("confidence"), "joined")


@query("WITH " + SQL["notes"] + """, f AS (SELECT track, ([480, 24, 96, 1000, 48, 51240])[track % 6 + 1] AS division, onset, note_id FROM notes
), g AS (SELECT track, division, CASE WHEN track % 4 = 0 THEN floor(onset * 24) * division // 24 ELSE floor(onset * division) END::BIGINT AS tick FROM f
), h AS (SELECT track, division, count(*) AS n, count(*) FILTER (WHERE 2 * least(tick * 24 % division, division - tick * 24 % division) <= 24) AS hits FROM g GROUP BY track, division
), d AS (SELECT DISTINCT division, len(list_filter(range(division), lambda t: 2 * least(t * 24 % division, division - t * 24 % division) <= 24)) / division AS chance FROM h
), t AS (
  SELECT h.*, chance, hits / n AS share, CASE WHEN chance >= 1 THEN 1.0 ELSE list_sum(list_transform(range(hits, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1) END + i * ln(chance) + (n - i) * ln(1 - least(chance, 0.999999))))) END AS tail FROM h JOIN d USING (division)
)
SELECT track, n, CASE WHEN division < 32768 THEN round(share, 6) END AS share, CASE WHEN division < 32768 THEN round(chance, 6) END AS chance,
       CASE WHEN division >= 32768 THEN 'unknown' WHEN share < 0.9 THEN 'performed' WHEN tail < 0.001 THEN 'quantized' ELSE 'unknown' END AS kind FROM t""")
def midi_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a track's onsets, in ticks of a clock, are a page's, a performance's, or can't be told apart."""
    division = F.element_at(F.array(*[F.lit(x) for x in (480, 24, 96, 1000, 48, 51240)]), (F.col("track") % 6 + 1).cast("int"))
    n = notes(spark, sf_dir).select("track", "onset", division.alias("division"))
    tick = F.when(F.col("track") % 4 == 0, F.floor(F.floor(F.col("onset") * 24) * F.col("division") / 24)).otherwise(F.floor(F.col("onset") * F.col("division")))
    n = n.withColumn("tick", tick.cast("long")).groupBy("track", "division").agg(F.count("*").alias("n"), F.count_if(scalar.on_grid(F.col("tick"), F.col("division"))).alias("hits"))
    share, chance, kind = scalar.timing_kind(F.col("n"), F.col("hits"), F.col("division"))
    return n.select("track", "n", F.round(share, 6).alias("share"), F.round(chance, 6).alias("chance"), kind.alias("kind"))


def bars_and_notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bars of 4, 3, 3.5 or 6 quarters by track, and a track's notes in them on a 24th or a sixth of a quarter, cut at bar lines and at
    the next note; a bar's place is within the track's first and last notes."""
    size = F.element_at(F.array(*[F.lit(x) for x in (4.0, 3.0, 3.5, 6.0)]), (F.col("track") % 4 + 1).cast("int"))
    n = notes(spark, sf_dir).withColumn("grid", F.when(F.col("track") % 3 == 0, 6.0).otherwise(24.0))
    n = n.select("track", "note_id", size.alias("bar_length"), (F.floor(F.col("onset") / 4 * F.col("grid")) / F.col("grid")).alias("at"), (F.ceil(F.col("confidence") * 3 * F.col("grid")) / F.col("grid")).alias("long"))
    n = n.groupBy("track", "bar_length", "at").agg(F.min("note_id").alias("note_id"), F.max("long").alias("long"))
    gap = F.lead("at").over(Window.partitionBy("track").orderBy("at")) - F.col("at")
    n = n.withColumn("end", F.col("at") + F.least("long", F.coalesce(gap, F.col("long"))))
    bar = F.explode(F.sequence(F.floor(F.col("at") / F.col("bar_length")), F.greatest(F.floor(F.col("at") / F.col("bar_length")), F.ceil(F.col("end") / F.col("bar_length")) - 1)))
    n = n.withColumn("bar", bar).withColumn("lo", F.col("bar") * F.col("bar_length"))
    n = n.withColumn("start", F.round(F.greatest(F.lit(0.0), F.col("at") - F.col("lo")), 9)).withColumn("duration", F.round(F.least(F.col("bar_length"), F.col("end") - F.col("lo")), 9) - F.col("start"))
    ends = n.groupBy("track", "bar_length").agg(F.min("bar").alias("a"), F.max("bar").alias("z"))
    bars = ends.select("track", F.explode(F.sequence("a", "z")).alias("bar"), "bar_length")
    return bars, n.select("track", "bar", "note_id", "start", "duration")


@query()
def written_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol of every bar: notes tied where the metre asks for it, tuplets within a beat or two, and rests."""
    bars, n = bars_and_notes(spark, sf_dir)
    out = engrave.written(n, bars, ["track", "bar"])
    return out.select("track", "bar", "note_id", "rest", F.round("start", 6).alias("start"), F.round("duration", 6).alias("duration"), "tuplet")
