"""Queries over notes, beats and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import islands, joins, sets, stats, windows
from ..sources import project
from ..sources.project import beats, frames, notes, with_sql
from .registry import query

NOTES, BEATS, FRAMES = with_sql("notes"), with_sql("notes", "beats"), with_sql("frames")

#: Beats that notes make themselves: the distinct onsets of a track, to a tenth, so that intervals repeat and have gaps.
OWN = ", own AS (SELECT DISTINCT track, round(onset, 1) AS t FROM notes)"


def own_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("track", F.round("onset", 1).alias("t")).distinct()


PHASED = BEATS + """, spans AS (SELECT track, t, beat_idx, lead(t) OVER (PARTITION BY track ORDER BY t) AS nxt FROM beats),
phased AS (SELECT n.*, CASE WHEN s.nxt > s.t THEN s.beat_idx END AS beat_idx, CASE WHEN s.nxt > s.t THEN (n.onset - s.t) / (s.nxt - s.t) END AS phase
  FROM notes n ASOF LEFT JOIN spans s ON n.track = s.track AND n.onset >= s.t)"""


def phased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.beat_phase(notes(spark, sf_dir), beats(spark, sf_dir), cell=240.0)


@query(PHASED + "SELECT note_id, track, beat_idx, round(phase, 9) AS phase FROM phased")
def asof_beat_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phased(spark, sf_dir).select("note_id", "track", "beat_idx", F.round("phase", 9).alias("phase"))


@query(PHASED + "SELECT track, beat_idx, round(phase, 9) AS phase FROM phased WHERE phase > 0.35 AND phase < 0.85")
def offbeat_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phased(spark, sf_dir).where("phase > 0.35 and phase < 0.85").select("track", "beat_idx", F.round("phase", 9).alias("phase"))


_DOMINANT = """, off AS (SELECT track, (floor(beat_idx / 16) * 16)::INT AS w, phase FROM phased WHERE phase > 0.35 AND phase < 0.85),
whole AS (SELECT track, w, median(phase) AS mid, count(*) AS n FROM off GROUP BY ALL),
bins AS (SELECT track, w, floor(phase / 0.02)::BIGINT AS bin, count(*) AS c FROM off GROUP BY ALL),
mass AS (SELECT b.track, b.w, b.bin, 2 * b.c + coalesce(l.c, 0) + coalesce(r.c, 0) AS mass FROM bins b
  LEFT JOIN bins l ON l.track = b.track AND l.w = b.w AND l.bin = b.bin - 1 LEFT JOIN bins r ON r.track = b.track AND r.w = b.w AND r.bin = b.bin + 1),
peak AS (SELECT track, w, (bin + 0.5::DOUBLE) * 0.02::DOUBLE AS phi, n FROM (
  SELECT m.*, n, row_number() OVER (PARTITION BY track, w ORDER BY mass DESC, round(abs(bin - mid / 0.02::DOUBLE), 9), bin) AS k FROM mass m JOIN whole USING (track, w)) WHERE k = 1),
one AS (SELECT track, w, n, median(phase) AS phi FROM off JOIN peak USING (track, w) WHERE abs(phase - phi) <= 0.06::DOUBLE GROUP BY ALL),
two AS (SELECT track, w, n, median(phase) AS phi, count(*) AS m, stddev_pop(phase) AS sd FROM off JOIN one USING (track, w)
  WHERE abs(phase - one.phi) <= 0.06::DOUBLE GROUP BY track, w, n),
dominant AS (SELECT track, w AS start_beat, phi, m / n AS conc, sd / sqrt(m) AS err, n FROM two WHERE n >= 4),
swung AS (SELECT track, start_beat, least(start_beat + 16, 60) AS end_beat, phi, phi / (1 - phi) AS bur,
  conc * least(1.0, n / 8.0) / (1 + err / (phi * (1 - phi)) / 0.10) AS confidence,
  CASE WHEN err > 0 THEN (phi - 0.5) / err ELSE 'inf'::DOUBLE END AS z,
  phi > 0.55 AND (CASE WHEN err > 0 THEN (phi - 0.5) / err ELSE 'inf'::DOUBLE END) > 2 AND conc > 2 * 0.06 / 0.5 * 1.2 AS is_swung, n FROM dominant)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.swing_spans(phased(spark, sf_dir), project.BEATS)


@query(PHASED + _DOMINANT + "SELECT track, start_beat, end_beat, round(phi, 6) AS phi, round(bur, 6) AS bur, round(confidence, 6) AS confidence, is_swung, n FROM swung")
def swing_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select("track", "start_beat", "end_beat", *[F.round(c, 6).alias(c) for c in ("phi", "bur", "confidence")], "is_swung", "n")


@query(PHASED + _DOMINANT + """, pooled AS (SELECT track, sum(confidence * phi) / sum(confidence) AS mean, avg(confidence) AS trust FROM swung WHERE is_swung GROUP BY track),
kept AS (SELECT track, mean FROM (SELECT *, 1 + (1.6 - 1) * (1 - pow(greatest(0.0, least(1.0, trust)), 3)) AS top FROM pooled) WHERE mean > top / (1 + top))
SELECT track, unnest(range(start_beat, end_beat))::INT AS beat_idx, round(confidence * phi + (1 - confidence) * mean, 6) AS phi FROM swung JOIN kept USING (track) WHERE is_swung""")
def pooled_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.pooled_phase(_spans(spark, sf_dir))
    return out.select("track", "beat_idx", F.round("phi", 6).alias("phi"))


@query(PHASED + """SELECT note_id, round(CASE WHEN phase < 1 THEN phase / (1 - phase) ELSE 'inf'::DOUBLE END, 6) AS bur,
round(CASE WHEN phase <= 0 OR phase >= 1 THEN phase WHEN phase <= 0.62 THEN phase / 0.62 * 0.5 ELSE 0.5 + (phase - 0.62) / (1 - 0.62) * 0.5 END, 6) AS warped,
round_even(phase * 12, 0) / 12 AS snapped, round(phase - round_even(phase * 12, 0) / 12, 6) AS rest, floor(phase * 12 + 0.5)::BIGINT AS half_up,
CASE ((round_even(phase * 24, 0)::INT % 24 + 24) % 24) WHEN 0 THEN 'beat' WHEN 12 THEN 'half' WHEN 6 THEN 'quarter' WHEN 18 THEN 'quarter' WHEN 8 THEN 'third' WHEN 16 THEN 'third'
  WHEN 4 THEN 'sixth' WHEN 20 THEN 'sixth' WHEN 3 THEN 'eighth' WHEN 9 THEN 'eighth' WHEN 15 THEN 'eighth' WHEN 21 THEN 'eighth' ELSE 'other' END AS place
FROM phased WHERE phase IS NOT NULL""")
def phase_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = phased(spark, sf_dir).where("phase is not null")
    near, rest = S.snap(F.col("phase"), 12)
    warped = S.warp_phase(F.col("phase"), F.lit(0.62))
    return p.select("note_id", F.round(S.bur_from_phase(F.col("phase")), 6).alias("bur"), F.round(warped, 6).alias("warped"), near.alias("snapped"), F.round(rest, 6).alias("rest"), S.round_half_up(F.col("phase") * 12).alias("half_up"), S.place_name(F.col("phase")).alias("place"))


@query(NOTES + """SELECT note_id, round(440.0 * pow(2.0, (pitch - 69.0) / 12.0), 6) AS hz, pitch % 12 AS chroma,
round(69.0 + 12.0 * log2(440.0 * pow(2.0, (pitch - 69.0) / 12.0) / 440.0), 6) AS midi,
([0, 1, 0, 1, 0, 0, 1, 0, 1, 0, 1, 0])[pitch % 12 + 1] AS alter, (['C','C','D','D','E','F','F','G','G','A','A','B'])[pitch % 12 + 1] AS step,
(floor(pitch / 12) - 1)::INT AS octave FROM notes""")
def pitch_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hz = S.midi_to_hz(F.col("pitch"))
    name = S.spell(F.col("pitch"), F.lit(False))
    return notes(spark, sf_dir).select("note_id", F.round(hz, 6).alias("hz"), S.chroma(F.col("pitch")).alias("chroma"), F.round(S.hz_to_midi(hz), 6).alias("midi"), name["alter"].alias("alter"), name["step"].alias("step"), name["octave"].alias("octave"))


@query(BEATS + """, c AS (SELECT n.note_id, b.beat_idx, abs(n.onset - b.t) AS d, row_number() OVER (PARTITION BY note_id ORDER BY abs(n.onset - b.t), b.t) AS k
  FROM notes n JOIN beats b ON n.track = b.track) SELECT note_id, CASE WHEN d <= 5 THEN beat_idx END AS beat_idx, CASE WHEN d <= 5 THEN round(d, 9) END AS distance FROM c WHERE k = 1""")
def nearest_beat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.nearest_join(notes(spark, sf_dir), beats(spark, sf_dir), ["track"], "onset", "t", ["beat_idx"], most=5.0)
    return out.select("note_id", "beat_idx", F.round("distance", 9).alias("distance"))


@query(BEATS + """, d AS (SELECT track, beat_idx FROM beats WHERE beat_idx % 4 = track % 4) SELECT note_id, (floor(beat_idx / 4) + CASE WHEN beat_idx % 4 >= track % 4 THEN 1 ELSE 0 END)::BIGINT AS bar,
((beat_idx - track % 4) % 4 + 4) % 4 AS beat FROM (SELECT n.note_id, n.track, b.beat_idx FROM notes n ASOF JOIN beats b ON n.track = b.track AND n.onset >= b.t)""")
def bar_and_beat(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = joins.asof_join(notes(spark, sf_dir), beats(spark, sf_dir), ["track"], "onset", "t", ["beat_idx"]).where("beat_idx is not null")
    anchor = F.pmod("track", F.lit(4))
    bar = F.floor(F.col("beat_idx") / 4) + F.when(F.pmod("beat_idx", F.lit(4)) >= anchor, 1).otherwise(0)
    return at.select("note_id", bar.cast("long").alias("bar"), F.pmod(F.col("beat_idx") - anchor, F.lit(4)).alias("beat"))


LINE = ", line AS (SELECT *, track // 50 AS rec FROM notes WHERE source = 'click'), oracle AS (SELECT track // 50 AS o_rec, note_id AS o_id, onset AS o_onset, pitch AS o_pitch, duration AS o_dur, confidence AS o_conf FROM notes WHERE source = 'view')"


def line_and_oracle(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two detectors' notes of each recording; a recording is fifty tracks, as one track's two sources hardly ever meet."""
    n = notes(spark, sf_dir).withColumn("rec", F.floor(F.col("track") / 50))
    o = n.where("source = 'view'").select(*[F.col(a).alias(b) for a, b in (("rec", "o_rec"), ("note_id", "o_id"), ("onset", "o_onset"), ("pitch", "o_pitch"), ("duration", "o_dur"), ("confidence", "o_conf"))])
    return n.where("source = 'click'"), o


SAME_REC = ("rec", "o_rec")


@query(NOTES + LINE + "SELECT note_id, pitch, round(onset, 5) AS onset FROM line WHERE EXISTS (SELECT 1 FROM oracle WHERE o_rec = rec AND o_pitch = pitch AND abs(onset - o_onset) <= 0.1)")
def corroborate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = line_and_oracle(spark, sf_dir)
    return joins.band_join(a, b, [SAME_REC, ("pitch", "o_pitch")], "onset", "o_onset", 0.1, "left_semi").select("note_id", "pitch", F.round("onset", 5).alias("onset"))


@query(NOTES + LINE + "SELECT o_id, o_pitch FROM oracle WHERE NOT EXISTS (SELECT 1 FROM line WHERE o_rec = rec AND o_pitch = pitch AND abs(onset - o_onset) <= 0.1)")
def pool_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = line_and_oracle(spark, sf_dir)
    return joins.band_join(b, a.select("rec", "pitch", "onset"), [("o_rec", "rec"), ("o_pitch", "pitch")], "o_onset", "onset", 0.1, "left_anti").select("o_id", "o_pitch")


_SNAPPED = LINE + """, band AS (SELECT note_id, pitch, o_pitch, o_onset, o_id FROM line JOIN oracle ON o_rec = rec AND o_pitch % 12 = pitch % 12 AND abs(onset - o_onset) <= 0.1),
snapped AS (SELECT l.*, coalesce((SELECT arg_min(o_pitch, (abs(o_pitch - b.pitch), o_onset, o_id)) FROM band b WHERE b.note_id = l.note_id
  AND NOT EXISTS (SELECT 1 FROM band x WHERE x.note_id = l.note_id AND x.o_pitch = l.pitch)), l.pitch) AS snapped FROM line l)"""


def snapped_line(a: DataFrame, b: DataFrame) -> DataFrame:
    """a with `snapped`: the nearest pitch of its class that the oracle has then, its own if that is among them or there is none."""
    a, b = a.withColumn("c", S.chroma(F.col("pitch"))), b.withColumn("o_c", S.chroma(F.col("o_pitch")))
    near = joins.band_join(a.select("rec", "note_id", "pitch", "onset", "c"), b, [SAME_REC, ("c", "o_c")], "onset", "o_onset", 0.1)
    best = near.groupBy("note_id").agg(F.min_by("o_pitch", F.struct(F.abs(F.col("o_pitch") - F.col("pitch")), "o_onset", "o_id")).alias("to"))
    return a.join(best, "note_id", "left").withColumn("snapped", F.coalesce("to", "pitch")).drop("to", "c")


@query(NOTES + _SNAPPED + "SELECT note_id, snapped FROM snapped")
def snap_octaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapped_line(*line_and_oracle(spark, sf_dir)).select("note_id", "snapped")


@query(NOTES + _SNAPPED + """, ok AS (SELECT *, EXISTS (SELECT 1 FROM oracle WHERE o_rec = rec AND o_pitch = snapped AND abs(onset - o_onset) <= 0.1) AS heard FROM snapped)
SELECT rec, count(*) AS input, count(*) FILTER (WHERE snapped <> pitch) AS snapped, count(*) FILTER (WHERE heard) AS corroborated, count(*) FILTER (WHERE NOT heard) AS rejected FROM ok GROUP BY rec""")
def oracle_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What snapping, corroborating and rejecting do to each recording's line."""
    a, b = line_and_oracle(spark, sf_dir)
    s = snapped_line(a, b)
    heard = joins.band_join(s.select("rec", "note_id", "snapped", "onset"), b, [SAME_REC, ("snapped", "o_pitch")], "onset", "o_onset", 0.1, "left_semi").select("note_id", F.lit(True).alias("heard"))
    return s.join(heard, "note_id", "left").groupBy("rec").agg(F.count("*").alias("input"), F.count_if(F.col("snapped") != F.col("pitch")).alias("snapped"), F.count("heard").alias("corroborated"), F.count_if(F.col("heard").isNull()).alias("rejected"))


_SECOND = NOTES.replace("WITH ", "WITH RECURSIVE ", 1) + LINE + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY o_rec ORDER BY o_onset, o_id) AS i FROM oracle),
fold AS (SELECT *, o_onset AS head FROM numbered WHERE i = 1
  UNION ALL SELECT n.*, CASE WHEN n.o_onset - f.head > 0.05 THEN n.o_onset ELSE f.head END FROM fold f JOIN numbered n ON n.o_rec = f.o_rec AND n.i = f.i + 1),
two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_rec, head ORDER BY o_pitch DESC, o_onset, o_id) AS k FROM fold) WHERE k <= 2),
second AS (SELECT * FROM two WHERE NOT EXISTS (SELECT 1 FROM line WHERE rec = o_rec AND pitch = o_pitch AND abs(onset - o_onset) <= 0.1))"""


def second(a: DataFrame, b: DataFrame) -> DataFrame:
    """The two highest of each simultaneity of the oracle that the line doesn't have."""
    c = islands.anchored_clusters(b.select(F.col("o_rec").alias("track"), F.col("o_id").alias("note_id"), F.col("o_onset").alias("onset"), "o_pitch", "o_dur", "o_conf"), 0.05)
    own = Window.partitionBy("track", "cluster").orderBy(F.desc("o_pitch"), "onset", "note_id")
    two = c.withColumn("k", F.row_number().over(own)).where("k <= 2").select(F.col("track").alias("o_rec"), F.col("note_id").alias("o_id"), F.col("onset").alias("o_onset"), "o_pitch", "o_dur", "o_conf")
    return joins.band_join(two, a.select("rec", "pitch", "onset"), [("o_rec", "rec"), ("o_pitch", "pitch")], "o_onset", "onset", 0.1, "left_anti")


@query(_SECOND + "SELECT o_id, o_pitch FROM second")
def second_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return second(*line_and_oracle(spark, sf_dir)).select("o_id", "o_pitch")


@query(_SECOND + """, moved AS (SELECT *, o_onset + 0.02 AS t FROM second), near AS (SELECT o_id, pitch, abs(onset - t) AS d FROM moved JOIN line ON rec = o_rec AND onset >= t - 1.0 AND onset <= t + 1.0),
ok AS (SELECT o_id, median(pitch) AS mid, min(d) AS closest FROM near GROUP BY o_id)
SELECT o.o_id, o.o_pitch, round(t, 5) AS onset FROM moved o JOIN ok USING (o_id) WHERE o_conf >= 0.45 AND closest >= 0.06 AND abs(o_pitch - mid) <= 12
AND NOT EXISTS (SELECT 1 FROM line WHERE rec = o_rec AND t >= onset AND t < onset + 0.5 * duration)""")
def fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-voice notes in holes of the line, moved by a fixed lag before they are tested."""
    a, b = line_and_oracle(spark, sf_dir)
    moved = second(a, b).withColumn("t", F.col("o_onset") + 0.02)
    near = joins.band_join(moved, a.select("rec", "pitch", "onset"), [("o_rec", "rec")], "t", "onset", 1.0)
    ok = near.groupBy("o_id").agg(F.percentile("pitch", 0.5).alias("mid"), F.min(F.abs(F.col("onset") - F.col("t"))).alias("closest"))
    held = joins.stabbing_join(moved, a.select("rec", F.col("onset").alias("lo"), (F.col("onset") + 0.5 * F.col("duration")).alias("hi")), [("o_rec", "rec")], "t", ("lo", "hi"), 0.25).select("o_id").distinct()
    out = moved.join(ok, "o_id").join(held, "o_id", "left_anti").where((F.col("o_conf") >= 0.45) & (F.col("closest") >= 0.06) & (F.abs(F.col("o_pitch") - F.col("mid")) <= 12))
    return out.select("o_id", "o_pitch", F.round("t", 5).alias("onset"))


PAIRS = NOTES + """, held AS (SELECT source, track // 10 AS part, note_id, onset, onset + 0.4 + confidence AS "end", pitch, pitch + 12 * (note_id % 4) AS wide, confidence FROM notes),
pairs AS (SELECT a.note_id AS a_id, b.note_id AS b_id, a.pitch AS a_pitch, b.pitch AS b_pitch, a.wide AS a_wide, b.wide AS b_wide, a.confidence AS a_conf, b.confidence AS b_conf, a."end" - a.onset AS a_len, b."end" - b.onset AS b_len,
  least(a."end", b."end") - greatest(a.onset, b.onset) AS shared FROM held a JOIN held b ON a.source = b.source AND a.part = b.part AND a.note_id < b.note_id AND a.onset < b."end" AND b.onset < a."end")"""


def voices(n: DataFrame) -> DataFrame:
    """notes with `part`, which makes a voice with `source`: every note is of one."""
    return n.withColumn("part", F.floor(F.col("track") / 10))


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of notes of one voice that sound together; ten tracks' worth of a source is a voice, as one track's notes never overlap."""
    n = voices(notes(spark, sf_dir)).withColumn("end", F.col("onset") + 0.4 + F.col("confidence"))
    side = lambda p: n.select(F.col("source").alias(f"{p}_source"), F.col("part").alias(f"{p}_part"), F.col("note_id").alias(f"{p}_id"), F.col("onset").alias(f"{p}_on"), F.col("end").alias(f"{p}_end"), F.col("pitch").alias(f"{p}_pitch"), (F.col("pitch") + 12 * F.pmod("note_id", F.lit(4))).alias(f"{p}_wide"), F.col("confidence").alias(f"{p}_conf"))
    both = joins.interval_join(side("a"), side("b"), [("a_source", "b_source"), ("a_part", "b_part")], ("a_on", "a_end"), ("b_on", "b_end"), 2.0).where("a_id < b_id")
    shared = S.overlap(F.col("a_on"), F.col("a_end"), F.col("b_on"), F.col("b_end"))
    return both.withColumn("shared", shared).withColumn("a_len", F.col("a_end") - F.col("a_on")).withColumn("b_len", F.col("b_end") - F.col("b_on"))


@query(PAIRS + "SELECT a_id, b_id, round(shared, 9) AS shared, shared >= 0.06 OR shared >= 0.3 * least(a_len, b_len) AS meaningful FROM pairs")
def overlapping_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = overlapping(spark, sf_dir)
    return p.select("a_id", "b_id", F.round("shared", 9).alias("shared"), S.meaningful(F.col("shared"), F.col("a_len"), F.col("b_len")).alias("meaningful"))


#: Semitones from a note to its overtones.
OVERTONES = (12, 19, 24, 28, 31, 34, 36)


@query(PAIRS + """SELECT DISTINCT ghost FROM (SELECT b_id AS ghost FROM pairs WHERE b_wide - a_wide IN (12, 19, 24, 28, 31, 34, 36) AND shared >= 0.5 * b_len AND b_conf <= 0.6 * a_conf
UNION ALL SELECT a_id FROM pairs WHERE a_wide - b_wide IN (12, 19, 24, 28, 31, 34, 36) AND shared >= 0.5 * a_len AND a_conf <= 0.6 * b_conf)""")
def ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiet notes that sound with a louder one of which they are an overtone; pitches are spread over four octaves."""
    p = overlapping(spark, sf_dir)
    one = p.where((F.col("b_wide") - F.col("a_wide")).isin(*OVERTONES) & (F.col("shared") >= 0.5 * F.col("b_len")) & (F.col("b_conf") <= 0.6 * F.col("a_conf"))).select(F.col("b_id").alias("ghost"))
    two = p.where((F.col("a_wide") - F.col("b_wide")).isin(*OVERTONES) & (F.col("shared") >= 0.5 * F.col("a_len")) & (F.col("a_conf") <= 0.6 * F.col("b_conf"))).select(F.col("a_id").alias("ghost"))
    return one.union(two).distinct()


@query(PAIRS + ", m AS (SELECT a_id, b_id FROM pairs WHERE shared >= 0.06) SELECT x.a_id, x.b_id, z.b_id AS c_id FROM m x JOIN m y ON x.a_id = y.a_id AND x.b_id < y.b_id JOIN m z ON z.a_id = x.b_id AND z.b_id = y.b_id")
def voice_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = overlapping(spark, sf_dir).where("shared >= 0.06").select("a_id", "b_id")
    wedge = m.select("a_id", F.col("b_id").alias("x")).join(m.select("a_id", F.col("b_id").alias("y")), "a_id").where("x < y")
    return wedge.join(m.select(F.col("a_id").alias("x"), F.col("b_id").alias("y")), ["x", "y"]).select("a_id", F.col("x").alias("b_id"), F.col("y").alias("c_id"))


@query(NOTES + """, p AS (SELECT *, max(onset + duration) OVER (PARTITION BY track ORDER BY onset, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM notes),
q AS (SELECT *, sum(CASE WHEN ended IS NULL OR onset - ended >= 6.0 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY onset, note_id ROWS UNBOUNDED PRECEDING) AS phrase FROM p)
SELECT track, phrase::BIGINT AS phrase, count(*) AS n, round(min(onset), 5) AS first, round(max(onset + duration), 5) AS last FROM q GROUP BY track, phrase""")
def lower_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = islands.phrases(notes(spark, sf_dir), 6.0)
    return p.groupBy("track", "phrase").agg(F.count("*").alias("n"), F.round(F.min("onset"), 5).alias("first"), F.round(F.max(F.col("onset") + F.col("duration")), 5).alias("last"))


_CLUSTER = NOTES.replace("WITH ", "WITH RECURSIVE ", 1) + """, numbered AS (SELECT track, note_id, onset, pitch, row_number() OVER (PARTITION BY track ORDER BY onset, note_id) AS i FROM notes),
fold AS (SELECT track, i, note_id, onset, pitch, onset AS first FROM numbered WHERE i = 1
  UNION ALL SELECT n.track, n.i, n.note_id, n.onset, n.pitch, CASE WHEN n.onset - f.first > 5.0 THEN n.onset ELSE f.first END FROM fold f JOIN numbered n ON n.track = f.track AND n.i = f.i + 1)"""


@query(_CLUSTER + "SELECT track, round(first, 5) AS cluster, count(*) AS n FROM fold GROUP BY track, first")
def anchored_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = islands.anchored_clusters(notes(spark, sf_dir), 5.0)
    return c.groupBy("track", F.round("cluster", 5).alias("cluster")).agg(F.count("*").alias("n"))


@query(_CLUSTER + "SELECT track, round(first, 5) AS cluster, arg_max(note_id, (pitch, -note_id)) AS note_id, max(pitch) AS pitch FROM fold GROUP BY track, first")
def top_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = islands.anchored_clusters(notes(spark, sf_dir), 5.0)
    return c.groupBy("track", F.round("cluster", 5).alias("cluster")).agg(F.max_by("note_id", F.struct("pitch", -F.col("note_id"))).alias("note_id"), F.max("pitch").alias("pitch"))


_STEPS = NOTES + OWN + ", steps AS (SELECT track, t, lead(t) OVER (PARTITION BY track ORDER BY t) - t AS gap FROM own), mid AS (SELECT track, median(gap) AS mid FROM steps GROUP BY track)"


@query(_STEPS + """, edges AS (SELECT track, t FROM own UNION ALL SELECT track, 0.0 FROM mid UNION ALL SELECT track, 720.0 FROM mid),
gaps AS (SELECT track, t AS lo, lead(t) OVER (PARTITION BY track ORDER BY t) AS hi FROM edges) SELECT track, round(lo, 6) AS lo, round(hi, 6) AS hi FROM gaps JOIN mid USING (track) WHERE hi - lo > 3.0 * mid""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.coverage_gaps(own_beats(spark, sf_dir), "t", 0.0, 720.0).select("track", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(_STEPS + """, k AS (SELECT track, t, gap, CASE WHEN round_even(gap / mid, 0) BETWEEN 2 AND 4 AND abs(gap / (round_even(gap / mid, 0) * mid) - 1) <= 0.15 THEN round_even(gap / mid, 0)::INT END AS k FROM steps JOIN mid USING (track)),
i AS (SELECT *, sum(CASE WHEN k IS DISTINCT FROM lk OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY t ROWS UNBOUNDED PRECEDING) AS id FROM (SELECT *, lag(k) OVER (PARTITION BY track ORDER BY t) AS lk, row_number() OVER (PARTITION BY track ORDER BY t) AS rn FROM k)),
n AS (SELECT *, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY track, id) >= 2 THEN k ELSE 1 END AS parts FROM i)
SELECT track, round(CASE WHEN j = 0 THEN t ELSE t + gap * j / parts END, 6) AS t, j > 0 AS implied FROM (SELECT *, unnest(range(parts)) AS j FROM n)""")
def repair_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = islands.repair_rate(own_beats(spark, sf_dir), run=2)
    return out.select("track", F.round("t", 6).alias("t"), "implied")


@query(_STEPS + """, n AS (SELECT track, t, gap, coalesce(CASE WHEN round_even(gap / mid, 0) >= 2 AND round_even(gap / mid, 0) - 1 <= 8 THEN round_even(gap / mid, 0)::INT END, 1) AS parts FROM steps JOIN mid USING (track))
SELECT track, round(CASE WHEN j = 0 THEN t ELSE t + gap * j / parts END, 6) AS t, j > 0 AS implied FROM (SELECT *, unnest(range(parts)) AS j FROM n)""")
def insert_implied_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.insert_implied(own_beats(spark, sf_dir)).select("track", F.round("t", 6).alias("t"), "implied")


@query(_STEPS + "SELECT track, round(t, 6) AS t, false AS implied FROM own UNION ALL SELECT track, round(t + gap / 2, 6), true FROM steps WHERE gap IS NOT NULL")
def halve_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.halve_beats(own_beats(spark, sf_dir)).select("track", F.round("t", 6).alias("t"), "implied")


@query(_STEPS + ", b AS (SELECT track, round_even(gap, 0) AS b, count(*) AS n FROM steps WHERE gap IS NOT NULL GROUP BY ALL) SELECT track, round(mid, 6) AS median, arg_max(b, (n, -b)) AS mode, max(n) AS n FROM mid JOIN b USING (track) GROUP BY track, mid")
def typical_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = own_beats(spark, sf_dir)
    return stats.median_interval(b).join(stats.modal_interval(b, 0), "track").select("track", F.round("median", 6).alias("median"), "mode", "n")


@query(_STEPS + """, bpm AS (SELECT track, t, coalesce(CASE WHEN gap > 0 THEN 60.0 / gap END, lag(CASE WHEN gap > 0 THEN 60.0 / gap END) OVER (PARTITION BY track ORDER BY t)) AS bpm FROM steps),
m AS (SELECT track, median(bpm) AS m, count(bpm) AS n FROM bpm GROUP BY track)
SELECT track, round(t, 6) AS t, round(bpm, 6) AS bpm, coalesce(abs(log2(bpm / m)) >= 0.5 AND n >= 3, false) AS outlier FROM bpm JOIN m USING (track)""")
def local_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.local_tempo(own_beats(spark, sf_dir))
    return out.select("track", F.round("t", 6).alias("t"), F.round("bpm", 6).alias("bpm"), "outlier")


@query(_STEPS + """, g AS (SELECT track, gap, row_number() OVER (PARTITION BY track ORDER BY t) AS i, row_number() OVER (PARTITION BY track ORDER BY t DESC) AS j FROM steps WHERE gap > 0),
a AS (SELECT track, list_sort(list(gap)) AS v FROM g WHERE i <= 8 GROUP BY track), z AS (SELECT track, list_sort(list(gap)) AS v FROM g WHERE j <= 8 GROUP BY track)
SELECT track, round(a.v[(len(a.v) // 2) + 1], 6) AS first, round(z.v[(len(z.v) // 2) + 1], 6) AS last FROM a JOIN z USING (track)""")
def edge_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.edge_period(own_beats(spark, sf_dir)).select("track", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"))


@query(_STEPS + """, g AS (SELECT track, t, gap FROM steps WHERE gap IS NOT NULL), b AS (SELECT track, round_even(gap, 2) AS b, count(*) AS n FROM g GROUP BY ALL), seed AS (SELECT track, arg_max(b, (n, -b)) AS seed FROM b GROUP BY track),
v AS (SELECT track, t, seed, CASE WHEN gap / seed >= 0.75 THEN gap / round_even(gap / seed, 0) WHEN abs(gap / seed / 0.5 - 1) <= 0.15 THEN gap * 2 END AS v FROM g JOIN seed USING (track))
SELECT track, round(t, 6) AS t, round(CASE WHEN count(v) OVER w >= 3 THEN median(v) OVER w ELSE seed END, 6) AS pulse FROM v WINDOW w AS (PARTITION BY track ORDER BY t ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)""")
def reference_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.reference_pulse(own_beats(spark, sf_dir)).select("track", F.round("t", 6).alias("t"), F.round("pulse", 6).alias("pulse"))


@query(_STEPS + """, p AS (SELECT track, t, gap, lag(t) OVER w AS x0, lag(gap) OVER w AS y0, lead(t) OVER w AS x1, lead(gap) OVER w AS y1 FROM steps WHERE gap IS NOT NULL WINDOW w AS (PARTITION BY track ORDER BY t))
SELECT track, round(t, 6) AS t, round(CASE WHEN x1 > x0 THEN gap - (y0 + (y1 - y0) * (t - x0) / (x1 - x0)) END, 6) AS error FROM p""")
def placement_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.intervals(own_beats(spark, sf_dir)).where("gap is not null")
    return windows.placement_errors(p, "t", "gap").select("track", F.round("t", 6).alias("t"), F.round("error", 6).alias("error"))


@query(NOTES + """, l AS (SELECT *, 20 * log10(confidence) AS db FROM notes WHERE confidence > 0)
SELECT note_id FROM (SELECT note_id, pitch, db, median(pitch) OVER w AS mid, median(db) OVER w AS loud FROM l WINDOW w AS (PARTITION BY track ORDER BY onset RANGE BETWEEN 24.0 PRECEDING AND 24.0 FOLLOWING)) WHERE pitch >= mid - 3 AND round(db - loud, 9) >= -0.5""")
def reject_line_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir).where("confidence > 0").withColumn("db", 20 * F.log10("confidence"))
    return windows.reject_line_outliers(n, 24.0, 3.0, "db", 0.5).select("note_id")


_FOLD = """, v AS (SELECT note_id, pitch * 2 AS pitch, list_sort(list_concat(coalesce(list(pitch * 2) OVER (PARTITION BY track ORDER BY onset, note_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []),
  coalesce(list(pitch * 2) OVER (PARTITION BY track ORDER BY onset, note_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []))) AS near FROM notes),
m AS (SELECT note_id, pitch, CASE WHEN len(near) > 0 THEN (near[(len(near) + 1) // 2] + near[(len(near) + 2) // 2]) / 2.0 END AS mid FROM v)"""


@query(NOTES + _FOLD + "SELECT note_id, CASE WHEN abs(pitch - mid) BETWEEN 11 AND 13 THEN pitch - sign(pitch - mid)::INT * 12 ELSE pitch END AS folded FROM m")
def fold_octaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitches are doubled, as those of a one-octave projection never lie an octave apart."""
    return windows.fold_octaves(notes(spark, sf_dir).withColumn("pitch", F.col("pitch") * 2)).select("note_id", "folded")


@query(PHASED + """, per AS (SELECT track, beat_idx, min(phase) AS first, max(phase) AS last FROM phased WHERE phase IS NOT NULL GROUP BY ALL),
c AS (SELECT track, beat_idx, first AS c FROM per WHERE first <= 0.35 UNION ALL SELECT track, beat_idx, last - 1 FROM per WHERE last >= 0.88),
m AS (SELECT p.track, p.beat_idx, p.first, median(c.c) AS mid, count(c.c) AS n, max(b.last) AS before FROM per p LEFT JOIN c ON c.track = p.track AND c.beat_idx BETWEEN p.beat_idx - 4 AND p.beat_idx + 4
  LEFT JOIN per b ON b.track = p.track AND b.beat_idx = p.beat_idx - 1 GROUP BY p.track, p.beat_idx, p.first)
SELECT track, beat_idx, round(least(0.2, mid, first), 6) AS lag FROM m WHERE n >= 3 AND mid >= 0.08 AND coalesce(before, 0.0) < 0.88 AND least(0.2, mid, first) > 0""")
def line_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = phased(spark, sf_dir).where("phase is not null").select("track", "beat_idx", "phase")
    return windows.line_lag(p).select("track", "beat_idx", F.round("lag", 6).alias("lag"))


@query(NOTES + "SELECT note_id, round(percent_rank() OVER (PARTITION BY track ORDER BY confidence), 9) AS rank FROM notes")
def velocity_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.velocities(notes(spark, sf_dir)).select("note_id", F.round("rank", 9).alias("rank"))


@query(NOTES + """, c AS (SELECT note_id, least(confidence * 20, coalesce(lead(onset) OVER (PARTITION BY track ORDER BY onset, note_id) - onset, confidence * 20)) AS duration FROM notes)
SELECT note_id, round(duration, 6) AS duration FROM c WHERE duration > 1e-6""")
def without_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir).withColumn("duration", F.col("confidence") * 20)
    return windows.without_overlap(n).select("note_id", F.round("duration", 6).alias("duration"))


@query(NOTES + """, g AS (SELECT note_id, duration, lead(onset) OVER (PARTITION BY track ORDER BY onset, note_id) - onset AS gap FROM notes)
SELECT note_id, round(CASE WHEN gap - duration > 1e-6 AND gap - duration < 2.0 - 1e-6 THEN gap ELSE duration END, 6) AS duration FROM g""")
def close_short_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.close_short_gaps(notes(spark, sf_dir), 2.0).select("note_id", F.round("duration", 6).alias("duration"))


@query(NOTES + """, o AS (SELECT track, round(onset, 6) AS onset, max(duration) AS duration FROM notes GROUP BY ALL)
SELECT track, onset, round(least(duration, coalesce(lead(onset) OVER (PARTITION BY track ORDER BY onset) - onset, duration)), 6) AS duration FROM o""")
def line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.line_events(notes(spark, sf_dir)).select("track", "onset", F.round("duration", 6).alias("duration"))


@query(PHASED + """SELECT track, beat_idx, max(duration) AS duration, arg_max(pitch, (duration, pitch)) AS pitch, array_to_string(list_sort(list(DISTINCT pitch)), ',') AS chord FROM (SELECT track, beat_idx, round(duration, 6) AS duration, pitch FROM phased WHERE beat_idx IS NOT NULL) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY track, beat_idx"))
def merge_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = phased(spark, sf_dir).where("beat_idx is not null").withColumn("duration", F.round("duration", 6))
    return sets.merge_chords(p, ["track", "beat_idx"]).withColumn("chord", F.array_join("chord", ","))


@query(NOTES + """, c AS (SELECT *, onset + duration AS e, lag(onset + duration) OVER (PARTITION BY track, source ORDER BY onset, note_id) AS ended FROM notes),
d AS (SELECT *, sum(CASE WHEN ended IS NULL OR abs(onset - ended) > 8.0 THEN 1 ELSE 0 END) OVER (PARTITION BY track, source ORDER BY onset, note_id ROWS UNBOUNDED PRECEDING) AS id FROM c)
SELECT track, source, round(min(onset), 6) AS onset, round(max(e), 6) AS "end", count(*) AS joined FROM d GROUP BY track, source, id""")
def merge_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = islands.merge_touching(notes(spark, sf_dir), 8.0, ["track", "source"])
    return out.select("track", "source", F.round("onset", 6).alias("onset"), F.round("end", 6).alias("end"), "joined")


@query(NOTES + """, s AS (SELECT *, coalesce(sum(CASE WHEN duration <= 0.3 THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY onset, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS id FROM notes)
SELECT track, round(min(onset), 6) AS onset, arg_max(pitch, (onset, note_id)) AS pitch, count(*) - 1 AS graces, bool_and(duration <= 0.3) AS open FROM s GROUP BY track, id""")
def absorb_lead_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.absorb_lead_ins(notes(spark, sf_dir), 0.3).withColumn("onset", F.round("onset", 6))


@query(NOTES + """, s AS (SELECT track, floor(onset / 6) * 6 AS lo, floor(onset / 6) * 6 + 6 + confidence * 10 AS hi FROM notes), m AS (SELECT *, max(hi) OVER (PARTITION BY track ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s),
i AS (SELECT *, sum(CASE WHEN e IS NULL OR lo > e THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS id FROM m)
SELECT track, round(min(lo), 6) AS lo, round(max(hi), 6) AS hi FROM i GROUP BY track, id""")
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = (F.floor(F.col("onset") / 6) * 6).cast("double")
    s = notes(spark, sf_dir).select("track", lo.alias("lo"), (lo + 6 + F.col("confidence") * 10).alias("hi"))
    return islands.merge_intervals(s, "track", "lo", "hi").select("track", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(FRAMES + """, r AS (SELECT *, sum(CASE WHEN pitch IS NOT NULL AND lp IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(pitch) OVER (PARTITION BY track ORDER BY frame) AS lp FROM frames))
SELECT track, min(frame) AS first, max(frame) AS last, count(*) AS frames FROM r WHERE pitch IS NOT NULL GROUP BY track, run""")
def voiced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.voiced_runs(frames(spark, sf_dir))


_FILLED = FRAMES + """, f AS (SELECT *, last_value(pitch IGNORE NULLS) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) AS lp, last_value(CASE WHEN pitch IS NOT NULL THEN frame END IGNORE NULLS) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) AS lf,
  first_value(CASE WHEN pitch IS NOT NULL THEN frame END IGNORE NULLS) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nf FROM frames),
filled AS (SELECT *, coalesce(pitch, CASE WHEN nf - lf - 1 <= 2 THEN lp END) AS filled FROM f)"""


@query(_FILLED + "SELECT track, frame, filled FROM filled")
def fill_short_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.fill_short_gaps(frames(spark, sf_dir), 2).select("track", "frame", "filled")


_CUTS = _FILLED + """, v AS (SELECT *, sum(CASE WHEN filled IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run, round_even(filled / 10, 0) AS near,
  level >= lag(level) OVER w AND level > lead(level) OVER w AND level >= avg(level) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + 20000.0 AS onset FROM filled WINDOW w AS (PARTITION BY track ORDER BY frame)),
r AS (SELECT *, min(frame) OVER (PARTITION BY track, run) AS start, lag(near) OVER (PARTITION BY track, run ORDER BY frame) AS ln FROM v WHERE filled IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN ln IS NULL OR near <> ln THEN 1 ELSE 0 END) OVER (PARTITION BY track, run ORDER BY frame ROWS UNBOUNDED PRECEDING) AS isle FROM r),
s AS (SELECT track, run, isle, min(frame) AS frame, any_value(near) AS near, count(*) AS n FROM i GROUP BY track, run, isle),
c AS (SELECT track, run, frame FROM (SELECT *, lag(near) OVER (PARTITION BY track, run ORDER BY isle) AS was FROM s WHERE n >= 2 OR isle = 1) WHERE was IS NOT NULL AND near <> was)"""


@query(_CUTS + "SELECT track, frame FROM c")
def persistent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a voiced run where another rounded pitch takes over for two frames or more."""
    f = islands.fill_short_gaps(frames(spark, sf_dir), 2).withColumn("near", F.bround(F.col("filled") / 10))
    return islands.persistent_changes(islands.in_runs(f, "filled"), "near", 2).where("change").select("track", "frame")


@query(_CUTS + """, e AS (SELECT i.*, c.frame IS NOT NULL AS change, coalesce(onset, false) AND i.frame > start AS struck FROM i LEFT JOIN c ON c.track = i.track AND c.frame = i.frame),
d AS (SELECT *, min(CASE WHEN change THEN frame END) OVER (PARTITION BY track, run) AS first_change, min(CASE WHEN struck THEN frame END) OVER (PARTITION BY track, run) AS first_struck FROM e),
g AS (SELECT *, sum(CASE WHEN struck OR (change AND NOT (frame = first_change AND frame - start < 2 AND coalesce(first_struck > first_change, true))) THEN 1 ELSE 0 END) OVER (PARTITION BY track, run ORDER BY frame ROWS UNBOUNDED PRECEDING) AS seg FROM d)
SELECT track, round(min(frame) * 0.01::DOUBLE, 6) AS onset, round(count(*) * 0.01::DOUBLE, 6) AS duration, round_even(median(filled / 10), 0)::INT AS pitch, round(avg(periodicity), 6) AS confidence FROM g GROUP BY track, run, seg HAVING count(*) >= 2""")
def segment_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = windows.flag_peaks(frames(spark, sf_dir), "level", 5, 20000.0, "onset", edges=False)
    f = islands.fill_short_gaps(f, 2).withColumn("filled", F.col("filled") / 10)
    out = islands.segment_runs(f, 2, 2, 0.01)
    return out.withColumn("onset", F.round("onset", 6)).withColumn("duration", F.round("duration", 6))


@query(FRAMES + "SELECT track, frame, CASE WHEN pitch IS NOT NULL THEN round(median(pitch) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) END AS smooth FROM frames")
def median_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.median_smooth(frames(spark, sf_dir), 2).select("track", "frame", F.round("smooth", 6).alias("smooth"))


@query(FRAMES + """, p AS (SELECT track, frame, level, lag(level) OVER w AS b, lead(level) OVER w AS a, avg(level) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m FROM frames WINDOW w AS (PARTITION BY track ORDER BY frame))
SELECT track, frame FROM p WHERE level >= coalesce(b, level) AND level > coalesce(a, level - 1) AND level >= m + 20000.0""")
def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.peaks(frames(spark, sf_dir), "level", 5, 20000.0).select("track", "frame")


@query(FRAMES + "SELECT track, round(atan2(sum(sin(p * 6.283185307179586)), sum(cos(p * 6.283185307179586))) / 6.283185307179586, 5) AS offset, round(sqrt(pow(sum(sin(p * 6.283185307179586)), 2) + pow(sum(cos(p * 6.283185307179586)), 2)) / count(p), 5) AS concentration FROM (SELECT track, level / 1000.0 AS p FROM frames) GROUP BY track".replace(" AS offset", ' AS "offset"'))
def tuning_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select("track", (F.col("level") / 1000.0).alias("p"))
    return stats.circular_mean(f, ["track"], "p").select("track", F.round("offset", 5).alias("offset"), F.round("concentration", 5).alias("concentration"))


@query(FRAMES + "SELECT track, (frame // 16)::INT AS w, round(avg(level * level), 2) AS power, round(10.0 * log10(greatest(avg(level * level), 1e-12)), 6) AS db, round(min(level), 2) AS low, round(max(level), 2) AS high FROM frames GROUP BY track, frame // 16 HAVING count(*) = 16")
def window_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).groupBy("track", F.floor(F.col("frame") / 16).cast("int").alias("w")).agg(F.avg(F.col("level") * F.col("level")).alias("p"), F.min("level").alias("lo"), F.max("level").alias("hi"), F.count("*").alias("n")).where("n = 16")
    return f.select("track", "w", F.round("p", 2).alias("power"), F.round(S.db(F.col("p")), 6).alias("db"), F.round("lo", 2).alias("low"), F.round("hi", 2).alias("high"))


@query(FRAMES + "SELECT track, frame, round(CASE WHEN s > 0 THEN (level - m) / s ELSE 0.0 END, 5) AS standard FROM (SELECT track, frame, level, avg(level) OVER (PARTITION BY track) AS m, stddev_pop(level) OVER (PARTITION BY track) AS s FROM frames)")
def standardize_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.standardize(frames(spark, sf_dir), ["track"], "level").select("track", "frame", F.round("standard", 5).alias("standard"))


@query(NOTES + """, h AS (SELECT track, source, pitch % 12 AS pc, sum(duration) AS d FROM notes GROUP BY ALL), s AS (SELECT track, source, pc, d, sum(d) OVER (PARTITION BY track, source) AS t FROM h)
SELECT track, source, arg_max(pc, (round(d, 6), -pc)) AS tonic, round(max(d) / max(t), 6) AS share FROM s GROUP BY track, source""")
def chroma_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = notes(spark, sf_dir).groupBy("track", "source", S.chroma(F.col("pitch")).alias("pc")).agg(F.sum("duration").alias("d"))
    return h.groupBy("track", "source").agg(F.max_by("pc", F.struct(F.round("d", 6), -F.col("pc"))).alias("tonic"), F.round(F.max("d") / F.sum("d"), 6).alias("share"))


@query(NOTES + """, k AS (SELECT track, pitch % 12 AS pc, sum(duration) AS d FROM notes GROUP BY ALL)
, prof(mode, i, w) AS (SELECT 'major', unnest(range(12)), unnest([6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]::DOUBLE[]) UNION ALL SELECT 'minor', unnest(range(12)), unnest([6.33, 2.68, 3.52, 5.38, 2.6, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]::DOUBLE[]))
, c AS (SELECT t.track, mode, tonic::INT AS tonic, corr(coalesce(k.d, 0.0), w) AS r FROM (SELECT DISTINCT track FROM k) t, range(12) q(tonic) CROSS JOIN prof LEFT JOIN k ON k.track = t.track AND k.pc = (prof.i + tonic) % 12 GROUP BY t.track, mode, tonic)
SELECT track, arg_max(tonic, (round(r, 9), mode = 'major', -tonic)) AS tonic, arg_max(mode, (round(r, 9), mode = 'major', -tonic)) AS mode, round(max(r), 6) AS r FROM c GROUP BY track""")
def detect_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key whose duration profile is correlated most; the profiles' values are fixed."""
    major, minor = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88), (6.33, 2.68, 3.52, 5.38, 2.6, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
    h = notes(spark, sf_dir).withColumn("pc", S.chroma(F.col("pitch")))
    h = h.groupBy("track").agg(*[F.sum(F.when(F.col("pc") == i, F.col("duration")).otherwise(0.0)).alias(f"p{i}") for i in range(12)])
    keys = [F.struct(F.lit(m).alias("mode"), F.lit(t).alias("tonic"), F.array(*[F.lit(w[(i - t) % 12]) for i in range(12)]).alias("w")) for m, w in (("major", major), ("minor", minor)) for t in range(12)]
    rows = h.select("track", F.array(*[f"p{i}" for i in range(12)]).alias("d"), F.explode(F.array(*keys)).alias("k")).select("track", "k.mode", "k.tonic", F.explode(F.arrays_zip("d", F.col("k.w").alias("w"))).alias("x"))
    c = rows.groupBy("track", "mode", "tonic").agg(F.corr("x.d", "x.w").alias("r"))
    best = F.struct(F.round("r", 9), F.col("mode") == "major", -F.col("tonic"))
    return c.groupBy("track").agg(F.max_by("tonic", best).alias("tonic"), F.max_by("mode", best).alias("mode"), F.round(F.max("r"), 6).alias("r"))


_LINES = NOTES + """, p AS (SELECT track, onset AS x, confidence AS y FROM notes),
pi AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY x, y) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM p),
q AS (SELECT * FROM pi WHERE n <= 400 OR floor(ceil(i / (n / 400.0::DOUBLE)) * (n / 400.0::DOUBLE)) = i),
s AS (SELECT a.track, median((b.y - a.y) / (b.x - a.x)) AS slope FROM q a JOIN q b ON a.track = b.track AND a.i < b.i AND a.x <> b.x GROUP BY a.track),
line AS (SELECT track, slope, median(y - slope * x) AS intercept FROM q JOIN s USING (track) GROUP BY track, slope)"""


@query(_LINES + "SELECT track, round(slope, 9) AS slope, round(intercept, 6) AS intercept FROM line")
def theil_sen(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.theil_sen(notes(spark, sf_dir), ["track"], "onset", "confidence")
    return out.select("track", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(_LINES + """, k AS (SELECT p.track, x, y FROM p JOIN line USING (track) WHERE round(abs(y - (slope * x + intercept)), 9) <= 0.02),
ki AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY x, y) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM k),
kq AS (SELECT * FROM ki WHERE n <= 400 OR floor(ceil(i / (n / 400.0::DOUBLE)) * (n / 400.0::DOUBLE)) = i),
ks AS (SELECT a.track, median((b.y - a.y) / (b.x - a.x)) AS slope FROM kq a JOIN kq b ON a.track = b.track AND a.i < b.i AND a.x <> b.x GROUP BY a.track),
again AS (SELECT track, slope, median(y - slope * x) AS intercept, max(n) AS n FROM kq JOIN ks USING (track) GROUP BY track, slope)
SELECT l.track, round(CASE WHEN a.n >= 10 THEN a.slope ELSE l.slope END, 9) AS slope, round(CASE WHEN a.n >= 10 THEN a.intercept ELSE l.intercept END, 6) AS intercept FROM line l LEFT JOIN again a USING (track)""")
def inlier_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line again through the points that the first one passes near, where there are ten of them."""
    p = notes(spark, sf_dir).select("track", F.col("onset").alias("x"), F.col("confidence").alias("y"))
    out = stats.inlier_line(p, ["track"], "x", "y", 0.02, 10)
    return out.select("track", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(NOTES + """, n AS (SELECT source, confidence, pitch % 2 = 0 AS good FROM notes) SELECT a.source, round(sum(CASE WHEN a.confidence > b.confidence THEN 1.0 WHEN a.confidence = b.confidence THEN 0.5 ELSE 0 END) / count(*), 9) AS auc
FROM n a JOIN n b ON a.source = b.source AND a.good AND NOT b.good GROUP BY a.source""")
def confidence_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir).withColumn("good", F.col("pitch") % 2 == 0)
    return stats.mid_rank_auc(n, ["source"], "confidence", "good", cell=1 / 256).withColumn("auc", F.round("auc", 9))


@query(NOTES + """, n AS (SELECT source, round(confidence, 1) AS c, (pitch % 3 = 0)::INT AS f FROM notes), g AS (SELECT source, c, count(*) AS n, sum(f) AS f FROM n GROUP BY ALL),
h AS (SELECT *, greatest(0.0, 0.2 * sum(n) OVER (PARTITION BY source) - coalesce(sum(n) OVER (PARTITION BY source ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM g)
SELECT source, round(sum(f * least(1.0, room / n)) / sum(f), 9) AS share FROM h GROUP BY source""")
def share_in_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir).select("source", F.round("confidence", 1).alias("c"), (F.col("pitch") % 3 == 0).alias("flag"))
    return stats.share_in_lowest(n, ["source"], "c", "flag", 0.2, cell=1 / 16).withColumn("share", F.round("share", 9))


@query(NOTES + ", c AS (SELECT source, pitch, count(*) AS n FROM notes GROUP BY ALL), p AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM c) SELECT source, round(sum(-p * log2(p)), 9) AS bits FROM p GROUP BY source")
def pitch_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.entropy(notes(spark, sf_dir), ["source"], "pitch").withColumn("bits", F.round("bits", 9))


@query(NOTES + ", m AS (SELECT track, note_id, pitch, list(pitch) OVER (PARTITION BY track ORDER BY onset, note_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS v FROM notes), u AS (SELECT note_id, unnest(v) AS x FROM m), c AS (SELECT note_id, x, count(*) AS n FROM u GROUP BY ALL) SELECT note_id, arg_max(x, (n, -x)) AS mode FROM c GROUP BY note_id")
def rolling_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rolling_mode(notes(spark, sf_dir), "pitch", ["onset", "note_id"], 4).select("note_id", "mode")


@query(NOTES + """SELECT track, note_id FROM (SELECT track, note_id, count(*) OVER (PARTITION BY track) AS size, row_number() OVER (PARTITION BY track ORDER BY confidence DESC, note_id) AS turn FROM notes) ORDER BY turn, size, track, note_id LIMIT 100""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.round_robin(notes(spark, sf_dir), ["track"], [F.desc("confidence"), F.col("note_id")], 100).select("track", "note_id")


@query(NOTES + """SELECT track, source, CASE WHEN grouping(track) = 1 THEN 'all' ELSE 'one' END AS level, count(*) AS n, round(avg(confidence), 6) AS confidence, round(median(pitch), 6) AS pitch FROM notes GROUP BY GROUPING SETS ((), (track), (source))""".replace("CASE WHEN grouping(track) = 1 THEN 'all' ELSE 'one' END", "CASE WHEN grouping(track) = 1 AND grouping(source) = 1 THEN 'all' ELSE 'one' END"))
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block overall, one for each track and one for each source."""
    n = notes(spark, sf_dir)
    g = n.groupingSets([[], ["track"], ["source"]], "track", "source").agg(F.grouping("track").alias("a"), F.grouping("source").alias("b"), F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.percentile("pitch", 0.5), 6).alias("pitch"))
    return g.select("track", "source", F.when((F.col("a") == 1) & (F.col("b") == 1), "all").otherwise("one").alias("level"), "n", "confidence", "pitch")


@query(NOTES + """, v AS (SELECT note_id, duration, lead(onset) OVER (PARTITION BY track ORDER BY onset, note_id) - onset AS gap FROM notes)
SELECT note_id, round(coalesce((SELECT arg_min(x, (abs(x - duration), x)) FROM unnest([0.125, 0.25, 0.375, 0.5, 1.0]::DOUBLE[]) u(x) WHERE x <= gap + 1e-6), gap), 6) AS value FROM v WHERE gap IS NOT NULL""")
def snap_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.lead("onset").over(Window.partitionBy("track").orderBy("onset", "note_id")) - F.col("onset")
    v = notes(spark, sf_dir).withColumn("gap", gap).where("gap is not null")
    return v.select("note_id", F.round(S.snap_value(F.col("duration"), F.col("gap"), (0.125, 0.25, 0.375, 0.5, 1.0)), 6).alias("value"))
