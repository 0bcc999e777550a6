"""Queries of written rhythm, routing, error classes and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import islands, joins, notation
from ..sources.project import notes
from .registry import query
from .note_queries import LINE, NOTES, OWN, PHASED, SAME_REC, line_and_oracle, own_beats, phased

_GRID = PHASED + """, per AS (SELECT track, beat_idx, list_sort(list(phase)) AS p FROM phased WHERE phase IS NOT NULL GROUP BY track, beat_idx),
cand AS (SELECT track, beat_idx, p, unnest(range(6)) AS rank, unnest([2, 4, 3, 8, 6, 12]) AS grid FROM per),
snap AS (SELECT track, beat_idx, rank, grid, len(p) AS n, list_transform(p, lambda x: round_even(x * grid, 0) / grid) AS near, p FROM cand),
err AS (SELECT track, beat_idx, rank, grid, n, len(list_distinct(near)) = n AS apart, round(list_sum(list_transform(range(1, n + 1), lambda i: abs(p[i] - near[i]))) / n, 9) AS error FROM snap),
best AS (SELECT track, beat_idx, min(error) FILTER (WHERE apart) AS best FROM err GROUP BY ALL),
grids AS (SELECT e.track, e.beat_idx, coalesce(arg_min(grid, rank) FILTER (WHERE apart AND error <= best + 0.05), max(grid))::INT AS grid,
  coalesce(arg_min(error, rank) FILTER (WHERE apart AND error <= best + 0.05), arg_max(error, grid)) AS error, max(n)::INT AS n FROM err e JOIN best USING (track, beat_idx) GROUP BY e.track, e.beat_idx)"""


def _phased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phased(spark, sf_dir).where("phase is not null")


@query(_GRID + "SELECT track, beat_idx, grid, round(error, 6) AS error, n FROM grids")
def choose_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notation.choose_grid(_phased(spark, sf_dir)).withColumn("error", F.round("error", 6))


@query(_GRID + """, q AS (SELECT note_id, phase, p.beat_idx, p.beat_idx + round_even(phase * grid, 0) / grid AS pos FROM phased p JOIN grids USING (track, beat_idx))
SELECT note_id, floor(pos / 4)::BIGINT AS bar, round(pos - floor(pos / 4) * 4, 6) AS beat, round(phase - (pos - beat_idx), 6) AS residual, round(beat_idx + phase, 5) AS replayed FROM q""")
def quantize_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _phased(spark, sf_dir)
    q = notation.quantize(p, notation.choose_grid(p))
    return q.select("note_id", "bar", F.round("beat", 6).alias("beat"), F.round("residual", 6).alias("residual"), F.round(notation.replay(q), 5).alias("replayed"))


_SIG = PHASED + """, ats AS (SELECT track, beat_idx, list(DISTINCT floor(phase * 12)::BIGINT) AS at_bins FROM phased WHERE phase IS NOT NULL GROUP BY track, beat_idx),
sig AS (SELECT track, beat_idx, array_to_string(list_transform(range(12), lambda k: CASE WHEN list_contains(at_bins, k) THEN 'O' ELSE '.' END), '') AS signature FROM ats)"""


@query(_SIG + "SELECT * FROM sig")
def onset_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notation.onset_signatures(_phased(spark, sf_dir))


@query(_SIG + """, inv AS (SELECT signature FROM sig GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 12) SELECT coalesce(i.signature, 'RARE') AS class, count(*) AS n FROM sig s LEFT JOIN inv i USING (signature) GROUP BY 1""")
def signature_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats by signature, with those outside the dozen most frequent folded."""
    from ..operators.sets import top_k

    s = notation.onset_signatures(_phased(spark, sf_dir))
    inventory = top_k(s, "signature", 12).select("signature", F.col("signature").alias("known"))
    return s.join(F.broadcast(inventory), "signature", "left").groupBy(F.coalesce("known", F.lit("RARE")).alias("class")).agg(F.count("*").alias("n"))


@query(NOTES + """, h AS (SELECT note_id, onset AS lo, onset + confidence * 60 AS hi FROM notes), b AS (SELECT note_id, lo, hi, unnest(range(floor(lo / 48)::BIGINT, greatest(floor(lo / 48), ceil(hi / 48) - 1)::BIGINT + 1)) AS bar_no FROM h)
SELECT note_id, bar_no, round(greatest(lo, bar_no * 48.0) - bar_no * 48.0, 6) AS at, round(least(hi, (bar_no + 1) * 48.0) - greatest(lo, bar_no * 48.0), 6) AS size, bar_no * 48.0 > lo AS tied_in, (bar_no + 1) * 48.0 < hi AS tied_out FROM b""".replace("AS at,", 'AS "at",'))
def split_at_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir).select("note_id", "onset", (F.col("confidence") * 60).alias("held"))
    out = notation.split_at_bars(n, "onset", "held", 48.0)
    return out.select("note_id", "bar_no", F.round("at", 6).alias("at"), F.round("size", 6).alias("size"), "tied_in", "tied_out")


@query(NOTES + LINE + """, p AS (SELECT note_id, o_id, onset - o_onset AS d, o_pitch AS r, pitch AS e, row_number() OVER (PARTITION BY note_id ORDER BY abs(onset - o_onset), o_id) AS k FROM line JOIN oracle ON rec = o_rec AND abs(onset - o_onset) <= 0.5)
SELECT note_id, o_id, CASE WHEN r = e AND d > 0.05 THEN 'timing_late' WHEN r = e AND d < -0.05 THEN 'timing_early' WHEN r = e THEN 'loose' WHEN abs(e - r) % 12 = 0 THEN 'octave' WHEN abs(e - r) <= 2 THEN 'neighbour' ELSE 'other_pitch' END AS class FROM p WHERE k = 1""")
def classify_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = line_and_oracle(spark, sf_dir)
    near = joins.band_join(a.select("rec", "note_id", "onset", "pitch"), b.select("o_rec", "o_id", "o_onset", "o_pitch"), [SAME_REC], "onset", "o_onset", 0.5)
    d = F.col("onset") - F.col("o_onset")
    best = near.groupBy("note_id").agg(F.min_by(F.struct("o_id", d.alias("d"), "o_pitch", "pitch"), F.struct(F.abs(d), "o_id")).alias("x"))
    return best.select("note_id", F.col("x.o_id").alias("o_id"), notation.pair_class(F.col("x.d"), F.col("x.o_pitch"), F.col("x.pitch"), 0.05, 0.05).alias("class"))


@query(PHASED + """, v AS (SELECT track, (beat_idx % 4)::INT AS phase, count(*) AS n FROM phased WHERE phase < 0.25 GROUP BY ALL), t AS (SELECT track, arg_max(phase, (n, -phase)) AS phase, max(n) AS votes, sum(n) AS a FROM v GROUP BY track)
SELECT track, phase, votes, round(votes / a, 9) AS share, a >= 4 AND votes / a >= 0.5 AS trusted FROM t""")
def downbeat_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = phased(spark, sf_dir).where("phase < 0.25")
    return notation.grid_votes(p, ["track"], "beat_idx", 4).withColumn("share", F.round("share", 9)).withColumn("phase", F.col("phase").cast("int"))


@query(NOTES + """, c AS (SELECT note_id, duration, onset, lead(onset) OVER w AS nx, lead(pitch) OVER w - pitch AS step, lead(duration) OVER w AS nd FROM notes WINDOW w AS (PARTITION BY track ORDER BY onset, note_id)),
m AS (SELECT *, coalesce(duration <= 0.45 AND abs(nx - onset - duration) <= 0.1 AND step IN (0, 1) AND nd >= 1.05 * duration, false) AS lead_in FROM c) SELECT note_id, lead_in, round(CASE WHEN lead_in THEN nx - onset ELSE duration END, 6) AS duration FROM m""")
def mark_lead_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = notation.mark_lead_ins(notes(spark, sf_dir), 0.45, 0.1, 1.05)
    return out.select("note_id", "lead_in", F.round("duration", 6).alias("duration"))


@query(NOTES + """, c AS (SELECT source, onset - lag(onset) OVER w AS gap, lag(onset + duration) OVER w > onset AS laps FROM notes WINDOW w AS (PARTITION BY source ORDER BY onset, note_id))
SELECT source, round(count(*) FILTER (WHERE gap <= 0.5 AND laps) / count(*) FILTER (WHERE gap <= 0.5), 9) AS share FROM c GROUP BY source""")
def polyphony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notation.polyphony(notes(spark, sf_dir), ["source"], 0.5).withColumn("share", F.round("share", 9))


@query(NOTES + """, p AS (SELECT track, floor(onset / 24)::INT AS w, source AS stem, avg(confidence * confidence) AS power FROM notes GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY track, w ORDER BY round(power, 12) DESC, stem) = 1 AS top FROM p), s AS (SELECT track, stem, round(10.0 * log10(greatest(avg(power), 1e-12)), 9) AS level, count(*) FILTER (WHERE top) AS wins FROM k GROUP BY ALL),
l AS (SELECT *, round(wins / (SELECT count(DISTINCT w) FROM p WHERE p.track = s.track), 9) AS share FROM s), r AS (SELECT *, row_number() OVER z AS i, lead(level) OVER z AS rival FROM l WINDOW z AS (PARTITION BY track ORDER BY share DESC, level DESC, stem))
SELECT track, stem AS lead, round(share, 6) AS share, round(level - rival, 6) AS margin, CASE WHEN share >= 0.3 AND level - rival >= 0.5 THEN 'lead' WHEN share >= 0.3 THEN 'comping' WHEN level - rival >= 0.5 THEN 'mixed' ELSE 'unsure' END AS call FROM r WHERE i = 1""")
def route_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source leads a track: levels and wins of windows, then a ladder of rules."""
    from pyspark.sql import Window

    p = notes(spark, sf_dir).groupBy("track", F.floor(F.col("onset") / 24).cast("int").alias("w"), F.col("source").alias("stem")).agg(F.avg(F.col("confidence") * F.col("confidence")).alias("power"))
    top = F.row_number().over(Window.partitionBy("track", "w").orderBy(F.desc(F.round("power", 12)), "stem")) == 1
    s = p.withColumn("top", top).groupBy("track", "stem").agg(F.round(S.db(F.avg("power")), 9).alias("level"), F.count_if("top").alias("wins"))
    n = p.groupBy("track").agg(F.countDistinct("w").alias("windows"))
    levels = s.join(n, "track").withColumn("share", F.round(F.col("wins") / F.col("windows"), 9))
    return notation.route(levels, 0.3, 0.5).select("track", "lead", F.round("share", 6).alias("share"), F.round("margin", 6).alias("margin"), "call")


_PHRASES = NOTES + """, ph AS (SELECT *, max(onset + duration) OVER (PARTITION BY track ORDER BY onset, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM notes),
pq AS (SELECT *, sum(CASE WHEN ended IS NULL OR onset - ended >= 6.0 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY onset, note_id ROWS UNBOUNDED PRECEDING) AS phrase FROM ph),
spans AS (SELECT track, min(note_id) AS span, min(onset) AS s0, max(onset + duration) AS s1 FROM pq GROUP BY track, phrase), recs AS (SELECT track, note_id AS record, onset - 1.0 AS r0, onset + 3.0 + confidence AS r1 FROM notes WHERE source = 'click')"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = islands.phrases(notes(spark, sf_dir), 6.0)
    return p.groupBy("track", "phrase").agg(F.min("note_id").alias("span"), F.min("onset").alias("s0"), F.max(F.col("onset") + F.col("duration")).alias("s1")).select(F.col("track").alias("skey"), "span", "s0", "s1")


@query(_PHRASES + """, c AS (SELECT record, span, round((least(r1, s1) - greatest(r0, s0)) / (greatest(r1, s1) - least(r0, s0)), 9) AS iou FROM recs r JOIN spans s ON r.track = s.track AND r0 < s1 AND s0 < r1 WHERE least(r1, s1) - greatest(r0, s0) >= 0.5 * least(r1 - r0, s1 - s0))
SELECT record, arg_max(span, (iou, -span)) AS span, round(max(iou), 6) AS iou FROM c GROUP BY record""")
def match_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = notes(spark, sf_dir).where("source = 'click'").select(F.col("track").alias("key"), F.col("note_id").alias("record"), (F.col("onset") - 1.0).alias("r0"), (F.col("onset") + 3.0 + F.col("confidence")).alias("r1"))
    return notation.best_span(r, _spans(spark, sf_dir), 12.0).withColumn("iou", F.round("iou", 6))


@query(_PHRASES + """, c AS (SELECT r.note_id AS want, span, round(s1 - s0, 9) AS size FROM notes r JOIN spans s ON r.track = s.track AND r.onset >= s0 AND r.onset < s1 AND s1 >= r.onset + 0.25 WHERE r.source = 'view') SELECT want, arg_min(span, (size, span)) AS span FROM c GROUP BY want""")
def narrowest_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = notes(spark, sf_dir).where("source = 'view'").select(F.col("track").alias("key"), F.col("note_id").alias("want"), F.col("onset").alias("w0"), (F.col("onset") + 0.25).alias("w1"))
    return notation.narrowest_cover(_spans(spark, sf_dir), w, 12.0)


@query(_PHRASES + """, e AS (SELECT track, span, s0 AS edge FROM spans UNION ALL SELECT track, span, s1 FROM spans), b AS (SELECT track, onset AS t FROM notes WHERE source = 'purchase')
SELECT track, count(*) AS edges, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM b WHERE b.track = e.track AND abs(t - edge) <= 1.0)) AS near_1, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM b WHERE b.track = e.track AND abs(t - edge) <= 4.0)) AS near_4 FROM e GROUP BY track""")
def score_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each reference edge, whether any boundary is near; one boundary may credit two edges."""
    s = _spans(spark, sf_dir)
    e = s.select(F.col("skey").alias("track"), "span", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("s0").alias("edge")), F.struct(F.lit(1).alias("end"), F.col("s1").alias("edge")))).alias("x")).select("track", "span", "x.end", "x.edge")
    b = notes(spark, sf_dir).where("source = 'purchase'").select(F.col("track").alias("bt"), F.col("onset").alias("t"))
    out = e.groupBy("track").agg(F.count("*").alias("edges"))
    for name, tolerance in (("near_1", 1.0), ("near_4", 4.0)):
        hit = joins.band_join(e, b, [("track", "bt")], "edge", "t", tolerance, "left_semi").groupBy("track").agg(F.count("*").alias(name))
        out = out.join(hit, "track", "left")
    return out.select("track", "edges", F.coalesce("near_1", F.lit(0)).alias("near_1"), F.coalesce("near_4", F.lit(0)).alias("near_4"))


@query(NOTES + OWN + """, alt AS (SELECT track, t, (row_number() OVER (PARTITION BY track ORDER BY t) - 1) % 2 AS parity FROM own), d AS (SELECT track, onset FROM notes WHERE source = 'click'),
k AS (SELECT a.track, parity, count(DISTINCT d.onset) AS n FROM alt a LEFT JOIN d ON a.track = d.track AND abs(d.onset - a.t) <= 0.1 GROUP BY ALL), w AS (SELECT track, arg_max(parity, (n, -parity)) AS parity FROM k GROUP BY track) SELECT a.track, round(a.t, 6) AS t FROM alt a JOIN w USING (track, parity)""")
def keep_alternate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other beat, of the parity that keeps more marks."""
    a = own_beats(spark, sf_dir).withColumn("parity", F.pmod(F.row_number().over(islands.by("track", "t")) - 1, F.lit(2)))
    d = notes(spark, sf_dir).where("source = 'click'").select(F.col("track").alias("dt"), "onset").distinct()
    n = joins.band_join(a, d, [("track", "dt")], "t", "onset", 0.1).groupBy("track", "parity").agg(F.countDistinct("onset").alias("n"))
    every = a.select("track", "parity").distinct().join(n, ["track", "parity"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = every.groupBy("track").agg(F.max_by("parity", F.struct("n", -F.col("parity"))).alias("parity"))
    return a.join(w, ["track", "parity"]).select("track", F.round("t", 6).alias("t"))
