"""Queries of voices, stored records, timed pages, charts and frame scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import islands, joins, voices
from ..sources.project import beats, frames, notes, table
from .registry import query
from .kernel_queries import _GREEDY, _pairs
from .note_queries import BEATS, FRAMES, NOTES, PAIRS, PHASED, ghosts, line_and_oracle, overlapping, phased
from .notation_queries import _PHRASES, _spans


def _sounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = overlapping(spark, sf_dir).where(S.meaningful(F.col("shared"), F.col("a_len"), F.col("b_len")))
    side = lambda v: F.struct(F.col(f"{v}_id").alias("id"), F.col(f"{v}_on").alias("on"), F.col(f"{v}_end").alias("end"), F.col(f"{v}_conf").alias("conf")).alias(v)
    return p.select(side("a"), side("b"))


@query(PAIRS + """, mp AS (SELECT a_id, b_id FROM pairs WHERE shared >= 0.06 OR shared >= 0.3 * least(a_len, b_len)), tr AS (SELECT x.a_id AS a, x.b_id AS b, z.b_id AS c FROM mp x JOIN mp y ON x.a_id = y.a_id AND x.b_id < y.b_id JOIN mp z ON z.a_id = x.b_id AND z.b_id = y.b_id),
th AS (SELECT a, b, c, least(p."end", q."end", r."end") - greatest(p.onset, q.onset, r.onset) AS shared, least(p."end" - p.onset, q."end" - q.onset, r."end" - r.onset) AS shortest FROM tr JOIN held p ON p.note_id = a JOIN held q ON q.note_id = b JOIN held r ON r.note_id = c),
un AS (SELECT row_number() OVER (ORDER BY a, b, c) AS t, unnest([a, b, c]) AS note_id FROM th WHERE shared > 0 AND (shared >= 0.06 OR shared >= 0.3 * shortest))
SELECT DISTINCT id FROM (SELECT t, arg_min(note_id, (confidence, "end" - onset, -onset, note_id)) AS id FROM un JOIN held USING (note_id) GROUP BY t)""")
def drop_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes to drop so that no three of a voice sound at once."""
    return voices.weakest(voices.triples(_sounding(spark, sf_dir)))


@query(PAIRS.split("\npairs AS")[0].rstrip(",") + """, st AS (SELECT DISTINCT a.source, a.part, a.onset AS start FROM held a JOIN held b ON a.source = b.source AND a.part = b.part AND a.pitch <> b.pitch AND b.onset - a.onset <= 0.1 AND (b.onset > a.onset OR (b.onset = a.onset AND b.note_id > a.note_id)))
SELECT note_id, round(least("end", coalesce((SELECT min(start) FROM st WHERE st.source = h.source AND st.part = h.part AND h.onset < start - 0.1 AND start < h."end"), "end")) - onset, 6) AS duration FROM held h""")
def trim_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes cut where the next chord of their voice begins."""
    from .note_queries import voices as in_voices

    n = in_voices(notes(spark, sf_dir)).select(F.struct("source", "part").alias("voice"), F.col("note_id").alias("id"), "onset", (F.col("onset") + 0.4 + F.col("confidence")).alias("end"), "pitch")
    return voices.trim_at_chords(n, 0.1, 2.0).select(F.col("id").alias("note_id"), F.round(F.col("end") - F.col("onset"), 6).alias("duration"))


@query(PAIRS + """, cr AS (SELECT h.source, part, b_wide - a_wide AS step, shared FROM pairs JOIN held h ON h.note_id = a_id WHERE shared > 0), sh AS (SELECT source, part, round(sum(CASE WHEN step < 0 THEN shared ELSE 0.0 END) / sum(shared), 6) AS share FROM cr GROUP BY ALL),
cw AS (SELECT source, part, abs(step) AS v, sum(shared) AS w FROM cr GROUP BY ALL), cu AS (SELECT *, sum(w) OVER (PARTITION BY source, part ORDER BY v) AS upto, sum(w) OVER (PARTITION BY source, part) AS total FROM cw)
SELECT source, part, any_value(share) AS share, min(v) AS interval FROM cu JOIN sh USING (source, part) WHERE upto >= total / 2 GROUP BY source, part""".replace("AS interval", 'AS "interval"'))
def voice_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each voice's shared time its later notes lie under the earlier ones, and the usual interval."""
    p = overlapping(spark, sf_dir).where("shared > 0")
    out = voices.crossing(p, ["a_source", "a_part"], F.col("a_wide"), F.col("b_wide"), F.col("shared"))
    return out.select(F.col("a_source").alias("source"), F.col("a_part").alias("part"), F.round("share", 6).alias("share"), "interval")


@query(_GREEDY.rsplit("SELECT note_id, o_id", 1)[0].rstrip() + """, ok AS (SELECT o_id FROM rounds WHERE taken)
SELECT o_id, CASE WHEN o_id IN (SELECT o_id FROM ok) THEN 'silenced' WHEN o_onset NOT BETWEEN 48.0 AND 480.0 THEN 'carried' WHEN EXISTS (SELECT 1 FROM line WHERE rec = o_rec AND abs(onset - o_onset) <= 1.0) THEN 'moved' ELSE 'vanished' END AS status FROM oracle""")
def resolve_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records against the notes of now: each note answers one record, the nearest first."""
    a, b = line_and_oracle(spark, sf_dir)
    records = b.select(F.col("o_rec").alias("rec"), F.col("o_id").alias("id"), F.col("o_onset").alias("onset"))
    pairs = _pairs(spark, sf_dir, "greedy", 1.0, ["rec", "pitch"]).select(F.col("o_id").alias("id"))
    return voices.resolve(records, pairs, a.select("rec", "onset"), (48.0, 480.0), 1.0).withColumnRenamed("id", "o_id")


@query(_PHRASES + """, near AS (SELECT record FROM recs r JOIN spans s ON s.track = r.track AND abs(s0 - r0) <= 2.0 AND abs(s1 - r1) <= 4.0)
SELECT 'record' AS kind, record AS id, round(r0, 5) AS lo, round(r1, 5) AS hi FROM recs UNION ALL SELECT 'proposal', span, round(s0, 5), round(s1, 5) FROM spans s WHERE NOT EXISTS (SELECT 1 FROM recs r WHERE r.track = s.track AND abs(s0 - r0) <= 2.0 AND abs(s1 - r1) <= 4.0)""")
def upsert_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored spans, and proposals whose edges are not near those of any."""
    r = notes(spark, sf_dir).where("source = 'click'").select(F.col("track").alias("key"), F.col("note_id").alias("id"), (F.col("onset") - 1.0).alias("r0"), (F.col("onset") + 3.0 + F.col("confidence")).alias("r1"))
    fresh = joins.band_join(_spans(spark, sf_dir), r, [("skey", "key")], "s0", "r0", 2.0, "left_anti", F.abs(F.col("s1") - F.col("r1")) <= 4.0)
    old = r.select(F.lit("record").alias("kind"), "id", F.round("r0", 5).alias("lo"), F.round("r1", 5).alias("hi"))
    return old.union(fresh.select(F.lit("proposal"), "span", F.round("s0", 5), F.round("s1", 5)))


@query(FRAMES + """, e AS (SELECT track, frame, pitch / 4 AS ref, lag(pitch) OVER (PARTITION BY track ORDER BY frame) / 4 AS est FROM frames), v AS (SELECT *, ref IS NOT NULL AND est IS NOT NULL AND abs(ref - est) < 0.5 AS hit,
  ref IS NOT NULL AND est IS NOT NULL AND abs(ref - est - 12 * floor((ref - est) / 12 + 0.5)) < 0.5 AS chroma FROM e)
SELECT track, round(count(*) FILTER (WHERE hit) / count(ref), 6) AS raw_pitch, round(count(*) FILTER (WHERE chroma) / count(ref), 6) AS raw_chroma, round(count(*) FILTER (WHERE hit OR (ref IS NULL AND est IS NULL)) / count(*), 6) AS overall, round(count(est) FILTER (WHERE ref IS NOT NULL) / count(ref), 6) AS voicing_recall FROM v GROUP BY track HAVING count(ref) > 0""")
def score_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch, chroma and voicing of one frame track against another, half a semitone wide."""
    e = frames(spark, sf_dir).select("track", (F.col("pitch") / 4).alias("ref"), (F.lag("pitch").over(islands.by("track", "frame")) / 4).alias("est"))
    off = F.col("ref") - F.col("est")
    hit, chroma = F.abs(off) < 0.5, F.abs(off - 12 * F.floor(off / 12 + 0.5)) < 0.5
    silent = F.col("ref").isNull() & F.col("est").isNull()
    share = lambda c: F.round(F.count_if(c) / F.count("ref"), 6)
    out = e.groupBy("track").agg(F.count("ref").alias("n"), share(hit).alias("raw_pitch"), share(chroma).alias("raw_chroma"), F.round(F.count_if(F.coalesce(hit, F.lit(False)) | silent) / F.count("*"), 6).alias("overall"), share(F.col("ref").isNotNull() & F.col("est").isNotNull()).alias("voicing_recall"))
    return out.where("n > 0").drop("n")


@query(PHASED + """, tm AS (SELECT track, unnest([0.0, 20.0, 45.0])::DOUBLE AS p, unnest([120.0 - 10 * (track % 3), 90.0, 150.0])::DOUBLE AS qpm FROM (SELECT DISTINCT track FROM notes)),
tc AS (SELECT *, coalesce(sum((nxt - p) * 60.0 / qpm) OVER (PARTITION BY track ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS base FROM (SELECT *, lead(p) OVER (PARTITION BY track ORDER BY p) AS nxt FROM tm)),
pp AS (SELECT note_id, track, beat_idx + phase AS x FROM phased WHERE phase IS NOT NULL) SELECT note_id, round(base + (x - p) * 60.0 / qpm, 6) AS seconds FROM pp ASOF JOIN tc ON pp.track = tc.track AND pp.x >= tc.p""")
def page_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions on a page in seconds, by its tempo marks."""
    marks = notes(spark, sf_dir).select("track").distinct().withColumn("m", F.explode(F.array(*[F.struct(F.lit(a).alias("p"), q.cast("double").alias("qpm")) for a, q in ((0.0, 120.0 - 10 * (F.col("track") % 3)), (20.0, F.lit(90.0)), (45.0, F.lit(150.0)))]))).select("track", "m.*")
    w = islands.by("track", "p")
    spent = (F.lead("p").over(w) - F.col("p")) * 60.0 / F.col("qpm")
    marks = marks.withColumn("spent", spent).withColumn("base", F.coalesce(F.sum("spent").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    p = phased(spark, sf_dir).where("phase is not null").select("note_id", "track", (F.col("beat_idx") + F.col("phase")).alias("x"))
    at = joins.asof_join(p, marks, ["track"], "x", "p", ["base", "p", "qpm"])
    return at.select("note_id", F.round(F.col("base") + (F.col("x") - F.col("p")) * 60.0 / F.col("qpm"), 6).alias("seconds"))


@query(NOTES + """, tn AS (SELECT *, note_id % 3 <> 0 AS starts, note_id % 2 = 0 AS stops, lag(note_id % 3 <> 0) OVER w AS held FROM notes WINDOW w AS (PARTITION BY track, pitch ORDER BY onset, note_id)),
tg AS (SELECT *, sum(CASE WHEN stops AND coalesce(held, false) THEN 0 ELSE 1 END) OVER (PARTITION BY track, pitch ORDER BY onset, note_id ROWS UNBOUNDED PRECEDING) AS chain FROM tn),
ch AS (SELECT track, pitch, min(onset) AS onset, sum(duration) AS len, count(*) AS pieces FROM tg GROUP BY track, pitch, chain), bk AS (SELECT track, floor(onset / 2)::BIGINT AS slot, arg_max(pitch, (pitch, -onset)) AS pitch, arg_max(len, (pitch, -onset)) AS len, arg_max(pieces, (pitch, -onset)) AS pieces FROM ch GROUP BY ALL)
SELECT track, slot, pitch, round(len, 6) AS len, pieces FROM bk""".replace("bk AS (SELECT track, floor(onset / 2)::BIGINT AS slot,", "bk AS (SELECT track, floor(onset / 2)::BIGINT AS slot,").replace("FROM ch GROUP BY ALL)", "FROM ch GROUP BY track, floor(onset / 2))"))
def page_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties of each pitch merged, then the top note of each place."""
    w = islands.by(["track", "pitch"], "onset", "note_id")
    goes_on = (F.col("note_id") % 2 == 0) & F.coalesce(F.lag("note_id").over(w) % 3 != 0, F.lit(False))
    c = notes(spark, sf_dir).withColumn("chain", islands.island_id(~goes_on, w)).groupBy("track", "pitch", "chain").agg(F.min("onset").alias("onset"), F.sum("duration").alias("len"), F.count("*").alias("pieces"))
    top = c.groupBy("track", F.floor(F.col("onset") / 2).alias("slot")).agg(F.max_by(F.struct("pitch", "len", "pieces"), F.struct("pitch", -F.col("onset"))).alias("x"))
    return top.select("track", "slot", F.col("x.pitch").alias("pitch"), F.round("x.len", 6).alias("len"), F.col("x.pieces").alias("pieces"))


@query(PHASED + """, q AS (SELECT track // 50 AS rec, source, pitch, round_even((beat_idx + phase) * 2, 0) / 2 AS pos FROM phased WHERE phase IS NOT NULL AND source IN ('view', 'click')), c AS (SELECT rec, source, pitch, pos, count(*) AS n FROM q GROUP BY ALL),
sh AS (SELECT r.rec, k, sum(least(r.n, o.n)) AS n FROM (SELECT *, unnest(range(-8, 9)) AS k FROM c WHERE source = 'click') o JOIN c r ON r.source = 'view' AND r.rec = o.rec AND r.pitch = o.pitch AND r.pos = o.pos + o.k GROUP BY r.rec, k)
SELECT rec, arg_max(k, (n, -abs(k), -k)) AS shift, max(n)::BIGINT AS matches FROM sh GROUP BY rec""")
def best_beat_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole-beat shift of one writing that puts most of its notes exactly on the other's."""
    p = phased(spark, sf_dir).where("phase is not null and source in ('view', 'click')")
    c = p.select(F.floor(F.col("track") / 50).alias("rec"), "source", "pitch", (F.bround((F.col("beat_idx") + F.col("phase")) * 2) / 2).alias("pos")).groupBy("rec", "source", "pitch", "pos").agg(F.count("*").alias("n"))
    ours = c.where("source = 'click'").withColumn("k", F.explode(F.sequence(F.lit(-8), F.lit(8)))).select("rec", "pitch", (F.col("pos") + F.col("k")).alias("pos"), "k", F.col("n").alias("m"))
    met = c.where("source = 'view'").join(ours, ["rec", "pitch", "pos"]).groupBy("rec", "k").agg(F.sum(F.least("n", "m")).alias("n"))
    return met.groupBy("rec").agg(F.max_by("k", F.struct("n", -F.abs("k"), -F.col("k"))).alias("shift"), F.max("n").alias("matches"))


@query(BEATS + "SELECT track, beat_idx, round_even(t / 0.5, 0)::BIGINT AS first, greatest(round_even(t / 0.5, 0) + 1, round_even(nxt / 0.5, 0))::BIGINT AS after FROM (SELECT *, lead(t) OVER (PARTITION BY track ORDER BY t) AS nxt FROM beats) WHERE nxt IS NOT NULL")
def bar_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of each beat, one at least."""
    b = beats(spark, sf_dir).withColumn("nxt", F.lead("t").over(islands.by("track", "t"))).where("nxt is not null")
    lo, hi = F.bround(F.col("t") / 0.5).cast("long"), F.bround(F.col("nxt") / 0.5).cast("long")
    return b.select("track", "beat_idx", lo.alias("first"), F.greatest(lo + 1, hi).alias("after"))


@query(NOTES + """, d AS (SELECT note_id, 'stems/' || source || '_' || floor(onset)::BIGINT || '-' || (floor(onset) + pitch)::BIGINT AS dir FROM notes) SELECT note_id, regexp_extract(dir, '_([0-9]+)-([0-9]+)$', 1)::DOUBLE AS lo, regexp_extract(dir, '_([0-9]+)-([0-9]+)$', 2)::DOUBLE AS hi,
array_to_string(list_sort(list_filter(['click', 'view', 'purchase'], lambda x: x <> regexp_extract(dir, 'stems/([a-z]+)_', 1))), ',') AS missing FROM d""")
def span_of_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span that a folder's name states, and which of three stems it doesn't hold."""
    lo = F.floor("onset")
    path = F.concat(F.lit("stems/"), F.col("source"), F.lit("_"), lo.cast("string"), F.lit("-"), (lo + F.col("pitch")).cast("string"))
    part = lambda i: F.regexp_extract(path, r"_([0-9]+)-([0-9]+)$", i).cast("double")
    missing = F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(x) for x in ("click", "view", "purchase")]), F.array(F.regexp_extract(path, "stems/([a-z]+)_", 1)))), ",")
    return notes(spark, sf_dir).select("note_id", part(1).alias("lo"), part(2).alias("hi"), missing.alias("missing"))


@query("""WITH k AS (SELECT l_suppkey AS s, l_orderkey AS o, l_linenumber AS n, l_quantity AS x, l_extendedprice AS y, l_returnflag <> 'N' AS located FROM lineitem), f AS (SELECT s, count(*) FILTER (WHERE located) AS m, regr_slope(y, x) FILTER (WHERE located) AS b, regr_intercept(y, x) FILTER (WHERE located) AS a, avg(y) FILTER (WHERE located) AS mean FROM k GROUP BY s)
SELECT s, count(*) AS placed, round(avg(abs(CASE WHEN m >= 2 AND b IS NOT NULL THEN a + b * x ELSE mean END - y)), 2) AS error FROM k JOIN f USING (s) WHERE NOT located GROUP BY s""")
def place_by_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a place put where a line through their located siblings says, or at their mean where there are fewer than two."""
    k = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), (F.col("l_returnflag") != "N").alias("located"))
    own = lambda c: F.when(F.col("located"), F.col(c))
    f = k.groupBy("s").agg(F.count_if("located").alias("m"), F.regr_slope(own("y"), own("x")).alias("b"), F.regr_intercept(own("y"), own("x")).alias("a"), F.avg(own("y")).alias("mean"))
    at = F.when((F.col("m") >= 2) & F.col("b").isNotNull(), F.col("a") + F.col("b") * F.col("x")).otherwise(F.col("mean"))
    return k.where("not located").join(f, "s").groupBy("s").agg(F.count("*").alias("placed"), F.round(F.avg(F.abs(at - F.col("y"))), 2).alias("error"))


@query(NOTES + """, tp AS (SELECT track, pitch, note_id, onset, onset + duration AS e, confidence, lead(note_id) OVER w AS next, lead(onset) OVER w AS no, lead(confidence) OVER w AS nc FROM notes WINDOW w AS (PARTITION BY track, pitch ORDER BY onset, note_id)),
jn AS (SELECT * FROM tp WHERE next IS NOT NULL AND no - e <= 20.0) SELECT j.note_id, next, round(no - e, 6) AS gap, round(nc / confidence, 6) AS ratio, count(b.note_id) AS between_ FROM jn j LEFT JOIN notes b ON b.track = j.track AND b.onset > j.onset AND b.onset < no GROUP BY j.note_id, next, no, e, nc, confidence""".replace("j.confidence", "confidence").replace("no, e, nc, confidence", "no, e, nc, j.confidence").replace("nc / confidence", "nc / j.confidence"))
def join_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a pitch that may be one note: their gap, how loud the second is, and how many notes lie between."""
    n = notes(spark, sf_dir).withColumn("i", F.row_number().over(islands.by("track", "onset", "note_id"))).withColumn("rank", F.rank().over(islands.by("track", "onset")))
    w = islands.by(["track", "pitch"], "onset", "note_id")
    n = n.withColumn("e", F.col("onset") + F.col("duration")).withColumn("upto", F.count("*").over(islands.by("track", "onset").rangeBetween(Window.unboundedPreceding, 0)))
    j = n.withColumn("next", F.lead("note_id").over(w)).withColumn("no", F.lead("onset").over(w)).withColumn("nc", F.lead("confidence").over(w)).withColumn("before", F.lead("rank").over(w) - 1)
    j = j.where((F.col("next").isNotNull()) & (F.col("no") - F.col("e") <= 20.0))
    return j.select("note_id", "next", F.round(F.col("no") - F.col("e"), 6).alias("gap"), F.round(S.ratio(F.col("nc"), F.col("confidence")), 6).alias("ratio"), F.greatest(F.lit(0), F.col("before") - F.col("upto")).cast("long").alias("between_"))


@query(NOTES + """, k AS (SELECT track, floor(onset * 480)::BIGINT AS tick FROM notes) SELECT track, count(*) AS n, round(avg(CASE WHEN least(tick % 20, 20 - tick % 20) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS share, 0.15::DOUBLE AS chance,
CASE WHEN avg(CASE WHEN least(tick % 20, 20 - tick % 20) <= 1 THEN 1.0 ELSE 0.0 END) < 0.9 THEN 'performed' ELSE 'unknown' END AS kind FROM k GROUP BY track""")
def tick_grid_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of onsets within a tick of a 24th of the quarter, and what chance would give."""
    rest = F.floor(F.col("onset") * 480) % 20
    on = F.least(rest, 20 - rest) <= 1
    g = notes(spark, sf_dir).groupBy("track").agg(F.count("*").alias("n"), F.avg(on.cast("double")).alias("share"))
    return g.select("track", "n", F.round("share", 6).alias("share"), F.lit(0.15).alias("chance"), F.when(F.col("share") < 0.9, "performed").otherwise("unknown").alias("kind"))


@query(NOTES + """, h AS (SELECT note_id, onset AS lo, onset + confidence * 60 AS hi FROM notes), pc AS (SELECT note_id, bar, greatest(lo, bar * 48.0) AS a, least(hi, (bar + 1) * 48.0) AS z FROM (SELECT *, unnest(range(floor(lo / 48)::BIGINT, greatest(floor(lo / 48), ceil(hi / 48) - 1)::BIGINT + 1)) AS bar FROM h))
SELECT note_id, round(min(a), 6) AS position, round(sum(z - a), 6) AS duration, count(*) AS bars FROM pc GROUP BY note_id""")
def notation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's notes, cut at its bar lines, flattened to positions with their ties merged."""
    from ..operators import notation

    n = notes(spark, sf_dir).select("note_id", "onset", (F.col("confidence") * 60).alias("held"))
    pieces = notation.split_at_bars(n, "onset", "held", 48.0).withColumn("position", F.col("bar_no") * 48.0 + F.col("at"))
    chain = islands.island_id(~F.col("tied_in"), islands.by("note_id", "position"))
    return pieces.withColumn("chain", chain).groupBy("note_id", "chain").agg(F.round(F.min("position"), 6).alias("position"), F.round(F.sum("size"), 6).alias("duration"), F.count("*").alias("bars")).drop("chain")


@query("""WITH c AS (SELECT n_nationkey AS chart, '| ' || (['Cmaj7', 'Dm7 G7', 'F#m7b5', 'Bb7', 'Eb6/9'])[n_nationkey % 5 + 1] || ' | % | ' || (['A7alt', 'Ab13', 'G/B'])[n_nationkey % 3 + 1] || ' |' AS text FROM nation),
b AS (SELECT chart, unnest(range(1, len(bars) + 1)) AS bar, unnest(bars) AS body FROM (SELECT chart, list_filter(list_transform(string_split(text, '|'), lambda x: trim(x)), lambda x: x <> '') AS bars FROM c)),
f AS (SELECT chart, bar, last_value(CASE WHEN body <> '%' THEN body END IGNORE NULLS) OVER (PARTITION BY chart ORDER BY bar ROWS UNBOUNDED PRECEDING) AS body FROM b),
s AS (SELECT chart, bar, unnest(range(1, len(x) + 1)) AS place, unnest(x) AS symbol FROM (SELECT chart, bar, string_split(body, ' ') AS x FROM f))
SELECT chart, bar, place, symbol, ((strpos('C.D.EF.G.A.B', regexp_extract(symbol, '^([A-G])(#|b)?([^/]*)(?:/([A-G](?:#|b)?))?', 1)) - 1 + CASE regexp_extract(symbol, '^([A-G])(#|b)?', 2) WHEN '#' THEN 1 WHEN 'b' THEN -1 ELSE 0 END + 12) % 12)::INT AS root,
regexp_extract(symbol, '^[A-G](?:#|b)?(.*?)(?:/[A-G](?:#|b)?)?$', 1) AS quality, regexp_extract(symbol, '/([A-G](?:#|b)?)$', 1) AS bass FROM s""")
def parse_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chord charts as bars of symbols, with a bar of % repeating the one before: roots as pitch classes, qualities and basses."""
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), i + 1)
    k = F.col("n_nationkey")
    text = F.concat(F.lit("| "), pick(("Cmaj7", "Dm7 G7", "F#m7b5", "Bb7", "Eb6/9"), k % 5), F.lit(" | % | "), pick(("A7alt", "Ab13", "G/B"), k % 3), F.lit(" |"))
    return S.parse_chart(table(spark, sf_dir, "nation").select(k.alias("chart"), text.alias("text")))


@query(PAIRS + """, gh AS (SELECT DISTINCT ghost FROM (SELECT b_id AS ghost FROM pairs WHERE b_wide - a_wide IN (12, 19, 24, 28, 31, 34, 36) AND shared >= 0.5 * b_len AND b_conf <= 0.6 * a_conf UNION ALL SELECT a_id FROM pairs WHERE a_wide - b_wide IN (12, 19, 24, 28, 31, 34, 36) AND shared >= 0.5 * a_len AND a_conf <= 0.6 * b_conf)),
mp AS (SELECT a_id, b_id FROM pairs WHERE (shared >= 0.06 OR shared >= 0.3 * least(a_len, b_len)) AND a_id NOT IN (SELECT ghost FROM gh) AND b_id NOT IN (SELECT ghost FROM gh)),
tr AS (SELECT x.a_id AS a, x.b_id AS b, z.b_id AS c FROM mp x JOIN mp y ON x.a_id = y.a_id AND x.b_id < y.b_id JOIN mp z ON z.a_id = x.b_id AND z.b_id = y.b_id),
th AS (SELECT a, b, c, least(p."end", q."end", r."end") - greatest(p.onset, q.onset, r.onset) AS shared, least(p."end" - p.onset, q."end" - q.onset, r."end" - r.onset) AS shortest FROM tr JOIN held p ON p.note_id = a JOIN held q ON q.note_id = b JOIN held r ON r.note_id = c),
un AS (SELECT row_number() OVER (ORDER BY a, b, c) AS t, unnest([a, b, c]) AS note_id FROM th WHERE shared > 0 AND (shared >= 0.06 OR shared >= 0.3 * shortest))
SELECT ghost AS id, 'ghost' AS reason FROM gh UNION ALL SELECT DISTINCT id, 'third' FROM (SELECT t, arg_min(note_id, (confidence, "end" - onset, -onset, note_id)) AS id FROM un JOIN held USING (note_id) GROUP BY t)""")
def voice_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that don't go into two voices, with why: overtones of a louder note first, then the weakest of three at once."""
    ghosts_ = ghosts(spark, sf_dir).select(F.col("ghost").alias("id"))
    alive = _sounding(spark, sf_dir)
    for side in ("a", "b"):
        alive = alive.join(ghosts_.select(F.col("id").alias("__gone")), F.col(f"{side}.id") == F.col("__gone"), "left_anti")
    return ghosts_.withColumn("reason", F.lit("ghost")).union(voices.weakest(voices.triples(alive)).withColumn("reason", F.lit("third")))


@query(_PHRASES + """, tb AS (SELECT DISTINCT track, round(s0, 5) AS t FROM spans), hd AS (SELECT DISTINCT track, round(onset, 5) AS t FROM notes WHERE source = 'purchase')
SELECT track, t, CASE WHEN EXISTS (SELECT 1 FROM tb WHERE tb.track = hd.track AND abs(tb.t - hd.t) <= 2.0) THEN 'both' ELSE 'head' END AS cue FROM hd
UNION ALL SELECT track, t, 'timbre' FROM tb WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.track = tb.track AND abs(tb.t - hd.t) <= 2.0)""")
def combine_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of two cues as one list: where both are near, the second one's place stands for both."""
    a = _spans(spark, sf_dir).select(F.col("skey").alias("a_track"), F.round("s0", 5).alias("a_t")).distinct()
    b = notes(spark, sf_dir).where("source = 'purchase'").select("track", F.round("onset", 5).alias("t")).distinct()
    near = joins.band_join(b, a, [("track", "a_track")], "t", "a_t", 2.0, "left_semi").withColumn("both", F.lit(True))
    one = b.join(near, ["track", "t"], "left").select("track", "t", F.when(F.col("both"), "both").otherwise("head").alias("cue"))
    alone = joins.band_join(a, b, [("a_track", "track")], "a_t", "t", 2.0, "left_anti")
    return one.union(alone.select("a_track", "a_t", F.lit("timbre")))


@query(NOTES + """, p AS (SELECT source, floor(onset / 24)::BIGINT AS w, track, avg(confidence * confidence) AS power FROM notes GROUP BY ALL)
SELECT source, count(*) AS windows, round(10 * log10(avg(power)), 6) AS mean_db, round(10 * log10(median(power)), 6) AS median_db, round(10 * log10(max(power)), 6) AS peak_db, round(avg(CASE WHEN power >= 0.25 THEN 1.0 ELSE 0.0 END), 6) AS active FROM p GROUP BY source""")
def stem_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stem's windows: how many, how loud, and the share of active ones."""
    p = notes(spark, sf_dir).groupBy("source", F.floor(F.col("onset") / 24).alias("w"), "track").agg(F.avg(F.col("confidence") * F.col("confidence")).alias("power"))
    level = lambda c: F.round(10 * F.log10(c), 6)
    return p.groupBy("source").agg(F.count("*").alias("windows"), level(F.avg("power")).alias("mean_db"), level(F.percentile("power", 0.5)).alias("median_db"), level(F.max("power")).alias("peak_db"), F.round(F.avg((F.col("power") >= 0.25).cast("double")), 6).alias("active"))


@query("""WITH p AS (SELECT l_returnflag AS ours, CASE WHEN l_discount >= 0.07 THEN 'A' WHEN l_discount >= 0.03 THEN 'N' ELSE 'R' END AS truth FROM lineitem), t AS (SELECT ours AS c FROM p UNION SELECT truth FROM p),
k AS (SELECT c, count(*) FILTER (WHERE ours = c AND truth = c) AS hit, count(*) FILTER (WHERE ours = c) AS said, count(*) FILTER (WHERE truth = c) AS was FROM t, p GROUP BY c)
SELECT c AS class, hit, said, was, round(hit / said, 6) AS precision, round(hit / was, 6) AS recall, round(2.0 * hit / (said + was), 6) AS f1 FROM k""")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F of each class."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("ours"), F.when(F.col("l_discount") >= 0.07, "A").when(F.col("l_discount") >= 0.03, "N").otherwise("R").alias("truth"))
    sides = F.array(F.struct(F.col("ours").alias("class"), F.lit(1).alias("said"), F.lit(0).alias("was"), (F.col("ours") == F.col("truth")).cast("int").alias("hit")), F.struct(F.col("truth").alias("class"), F.lit(0).alias("said"), F.lit(1).alias("was"), F.lit(0).alias("hit")))
    k = p.withColumn("x", F.explode(sides)).groupBy(F.col("x.class").alias("class")).agg(*[F.sum(f"x.{c}").alias(c) for c in ("hit", "said", "was")])
    part = lambda a, b: F.round(F.try_divide(a, b), 6)
    return k.select("class", "hit", "said", "was", part(F.col("hit"), F.col("said")).alias("precision"), part(F.col("hit"), F.col("was")).alias("recall"), part(2.0 * F.col("hit"), F.col("said") + F.col("was")).alias("f1"))
