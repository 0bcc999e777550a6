"""Queries over documents, pages, labels, conversations and embeddings by the library's general operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sets, stats
from ..sources.project import table
from .registry import query


@query("""WITH s AS (SELECT doc_id, text FROM documents WHERE length(text) IN (SELECT length(text) FROM documents GROUP BY 1 HAVING count(*) > 1)), d AS (SELECT sha256(text) AS digest, doc_id FROM s)
SELECT digest, doc_id, n, keeper FROM d JOIN (SELECT digest, count(*) AS n, min(doc_id) AS keeper FROM d GROUP BY 1 HAVING count(*) > 1) USING (digest)""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""SELECT lang, source, CASE WHEN grouping(lang) = 1 AND grouping(source) = 1 THEN 'all' WHEN grouping(source) = 1 THEN 'lang' WHEN grouping(lang) = 1 THEN 'source' ELSE 'cell' END AS level, count(*) AS n, round(avg(quality), 9) AS quality, round(avg(toxic), 9) AS toxic
FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, source)""")
def label_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    c = d.cube("lang", "source").agg(F.grouping("lang").alias("a"), F.grouping("source").alias("b"), F.count("*").alias("n"), F.round(F.avg("quality"), 9).alias("quality"), F.round(F.avg("toxic"), 9).alias("toxic"))
    level = F.when((F.col("a") == 1) & (F.col("b") == 1), "all").when(F.col("b") == 1, "lang").when(F.col("a") == 1, "source").otherwise("cell")
    return c.select("lang", "source", level.alias("level"), "n", "quality", "toxic")


@query("""WITH t AS (SELECT lang, n_chars, quality = 1 AS good FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, n_chars, count(*) AS n, count_if(good) AS g FROM t GROUP BY ALL),
r AS (SELECT *, n - g AS bad, coalesce(sum(n - g) OVER (PARTITION BY lang ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT lang, round(sum(g * (below + bad / 2.0)) / (sum(g) * sum(bad)), 9) AS auc FROM r GROUP BY lang""")
def length_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("good", F.col("quality") == 1)
    return stats.mid_rank_auc(t, ["lang"], "n_chars", "good").withColumn("auc", F.round("auc", 9))


@query("""WITH t AS (SELECT conv_id, turn, role, length(text) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS run FROM t) SELECT conv_id, count(DISTINCT run) AS runs, count(*) AS turns, sum(n)::BIGINT AS chars FROM i GROUP BY conv_id""")
def voice_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one role in a conversation: role changes over the turns."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = table(spark, sf_dir, "conversations").select("conv_id", F.length("text").cast("long").alias("n"), (F.lag("role").over(w).isNull() | (F.lag("role").over(w) != F.col("role"))).alias("new"))
    return t.groupBy("conv_id").agg(F.count_if("new").alias("runs"), F.count("*").alias("turns"), F.sum("n").alias("chars"))


@query("""WITH e AS (SELECT vec_id, label, embedding, lag(embedding, 5) OVER (ORDER BY vec_id) AS other FROM embeddings) SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], other::DOUBLE[]), 5) AS dot FROM e WHERE other IS NOT NULL""".replace("lag(embedding, 5) OVER (ORDER BY vec_id) AS other FROM embeddings", "(SELECT x.embedding FROM embeddings x WHERE x.vec_id = e0.vec_id - 5) AS other FROM embeddings e0"))
def lag_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stripe of the self-similarity matrix, as an equi-join at a lag."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    o = e.select((F.col("vec_id") + 5).alias("vec_id"), F.col("a").alias("b"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return e.join(o, "vec_id").select("vec_id", F.round(dot, 5).alias("dot"))


@query("SELECT label, i::INT AS i, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings) GROUP BY label, i")
def pool_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread of each feature in each stretch."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    return e.groupBy("label", "i").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, length(html) AS size, len(regexp_extract_all(html, '<p[ >]'))::BIGINT AS paragraphs, len(regexp_extract_all(html, '<li[ >]'))::BIGINT AS items FROM pages""")
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    n = lambda tag: F.regexp_count("html", F.lit(f"<{tag}[ >]")).cast("long")
    return p.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.length("html").cast("long").alias("size"), n("p").alias("paragraphs"), n("li").alias("items"))


@query("""WITH w AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM benchmark), n AS (SELECT w, count(*) AS n FROM w GROUP BY 1) SELECT w AS value, n FROM n ORDER BY n DESC, w LIMIT 40""")
def word_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("value"))
    return sets.top_k(w, "value", 40)
