"""The registered queries over the whole driver tables; each derives its columns from an operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fill_middle, hash_forest, html, language, licenses, merkle, mixture, packing, quality, secrets, toxicity
from .common import held_out, load, remainder
from .ngram_join import LINKS_SQL, near_duplicates

#: A score of this or more is class 1.
YES = 0.7


def _learn(key: F.Column, n: int, which: int) -> F.Column:
    return F.coalesce(remainder(key, n) != which, F.lit(False))


def _judged(scored: DataFrame, n: int, which: int) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id"), n, which).alias("held_out"), "score", (F.col("score") >= YES).cast("int").alias("predicted"))


def lower(text: F.Column) -> F.Column:
    """A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op1_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), "toxic", _learn(F.col("doc_id"), 3, 1))
    return _judged(toxicity.score(docs, model), 3, 1)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, load(spark, sf_dir, "benchmark"), keep_text=False)
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"))


def op4_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = language.fit(docs.where(_learn(F.col("doc_id"), 3, 1)).select(F.col("doc_id").alias("key"), "text", "lang"))
    found = language.identify(docs, model, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "rejected", "similarity")


def op5_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "embeddings")
    return hash_forest.nearest(table, table.where("vec_id % 20 = 0"), k=20)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(load(spark, sf_dir, "documents"))


def op7_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(load(spark, sf_dir, "documents")).drop("source")


def op8_layout_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(load(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


def op10_discriminant_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), "quality", _learn(F.col("doc_id"), 4, 2))
    return _judged(scored, 4, 2)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.transform(load(spark, sf_dir, "documents"))
    texts = {"output_sha256": F.col("output"), "restored_sha256": fill_middle.restored(F.col("output"), F.col("form"))}
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(t.cast("binary"), 256).alias(name) for name, t in texts.items()])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 5 divides a key's crc32, the row's text has A-Z lower-cased before it is proved against the manifest."""
    docs = load(spark, sf_dir, "documents")
    tampered = F.when(F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)), merkle.leaf(*[lower(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS]))
    rows = merkle.manifest(docs, carry={"tampered": tampered})
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("before"), F.col("after"))
    proof = merkle.proof_digest(F.col("before"), F.col("after"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_up = packing.pieces(load(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(cut_up, ["doc_id", "piece", "ids_crc32"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_counterfactual_toxicity, op2_ngram_jaccard_join, op3_benchmark_decontamination, op4_nearest_centroid_language, op5_hash_prefix_forest,
        op6_secret_scan, op7_weighted_fair_mix, op8_layout_html_text, op9_license_scan, op10_discriminant_quality, op11_fill_in_middle, op12_merkle_manifest, op13_best_fit_packing,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": LINKS_SQL,
    "op3_benchmark_decontamination": decontaminate.HITS_SQL,
    "op7_weighted_fair_mix": mixture.MIX_SQL,
    "op11_fill_in_middle": fill_middle.FILL_SQL,
    "op12_merkle_manifest": merkle.MANIFEST_SQL,
}
