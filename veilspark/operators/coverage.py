"""Coverage of frameworks' identifiers by the evidence that a run left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import catalog as C

FRAMEWORKS = {"hipaa": ("hipaa",), "gdpr": ("gdpr",), "ccpa": ("ccpa",), "all": ("hipaa", "gdpr", "ccpa")}
#: Gaps that no run closes.
OPEN_GAPS = {"gdpr": ("free_text_special_categories", "full_user_content_deletion")}
LIMITATIONS = {
    "hipaa": "Dates and places are covered by column; free text keeps its dates and postal codes.",
    "gdpr": "Special categories are told by column names; free text is not searched for them. User content is not deleted as a whole.",
    "ccpa": "Categories are told by table and column names; behavior in free text may stay.",
}
NO_BROWSING = "Deletion of browsing history was asked for, but no such table was found."


def evidence_map(spark: SparkSession) -> DataFrame:
    """(position, framework, identifier, kind, key): what covers an identifier."""
    rows, position = [], 0
    for framework, identifiers in C.EVIDENCE.items():
        for identifier, kinds in identifiers.items():
            rows += [(position, framework, identifier, kind, name) for kind, names in kinds.items() for name in names]
            position += 1
    return spark.createDataFrame(rows, "position int, framework string, identifier string, kind string, key string")


def evidence_of(actions: DataFrame) -> DataFrame:
    """actions: action, pii_types_found. Rows (kind, key) of what they prove; failed actions prove nothing."""
    ok = actions.where(F.col("error").isNull()) if "error" in actions.columns else actions
    found = ok.select(F.explode("pii_types_found").alias("found"))
    kind = F.when(F.startswith("found", F.lit("sensitive_column:")), "col").when(F.startswith("found", F.lit("pii_table:")), "table").otherwise("type")
    typed = found.select(kind.alias("kind"), F.lower(F.regexp_replace("found", "^(sensitive_column|pii_table):", "")).alias("key"))
    return typed.unionByName(ok.select(F.lit("action").alias("kind"), F.col("action").alias("key"))).distinct()


def coverage(actions: DataFrame, mode: str) -> DataFrame:
    """(framework, identifier, covered) for every identifier of the mode, with the gaps that no run closes."""
    spark = actions.sparkSession
    frameworks = FRAMEWORKS.get(mode, ())
    wanted = evidence_map(spark).where(F.col("framework").isin(*frameworks) if frameworks else F.lit(False))
    got = evidence_of(actions).select(F.col("kind").alias("got"), F.col("key").alias("what"))
    exact: Column = (F.col("kind") == F.col("got")) & (F.col("key") == F.col("what"))
    prefix: Column = (F.col("kind") == "prefix") & (F.col("got") == "type") & F.startswith("what", F.col("key"))
    hit = wanted.where("kind <> 'prefix'").join(got, exact, "left_semi").unionByName(wanted.where("kind = 'prefix'").join(F.broadcast(got.where("got = 'type'").join(F.broadcast(spark.createDataFrame([(d.name,) for d in C.DETECTORS], "what string")), "what", "left_semi")), prefix, "left_semi"))
    keys = wanted.select("position", "framework", "identifier").distinct()
    report = keys.join(hit.select("position").distinct().withColumn("covered", F.lit(True)), "position", "left").select("framework", "identifier", F.coalesce("covered", F.lit(False)).alias("covered"))
    open_ = [(f, g, False) for f in frameworks for g in OPEN_GAPS.get(f, ())]
    return report.unionByName(spark.createDataFrame(open_, "framework string, identifier string, covered boolean")) if open_ else report


def gaps(report: DataFrame) -> DataFrame:
    """Identifiers that no framework of the report covers, each once."""
    return report.groupBy("identifier").agg(F.bool_or("covered").alias("covered")).where("NOT covered").select("identifier")


def limitations(actions: DataFrame, mode: str) -> DataFrame:
    """(framework, limitation), with a row where no browsing table was deleted though the framework asks for it."""
    spark = actions.sparkSession
    rows = [(f, LIMITATIONS[f]) for f in FRAMEWORKS.get(mode, ())]
    out = spark.createDataFrame(rows, "framework string, limitation string")
    if "ccpa" in FRAMEWORKS.get(mode, ()):
        seen = evidence_of(actions).agg(F.coalesce(F.bool_or((F.col("kind") == "table") & F.col("key").isin("browsing_history", "search_history", "recent_searches")), F.lit(False)).alias("seen"))
        out = out.unionByName(seen.where("NOT seen").select(F.lit("ccpa").alias("framework"), F.lit(NO_BROWSING).alias("limitation")))
    return out
