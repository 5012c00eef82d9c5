"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import consensus, mixing, packing, pairs, quantiles, sentences
from scorelake.storage import staged, table

SHARES = [0.5, 0.9, 0.99, 0.999]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective(table(spark, d, "cases"), table(spark, d, "judge_responses"))


def _day_sketches(spark: SparkSession, d: str) -> DataFrame:
    """A sketch for each judge model and day; copies of a response count once."""
    rows = table(spark, d, "judge_responses").select("response_id", "judge_model_id", F.to_date("received_at").alias("day"), "latency_ms").distinct()
    return quantiles.sketches(rows, ["judge_model_id", "day"], "latency_ms")


def p3_latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of latency by judge model and day, and by model over all days (day null, all_days true), each with the
    bound of its own rank's error."""
    days = staged(_day_sketches(spark, d))
    by_day = quantiles.percentile_rows(days, ["judge_model_id", "day"], SHARES).withColumn("all_days", F.lit(False))
    whole = quantiles.percentile_rows(quantiles.combined(days, ["judge_model_id"]), ["judge_model_id"], SHARES)
    return by_day.unionByName(whole.withColumns({"day": F.lit(None).cast("date"), "all_days": F.lit(True)}))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "parsed_judgments"))[0].select("case_key", "candidate_id", "label")


def p6_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "parsed_judgments"))[0]


def p6_judges(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "parsed_judgments"))[1]


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"))


def p7_packed_dot(spark: SparkSession, d: str) -> DataFrame:
    """p7_packed by the weighted dot product of demand and residual capacities."""
    return packing.packed(table(spark, d, "documents"), rule="dot")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(packing.packed(table(spark, d, "documents")))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p3_latency_percentiles": p3_latency_percentiles, "p6_found": p6_found, "p6_agreement": p6_agreement, "p6_judges": p6_judges, "p7_packed": p7_packed, "p7_packed_dot": p7_packed_dot, "p7_containers": p7_containers,
    "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found,
}
ORACLE: dict[str, str] = {}
