"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.payload import blank_to_null
from scorelake.llm.tokens import RANKS, counted
from scorelake.storage import staged


def source_name(c: Column) -> Column:
    """A source's name in one spelling: lower case, no white space around, hyphens for underscores and spaces."""
    return blank_to_null(F.regexp_replace(F.lower(F.trim(c)), r"[_\s]+", "-"))


def allotted(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """How much each listed source gives: source, target_share, max_repeats, tokens (of its texts), docs, wanted (tokens
    of the mixture), rate (expected copies of each text).

    The mixture has ``total`` tokens, by default as many as the texts of the listed sources. Sources are filled in
    proportion to their weights; one that would exceed tokens * max_repeats is filled to that, and what it lacks goes to
    the others in proportion, until nothing changes. If all are full, the mixture is smaller. A source listed twice counts
    with its first row by weight; weights that are null, NaN or not above zero, and max_repeats under 1, give nothing.

    The fill level is found by sorting sources by the level at which each is full, in one window over the sources.
    """
    w = F.col("target_weight").cast("double")
    listed = targets.select(source_name(F.col("source")).alias("source"), F.when((w > 0) & ~F.isnan(w) & (w < float("inf")), w).otherwise(0.0).alias("weight"), F.coalesce(F.greatest("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    listed = listed.filter("source is not null").groupBy("source").agg(F.max(F.struct("weight", "max_repeats")).alias("t")).select("source", "t.weight", "t.max_repeats")
    rows = listed.join(sizes, "source", "left").select("source", "weight", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"))
    cap = F.when(F.col("weight") > 0, F.col("tokens") * F.col("max_repeats")).otherwise(0).cast("double")
    rows = rows.withColumn("most", cap).withColumn("full_at", F.when(F.col("weight") > 0, F.col("most") / F.col("weight")))
    # sources in the order in which a rising level fills them; one row a source, so the window is as small as the target list
    before = Window.orderBy(F.col("full_at").asc_nulls_last(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    goal = F.lit(float(total)) if total is not None else F.sum(F.when(F.col("weight") > 0, F.col("tokens")).otherwise(0)).over(everything).cast("double")
    rows = rows.withColumns({"goal": goal, "filled": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "all_weight": F.sum("weight").over(everything), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    rest = F.col("all_weight") - F.col("gone")
    # the level if exactly the sources before this one are full: right for the first source that is not full at it
    rows = rows.withColumn("level", F.when(rest > 1e-12, (F.col("goal") - F.col("filled")) / rest))
    first = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "source", "level"))).over(everything)
    rows = rows.withColumn("level", first["level"])
    wanted = F.when(F.col("weight") > 0, F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))).otherwise(0.0)
    return rows.select(
        "source", F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).alias("target_share"), "max_repeats", "tokens", "docs", wanted.alias("wanted"),
        F.when(F.col("tokens") > 0, F.least(wanted / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0).alias("rate"),
    )


def mixed(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0, id_col: str = "doc_id", ranks: str = RANKS) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture: id, source, n_tokens, copy INT (0 for the first use). shares: source, target_share, actual_share,
    max_repeats, source_tokens, mixed_tokens, docs, mixed_docs (distinct texts used); a listed source without texts has zeros.

    Systematic sampling: the texts of a source are lined up by size, each as long as its expected copies; a text is used
    once for each whole number that its stretch of the line crosses, after one random offset a source (a hash of name and
    ``seed``). A line in the order of size gives every size its share, so tokens come out in proportion too. No text is
    used more often than max_repeats. Texts of unlisted or null sources aren't used; empty ones count no tokens but may be
    used like others.

    A prefix sum never needs a source in one task: rows are range-partitioned by (source, size, id), summed by partition,
    and only the partition sums are accumulated across partitions.
    """
    sized = staged(counted(docs.withColumn("__source", source_name(F.col("source"))), [id_col, "__source"], "text", ranks).withColumnRenamed("__source", "source").filter("source is not null"))
    sizes = sized.groupBy("source").agg(F.sum(F.col("n_tokens").cast("bigint")).alias("tokens"), F.count("*").alias("docs"))
    plan = staged(allotted(sizes, targets, total))
    rows = sized.join(plan.filter("rate > 0").select("source", "rate", "max_repeats"), "source")
    line = staged(rows.repartitionByRange("source", "n_tokens", id_col).withColumn("part", F.spark_partition_id()))
    parts = line.groupBy("source", "part").agg(F.count("*").alias("n"))
    starts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("source", "part").orderBy("n_tokens", id_col)) + F.col("before")
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    # the same sum is computed for the end of a stretch and the start of the next, so no whole number is lost or doubled
    upto = F.floor(F.col("place") * F.col("rate") + offset)
    since = F.floor((F.col("place") - 1) * F.col("rate") + offset)
    copies = F.least(upto - since, F.col("max_repeats").cast("bigint"))
    used = line.join(starts, ["source", "part"]).withColumn("place", place).withColumn("copies", copies).filter("copies > 0")
    used = used.select(id_col, "source", "n_tokens", F.col("copies").cast("int").alias("copies"))
    mixture = used.select(id_col, "source", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    got = used.groupBy("source").agg(F.sum(F.col("copies").cast("bigint") * F.col("n_tokens")).alias("mixed_tokens"), F.count("*").alias("mixed_docs"))
    shares = plan.join(got, "source", "left").select("source", "target_share", "max_repeats", F.col("tokens").alias("source_tokens"), "docs", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("mixed_docs", F.lit(0)).alias("mixed_docs"))
    whole = F.sum("mixed_tokens").over(Window.partitionBy())
    return mixture, shares.withColumn("actual_share", F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0))
