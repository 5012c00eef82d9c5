"""Filling containers of fixed capacity: vector best-fit under several capacities at once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.tokens import RANKS, counted
from scorelake.storage import staged

CAPACITY = 2048  # tokens of a container
MOST_DOCUMENTS = 128  # pieces in a container
ATTENTION = 0.75  # attention cost of a container, as a share of that of one full piece
BLOCK_TOKENS = 4_000_000  # tokens that one task packs


def best_fit(sizes: np.ndarray, capacity: int, documents: int, attention: float, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.2)) -> np.ndarray:
    """The container of each piece, for pieces sorted by falling size.

    Every piece demands tokens, one document and attention cost (the square of its tokens, at most the whole ``attention``,
    so a piece that is heavier than that takes a container alone). Among the open containers whose three residual capacities all hold the demand, ``rule`` picks: "norm", the least weighted norm of the residual
    vector that is left; "dot", the greatest weighted dot product of demand and residual. Equal scores give the oldest
    container. If none fits, a new one is opened. Residuals are fractions of the capacities.
    """
    full = np.array([capacity, documents, attention], dtype=float)
    w = np.array(weights)
    residual = np.empty((1024, 3))
    open_, number = np.empty(1024, dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    live = made = 0
    least = sizes[-1] if len(sizes) else 0
    for i, size in enumerate(sizes):
        demand = np.minimum(np.array([size, 1.0, float(size) ** 2]) / full, 1.0)
        left = residual[:live] - demand
        fits = np.flatnonzero((left >= -1e-12).all(1))
        if len(fits):
            score = (w * left[fits] ** 2).sum(1) if rule == "norm" else -(w * residual[:live][fits] * demand).sum(1)
            at = fits[int(score.argmin())]
            residual[at] = left[at]
            number[i] = open_[at]
        else:
            if live == len(residual):
                residual, open_ = np.vstack([residual, np.empty_like(residual)]), np.concatenate([open_, np.empty_like(open_)])
            residual[live], open_[live], number[i] = 1.0 - demand, made, made
            at, live, made = live, live + 1, made + 1
        if residual[at, 0] * capacity < least - 1e-9 or residual[at, 1] * documents < 1 - 1e-9 or residual[at, 2] * attention < float(least) ** 2 * (1 - 1e-9):  # no piece fits it any more
            live -= 1
            residual[at:live], open_[at:live] = residual[at + 1 : live + 1].copy(), open_[at + 1 : live + 1].copy()
    return number


def pieces(sized: DataFrame, id_col: str, capacity: int) -> DataFrame:
    """Texts cut into pieces: only one longer than ``capacity`` is split, into full containers and a rest."""
    many = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), many - 1)))
    start = F.col("piece") * capacity
    return cut.select(id_col, *(["__row"] if "__row" in sized.columns else []), "piece", start.alias("token_start"), F.least(start + capacity, F.col("n_tokens")).alias("token_end"))


def packed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, documents: int = MOST_DOCUMENTS, attention: float | None = None, rule: str = "norm",
    ranks: str = RANKS, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row for each piece: id, piece, token_start, token_end (exclusive), block INT, container BIGINT (numbered within
    the block) and slot INT (place in the container).

    ``attention`` bounds the sum of squared piece lengths of a container with several pieces; ATTENTION times the square of
    ``capacity`` if not given, so pieces that are nearly full take a container alone. Rows are spread by a hash of their
    place, not of their ids, over blocks of about ``block_tokens``, so any number of texts, whatever their ids, is packed by
    independent tasks; each block is packed best-fit in the order of falling size. A block leaves at most a few
    containers part full, out of thousands. Null and empty texts have no tokens and take no container: their one row has
    null container and slot. Repeated and null ids are different texts. Every row of ``docs`` appears.
    """
    limit = ATTENTION * float(capacity) ** 2 if attention is None else float(attention)
    if min(capacity, documents, limit) <= 0:
        raise ValueError("capacities are above zero")
    sized = staged(counted(docs, [id_col], text_col, ranks).withColumn("__row", F.monotonically_increasing_id()))
    total = sized.agg(F.sum(F.col("n_tokens").cast("bigint"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_tokens))
    cut = pieces(sized, id_col, capacity)
    whole = cut.filter("token_end > token_start").withColumn("block", F.pmod(F.xxhash64("__row", "piece"), F.lit(blocks)).cast("int"))
    kind = dict(docs.dtypes)[id_col]

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(size=rows["token_end"] - rows["token_start"]).sort_values(["size", id_col, "piece", "__row"], ascending=[False, True, True, True], kind="stable")
        rows["container"] = best_fit(rows["size"].to_numpy(), capacity, documents, limit, rule)
        rows["slot"] = rows.groupby("container").cumcount().astype("int32")
        return rows[[id_col, "piece", "token_start", "token_end", "block", "container", "slot"]]

    schema = f"`{id_col}` {kind}, piece int, token_start int, token_end int, block int, container bigint, slot int"
    filled = whole.groupBy("block").applyInPandas(fill, schema)
    none = cut.filter("token_end <= token_start").select(id_col, "piece", "token_start", "token_end", *(F.lit(None).cast(t).alias(c) for c, t in (("block", "int"), ("container", "bigint"), ("slot", "int"))))
    return filled.unionByName(none)


def containers(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each container: block, container, pieces, tokens, attention (sum of squares), fill (share used)."""
    size = (F.col("token_end") - F.col("token_start")).cast("bigint")
    return (
        rows.filter("container is not null")
        .groupBy("block", "container")
        .agg(F.count("*").alias("pieces"), F.sum(size).alias("tokens"), F.sum(size * size).alias("attention"))
        .withColumn("fill", F.col("tokens") / capacity)
    )
