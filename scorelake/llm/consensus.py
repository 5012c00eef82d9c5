"""Consensus of several judges' labels by a mixture of competence and spamming.

Each label of a judge is either truthful, with the judge's competence as probability, or drawn from the judge's own guess
distribution. Competence may differ with the label that an item has (a lenient judge seldom sees that one is partial).
Expectation-maximisation gives the label of every item, and the competence and guesses of every judge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.payload import blank_to_null, case_key_or_derived
from scorelake.storage import staged

LABELS = ["pass", "partial", "fail"]

#: Spellings of the labels, after case, marks and white space around them are removed (fixed values).
SPELLINGS = {
    "pass": ["pass", "passed", "passes", "correct", "yes", "true", "right", "ok", "1", "1.0", "good"],
    "partial": ["partial", "partially", "partly", "partially correct", "partly correct", "half", "0.5", ".5", "incomplete"],
    "fail": ["fail", "failed", "fails", "wrong", "no", "incorrect", "false", "0", "0.0", "bad"],
}

#: So many judges' parameters (80 bytes each) are held by the driver and every task; more are joined as a table.
JUDGE_BOUND = 100_000


def normal_label(label: Column) -> Column:
    """pass, partial or fail, however it is spelled; null if it is missing or unusable."""
    text = F.lower(F.regexp_replace(label, r"^[^\p{L}\p{N}.]+|[^\p{L}\p{N}]+$", ""))
    found = F.lit(None).cast("string")
    for name, spelled in SPELLINGS.items():
        found = F.when(text.isin(*spelled), name).otherwise(found)
    return found


def votes(judgments: DataFrame) -> DataFrame:
    """One row for each judge of each item: case_key, candidate_id, judge, w_pass, w_partial, w_fail (summing to 1).

    Copies of a judgment count once. Labels are read whatever their spelling; where a label is missing, the score tells,
    on the judge's own scale (1, 5, 10 or 100, by the judge's greatest score). A judge asked repeatedly has one vote,
    shared among its answers, since repeats are not independent. Judgments that are unusable, or name no judge or item,
    give none.
    """
    rows = judgments.select(
        "judgment_id",
        case_key_or_derived(F.col("case_key"), F.col("dataset_id"), F.col("case_id")).alias("case_key"),
        "candidate_id",
        blank_to_null(F.lower(F.trim("judge_model_id"))).alias("judge"),
        normal_label(F.col("label")).alias("label"),
        F.when(F.trim("label") != "", True).alias("labelled"),
        F.when(~F.isnan("score") & (F.abs("score") < 1e9), F.col("score")).alias("score"),
    ).distinct()
    top = rows.groupBy("judge").agg(F.max("score").alias("top"))
    scale = F.when(F.col("top") > 10, 100.0).when(F.col("top") > 5, 10.0).when(F.col("top") > 1, 5.0).otherwise(1.0)
    part = F.col("score") / scale
    told = F.when(part >= 0.75, "pass").when(part >= 0.25, "partial").when(part.isNotNull(), "fail")
    usable = (
        rows.join(top, "judge")
        .withColumn("label", F.coalesce("label", F.when(F.col("labelled").isNull(), told)))
        .filter("label is not null and case_key is not null and candidate_id is not null")
    )
    return usable.groupBy("case_key", "candidate_id", "judge").agg(*(F.avg(F.when(F.col("label") == x, 1.0).otherwise(0.0)).alias(f"w_{x}") for x in LABELS))


def _posteriors(competence: np.ndarray, guess: np.ndarray, prior: np.ndarray, at: np.ndarray, judge: np.ndarray, w: np.ndarray, items: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels' probabilities of each item, probability of each vote if that label is true). w: votes × labels."""
    like = np.empty((len(at), 3))
    for t in range(3):
        honest = competence[judge, t]
        p = (1 - honest)[:, None] * guess[judge]
        p[:, t] += honest
        like[:, t] = (w * np.log(p)).sum(1)
    log = np.tile(np.log(prior), (items, 1))
    for t in range(3):
        log[:, t] += np.bincount(at, like[:, t], items)
    log -= log.max(1, keepdims=True)
    post = np.exp(log)
    return post / post.sum(1, keepdims=True), like


#: Counts of a judge in a round: truthful labels by label, guesses by label, votes by the item's label, agreement with the
#: consensus as given and with pass and fail swapped.
COUNTS = 11


def _counts(post: np.ndarray, competence: np.ndarray, guess: np.ndarray, at: np.ndarray, judge: np.ndarray, w: np.ndarray, judges: int) -> np.ndarray:
    """Expected counts of each judge (see COUNTS)."""
    out = np.zeros((judges, COUNTS))
    for t in range(3):
        honest = competence[judge, t]
        share = w[:, t] * post[at, t] * (honest / (honest + (1 - honest) * guess[judge, t]))
        out[:, t] = np.bincount(judge, share, judges)
        out[:, 3 + t] = np.bincount(judge, w[:, t] - share, judges)
        out[:, 6 + t] = np.bincount(judge, post[at, t], judges)
    out[:, 9] = np.bincount(judge, (w * post[at]).sum(1), judges)
    out[:, 10] = np.bincount(judge, (w * post[at][:, ::-1]).sum(1), judges)
    return out


class Model:
    """Parameters by judge index: competence, guess distribution, whether pass and fail are swapped; and the prior."""

    def __init__(self, judges: int) -> None:
        self.competence, self.guess, self.prior = np.full((judges, 3), 0.5), np.full((judges, 3), 1 / 3), np.full(3, 1 / 3)
        self.swapped = np.zeros(judges, dtype=bool)

    def update(self, counts: np.ndarray, labels: np.ndarray) -> float:
        before = self.competence.copy()
        self.competence = np.clip((counts[:, :3] + 0.5) / (counts[:, 6:9] + 1.0), 1e-4, 1 - 1e-4)
        self.guess = (counts[:, 3:6] + 0.5) / (counts[:, 3:6].sum(1, keepdims=True) + 1.5)
        self.prior = (labels + 1.0) / (labels.sum() + 3.0)
        return float(np.abs(self.competence - before).max(initial=0.0))

    def turn(self, counts: np.ndarray) -> bool:
        """Swaps pass and fail of judges who agree better with the consensus that way (as with any other spelling)."""
        turned = counts[:, 10] > 1.2 * counts[:, 9] + 3
        self.swapped ^= turned
        self.competence[turned], self.guess[turned] = 0.5, 1 / 3
        return bool(turned.any())


def _flat(batch: pa.RecordBatch, column: int, swapped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column(column)
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten()
    judge = values.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
    w = np.stack([values.field(1 + t).to_numpy(zero_copy_only=False) for t in range(3)], 1)
    w = np.where(swapped[judge][:, None], w[:, ::-1], w)
    return np.repeat(np.arange(len(sizes)), sizes), judge, w


def _estimate(items: DataFrame, judges: int, rounds: int) -> Model:
    model = Model(judges)
    names = [f"n{i}" for i in range(COUNTS)]
    first, turns = True, 0
    for step in range(rounds):
        state, initial = model, first

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, labels = np.zeros((judges, COUNTS)), np.zeros(3)
            for batch in batches:
                at, judge, w = _flat(batch, 0, state.swapped)
                if initial:
                    post = np.stack([np.bincount(at, w[:, t], batch.num_rows) for t in range(3)], 1)
                    post /= np.maximum(post.sum(1, keepdims=True), 1e-9)
                else:
                    post, _ = _posteriors(state.competence, state.guess, state.prior, at, judge, w, batch.num_rows)
                total += _counts(post, state.competence, state.guess, at, judge, w, judges)
                labels += post.sum(0)
            seen = np.flatnonzero(total.any(1))
            rows = np.vstack([total[seen], np.concatenate([labels, np.zeros(COUNTS - 3)])])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), *(pa.array(rows[:, i]) for i in range(COUNTS))], names=["judge_ix", *names])

        told = items.select("votes").mapInArrow(count, "judge_ix bigint, " + ", ".join(f"{x} double" for x in names))
        counts, labels = np.zeros((judges, COUNTS)), np.zeros(3)
        for r in told.groupBy("judge_ix").agg(*(F.sum(x).alias(x) for x in names)).collect():  # judges + 1 rows
            if r[0] < 0:
                labels = np.array(r[1:4])
            else:
                counts[r[0]] = r[1:]
        moved = model.update(counts, labels)
        first = False
        if (step == 4 or moved < 1e-3) and turns < 2 and model.turn(counts):
            turns += 1
        elif moved < 1e-3 and step > 4:
            break
    return model


def consensus(judgments: DataFrame, rounds: int = 30) -> tuple[DataFrame, DataFrame]:
    """(items, judges) of a table of judgments.

    items: case_key, candidate_id, label, confidence (its posterior probability), n_judges, agreement (share of the pairs
    of votes that agree; null for one judge). Equal probabilities give the label with more votes, then pass, partial, fail.
    judges: judge, competence (over the shares of the labels), guess_pass, guess_partial, guess_fail, swapped (says pass for fail and fail for pass),
    n_items. Items without any usable label have no row. An empty table gives empty results.

    The list of an item's votes holds one entry a judge, so no group grows with the rows; the model makes one pass over
    the items a round and moves only counts by judge.
    """
    cast = votes(judgments)
    cast = staged(cast)
    names = cast.groupBy("judge").agg(F.count("*").alias("n_items"))
    numbered = staged(names.withColumn("judge_ix", F.row_number().over(Window.orderBy("judge")) - 1))
    judges = numbered.count()
    if judges > JUDGE_BOUND:
        return _consensus_by_joins(cast, numbered, rounds)
    items = staged(
        cast.join(numbered.select("judge", "judge_ix"), "judge")
        .groupBy("case_key", "candidate_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("judge_ix").cast("bigint").alias("judge_ix"), *(f"w_{x}" for x in LABELS)))).alias("votes"))
    )
    model = _estimate(items, judges, rounds)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, judge, w = _flat(batch, 2, model.swapped)
            rows = batch.num_rows
            post, _ = _posteriors(model.competence, model.guess, model.prior, at, judge, w, rows)
            cast_ = np.stack([np.bincount(at, w[:, t], rows) for t in range(3)], 1)
            best = (np.round(post, 9) + cast_ * 1e-12).argmax(1)
            n = np.bincount(at, minlength=rows)
            same = (cast_**2).sum(1) - np.bincount(at, (w**2).sum(1), rows)
            agreement = pa.array(np.divide(same, n * (n - 1.0), out=np.zeros(rows), where=n > 1), mask=n < 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(LABELS, dtype=object)[best], pa.string()), pa.array(post[np.arange(rows), best]), pa.array(n, pa.int32()), agreement],
                names=["case_key", "candidate_id", "label", "confidence", "n_judges", "agreement"],
            )

    found = items.select("case_key", "candidate_id", "votes").mapInArrow(label, "case_key string, candidate_id string, label string, confidence double, n_judges int, agreement double")
    spark = judgments.sparkSession
    told = [(i, float(model.competence[i] @ model.prior), *map(float, model.guess[i]), bool(model.swapped[i])) for i in range(judges)]
    params = spark.createDataFrame(told, "judge_ix int, competence double, guess_pass double, guess_partial double, guess_fail double, swapped boolean")
    return found, numbered.join(params, "judge_ix").select("judge", "competence", "guess_pass", "guess_partial", "guess_fail", "swapped", "n_items")


def _consensus_by_joins(cast: DataFrame, names: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The same model where the judges are too many to hold: the parameters of Model are a table joined to the votes each
    round, and only sums and greatest values over all judges come to the driver."""
    item, three = ["case_key", "candidate_id"], range(3)
    params = names.select("judge", *(F.lit(0.5).alias(f"c{t}") for t in three), *(F.lit(1 / 3).alias(f"g{t}") for t in three), F.lit(False).alias("swapped"))

    def read(params: DataFrame) -> DataFrame:
        w = [F.when(F.col("swapped"), F.col(f"w_{LABELS[2 - t]}")).otherwise(F.col(f"w_{LABELS[t]}")).alias(f"w{t}") for t in three]
        return cast.join(params, "judge").select(*item, *params.columns, *w)

    def posteriors(rows: DataFrame, prior: list[float]) -> DataFrame:
        like = [sum((F.col(f"w{x}") * F.log((F.col(f"c{t}") if x == t else F.lit(0.0)) + (1 - F.col(f"c{t}")) * F.col(f"g{x}")) for x in three), F.lit(0.0)) for t in three]
        log = rows.groupBy(*item).agg(*((F.sum(like[t]) + float(np.log(prior[t]))).alias(f"l{t}") for t in three))
        e = [F.exp(F.col(f"l{t}") - F.greatest("l0", "l1", "l2")) for t in three]
        return log.select(*item, *((e[t] / (e[0] + e[1] + e[2])).alias(f"p{t}") for t in three))

    turns, prior = 0, [1 / 3] * 3
    for step in range(rounds):
        rows = read(params)
        if step == 0:
            total = F.greatest(F.sum("w0") + F.sum("w1") + F.sum("w2"), F.lit(1e-9))
            post = staged(rows.groupBy(*item).agg(*((F.sum(f"w{t}") / total).alias(f"p{t}") for t in three)))
        else:
            post = staged(posteriors(rows, prior))
        labels = post.agg(*(F.coalesce(F.sum(f"p{t}"), F.lit(0.0)) for t in three)).first()
        prior = [(n + 1.0) / (sum(labels) + 3.0) for n in labels]
        c, g, w, p = ([F.col(f"{x}{t}") for t in three] for x in "cgwp")
        honest = [w[t] * p[t] * c[t] / (c[t] + (1 - c[t]) * g[t]) for t in three]
        sums = rows.join(post, item).groupBy("judge").agg(
            *(F.sum(honest[t]).alias(f"h{t}") for t in three), *(F.sum(w[t] - honest[t]).alias(f"s{t}") for t in three), *(F.sum(p[t]).alias(f"n{t}") for t in three),
            F.sum(sum((w[t] * p[t] for t in three), F.lit(0.0))).alias("same"), F.sum(sum((w[t] * p[2 - t] for t in three), F.lit(0.0))).alias("turned"),
        )
        now = [F.least(F.greatest((F.col(f"h{t}") + 0.5) / (F.col(f"n{t}") + 1.0), F.lit(1e-4)), F.lit(1 - 1e-4)) for t in three]
        spam = F.col("s0") + F.col("s1") + F.col("s2") + 1.5
        made = staged(params.join(sums, "judge").select(
            "judge", *(now[t].alias(f"c{t}") for t in three), *(((F.col(f"s{t}") + 0.5) / spam).alias(f"g{t}") for t in three), "swapped",
            F.greatest(*(F.abs(now[t] - c[t]) for t in three)).alias("moved"), (F.col("turned") > 1.2 * F.col("same") + 3).alias("turn"),
        ))
        moved, turn = made.agg(F.max("moved"), F.max("turn")).first()
        params = made.drop("moved", "turn")
        if (step == 4 or moved < 1e-3) and turns < 2 and turn:
            turns += 1
            fresh = [F.when(F.col("turn"), v).otherwise(F.col(f"{x}{t}")).alias(f"{x}{t}") for x, v in (("c", 0.5), ("g", 1 / 3)) for t in three]
            params = made.select("judge", *fresh, (F.col("swapped") != F.col("turn")).alias("swapped"))
        elif moved < 1e-3 and step > 4:
            break
    rows = read(params)
    sums = rows.groupBy(*item).agg(F.count("*").cast("int").alias("n_judges"), *(F.sum(f"w{t}").alias(f"t{t}") for t in three), F.sum(F.col("w0") ** 2 + F.col("w1") ** 2 + F.col("w2") ** 2).alias("sq"))
    same = (F.col("t0") ** 2 + F.col("t1") ** 2 + F.col("t2") ** 2 - F.col("sq")) / (F.col("n_judges") * (F.col("n_judges") - 1))
    rank = [F.round(f"p{t}", 9) + F.col(f"t{t}") * 1e-12 for t in three]
    best = F.greatest(*rank)
    at = F.when(rank[0] == best, 0).when(rank[1] == best, 1).otherwise(2)
    pick = lambda values: F.element_at(F.array(*values), at + 1)
    found = posteriors(rows, prior).join(sums, item).select(*item, pick([F.lit(x) for x in LABELS]).alias("label"), pick([F.col(f"p{t}") for t in three]).alias("confidence"), "n_judges", F.when(F.col("n_judges") > 1, same).alias("agreement"))
    competence = sum((F.col(f"c{t}") * float(prior[t]) for t in three), F.lit(0.0))
    judges = names.join(params, "judge").select("judge", competence.alias("competence"), F.col("g0").alias("guess_pass"), F.col("g1").alias("guess_partial"), F.col("g2").alias("guess_fail"), "swapped", "n_items")
    return found, judges
