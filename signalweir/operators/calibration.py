"""Checking a decision threshold against labelled signals.

Input: tenant_id, score, label ('incident', 'noise', anything else is ignored).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweir.functions.signals import COST_FALSE_NEGATIVE, COST_FALSE_POSITIVE
from signalweir.scale import OrderedSlices

MIN_LABELS = 20


def _labeled(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("label").isin("incident", "noise"))


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _expected_cost(prior: Column, fpr: Column, tpr: Column, cost_fp: float, cost_fn: float) -> Column:
    return F.lit(cost_fp) * (F.lit(1.0) - prior) * fpr + F.lit(cost_fn) * prior * (F.lit(1.0) - tpr)


def evaluate_threshold(
    rows: DataFrame,
    threshold: float | None = None,
    cost_fp: float = COST_FALSE_POSITIVE,
    cost_fn: float = COST_FALSE_NEGATIVE,
) -> DataFrame:
    """Confusion matrix of `score > threshold` per tenant: one partial aggregate."""
    tau = cost_fp / (cost_fp + cost_fn) if threshold is None else threshold
    hit, real = F.col("score") > F.lit(tau), F.col("label") == "incident"
    counts = (
        _labeled(rows)
        .groupBy("tenant_id")
        .agg(
            F.count_if(hit & real).alias("tp"),
            F.count_if(hit & ~real).alias("fp"),
            F.count_if(~hit & real).alias("fn"),
            F.count_if(~hit & ~real).alias("tn"),
        )
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("threshold", F.lit(float(tau)))
        .withColumn("tpr", _rate(tp, tp + fn))
        .withColumn("fpr", _rate(fp, fp + tn))
        .withColumn("prior", (tp + fn) / (tp + fp + fn + tn))
        .withColumn("expected_cost", _expected_cost(F.col("prior"), F.col("fpr"), F.col("tpr"), cost_fp, cost_fn))
        .withColumn("precision", F.when(tp + fp > 0, tp / (tp + fp)))
        .withColumn("missed_incidents", fn)
    )


def roc_points(
    rows: DataFrame, cost_fp: float = COST_FALSE_POSITIVE, cost_fn: float = COST_FALSE_NEGATIVE
) -> DataFrame:
    """Every threshold that can change a decision, with its confusion counts and cost.

    Rows collapse to distinct scores first; the running counts then scan those scores in
    slices, so a tenant with most of the labels is spread over many tasks.
    """
    per_score = (
        _labeled(rows)
        .groupBy("tenant_id", "score")
        .agg(
            F.count_if(F.col("label") == "incident").alias("pos"),
            F.count_if(F.col("label") == "noise").alias("neg"),
        )
    )
    floor = per_score.select("tenant_id").distinct().select(
        "tenant_id", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg")
    )
    candidates = per_score.unionByName(floor).groupBy("tenant_id", "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    scan = OrderedSlices(candidates, ["tenant_id"], [F.col("score").desc()])
    above = (
        scan.running_sum("tp", F.col("pos"), inclusive=False)
        .running_sum("fp", F.col("neg"), inclusive=False)
        .frame()
    )
    totals = candidates.groupBy("tenant_id").agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    pos, neg, tp, fp = (F.col(c) for c in ("positives", "negatives", "tp", "fp"))
    return (
        above.join(totals, "tenant_id")
        .withColumn("fn", pos - tp)
        .withColumn("tn", neg - fp)
        .withColumn("tpr", _rate(tp, pos))
        .withColumn("fpr", _rate(fp, neg))
        .withColumn("prior", pos / (pos + neg))
        .withColumn("expected_cost", _expected_cost(F.col("prior"), F.col("fpr"), F.col("tpr"), cost_fp, cost_fn))
        .select(
            "tenant_id", F.col("score").alias("threshold"), "tp", "fp", "fn", "tn", "tpr", "fpr",
            "prior", "positives", "negatives", "expected_cost",
        )
    )


def sweep_threshold(
    rows: DataFrame, cost_fp: float = COST_FALSE_POSITIVE, cost_fn: float = COST_FALSE_NEGATIVE
) -> DataFrame:
    """The cheapest threshold per tenant; the lowest one wins a tie."""
    points = roc_points(rows, cost_fp, cost_fn)
    fields = [c for c in points.columns if c not in ("tenant_id", "expected_cost", "threshold")]
    best = points.groupBy("tenant_id").agg(F.min(F.struct("expected_cost", "threshold", *fields)).alias("best"))
    return best.select("tenant_id", "best.*").withColumn("sample_size", F.col("positives") + F.col("negatives"))


def reliability_curve(rows: DataFrame, buckets: int = 10) -> DataFrame:
    """Mean score against observed incident rate per score bucket; empty buckets are absent."""
    idx = F.least(F.floor(F.col("score") * buckets), F.lit(buckets - 1)).cast("bigint")
    label = F.concat(F.format_number(F.col("i") / buckets, 1), F.lit("-"), F.format_number((F.col("i") + 1) / buckets, 1))
    return (
        _labeled(rows)
        .groupBy("tenant_id", idx.alias("i"))
        .agg(
            F.count("*").alias("n"),
            F.avg("score").alias("mean_predicted"),
            F.avg((F.col("label") == "incident").cast("double")).alias("observed_rate"),
        )
        .select("tenant_id", label.alias("bucket"), "n", "mean_predicted", "observed_rate")
    )


def calibration_report(
    rows: DataFrame,
    cost_fp: float = COST_FALSE_POSITIVE,
    cost_fn: float = COST_FALSE_NEGATIVE,
    min_labels: int = MIN_LABELS,
) -> DataFrame:
    """Threshold in force against the empirical optimum, per tenant."""
    in_force = cost_fp / (cost_fp + cost_fn)
    labeled = rows.where(F.col("label").isNotNull()).groupBy("tenant_id").agg(F.count("*").alias("labeled"))
    current = evaluate_threshold(rows, in_force, cost_fp, cost_fn).select(
        "tenant_id", F.col("expected_cost").alias("current_cost")
    )
    best = sweep_threshold(rows, cost_fp, cost_fn).select(
        "tenant_id", F.col("threshold").alias("empirical_threshold"), F.col("expected_cost").alias("empirical_cost")
    )
    enough = F.col("labeled") >= min_labels
    return (
        labeled.join(current, "tenant_id", "left")
        .join(best, "tenant_id", "left")
        .select(
            "tenant_id",
            F.when(enough, F.lit("ok")).otherwise(F.lit("insufficient-labels")).alias("status"),
            "labeled",
            F.lit(in_force).alias("threshold_in_force"),
            F.when(enough, F.col("empirical_threshold")).alias("empirical_threshold"),
            F.when(enough, F.abs(F.col("empirical_threshold") - F.lit(in_force))).alias("divergence"),
            F.when(enough, F.col("current_cost") - F.col("empirical_cost")).alias("potential_cost_reduction"),
        )
    )
