"""Confusion matrices and rates of verdicts against labels, in total and by dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ABSTAIN, FALSE, GOLD_FALSE, GOLD_TRUE, MACHINE_FALSE, MACHINE_TRUE, MACHINE_UNCERTAIN, TRUE


def _ratio(n: Column, d: Column) -> Column:
    return F.try_divide(n, d)


def _counters() -> list[Column]:
    """Over rows (truth boolean, verdict); a null verdict is a missing one."""
    truth, verdict = F.col("truth"), F.col("verdict")
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    return [
        n(truth & (verdict == TRUE)).alias("tp"),
        n(~truth & (verdict == TRUE)).alias("fp"),
        n(~truth & (verdict == FALSE)).alias("tn"),
        n(truth & (verdict == FALSE)).alias("fn"),
        n(truth & (verdict == ABSTAIN)).alias("abstain_on_true"),
        n(~truth & (verdict == ABSTAIN)).alias("abstain_on_false"),
        n(truth & verdict.isNull()).alias("missing_on_true"),
        n(~truth & verdict.isNull()).alias("missing_on_false"),
    ]


def _rates(df: DataFrame, error_rates: bool) -> DataFrame:
    """Every rate is null where its denominator is 0."""
    c = F.col
    decided = c("tp") + c("fp") + c("tn") + c("fn")
    labelled = decided + c("abstain_on_true") + c("abstain_on_false") + c("missing_on_true") + c("missing_on_false")
    df = df.withColumns({"decided": decided, "labeled_total": labelled, "precision": _ratio(c("tp"), c("tp") + c("fp")), "recall": _ratio(c("tp"), c("tp") + c("fn"))})
    total = c("precision") + c("recall")
    f1 = F.when(total == 0, F.lit(0.0)).otherwise(2 * c("precision") * c("recall") / F.nullif(total, F.lit(0.0)))
    more = {
        "f1": f1,
        "specificity": _ratio(c("tn"), c("tn") + c("fp")),
        "accuracy": _ratio(c("tp") + c("tn"), c("decided")),
        "tp_retention": _ratio(c("tp"), c("tp") + c("fn") + c("abstain_on_true") + c("missing_on_true")),
        "fp_removal": _ratio(c("tn"), c("tn") + c("fp") + c("abstain_on_false") + c("missing_on_false")),
        "selective_coverage": _ratio(c("decided"), c("labeled_total")),
    }
    if error_rates:
        more |= {"false_positive_rate": _ratio(c("fp"), c("fp") + c("tn")), "false_negative_rate": _ratio(c("fn"), c("fn") + c("tp"))}
    return df.withColumns(more)


def _decided(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rows (finding_id, label, verdict, extra columns of labels) of all labels, gold or machine."""
    eligible = F.coalesce("evaluation_eligible", F.lit(True)) if "evaluation_eligible" in predictions.columns else F.lit(True)
    p = predictions.select("finding_id", "verdict", eligible.alias("eligible"))
    truth = F.when(F.col("label").isin(*GOLD_TRUE, MACHINE_TRUE), True).when(F.col("label").isin(GOLD_FALSE, MACHINE_FALSE), False)
    return labels.join(p, "finding_id", "left").withColumn("truth", truth).filter(F.col("truth").isNotNull() & F.coalesce("eligible", F.lit(True)))


def classification(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: verdicts against gold labels. Labels of neither class, and those
    of ineligible predictions, stand outside; missing predictions count in the
    end-to-end rates."""
    return _rates(_decided(labels, predictions).agg(*_counters()), False)


def label_audit(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rows (kind, value, n): excluded labels by name, excluded predictions and labelled cases, missing and extra predictions."""
    has = "evaluation_eligible" in predictions.columns
    p = predictions.select("finding_id", F.lit(True).alias("predicted"), (F.coalesce("evaluation_eligible", F.lit(True)) if has else F.lit(True)).alias("eligible"))
    known = F.col("label").isin(*GOLD_TRUE, GOLD_FALSE, MACHINE_TRUE, MACHINE_FALSE)
    j = labels.select("finding_id", "label", F.coalesce(known, F.lit(False)).alias("known")).join(p, "finding_id", "full_outer")
    known, excluded = F.coalesce("known", F.lit(False)), ~F.coalesce("eligible", F.lit(True))
    predicted = F.coalesce("predicted", F.lit(False))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("known").isNotNull() & ~known, F.struct(F.lit("excluded_label").alias("kind"), F.coalesce("label", F.lit("None")).alias("value"))),
            F.when(excluded, F.struct(F.lit("excluded_prediction").alias("kind"), F.lit("").alias("value"))),
            F.when(excluded & known, F.struct(F.lit("excluded_labeled_case").alias("kind"), F.lit("").alias("value"))),
            F.when(known & ~predicted, F.struct(F.lit("missing_prediction").alias("kind"), F.lit("").alias("value"))),
            F.when(predicted & ~excluded & ~known, F.struct(F.lit("extra_prediction").alias("kind"), F.lit("").alias("value"))),
        )
    )
    return j.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.value").agg(F.count("*").alias("n"))


def machine_reference(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: verdicts against machine labels, with error rates and the bounds of the true share."""
    prevalence = labels.agg(
        F.count("*").alias("records"),
        F.count_if(F.col("label") == MACHINE_TRUE).alias("machine_true_positive"),
        F.count_if(F.col("label") == MACHINE_FALSE).alias("machine_false_positive"),
        F.count_if(F.col("label") == MACHINE_UNCERTAIN).alias("machine_uncertain"),
    )
    prevalence = prevalence.withColumns(
        {
            "tp_fraction_lower_bound": _ratio(F.col("machine_true_positive"), F.col("records")),
            "tp_fraction_upper_bound": _ratio(F.col("machine_true_positive") + F.col("machine_uncertain"), F.col("records")),
        }
    )
    return _rates(_decided(labels, predictions).agg(*_counters()), True).crossJoin(prevalence)  # one row each


def by_dimension(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rows (dimension, key, rates) over the labels' ``features``.

    Dimensions are repository, rule, cwe, language and dataflow. A finding
    with several CWEs counts in each, one without in ``UNKNOWN``.
    """
    f = F.col("features")
    cwes = F.when(F.size(f["cwes"]) > 0, f["cwes"]).otherwise(F.array(F.lit("UNKNOWN")))
    one = lambda name, value: F.array(F.struct(F.lit(name).alias("dimension"), value.alias("key")))
    keys = F.concat(
        one("repository", f["repository"]),
        one("rule", f["rule_id"]),
        F.transform(cwes, lambda c: F.struct(F.lit("cwe").alias("dimension"), c.alias("key"))),
        one("language", f["language"]),
        one("dataflow", F.when(f["has_dataflow"], "true").otherwise("false")),
    )
    rows = _decided(labels, predictions).select("truth", "verdict", F.explode(keys).alias("d"))
    return _rates(rows.groupBy("d.dimension", "d.key").agg(*_counters()), True)


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: agreement of two reviewers' verdicts, and Cohen's kappa; null where chance alone agrees."""
    pairs = a.select("finding_id", F.col("verdict").alias("va")).join(b.select("finding_id", F.col("verdict").alias("vb")), "finding_id")
    table = pairs.groupBy("va", "vb").agg(F.count("*").alias("n"))
    sides = table.select(F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col("va").alias("v")), F.struct(F.lit("b").alias("s"), F.col("vb").alias("v")))).alias("x"), "n")
    margins = sides.groupBy("x.v").agg(F.sum(F.when(F.col("x.s") == "a", F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("x.s") == "b", F.col("n")).otherwise(0)).alias("nb"))
    chance = margins.agg(F.sum(F.col("na").cast("decimal(19,0)") * F.col("nb")).cast("double").alias("products"))
    row = table.agg(F.sum("n").alias("records"), F.coalesce(F.sum(F.when(F.col("va") == F.col("vb"), F.col("n"))), F.lit(0)).alias("agreements")).crossJoin(chance)  # one row each
    observed, expected = _ratio(F.col("agreements"), F.col("records")), F.col("products") / (F.col("records") * F.col("records").cast("double"))
    return row.select(
        "records",
        "agreements",
        observed.alias("raw_agreement"),
        expected.alias("chance_expected_agreement"),
        F.when(expected != 1.0, (observed - expected) / (1.0 - expected)).alias("cohen_kappa"),
    )


def verdict_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (side, verdict, n): each reviewer's verdicts, and pairs of them as ``a|b``."""
    j = a.select("finding_id", F.col("verdict").alias("va")).join(b.select("finding_id", F.col("verdict").alias("vb")), "finding_id")
    sides = F.array(
        F.struct(F.lit("reviewer_a").alias("side"), F.col("va").alias("verdict")),
        F.struct(F.lit("reviewer_b").alias("side"), F.col("vb").alias("verdict")),
        F.struct(F.lit("pair").alias("side"), F.concat_ws("|", "va", "vb").alias("verdict")),
    )
    return j.select(F.explode(sides).alias("s")).groupBy("s.side", "s.verdict").agg(F.count("*").alias("n"))
