"""Classification and ranking metrics over (score, label, order columns).

Curves are built from one row per distinct score: counts are summed map-side first, distinct scores are dealt by ranges of equal size, and cumulative sums are stitched from the ranges, so neither a
popular score, nor many scores close together, nor a global order brings all rows to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..durable import materialize, with_row_number
from ..schema import REVIEW_BUDGETS
from .quantiles import quantiles


def require_scores(scored: DataFrame) -> None:
    """Raise for an empty table, a label other than 0 and 1, or a score that is null, not finite or outside 0..1."""
    n, bad_label, bad_score = scored.agg(F.count("*"), F.count_if(F.coalesce(~F.col("label").isin(0, 1), F.lit(True))), F.count_if(F.coalesce(F.isnan("score") | ~F.col("score").between(0.0, 1.0), F.lit(True)))).first()
    if not n or bad_label or bad_score:
        raise ValueError(f"{n} rows, {bad_label} labels other than 0 and 1, {bad_score} scores outside 0..1")


def by_score(scored: DataFrame) -> DataFrame:
    """Per distinct score: rows and positives (n, p), and those of all scores at least as high (cum_n, cum_p)."""
    counts = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("p"))
    ranged = materialize(counts.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()), "scores")
    totals = ranged.groupBy("part").agg(F.sum("n").alias("bn"), F.sum("p").alias("bp"))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    heads = totals.select("part", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("hn"), F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("hp"))
    inside = Window.partitionBy("part").orderBy(F.desc("score"))
    return ranged.join(F.broadcast(heads), "part").select("score", "n", "p", (F.sum("n").over(inside) + F.col("hn")).alias("cum_n"), (F.sum("p").over(inside) + F.col("hp")).alias("cum_p"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def _f1(hit: Column, alerts: Column, positives: Column) -> Column:
    return ratio(2 * hit, alerts + positives)


def threshold_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: the confusion matrix at a threshold, rates, and the Brier score."""
    alert, one = F.col("score") >= threshold, F.col("label") == 1
    tp, fp, fn, tn = (F.count_if(c) for c in (alert & one, alert & ~one, ~alert & one, ~alert & ~one))
    return scored.agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), ratio(tp + fn, F.count("*")).alias("prevalence"), ratio(tp + fp, F.count("*")).alias("alert_rate"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        _f1(tp, tp + fp, tp + fn).alias("f1"), F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"),
    )


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum over distinct scores of the recall gained times the precision reached; null without positives."""
    return by_score(scored).agg(F.when(F.sum("p") > 0, F.sum(F.col("p") * F.col("cum_p") / F.col("cum_n")) / F.sum("p")).alias("average_precision"))


def grouped_average_precision(scored: DataFrame, groups: list[str]) -> DataFrame:
    """Average precision of each of many small groups of rows; a group's distinct scores meet in one task."""
    counts = scored.groupBy(*groups, "score").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("p"))
    above = Window.partitionBy(*groups).orderBy(F.desc("score"))
    curve = counts.withColumns({"cum_n": F.sum("n").over(above), "cum_p": F.sum("p").over(above)})
    return curve.groupBy(*groups).agg(F.when(F.sum("p") > 0, F.sum(F.col("p") * F.col("cum_p") / F.col("cum_n")) / F.sum("p")).alias("average_precision"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties counting half; null with one class."""
    neg = F.col("n") - F.col("p")
    below = F.sum(neg * (F.col("cum_p") - F.col("p") + F.col("p") / 2.0))
    return by_score(scored).agg(F.when((F.sum("p") > 0) & (F.sum(neg) > 0), below / (F.sum("p").cast("double") * F.sum(neg))).alias("roc_auc"))


def best_threshold(scored: DataFrame) -> DataFrame:
    """The score with the largest F1, the highest of equals, with its precision and recall."""
    curve = by_score(scored)
    whole = curve.agg(F.sum("p").alias("positives"))
    f1 = F.round(_f1(F.col("cum_p"), F.col("cum_n"), F.col("positives")), 12)
    best = curve.join(F.broadcast(whole)).select(f1.alias("f1"), F.col("score").alias("threshold"), ratio(F.col("cum_p"), F.col("cum_n")).alias("precision"), ratio(F.col("cum_p"), F.col("positives")).alias("recall"))
    return best.agg(F.max(F.struct("f1", "threshold", "precision", "recall")).alias("b")).select("b.threshold", "b.f1", "b.precision", "b.recall")


def review_budgets(scored: DataFrame, order: list[str], budgets: list[int] = REVIEW_BUDGETS) -> DataFrame:
    """Per budget (basis points): the rows reviewed (ceil), frauds captured, precision, recall and lift (null without frauds).

    Rows are reviewed by descending score, then order. All of a score's rows above the cut come from cumulative counts; only the rows of the score at which a cut
    falls are put in order, by numbers that ranges of them are given in parallel.
    """
    spark = scored.sparkSession
    table = spark.createDataFrame([(b,) for b in budgets], "budget_bp int")
    curve = by_score(scored)
    whole = curve.agg(F.sum("n").alias("total"), F.sum("p").alias("positives"))
    cuts = table.join(F.broadcast(whole)).withColumn("reviewed", F.floor((F.col("total") * F.col("budget_bp") + 9999) / 10000).cast("long"))
    at = curve.join(F.broadcast(cuts), (F.col("cum_n") >= F.col("reviewed")) & (F.col("cum_n") - F.col("n") < F.col("reviewed")))
    at = at.select("budget_bp", "reviewed", "total", "positives", "score", (F.col("cum_p") - F.col("p")).alias("before_p"), (F.col("reviewed") - (F.col("cum_n") - F.col("n"))).alias("wanted"))
    tied = with_row_number(scored.join(F.broadcast(at.select("score").distinct()), "score").select("score", "label", *order), ["score", *order], "number", 0)
    ahead = tied.groupBy("score").agg(F.min("number").alias("first"))  # a row per budget at most
    ties = tied.join(F.broadcast(ahead), "score").withColumn("place", F.col("number") - F.col("first") + 1)
    inside = F.broadcast(at).join(ties.select(F.col("score").alias("s"), "place", "label"), (F.col("score") == F.col("s")) & (F.col("place") <= F.col("wanted")))
    caught = inside.groupBy("budget_bp", "reviewed", "total", "positives").agg((F.first("before_p") + F.sum(F.col("label").cast("long"))).alias("captured"))
    precision = F.col("captured") / F.col("reviewed")
    return caught.select("budget_bp", "reviewed", "captured", precision.alias("precision"), F.when(F.col("positives") > 0, F.col("captured") / F.col("positives")).alias("recall"), F.when(F.col("positives") > 0, precision / (F.col("positives") / F.col("total"))).alias("lift"))


def error_examples(scored: DataFrame, threshold: float, order: list[str], keep: list[str], most: int = 3) -> DataFrame:
    """The most confident rows of each group, most of each (a report): false_positive, false_negative, correct_fraud, and high_confidence_wrong, which all wrong rows are in as well.

    Confidence is the score, but one less the score for a false negative, and the larger of both for high_confidence_wrong. Each task hands on at most its own candidates.
    """
    alert, one, other = F.col("score") >= threshold, F.col("label") == 1, 1 - F.col("score")
    wrong = F.array(F.struct(F.when(alert, "false_positive").otherwise("false_negative").alias("g"), F.when(alert, F.col("score")).otherwise(other).alias("c")), F.struct(F.lit("high_confidence_wrong").alias("g"), F.greatest(F.col("score"), other).alias("c")))
    right = F.array(F.struct(F.lit("correct_fraud").alias("g"), F.col("score").alias("c")))
    grouped = scored.where(alert | one).select("*", F.explode(F.when(alert & one, right).otherwise(wrong)).alias("x"))
    rank = Window.partitionBy("error_group").orderBy(F.desc("confidence"), *order)
    ranked = grouped.withColumns({"error_group": F.col("x.g"), "confidence": F.col("x.c")}).withColumn("place", F.row_number().over(rank))
    return ranked.where(F.col("place") <= most).select("error_group", "place", "score", *keep)


def quartiles(rows: DataFrame, column: str = "amount") -> list[float]:
    """The quartiles of a column, by linear interpolation: three numbers go to the driver. Raises for a column without values."""
    found = quantiles(rows, [column], [0.25, 0.5, 0.75])[column]
    if found[0] is None:
        raise ValueError(f"{column} has no values")
    return found


def slice_metrics(scored: DataFrame, edges: list[float], threshold: float, column: str = "amount") -> DataFrame:
    """Per slice of a column (the number of edges at or below the value): rows, positives, precision, recall, F1 and Brier score."""
    value = F.col(column).cast("double")
    band = sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))
    alert, one = F.col("score") >= threshold, F.col("label") == 1
    tp, alerts, ones = F.count_if(alert & one), F.count_if(alert), F.count_if(one)
    return scored.groupBy(band.cast("int").alias("band")).agg(F.count("*").alias("n_rows"), ones.alias("positives"), ratio(tp, alerts).alias("precision"), ratio(tp, ones).alias("recall"), _f1(tp, alerts, ones).alias("f1"), F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"))
