"""Loss curves and model-scoring metrics (family G)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bounds of the convergence check.
SMOOTH_STEPS = 20
DROP_MARGIN = 0.05
LOSS_CEILING = 4.10

RANGE_PARTITIONS_SETTING = "spark.sql.shuffle.partitions"


def loss_convergence(curve: DataFrame) -> DataFrame:
    """Mean of the last steps against step 0 and a ceiling; any NaN or infinity fails the run.

    The rank filter is applied before the shuffle too, so a long run sends at most 20 rows
    per task; the other measures are plain aggregates.
    """
    latest = Window.partitionBy("run").orderBy(F.col("step").desc())
    tail = (
        curve.withColumn("_rank", F.row_number().over(latest))
        .filter(F.col("_rank") <= SMOOTH_STEPS)
        .groupBy("run")
        .agg(F.avg("loss").alias("final_loss"))
    )
    loss = F.col("loss")
    whole = curve.groupBy("run").agg(
        F.min_by("loss", "step").alias("step0_loss"),
        F.count(F.lit(1)).alias("steps"),
        F.bool_or(F.isnan(loss) | (F.abs(loss) == float("inf"))).alias("non_finite"),
    )
    drop = F.col("step0_loss") - F.col("final_loss")
    ok = ~F.col("non_finite") & (drop > DROP_MARGIN) & (F.col("final_loss") < LOSS_CEILING)
    return whole.join(tail, "run").select(
        "run", "steps", "step0_loss", "final_loss", drop.alias("loss_drop"),
        F.when(ok, "PASS").otherwise("FAIL").alias("status"),
    )


def loss_decreased(history: DataFrame) -> DataFrame:
    """Last logged loss below the first; fewer than two points is not a pass."""
    ends = history.groupBy("run").agg(
        F.min_by("loss", "step").alias("loss_first"),
        F.max_by("loss", "step").alias("loss_last"),
        F.count(F.lit(1)).alias("points"),
    )
    # NaN sorts above every number in Spark, but a loss compared with NaN never decreased.
    finite = ~F.isnan("loss_first") & ~F.isnan("loss_last")
    return ends.withColumn(
        "decreased", (F.col("points") >= 2) & finite & (F.col("loss_last") < F.col("loss_first"))
    )


def accuracy(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*by).agg(F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("accuracy"))


def macro_f1(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean F1 over labels seen in truth or prediction, from confusion counts."""
    by = list(by)
    confusion = predictions.groupBy(*by, "y", "yhat").agg(F.count(F.lit(1)).alias("n"))
    sides = confusion.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("y").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")),
                F.struct(F.col("yhat").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")),
            )
        ).alias("s"),
        (F.col("y") == F.col("yhat")).cast("int").alias("hit"),
        "n",
    )
    per_label = sides.groupBy(*by, F.col("s.label").alias("label")).agg(
        F.sum(F.col("s.t") * F.col("n")).alias("support"),
        F.sum(F.col("s.p") * F.col("n")).alias("predicted"),
        F.sum(F.col("s.t") * F.col("hit") * F.col("n")).alias("tp"),
    )
    f1 = F.coalesce(
        2.0 * F.col("tp") / F.nullif(F.col("support") + F.col("predicted"), F.lit(0)), F.lit(0.0)
    )
    return per_label.groupBy(*by).agg(F.avg(f1).alias("macro_f1"), F.count(F.lit(1)).alias("labels"))


def roc_auc(scored: DataFrame, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Area under the ROC curve per group, ties counted half; null where a class is missing.

    Scores are collapsed to (score, positives, negatives) first. The distinct scores are then
    range-partitioned, each range sums its own pairs, and only one row per range meets in the
    last window. No global row window, and the ranges are computed once.
    """
    by = list(by)
    if ranges is None:
        ranges = int(scored.sparkSession.conf.get(RANGE_PARTITIONS_SETTING))
    counts = scored.groupBy(*by, "score").agg(
        F.sum(F.col("y").cast("bigint")).alias("pos"), F.sum(1 - F.col("y").cast("bigint")).alias("neg")
    )
    ranged = counts.repartitionByRange(ranges, *by, "score").withColumn("_range", F.spark_partition_id())
    below = Window.partitionBy("_range", *by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2)
    per_range = ranged.withColumn("_wins", wins).groupBy(*by, "_range").agg(
        F.sum("_wins").alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_range.withColumn("_below", F.coalesce(F.sum("neg").over(earlier), F.lit(0)))
    total = F.sum(F.col("wins") + F.col("pos") * F.col("_below"))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return carried.groupBy(*by).agg(
        (total / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"), F.sum("pos").alias("support")
    )


def roc_auc_weighted(class_scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest AUC weighted by class support; rows are (group.., label, y as 0/1, score)."""
    per_class = roc_auc(class_scores, [*by, "label"])
    weighted = F.sum(F.col("roc_auc") * F.col("support")) / F.sum("support")
    undefined = F.bool_or(F.col("roc_auc").isNull())
    return per_class.groupBy(*by).agg(F.when(~undefined, weighted).alias("roc_auc"))


def nrmse_r2(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """RMSE over the population deviation of the target (0 counts as 1), and R squared."""
    error = F.col("y") - F.col("yhat")
    std = F.coalesce(F.nullif(F.stddev_pop("y"), F.lit(0.0)), F.lit(1.0))
    return predictions.groupBy(*by).agg(
        (F.sqrt(F.avg(error * error)) / std).alias("nrmse"),
        (1 - F.sum(error * error) / F.nullif(F.var_pop("y") * F.count("y"), F.lit(0.0))).alias("r2"),
    )


def bench_compare(treated: DataFrame, baseline: DataFrame, keys: Sequence[str], higher_is_better: bool = True) -> DataFrame:
    """Winner and delta per task of two (keys.., value) tables."""
    pairs = treated.withColumnRenamed("value", "treated").join(
        baseline.withColumnRenamed("value", "baseline"), list(keys)
    )
    gain = F.col("treated") - F.col("baseline")
    better = gain if higher_is_better else -gain
    return pairs.withColumn("delta", gain).withColumn(
        "winner", F.when(better > 0, "treated").when(better < 0, "baseline").otherwise("tie")
    )
