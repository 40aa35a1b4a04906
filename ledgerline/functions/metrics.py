"""Classifier evaluation metrics as DataFrame aggregates (C7-C11), per group.

ROC-AUC and average precision first collapse the rows to one row per
(group, score) -- positives and negatives at that score -- and then need a
running sum over a group's *distinct scores* (exact and tie-aware, like
sklearn). Model probabilities are nearly all distinct, so one large tenant
would put almost all of its rows into a single window partition. The running
sum is therefore computed as a distributed prefix sum (``prefix_sums``):
range-partition by (group, score), fix the slices with a reliable
checkpoint, add per-slice offsets from a small (slice x group) table, and run
windows only within slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import cut_lineage


def prefix_sums(df: DataFrame, group_cols: Sequence[str], order_col: str, cols: Sequence[str],
                descending: bool = False, inclusive: bool = False, n_slices: int | None = None) -> DataFrame:
    """Running sums of ``cols`` per group in ``order_col`` order, skew-safe.

    Adds ``_cum_<c>``: the sum over rows before (``inclusive``: up to and
    including) each row. ``order_col`` must be unique within a group (e.g.
    distinct scores). No window partition is larger than one range slice.
    """
    g = list(group_cols)
    spark = df.sparkSession
    n = n_slices or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    o = F.col(order_col).desc() if descending else F.col(order_col).asc()
    r = df.repartitionByRange(n, *[F.col(c) for c in g], o).withColumn("_slice", F.spark_partition_id())
    r = cut_lineage(r)  # reliable checkpoint: slice ids stay fixed however often r is read
    tot = r.groupBy("_slice", *g).agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    wo = Window.partitionBy(*g).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_slice", *g, *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}") for c in cols])
    wl = Window.partitionBy("_slice", *g).orderBy(o).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    j = r.join(off, ["_slice", *g])
    return j.select(*df.columns, *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(wl), F.lit(0))).alias(f"_cum_{c}")
                                   for c in cols])


def confusion(df: DataFrame, y: str, p: str, group_cols: Sequence[str] = ("company_id",)) -> DataFrame:
    """Tp, tn, fp, fn (labels and predictions as 0/1)."""
    yv, pv = F.col(y).cast("int"), F.col(p).cast("int")
    return df.groupBy(*group_cols).agg(
        F.count(F.when((yv == 1) & (pv == 1), 1)).alias("true_positive"),
        F.count(F.when((yv == 0) & (pv == 0), 1)).alias("true_negative"),
        F.count(F.when((yv == 0) & (pv == 1), 1)).alias("false_positive"),
        F.count(F.when((yv == 1) & (pv == 0), 1)).alias("false_negative"),
    )


def classification_metrics(df: DataFrame, y: str, p: str, group_cols: Sequence[str] = ("company_id",)) -> DataFrame:
    """Accuracy, precision, recall, F1 at the given 0/1 prediction (zero_division = 0)."""
    c = confusion(df, y, p, group_cols)
    tp, tn, fp, fn = (F.col(x) for x in ("true_positive", "true_negative", "false_positive", "false_negative"))
    n = tp + tn + fp + fn
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    return c.select("*", F.when(n > 0, (tp + tn) / n).alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"), f1.alias("f1"))


def majority_baseline(train: DataFrame, test: DataFrame, y: str, group_cols: Sequence[str] = ("company_id",)) -> DataFrame:
    """Predict the training mode (ties -> the smaller class, as pandas ``mode()[0]``)."""
    g = list(group_cols)
    counts = train.groupBy(*g, F.col(y).cast("int").alias("_cls")).agg(F.count(F.lit(1)).alias("_n"))
    mode = counts.groupBy(*g).agg(F.max_by("_cls", F.struct(F.col("_n"), -F.col("_cls"))).alias("majority_class"))
    t = test.join(F.broadcast(mode), g).withColumn("_pred", F.col("majority_class"))
    return classification_metrics(t, y, "_pred", g).join(mode, g)


def _score_groups(df: DataFrame, y: str, score: str, g: list[str]) -> DataFrame:
    yv = F.col(y).cast("int")
    return df.groupBy(*g, F.col(score).cast("double").alias("_s")).agg(
        F.count(F.when(yv == 1, 1)).alias("_pos"), F.count(F.when(yv == 0, 1)).alias("_neg"))


def roc_auc(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = ("company_id",)) -> DataFrame:
    """AUC = sum over scores of pos * (neg below + neg at the score / 2) / (P * N); null if one class."""
    g = list(group_cols)
    sg = prefix_sums(_score_groups(df, y, score, g), g, "_s", ["_neg"]).withColumnRenamed("_cum__neg", "_neg_below")
    agg = sg.groupBy(*g).agg(F.sum(F.col("_pos") * (F.col("_neg_below") + F.col("_neg") / 2.0)).alias("_u"),
                             F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"))
    auc = F.when((F.col("positives") > 0) & (F.col("negatives") > 0),
                 F.col("_u") / (F.col("positives") * F.col("negatives")))
    return agg.select(*g, "positives", "negatives", auc.alias("roc_auc"))


def average_precision(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = ("company_id",)) -> DataFrame:
    """C11: step-form AP = sum (pos/P) * precision at each distinct threshold (descending); null if no positive."""
    g = list(group_cols)
    sg = prefix_sums(_score_groups(df, y, score, g), g, "_s", ["_pos", "_neg"], descending=True, inclusive=True)
    sg = sg.withColumnRenamed("_cum__pos", "_tp").withColumnRenamed("_cum__neg", "_fp")
    agg = sg.groupBy(*g).agg(F.sum(F.col("_pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))).alias("_a"),
                             F.sum("_pos").alias("positives"))
    return agg.select(*g, "positives", F.when(F.col("positives") > 0, F.col("_a") / F.col("positives"))
                      .alias("average_precision"))
