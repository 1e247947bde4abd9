"""Family G queries: loss curves and scoring metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolsight.operators import scoring as ops
from poolsight.plans import bindings as B
from poolsight.plans.registry import query
from poolsight.sources import sinks, workspace


@query(
    "loss_convergence",
    """WITH w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY step DESC) AS r FROM loss_curve),
  a AS (SELECT run, COUNT(*) AS steps, arg_min(loss, step) AS step0_loss, AVG(loss) FILTER (WHERE r <= 20) AS final_loss, bool_or(isnan(loss) OR isinf(loss)) AS bad FROM w GROUP BY 1)
SELECT run, steps, step0_loss, final_loss, step0_loss - final_loss AS loss_drop,
  CASE WHEN NOT bad AND step0_loss - final_loss > 0.05 AND final_loss < 4.10 THEN 'PASS' ELSE 'FAIL' END AS status FROM a""",
)
def loss_convergence(spark, root):
    return ops.loss_convergence(B.loss_curve(spark, root))


@query(
    "loss_decreased",
    """SELECT run, loss_first, loss_last, points, points >= 2 AND NOT isnan(loss_first) AND NOT isnan(loss_last) AND loss_last < loss_first AS decreased FROM (
  SELECT run, arg_min(loss, step) AS loss_first, arg_max(loss, step) AS loss_last, COUNT(*) AS points FROM loss_curve GROUP BY 1)""",
)
def loss_decreased(spark, root):
    return ops.loss_decreased(B.loss_curve(spark, root))


@query("accuracy", "SELECT source, AVG(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) AS accuracy FROM pred_multi GROUP BY 1")
def accuracy(spark, root):
    return ops.accuracy(B.pred_multi(spark, root), ["source"])


@query(
    "macro_f1",
    """WITH l AS (SELECT DISTINCT source, y AS label FROM pred_multi UNION SELECT DISTINCT source, yhat FROM pred_multi),
  s AS (SELECT l.source, label, COUNT(*) FILTER (WHERE y = label AND yhat = label) AS tp, COUNT(*) FILTER (WHERE y = label AND yhat <> label) AS fn,
    COUNT(*) FILTER (WHERE y <> label AND yhat = label) AS fp FROM l JOIN pred_multi p ON p.source = l.source GROUP BY 1, 2)
SELECT source, AVG(CASE WHEN tp + fn + fp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fn + fp) END) AS macro_f1, COUNT(*) AS labels FROM s GROUP BY 1""",
)
def macro_f1(spark, root):
    return ops.macro_f1(B.pred_multi(spark, root), ["source"])


PAIRS = """SUM(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) / COUNT(*)"""


@query(
    "roc_auc",
    f"""SELECT {PAIRS} AS roc_auc, (SELECT COUNT(*) FROM pred_bin WHERE y = 1) AS support
  FROM (SELECT score FROM pred_bin WHERE y = 1) p, (SELECT score FROM pred_bin WHERE y = 0) n""",
)
def roc_auc(spark, root):
    return ops.roc_auc(B.pred_bin(spark, root))


@query(
    "roc_auc_by_group",
    f"""SELECT g.source, a.roc_auc, CAST(g.support AS BIGINT) AS support FROM (SELECT source, SUM(y) AS support FROM pred_bin GROUP BY 1) g
  LEFT JOIN (SELECT p.source, {PAIRS} AS roc_auc FROM (SELECT * FROM pred_bin WHERE y = 1) p JOIN (SELECT * FROM pred_bin WHERE y = 0) n ON n.source = p.source GROUP BY 1) a ON a.source = g.source""",
)
def roc_auc_by_group(spark, root):
    return ops.roc_auc(B.pred_bin(spark, root), ["source"])


@query(
    "roc_auc_multiclass",
    f"""WITH s AS (SELECT label, CASE WHEN lang = label THEN 1 ELSE 0 END AS y, CAST((n_chars * (k + 3)) % 97 AS DOUBLE) / CAST(97 AS DOUBLE) AS score
    FROM documents, (VALUES ('de', 0), ('en', 1), ('es', 2), ('fr', 3)) c(label, k)),
  a AS (SELECT p.label, {PAIRS} AS auc FROM (SELECT * FROM s WHERE y = 1) p JOIN (SELECT * FROM s WHERE y = 0) n ON n.label = p.label GROUP BY 1)
SELECT SUM(auc * support) / SUM(support) AS roc_auc FROM a JOIN (SELECT label, SUM(y) AS support FROM s GROUP BY 1) USING (label)""",
)
def roc_auc_multiclass(spark, root):
    classes = F.array(*[F.struct(F.lit(c).alias("label"), F.lit(k).alias("k")) for k, c in enumerate(("de", "en", "es", "fr"))])
    scored = B.table(spark, root, "documents").select("lang", "n_chars", F.explode(classes).alias("c")).select(
        F.col("c.label").alias("label"),
        (F.col("lang") == F.col("c.label")).cast("int").alias("y"),
        ((F.col("n_chars") * (F.col("c.k") + 3) % 97).cast("double") / F.lit(97.0)).alias("score"),
    )
    return ops.roc_auc_weighted(scored)


@query(
    "nrmse_r2",
    """SELECT dataset, round(sqrt(AVG((y - yhat) * (y - yhat))) / stddev_pop(y), 9) AS nrmse, round(1 - SUM((y - yhat) * (y - yhat)) / (var_pop(y) * COUNT(*)), 9) AS r2 FROM pred_reg GROUP BY 1""",
)
def nrmse_r2(spark, root):
    scores = ops.nrmse_r2(B.pred_reg(spark, root), ["dataset"])
    return scores.select("dataset", F.round("nrmse", 9).alias("nrmse"), F.round("r2", 9).alias("r2"))


def bench_tables(spark, root):
    """Accuracy per source of two predictors: the given one, and one that always says `en`."""
    predictions = B.pred_multi(spark, root)
    treated = ops.accuracy(predictions, ["source"]).withColumnRenamed("accuracy", "value")
    constant = predictions.withColumn("yhat", F.lit("en"))
    return treated, ops.accuracy(constant, ["source"]).withColumnRenamed("accuracy", "value")


COMPARED = """SELECT source, treated, baseline, treated - baseline AS delta, CASE WHEN treated > baseline THEN 'treated' WHEN treated < baseline THEN 'baseline' ELSE 'tie' END AS winner FROM (
  SELECT source, AVG(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) AS treated, AVG(CASE WHEN y = 'en' THEN 1.0 ELSE 0.0 END) AS baseline FROM pred_multi GROUP BY 1)"""


@query("bench_compare", COMPARED)
def bench_compare(spark, root):
    return ops.bench_compare(*bench_tables(spark, root), ["source"])


@query("write_bench_csv", f"SELECT source, treated, baseline, delta, winner FROM ({COMPARED})")
def write_bench_csv(spark, root):
    path = workspace.fresh_path(spark, "bench_csv")
    compared = ops.bench_compare(*bench_tables(spark, root), ["source"])
    sinks.write_bench_csv(compared, path)
    return spark.read.schema(compared.schema).option("header", "true").csv(path)
