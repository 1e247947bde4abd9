"""The tuned tree baseline over all order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolsight.operators import baseline, scoring
from poolsight.plans import bindings as B
from poolsight.plans.registry import query
from poolsight.sources import workspace

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
#: A part of the declared space that a query can search in seconds.
SPACE = {"trees": (8, 10), "depth": (4, 5), "rate": (0.3,), "row_share": (0.8, 1.0), "feature_share": (0.8, 1.0)}


def _auc_sql(column: str) -> str:
    ranks = f"SELECT y, rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0 AS r FROM t"
    return f"SELECT (sum(r) FILTER (WHERE y = 1) - CAST(sum(y) AS DOUBLE) * (sum(y) + 1) / 2) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))) AS auc FROM ({ranks})"


@query(
    "tuned_tree_baseline",
    f"""WITH t AS (SELECT {', '.join(FEATURES)}, CASE WHEN l_quantity * l_discount > 1.25 THEN 1 ELSE 0 END AS y FROM lineitem WHERE l_orderkey % 5 = 0),
  single AS ({' UNION ALL '.join(_auc_sql(c) for c in FEATURES)})
SELECT 'test' AS part, (SELECT count(*) FROM t) AS rows, (SELECT CAST(sum(y) AS BIGINT) FROM t) AS positives,
  round(max(auc), 6) AS best_single_auc, TRUE AS scored, max(auc) < 0.9 AS trees_halve_the_gap FROM single""",
)
def tuned_tree_baseline(spark, root):
    """Whether a line gives away more than 1.25 units: no feature tells alone, trees have to join two.

    The search fits on the train lines and scores every test line. The best area under the curve of a single
    feature is checked as a number; the trees have to close half of what it leaves open.
    """
    y = (F.col("l_quantity") * F.col("l_discount") > 1.25).cast("int").alias("y")
    part = F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train").alias("part")
    rows = B.table(spark, root, "lineitem").select(part, *FEATURES, y)
    train, test = rows.filter(F.col("part") == "train"), rows.filter(F.col("part") == "test")
    scored = workspace.materialise(baseline.tuned_trees(train, test, FEATURES, "y", draws=2, folds=2, space=SPACE), "scored")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("score")) for c in FEATURES]))
    singles = scoring.roc_auc(scored.select("y", each.alias("x")).select("y", "x.*"), ["feature"])
    single = singles.agg(F.max("roc_auc")).scalar()
    return scored.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("y").alias("positives"), F.min(F.col("score").between(0, 1)).alias("scored"),
    ).select(
        "part", "rows", "positives", F.round(single, 6).alias("best_single_auc"), "scored",
        (scoring.roc_auc(scored).select("roc_auc").scalar() > (single + 1) / 2).alias("trees_halve_the_gap"),
    )
