import pytest
from pyspark.sql import functions as F

from poolsight.operators import baseline, scoring

SPACE = {"trees": (4, 8), "depth": (2, 3), "rate": (0.3,), "row_share": (1.0,), "feature_share": (1.0,)}


def test_grid_is_distinct_and_repeatable():
    one, two = (baseline.draw_grid(SPACE, 3, 1) for _ in range(2))
    assert one == two and len({tuple(p.values()) for p in one}) == 3
    assert len(baseline.draw_grid(SPACE, 50, 1)) == 4
    assert len(baseline.draw_grid(baseline.SEARCH_SPACE, baseline.DRAWS, 0)) == 15


@pytest.fixture
def rows(spark):
    df = spark.range(600).select(
        "id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")
    )
    return df.withColumn("y", ((F.col("a") + F.col("b")) > 9).cast("int"))


def test_classifier_learns_and_scores_every_row(spark, rows):
    """Rows without a label or a feature are scored too, and teach nothing or as -1."""
    data = rows.withColumn("y", F.when(F.col("id") % 10 > 0, F.col("y"))).withColumn("b", F.when(F.col("id") % 19 > 0, F.col("b")))
    train, test = data.filter("id % 4 <> 0"), data.filter("id % 4 = 0")
    got = baseline.tuned_trees(train, test, ["a", "b"], "y", draws=2, folds=2, space=SPACE)
    assert got.columns == [*data.columns, "score", "yhat"]
    assert got.count() == test.count() == got.filter("score between 0 and 1").count()
    assert scoring.roc_auc(got.filter("y is not null")).first().roc_auc > 0.9


def test_regressor_learns(spark, rows):
    data = rows.withColumn("y", F.col("a") * 2)
    train, test = data.filter("id % 4 <> 0"), data.filter("id % 4 = 0")
    got = baseline.tuned_trees(train, test, ["a", "b"], "y", regression=True, draws=1, folds=2, space=SPACE)
    assert scoring.nrmse_r2(got).first().r2 > 0.5
