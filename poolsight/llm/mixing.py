"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, its target share of the mix over its share of the rows.
A document's count is the inverse of the Poisson distribution of that mean at a uniform number
hashed from the seed and the document, so a count depends on no other row and on no partitioning.
Documents are exploded by their counts and dealt out anew in the order of a hash of (document,
copy). Everything on the path is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsight.llm.catalog import query, table

#: A larger mean is split into equal parts of at most this mean, inverted apart and summed.
PART = 16.0
#: Sources up to which their rates are broadcast; a row of rates is under 1 kB.
BROADCAST_SOURCES = 10_000


def unit(*parts: Column) -> Column:
    """Uniform in [0, 1): the first 52 bits of the md5 of the parts."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, source: str, weights: Mapping[str | None, int], default: int, epochs: float):
    """One row a source: its mean repetition rate, in how many parts, and the part's cumulative chances."""
    counts = docs.groupBy(F.col(source).alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    weight = F.lit(default)
    for name, value in weights.items():
        weight = F.when(F.col("__source").eqNullSafe(F.lit(name)), F.lit(value)).otherwise(weight)
    counts = counts.withColumn("__w", weight.cast("double"))
    rows, weights = counts.agg(F.sum("__n")).scalar(), counts.agg(F.sum("__w")).scalar()
    rate = F.lit(float(epochs)) * rows * F.col("__w") / F.nullif(weights * F.col("__n"), F.lit(0.0))
    rated = counts.select("__source", F.coalesce(rate, F.lit(0.0)).alias("__rate"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("__rate") / PART)).cast("int")
    mean = F.col("__rate") / F.col("__parts")
    zero = F.exp(-mean)
    steps = F.sequence(F.lit(1), F.lit(int(PART + 12 * PART**0.5 + 30)))
    chances = F.aggregate(
        steps,
        F.struct(zero.alias("term"), F.array(zero).alias("cdf")),
        lambda a, k: F.struct(
            (a["term"] * mean / k).alias("term"),
            F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["term"] * mean / k)).alias("cdf"),
        ),
        lambda a: a["cdf"],
    )
    return rated.withColumn("__parts", parts).withColumn("__cdf", chances)


def poisson_mix(
    docs: DataFrame,
    weights: Mapping[str | None, int] | None = None,
    default_weight: int = 1,
    epochs: float = 1.0,
    seed: int = 7,
    source: str = "source",
    ident: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """All columns of `docs` for every copy, plus `__repeat_rate`, `__repeats`, `__copy` and `__shuffle_key`.

    `weights` are whole numbers by source, `default_weight` holds for sources not named; a null
    source is a source. The mix has `epochs` times the rows of `docs` in expectation. A document
    drawn zero times has no row. Repeated rows of one id draw alike; a null id draws by its text.
    A weight of zero, an empty table or all-zero weights give no rows. Row order inside partitions
    is that of `__shuffle_key`, which is also a total order to sort by; sources never share a task by
    name, so a source with most of the rows is spread like any other.
    """
    rates = source_rates(docs, source, weights or {}, default_weight, epochs)
    named = F.coalesce(F.col(ident).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    known = len(docs.select(source).distinct().limit(BROADCAST_SOURCES + 1).take(BROADCAST_SOURCES + 1))
    rated = docs.join(
        F.broadcast(rates) if known <= BROADCAST_SOURCES else rates, F.col(source).eqNullSafe(F.col("__source"))
    )
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("__parts")),
        F.lit(0),
        lambda total, part: total
        + F.size(
            F.filter(F.col("__cdf"), lambda c: c <= unit(F.lit(str(seed)), F.col("__name"), part.cast("string")))
        ),
    )
    single = F.size(F.filter(F.col("__cdf"), lambda c: c <= F.col("__u")))
    copies = (
        rated.withColumn("__name", named)
        .withColumn("__u", unit(F.lit(str(seed)), F.col("__name"), F.lit("1")))
        .withColumn("__repeats", F.when(F.col("__parts") == 1, single).otherwise(drawn).cast("int"))
        .filter("__repeats > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__repeats"))))
        .withColumn("__repeat_rate", F.round("__rate", 6))
        .withColumn("__shuffle_key", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.col("__name"), F.col("__copy").cast("string"))))
        .drop("__name", "__u", "__parts", "__cdf", "__rate", "__source")
    )
    return copies.repartition(F.col("__shuffle_key")).sortWithinPartitions("__shuffle_key")


SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE * (SELECT sum(n) FROM counts)::DOUBLE * 1.0::DOUBLE
  / ((SELECT count(*) FROM counts)::DOUBLE * n::DOUBLE) AS rate FROM counts),
chances AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS cdf FROM rates
  UNION ALL
  SELECT source, rate, k + 1, term * rate / (k + 1), cdf + term * rate / (k + 1) FROM chances WHERE k < 94),
drawn AS (SELECT row_number() OVER () AS r, doc_id, text, lang, source, n_chars,
  ('0x' || substr(md5('7|' || doc_id || '|1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (SELECT any_value(d.doc_id) AS doc_id, any_value(d.text) AS text, any_value(d.lang) AS lang, any_value(d.source) AS source,
  any_value(d.n_chars) AS n_chars, round(any_value(c.rate), 6) AS repeat_rate,
  count(*) FILTER (c.cdf <= d.u) AS repeats
  FROM drawn d JOIN chances c ON d.source IS NOT DISTINCT FROM c.source GROUP BY d.r)
SELECT doc_id, text, lang, source, n_chars, repeat_rate, repeats::INTEGER AS repeats, copy::INTEGER AS copy,
  md5('order7|' || doc_id || '|' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, repeats + 1)) AS copy FROM counted WHERE repeats > 0)
"""


@query("op10_poisson_mix", SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source to the same weight, as many rows as the table has."""
    docs = table(spark, sf_dir, "documents")
    added = [F.col(f"__{c}").alias(c) for c in ("repeat_rate", "repeats", "copy", "shuffle_key")]
    return poisson_mix(docs).select(*docs.columns, *added)
