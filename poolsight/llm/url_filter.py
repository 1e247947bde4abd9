"""Verdicts on URLs from a list of canonical URLs: a blocked Bloom filter, then an exact hash join.

A listed URL is a host with a path; it fits that host and its subdomains where a page's path starts
with its own. The list is asked twice, each time first through a Bloom filter and then exactly: which
ends of a page's host are listed at all, and, with the path lengths listed for that host, which host
and path are. A Bloom block is eight 64-bit words in one row, and a key sets one bit in each, so a probe
reads one row of a broadcast table of bounded size. False positives only cost a look-up, since the join
with the list removes them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsight.llm.catalog import query, table
from poolsight.llm.storage import materialise

#: Bits a listed key, and the most blocks of 512 bits; a longer list raises only the share of false positives.
BITS, MOST_BLOCKS = 12, 1 << 17
#: Keys and their bytes up to which a list is broadcast; a longer one is joined by a shuffle, salted this often.
BROADCAST_KEYS, BROADCAST_BYTES, SALTS = 500_000, 64 << 20, 8
WORDS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _bit(key: Column, word: int) -> Column:
    place = F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 6 * word).bitwiseAND(F.lit(63))
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


class Listed:
    """Distinct keys with what is known of them, their Bloom filter, and the form of the exact join."""

    def __init__(self, rows: DataFrame, key: str) -> None:
        size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(key)), F.lit(0))).first()
        self.rows, self.key = rows, key
        self.small = size[0] <= BROADCAST_KEYS and size[1] <= BROADCAST_BYTES
        wanted = max(1, math.ceil(size[0] * BITS / (64 * WORDS)))
        self.blocks = min(MOST_BLOCKS, 1 << (wanted - 1).bit_length())
        words = [F.bit_or(_bit(F.col(key), i)).alias(f"__word{i}") for i in range(WORDS)]
        self.filter = rows.groupBy(_block(F.col(key), self.blocks).alias("__block")).agg(*words)

    def possible(self, candidates: DataFrame) -> DataFrame:
        """The candidates whose key may be listed; every listed one is among them."""
        key = F.col(self.key)
        hit = F.col("__block") == _block(key, self.blocks)
        for i in range(WORDS):
            hit = hit & (F.col(f"__word{i}").bitwiseAND(_bit(key, i)) != 0)
        return candidates.join(F.broadcast(self.filter), hit).select(*candidates.columns)

    def exact(self, candidates: DataFrame) -> DataFrame:
        """The candidates that are listed, with the list's columns; a key of very many candidates is salted."""
        if self.small:
            return candidates.join(F.broadcast(self.rows), self.key)
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        salted = self.rows.withColumn("__salt", salts)
        own = candidates.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)))
        return own.hint("merge").join(salted, [self.key, "__salt"]).drop("__salt")


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """All columns of `pages` with `__host`, `__path`, `__rule` and `__verdict`.

    `listed` has host, path and verdict. A URL's host is what follows its first `://` up to `/`, `?`, `#` or its
    end, A-Z lower-cased; its path goes on up to `?`, `#` or the end. Of the listed URLs that fit, the longest
    (host and path together, then host) decides; without one, the rule is null and the verdict `otherwise`.
    A null URL, an empty one and one without `://` have an empty host and path, which no listed URL with a
    host fits. Repeated pages are judged each; of repeated listed URLs the greatest verdict holds (block
    before allow); listed rows with a null host count as empty hosts and never fit, a null path is an empty one.
    Nothing listed leaves every page at `otherwise`. URLs of any length are read whole. Added columns replace
    columns of the same name; all others are kept.
    """
    added = ["__host", "__path", "__rule", "__verdict"]
    kept = [c for c in pages.columns if c not in (*added, "__row")]
    rows = materialise(
        pages.select(*kept, host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path"), F.monotonically_increasing_id().alias("__row")),
        "urls",
    )
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    clean = listed.select(host.alias("__end"), F.coalesce("path", F.lit("")).alias("__start"), "verdict").filter(F.col("__end") != "")
    rules = clean.groupBy("__end", "__start").agg(F.max("verdict").alias("__verdict"))
    rules = materialise(rules.withColumn("__key", F.concat("__end", F.lit(" "), "__start")), "url-list")
    hosts = Listed(rules.groupBy("__end").agg(F.collect_set(F.length("__start")).alias("__sizes")), "__end")
    whole = Listed(rules.select("__key", "__verdict"), "__key")
    # how many labels listed hosts have: a handful of small numbers
    depths = rules.agg(F.sort_array(F.collect_set(_labels(F.col("__end"))))).first()[0]

    end_of = lambda n: F.call_function("substring_index", F.col("__host"), F.lit("."), -n)
    ends = F.transform(F.filter(F.lit(depths).cast("array<int>"), lambda n: n <= _labels(F.col("__host"))), end_of)
    asked = rows.filter(F.col("__host") != "").select("__row", "__path", F.explode(ends).alias("__end"))
    known = hosts.exact(hosts.possible(asked))
    starts = F.filter("__sizes", lambda n: n <= F.length("__path"))
    tried = known.select("__row", "__end", F.explode(F.transform(starts, lambda n: F.left("__path", n))).alias("__start"))
    tried = tried.select("__row", "__end", "__start", F.concat("__end", F.lit(" "), "__start").alias("__key"))
    fits = whole.exact(whole.possible(tried))
    longest = F.struct((F.length("__end") + F.length("__start")).alias("n"), F.length("__end").alias("host"))
    best = fits.groupBy("__row").agg(F.max_by(F.struct(F.concat("__end", "__start").alias("rule"), "__verdict"), longest).alias("__best"))
    return rows.join(best, "__row", "left").select(
        *kept, "__host", "__path", F.col("__best.rule").alias("__rule"), F.coalesce("__best.__verdict", F.lit(otherwise)).alias("__verdict")
    )


RULES = "('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')"

SQL = f"""
WITH rules(h, p, v) AS (VALUES {RULES}),
urls AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
),
fits AS (
  SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h) + length(p) DESC, length(h) DESC) AS place
  FROM urls JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM urls LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (r)
"""


@query("op11_bloom_url_filter", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.sql(f"SELECT * FROM VALUES {RULES} AS t(host, path, verdict)")
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listed)
    return judged.select("page_id", *[F.col(f"__{c}").alias(c) for c in ("host", "path", "rule", "verdict")])
