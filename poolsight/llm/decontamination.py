"""Benchmark decontamination as a prefix-filtered set join, on DataFrame functions alone.

An item's windows are its runs of `window` words (a shorter item is one window); a window is the
set of the word shingles in it. A document holds a window only if it holds all its shingles, so one
shingle, the rarest in the corpus, is the necessary prefix. The first pass over the documents counts the
benchmark's shingles in them; the second joins documents with every window's rarest shingle alone.
Positions and lengths bound where a window can lie around that shingle, and its words are compared with
the document's words there, in the same stage. Shingles are 64-bit hashes; what counts rests on words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolsight.llm.catalog import query, table
from poolsight.llm.storage import materialise

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
#: Benchmark shingles, windows and bytes of these up to which they are broadcast; beyond, joins are shuffled.
BROADCAST_SHINGLES, BROADCAST_BYTES = 1_000_000, 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for the document itself among its shingles; a shingle of this very hash is moved by one.
WHOLE = 0


def words(text: Column) -> Column:
    """Lower-cased words; a cut at either end of the text leaves an empty one to drop."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS), "")


def shingle(words: Column, at: Column, size: int) -> Column:
    """Hash of the `size` words from a place on; odd, so that it is never the one of the document itself."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)]).bitwiseOR(F.lit(1).cast("long"))


def item_windows(items: DataFrame, window: int, ident: str, text: str) -> DataFrame:
    """(window, words, items): every distinct window once, with the ids of the items that have it."""
    texts = items.select(F.col(ident).cast("string").alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(0), F.size("w") - length))
    cut = texts.select("item", "w", starts.alias("from"), length.alias("length"))
    cut = cut.select("item", F.expr("slice(w, from + 1, length)").alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("window", F.monotonically_increasing_id())


def window_shingles(windows: DataFrame) -> DataFrame:
    """(window, size, at, shingle): shingles of up to SHINGLE words, shorter for shorter windows; linear in an item's length."""
    size = F.least(F.size("words"), F.lit(SHINGLE))
    places = windows.select("window", "words", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("at"))
    own = F.when(F.col("size") == 1, shingle(F.col("words"), F.col("at"), 1)).when(F.col("size") == 2, shingle(F.col("words"), F.col("at"), 2))
    return places.select("window", "size", "at", own.otherwise(shingle(F.col("words"), F.col("at"), SHINGLE)).alias("shingle"))


def document_shingles(base: DataFrame, sizes: list[int]) -> DataFrame:
    """A row a shingle of a document, by size and place, and one for the document itself (`pos` past its last word)."""
    placed = base.withColumn("n_words", F.size("w").cast("long")).select("*", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
    itself = F.col("pos") == F.col("n_words")
    if not sizes:
        return placed.filter(itself).withColumn("shingle", F.lit(WHOLE).cast("long"))
    size = F.lit(sizes[0])
    if len(sizes) > 1:
        every = F.array(*[F.lit(s) for s in sizes])
        placed = placed.withColumn("size", F.explode(F.when(itself, F.slice(every, 1, 1)).otherwise(every)))
        size = F.col("size")
    # never null and computed once: a filter on it would be pushed below and compute it twice
    own = F.when(itself, F.lit(WHOLE).cast("long"))
    for s in sizes[:-1]:
        own = own.when(size == s, shingle(F.col("w"), F.col("pos"), s))
    own = own.otherwise(shingle(F.col("w"), F.col("pos"), sizes[-1]))
    return placed.filter(itself | (F.col("pos") + size <= F.col("n_words"))).withColumn("shingle", own).drop("word")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = 13,
    percent: int = 5,
    ident: str = "doc_id",
    text: str = "text",
    item_ident: str = "item_id",
    item_text: str = "text",
    broadcast_shingles: int = BROADCAST_SHINGLES,
) -> DataFrame:
    """One row a row of `docs`: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    Words, windows and hits are those of the module's head; a document is contaminated when it has a
    hit and its hits are at least `percent` per cent of its words. Null and wordless texts have no
    words and no hits; null and wordless items have no windows; null item ids are left out of counts
    and digests but their windows still hit; repeated rows each get the same result; an empty
    benchmark hits nothing; empty documents give no rows. (doc_id, text_hash) names a row for joins.
    """
    known = materialise(item_windows(items, window, item_ident, item_text), "item-windows")
    parts = materialise(window_shingles(known), "item-shingles")
    vocabulary = parts.select("shingle").distinct()
    sizes = sorted(r["size"] for r in parts.select("size").distinct().collect())
    n_windows, bytes_ = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.array_join("words", " "))), F.lit(0))).first()
    base = docs.select(
        F.col(ident).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), words(F.col(text)).alias("w")
    )

    seen = document_shingles(base.select("w"), sizes).select("shingle")
    counted = F.count(F.lit(1)).alias("df")
    if vocabulary.count() <= broadcast_shingles:
        rarity = seen.join(F.broadcast(vocabulary), "shingle").groupBy("shingle").agg(counted)
    else:
        rarity = seen.groupBy("shingle").agg(counted).join(vocabulary, "shingle")
    rarity = materialise(rarity, "shingle-rarity")

    # a window with a shingle that no document holds is in none; of the others the rarest shingle is joined
    span = F.size("words") - F.col("size") + 1
    prefix = (
        parts.join(rarity, "shingle").groupBy("window")
        .agg(F.min_by(F.struct("size", "shingle", "at"), F.struct("df", "shingle", "at")).alias("p"), F.count(F.lit(1)).alias("met"))
        .select("window", "met", "p.*").join(known, "window").filter(F.col("met") == span)
        .select(F.col("shingle").alias("p_shingle"), "at", "words", "items")
    )
    itself = docs.sparkSession.range(1).select(
        F.lit(WHOLE).cast("long").alias("p_shingle"), F.lit(0).alias("at"),
        F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("array<string>").alias("items"),
    )
    prefix = prefix.union(itself)
    if n_windows <= broadcast_shingles and bytes_ <= BROADCAST_BYTES:
        prefix = F.broadcast(prefix)
    lo, length = F.col("pos") - F.col("at"), F.size("words")
    there = F.when((lo >= 0) & (lo + length <= F.col("n_words")), F.slice("w", lo + 1, length))
    joined = document_shingles(base, sizes).join(prefix, F.col("shingle") == F.col("p_shingle"))
    met = joined.filter(F.col("words").isNull() | (there == F.col("words"))).select(
        "doc_id", "text_hash", "n_words", F.col("words").isNull().alias("itself"), lo.alias("lo"), (lo + length).alias("hi"), "items"
    )
    met = materialise(met, "met-windows")
    windows = met.filter(~F.col("itself"))
    cover = windows.groupBy("doc_id", "text_hash", "lo").agg(F.max("hi").alias("hi"))
    earlier = Window.partitionBy("doc_id", "text_hash").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    covered = cover.withColumn("reached", F.coalesce(F.max("hi").over(earlier), F.col("lo")))
    n_hit = covered.groupBy("doc_id", "text_hash").agg(
        F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "reached"))).alias("n_hit")
    )
    named = windows.select("doc_id", "text_hash", F.explode_outer("items").alias("item"))
    n_items = named.groupBy("doc_id", "text_hash").agg(F.collect_set("item").alias("names"))
    tally = n_hit.join(n_items.withColumnsRenamed({"doc_id": "i_doc", "text_hash": "i_hash"}),
        F.col("doc_id").eqNullSafe(F.col("i_doc")) & (F.col("text_hash") == F.col("i_hash")))
    tally = tally.select(F.col("doc_id").alias("t_doc"), F.col("text_hash").alias("t_hash"), "n_hit", "names")
    whole = met.filter("itself").select("doc_id", "text_hash", "n_words")
    names = F.coalesce(F.array_sort("names"), F.array().cast("array<string>"))
    return (
        whole.join(tally, F.col("doc_id").eqNullSafe(F.col("t_doc")) & (F.col("text_hash") == F.col("t_hash")), "left")
        .select(
            "doc_id",
            "text_hash",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(names).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"),
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
    )


def drop_contaminated(docs: DataFrame, verdicts: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of `docs` that no contaminated verdict names; these are broadcast if they are few enough."""
    bad = verdicts.filter("contaminated").select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash"))
    bad = materialise(bad.distinct(), "contaminated")
    few = bad.count() <= BROADCAST_SHINGLES
    same = F.col(ident).eqNullSafe(F.col("__bad_id")) & (F.xxhash64(F.col(text)) == F.col("__bad_hash"))
    return docs.join(F.broadcast(bad) if few else bad, same, "left_anti")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 13) AS size FROM (SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT size FROM b),
dw AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op8_prefix_filtered_join", SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate(docs, items).drop("text_hash")
