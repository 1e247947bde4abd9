"""Ranked lexical search without a document index: an Aho-Corasick scan of whole texts.

All terms of the items make one automaton, broadcast to the tasks. A term stands in it between guards,
and texts are scanned with every separator turned into the guard, so a hit is a whole term and its count
the term's frequency. The first scan gives the corpus figures (documents, terms, document frequencies),
the second the scores: a hit leads to the items that hold its term. Nothing is kept a document: a task
holds the best documents of every item and hands on only these. Items beyond the bound of one automaton
are searched in blocks, each by scans of its own.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolsight.llm.catalog import query, table
from poolsight.llm.storage import arrow_batches, materialise
from poolsight.llm.text import small_batches

#: Bytes of item terms in one automaton, bytes of a text scanned at once, and score cells held at once.
BLOCK_BYTES, SCAN_BYTES, CELLS = 16 << 20, 1 << 20, 1 << 21
#: Documents that cross to Python together, and the shares of tasks whose best are ranked apart first.
TEXTS_AT_ONCE, PARTS = 1000, 32
GUARD = b" "
SATURATION = 1_000_000_000
#: Doubles hold whole numbers exactly below this.
EXACT = 1 << 53

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_MAP = bytes.maketrans(_SEPARATORS + _UPPER, GUARD * len(_SEPARATORS) + _LOWER)


def guarded(text: str) -> bytes:
    """The text with A-Z lower-cased and a guard for every separator, one more at either end."""
    return GUARD + text.encode("utf-8", "surrogatepass").translate(_MAP) + GUARD


def count_terms(data: bytes) -> int:
    """Terms in a guarded text."""
    inside = np.frombuffer(data, dtype=np.uint8) != GUARD[0]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def pieces(data: bytes) -> Iterator[bytes]:
    """A guarded text in pieces cut at guards, which both neighbours keep; a term is never cut."""
    at = 0
    while len(data) - at > SCAN_BYTES:
        cut = data.rfind(GUARD, at + 1, at + SCAN_BYTES)
        if cut < 0:
            cut = data.find(GUARD, at + SCAN_BYTES)
        yield data[at : cut + 1]
        at = cut
    if len(data) - at > 1:
        yield data[at:]


class Automaton:
    """Finds guarded terms; built anew in each Python worker from the terms it is given."""

    _kept: dict[str, Automaton] = {}

    def __init__(self, terms: list[bytes]) -> None:
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.found.add_word((GUARD + term + GUARD).decode("latin-1"), i)
        if terms:
            self.found.make_automaton()
        self.empty = not terms

    @classmethod
    def shared(cls, name: str, terms: list[bytes]) -> Automaton:
        if name not in cls._kept:
            cls._kept.clear()
            cls._kept[name] = cls(terms)
        return cls._kept[name]

    def counts(self, data: bytes) -> Counter:
        out: Counter = Counter()
        if not self.empty:
            for piece in pieces(data):
                out.update(map(itemgetter(1), self.found.iter(piece.decode("latin-1"))))
        return out


def item_terms(items: DataFrame, ident: str, text: str) -> DataFrame:
    """(item, ident, term, repeats): an item is a row, so equal ids stay apart."""

    def run(batches):
        for batch in batches:
            rows = []
            for item, name, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(item, name, term, n) for term, n in Counter(guarded(words or "").split()).items()]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    numbered = materialise(items.select(F.monotonically_increasing_id().alias("item"), F.col(ident).cast("long").alias("ident"), F.col(text).alias("text")), "items")
    schema = pa.schema([("item", pa.int64()), ("ident", pa.int64()), ("term", pa.binary()), ("repeats", pa.int64())])
    return materialise(numbered.mapInArrow(run, "item long, ident long, term binary, repeats long"), "item-terms")


class Block:
    """A bounded number of items: their terms, and for every term the items that hold it."""

    def __init__(self, rows: list) -> None:
        self.name = uuid.uuid4().hex
        self.idents = sorted({(r["item"], r["ident"]) for r in rows}, key=itemgetter(0))
        place = {item: i for i, (item, _) in enumerate(self.idents)}
        self.terms = sorted({bytes(r["term"]) for r in rows})
        number = {t: i for i, t in enumerate(self.terms)}
        postings = sorted((number[bytes(r["term"])], place[r["item"]], r["repeats"]) for r in rows)
        held, self.items, self.repeats = (np.array(c, dtype=np.int64) for c in (zip(*postings, strict=True) if postings else ((), (), ())))
        self.bounds = np.searchsorted(held, np.arange(len(self.terms) + 1))
        self.weights = self.scale = self.exact = None

    def weigh(self, documents: int, length: int, frequency: dict[int, int]) -> None:
        """Set every term's weight and what a document's length is scaled by."""
        w = [math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency.get(i, 0) + 1))) for i in range(len(self.terms))]
        self.weights = np.repeat(np.array(w, dtype=np.int64), np.diff(self.bounds)) * self.repeats
        self.scale = (documents, max(length, 1))
        most = np.bincount(self.items, self.weights.astype(float), len(self.idents)) * (SATURATION // 1000)
        self.exact = bool(len(most) == 0 or most.max() < EXACT / 4)

    def scores(self, n: np.ndarray, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Scores (documents, items) as whole numbers, from the documents' lengths and their hits."""
        documents, length = self.scale
        m = np.array([25 + 75 * int(v) * documents // length for v in n], dtype=np.int64)
        share = SATURATION * tf // (1000 * tf + 8 * m[rows])
        many = np.diff(self.bounds)[terms]
        first = np.cumsum(many) - many
        at = np.arange(many.sum()) - np.repeat(first - self.bounds[terms], many)
        cell = np.repeat(rows * len(self.idents), many) + self.items[at]
        value = np.repeat(share, many) * self.weights[at]
        shape = (len(n), len(self.idents))
        if self.exact:
            return np.bincount(cell, value.astype(float), shape[0] * shape[1]).astype(np.int64).reshape(shape)
        out = np.zeros(shape[0] * shape[1], dtype=np.int64)
        np.add.at(out, cell, value)
        return out.reshape(shape)


class Best:
    """The highest-scoring documents of every item seen so far; null ids come after all others."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.bar = top, np.ones(items, dtype=np.int64)
        self.item = self.score = self.ident = np.zeros(0, dtype=np.int64)
        self.null = np.zeros(0, dtype=bool)

    def add(self, scores: np.ndarray, ident: np.ndarray, null: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.bar)
        self.item = np.concatenate([self.item, item])
        self.score = np.concatenate([self.score, scores[row, item]])
        self.ident, self.null = np.concatenate([self.ident, ident[row]]), np.concatenate([self.null, null[row]])
        order = np.lexsort((self.ident, self.null, -self.score, self.item))
        item = self.item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.top]
        self.item, self.score, self.ident, self.null = (c[order] for c in (self.item, self.score, self.ident, self.null))
        full = np.flatnonzero(rank[rank < self.top] == self.top - 1)
        self.bar[self.item[full]] = self.score[full]


def _hits(batch: pa.RecordBatch, automaton: Automaton):
    """Ids, their nulls, lengths, and (row, term, tf) of the documents of a batch."""
    n, rows, terms, tf = [], [], [], []
    for row, value in enumerate(batch.column(1)):
        data = guarded(value.as_py() or "")
        n.append(count_terms(data))
        counts = automaton.counts(data) if n[-1] else {}
        rows += [row] * len(counts)
        terms += counts.keys()
        tf += counts.values()
    null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
    ident = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
    return ident, null, np.array(n, dtype=np.int64), *(np.array(c, dtype=np.int64) for c in (rows, terms, tf))


def corpus_figures(docs: DataFrame, block) -> DataFrame:
    """(term, n): how many documents hold a term; -1 counts documents with a term, -2 all their terms."""

    def run(batches):
        own = block.value
        automaton, total = Automaton.shared(own.name, own.terms), np.zeros(len(own.terms) + 2, dtype=np.int64)
        for batch in small_batches(batches, 256):
            _, _, n, _, terms, _ = _hits(batch, automaton)
            total[:-2] += np.bincount(terms, minlength=len(own.terms))
            total[-1] += np.count_nonzero(n)
            total[-2] += n.sum()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(seen < len(own.terms), seen, seen - len(total))), pa.array(total[seen])], names=["term", "n"])

    return docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def best_of_tasks(docs: DataFrame, block, top: int) -> DataFrame:
    """(item, doc, score, part): every task's best documents of every item."""

    def run(batches):
        own = block.value
        automaton, best = Automaton.shared(own.name, own.terms), Best(len(own.idents), top)
        for batch in small_batches(batches, max(1, min(256, CELLS // max(len(own.idents), 1)))):
            ident, null, *hits = _hits(batch, automaton)
            if len(hits[1]):
                best.add(own.scores(*hits), ident, null)
        doc = pa.array(best.ident, pa.int64(), mask=best.null)
        yield pa.RecordBatch.from_arrays([pa.array(best.item), doc, pa.array(best.score)], names=["item", "doc", "score"])

    found = docs.mapInArrow(run, "item long, doc long, score long")
    return found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The best of each item, first among a share of the tasks, then among what these kept."""
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    for by in (["item", "part"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    return found


def search(
    docs: DataFrame, items: DataFrame, top: int = 10, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents with the highest score above 0 for every row of `items`.

    Terms are runs of ASCII digits and letters, A-Z lower-cased, and of all characters beyond ASCII. Null and
    empty texts have none: such an item has no rows, such a document counts nowhere. Equal scores go by
    ascending id, null ids last. A repeated item has its list under its id each time; a repeated document is
    a document each time. Empty tables give no rows. Texts are scanned whole, in pieces cut between terms. Other
    columns are not read. Item terms come to the driver block by block, a block being about `block_bytes`
    or one item; each block costs two scans of the documents.
    """
    spark = docs.sparkSession
    terms = item_terms(items, item, item_text)
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    terms = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    chosen = docs.select(F.col(ident).cast("long").alias("doc"), F.col(text).alias("text"))
    out = None
    with arrow_batches(spark, TEXTS_AT_ONCE):
        for number in range(blocks):
            block = Block(terms.filter(F.col("block") == number).drop("block").collect())
            shared = spark.sparkContext.broadcast(block)
            figures = {r["term"]: r["n"] for r in corpus_figures(chosen, shared).collect()}
            shared.unpersist()
            block.weigh(figures.get(-1, 0), figures.get(-2, 0), figures)
            found = materialise(best_of_tasks(chosen, spark.sparkContext.broadcast(block), top), "found")
            names = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(block.idents)], "item long, ident long")
            lists = ranked(found, top).join(names, "item").select(F.col("ident").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
            out = lists if out is None else out.union(lists)
    return out


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
q AS (
  SELECT item_id, row_number() OVER () AS i,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
qt AS (SELECT i, term, count(*) AS reps FROM (SELECT i, unnest(w) AS term FROM q) GROUP BY ALL),
dt AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
c AS (SELECT count(*) AS n, coalesce(sum(len(w)), 0)::BIGINT AS l FROM d WHERE len(w) > 0),
t AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM dt GROUP BY term), c),
m AS (SELECT r, doc_id, 25 + ((75 * len(w)::BIGINT * n) // l) AS m FROM d, c WHERE len(w) > 0),
s AS (
  SELECT i, r, sum(reps * t.w * ((1000000000 * tf) // (1000 * tf + 8 * m.m)))::BIGINT AS score
  FROM qt JOIN dt USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY i, r
),
p AS (
  SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank
  FROM s JOIN m USING (r) WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM p JOIN q USING (i) WHERE rank <= 10
"""


@query("op12_aho_corasick_search", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
