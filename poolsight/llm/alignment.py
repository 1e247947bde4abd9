"""Alignment of two tokenizers by interval coalescing, and how often their tokens meet.

Tokens of both sides are byte ranges of the same text. All ranges of a batch of texts are sorted together
by start, and a running maximum of their ends is kept: where a start reaches that maximum, both sides have
ended a token, and a group begins. Inside a group every token of one side is linked with every one of the
other.

How many documents hold a pair of ids linked is a corpus figure. Documents are written with their pairs,
packed; the pairs are counted; and the counts are brought back to the documents. The commonest pairs, a
bounded number, are broadcast; the rare rest goes through a shuffle join, where by their rarity no key is
hot.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsight.llm.byte_bpe import ByteBpe
from poolsight.llm.catalog import query, table
from poolsight.llm.storage import arrow_batches, filesystem, materialise
from poolsight.llm.text import small_batches

#: Where the two public vocabularies lie on every machine.
VOCABULARY, MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Documents that cross to Python together, and characters after which a text is cut where both sides surely end a token.
TEXTS_AT_ONCE, SEGMENT = 256, 1 << 19
#: Pairs whose counts are broadcast, links expanded at once, and distinct pairs a task counts before it hands them on.
BROADCAST_PAIRS, LINKS_AT_ONCE, COUNTED_AT_ONCE = 1 << 20, 1 << 21, 1 << 21
_CUT = re.compile("(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")

ALIGNED = "doc_id long, row long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>, ends array<long>"
LINKED = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, links binary"


class Sides:
    """Both tokenizers, and the bytes of every id."""

    _kept: dict[tuple[str, str], Sides] = {}

    def __init__(self, vocabulary: str, model: str) -> None:
        import sentencepiece

        self.a = ByteBpe.from_vocabulary(vocabulary)
        self.a_bytes = [b""] * self.a.n_vocab
        for token, rank in self.a.ranks.items():
            self.a_bytes[rank] = token
        fs, place = filesystem(model)
        with fs.open_input_stream(place) as stream:
            self.b = sentencepiece.SentencePieceProcessor(model_proto=stream.read())
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        # a text may be cut at a space only if no piece reaches from other characters over one
        self.cuts = not any(b" " in t.lstrip(b" ") for t in self.b_bytes)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    @classmethod
    def shared(cls, vocabulary: str, model: str) -> Sides:
        key = (vocabulary, model)
        if key not in cls._kept:
            cls._kept[key] = cls(*key)
        return cls._kept[key]

    def segments(self, text: str) -> Iterator[str]:
        """Pieces that, joined by spaces, are the text; each is encoded as if it stood alone."""
        at = 0
        while self.cuts and len(text) - at > SEGMENT and (cut := _CUT.search(text, at + SEGMENT)):
            yield text[at : cut.start()]
            at = cut.end()
        yield text[at:]

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both sides; none where the bytes of either differ from a space and the text."""
        a, b = [], []
        for segment in self.segments(text) if text else ():
            own_a, own_b, want = self.a.encode(" " + segment), self.b.encode(segment, num_threads=1), (" " + segment).encode()
            if b"".join(map(self.a_bytes.__getitem__, own_a)) != want or b"".join(map(self.b_bytes.__getitem__, own_b)) != want:
                return [], []
            a += own_a
            b += own_b
        return a, b


def coalesce(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group of each A token and of each B token, and the end of each group; both sides cover the same bytes."""
    end = np.concatenate([np.cumsum(a_len), np.cumsum(b_len)])
    start = end - np.concatenate([a_len, b_len])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    first = np.ones(len(order), dtype=bool)
    first[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(first) - 1
    last = np.append(first[1:], True) if len(first) else first
    return group[: len(a_len)], group[len(a_len) :], reach[last]


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def align(docs: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, model: str = MODEL) -> DataFrame:
    """A row a document: ids of both sides, and how many tokens of each and which byte end every group has.

    Byte offsets count from the space before the text. Null and empty texts, and texts whose bytes a side does
    not give back, have empty lists. Repeated rows are documents each, null ids stay; `row` tells rows apart. No
    other column is read. Very long texts are encoded in pieces cut at single spaces between letters or
    digits, where no token of either side reaches over; the lists are those of the whole text.
    """
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in ALIGNED.split(", ")]

    def run(batches):
        sides = Sides.shared(vocabulary, model)
        a_size, b_size = (np.array([len(t) for t in side], dtype=np.int64) for side in (sides.a_bytes, sides.b_bytes))
        for batch in small_batches(batches, 64):
            a, b, a_off, b_off = [], [], [0], [0]
            for value in batch.column(2):
                own_a, own_b = sides.encode(value.as_py())
                a += own_a
                b += own_b
                a_off.append(len(a))
                b_off.append(len(b))
            a, b, a_off, b_off = (np.array(x, dtype=np.int64) for x in (a, b, a_off, b_off))
            in_a, in_b, ends = coalesce(a_size[a], b_size[b])
            # groups never reach over two documents, so a document's first A token opens its first group
            g_off = np.append(in_a, len(ends))[a_off]
            many = np.diff(g_off)
            base = np.concatenate([[0], np.cumsum(a_size[a])])[a_off[:-1]]
            columns = [
                batch.column(0), batch.column(1), _lists(a_off, a, kinds[2]), _lists(b_off, b, kinds[3]),
                _lists(g_off, np.bincount(in_a, minlength=len(ends)), kinds[4]),
                _lists(g_off, np.bincount(in_b, minlength=len(ends)), kinds[5]),
                _lists(g_off, ends - np.repeat(base, many), kinds[6]),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(k) if not pa.types.is_list(c.type) else c for c, k in zip(columns, kinds, strict=True)], names=names)

    chosen = docs.select(F.col(ident).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, ALIGNED)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.flatten()).astype(np.int64), offsets - offsets[0]


def _entries(group: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) with how often the id stands in the group."""
    key, n = np.unique(group * width + ids, return_counts=True)
    return key // width, key % width, n


def _pairs(doc: np.ndarray, in_a: np.ndarray, a: np.ndarray, in_b: np.ndarray, b: np.ndarray, widths: tuple[int, int]):
    """(document, pair, links) of a batch, each document's pairs once and ascending; `doc` is each group's document."""
    (ga, ia, na), (gb, ib, nb) = _entries(in_a, a, widths[0]), _entries(in_b, b, widths[1])
    first = np.searchsorted(gb, np.arange(len(doc) + 1))
    many = np.diff(first)[ga] if len(ga) else ga
    steps, parts, at = np.cumsum(many), [], 0
    while at < len(ga):
        before = steps[at] - many[at]
        to = max(at + 1, int(np.searchsorted(steps, before + LINKS_AT_ONCE, side="right")))
        own = many[at:to]
        other = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own - first[ga[at:to]], own)
        key = np.repeat(doc[ga[at:to]] * (widths[0] * widths[1]) + ia[at:to] * widths[1], own) + ib[other]
        parts.append(_summed(key, np.repeat(na[at:to], own) * nb[other]))
        at = to
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, links = parts[0] if len(parts) == 1 else _summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
    return key // (widths[0] * widths[1]), key % (widths[0] * widths[1]), links


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as the bytes of the narrowest type, byte planes apart, deflated."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or int(values.max()) < 1 << (8 * w))
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zlib.compress(planes.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zlib.decompress(data[1:]), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.int64)


def digests(aligned: DataFrame, vocabulary: str = VOCABULARY, model: str = MODEL) -> DataFrame:
    """A row a document: token, group and link counts, the hash of its groups, and its linked id pairs, packed."""
    names = [c.split()[0] for c in LINKED.split(", ")]

    def run(batches):
        sides = Sides.shared(vocabulary, model)
        wa, wb = len(sides.a_bytes), len(sides.b_bytes)
        # an id is followed by a comma, or by what closes its side of the group
        written = [f"{i}{close}" for n, closes in ((wa, ",|"), (wb, ",;")) for close in closes for i in range(n)]
        for batch in small_batches(batches, 64):
            (a, a_off), (b, b_off), (a_many, g_off), (b_many, _) = (_flat(batch.column(i)) for i in range(2, 6))
            groups = np.arange(len(a_many))
            in_a, in_b = np.repeat(groups, a_many), np.repeat(groups, b_many)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(g_off))
            n_links = np.concatenate([[0], np.cumsum(a_many * b_many)])[g_off]
            last_a, last_b = np.append(in_a[1:] != in_a[:-1], True), np.append(in_b[1:] != in_b[:-1], True)
            entry = np.concatenate([a + wa * last_a[: len(a)], 2 * wa + b + wb * last_b[: len(b)]])
            order = np.argsort(np.concatenate([2 * in_a, 2 * in_b + 1]), kind="stable")
            entry, bounds = entry[order].tolist(), a_off + b_off
            texts = ["".join(map(written.__getitem__, entry[lo:hi]))[:-1] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            of, pair, links = _pairs(doc, in_a, a, in_b, b, (wa, wb))
            cut = np.searchsorted(of, np.arange(batch.num_rows + 1))
            packed = [(_pack(np.diff(pair[lo:hi], prepend=0)), _pack(links[lo:hi])) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), *(pa.array(np.diff(x)) for x in (a_off, b_off, g_off, n_links)),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]),
                    *(pa.array(c, pa.binary()) for c in zip(*packed, strict=True)),
                ],
                names=names,
            )

    return aligned.mapInArrow(run, LINKED)


def _unpacked(batch: pa.RecordBatch, pairs: str = "pairs", links: str = "links"):
    """Rows' places in the batch, pairs and links of packed documents."""
    own = [np.cumsum(_unpack(v.as_py())) for v in batch.column(pairs)]
    of = np.repeat(np.arange(batch.num_rows), [len(p) for p in own])
    joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return of, joined(own), joined([_unpack(v.as_py()) for v in batch.column(links)])


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n): the number of documents that hold a pair linked; summed in tasks before the shuffle."""

    def run(batches):
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        kept, held = [], 0
        for batch in small_batches(batches, 256):
            _, pair, _ = _unpacked(batch)
            kept.append(_summed(pair, np.ones(len(pair), np.int64)))
            held += len(kept[-1][0])
            if held > COUNTED_AT_ONCE:
                key, n = _summed(*(np.concatenate(c) for c in zip((key, n), *kept, strict=True)))
                kept, held = [], 0
                if len(key) > COUNTED_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])
                    key, n = key[:0], n[:0]
        key, n = _summed(*(np.concatenate(c) for c in zip((key, n), *kept, strict=True)))
        for at in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], names=["pair", "n"])

    return linked.select("pairs", "links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _common(counted: DataFrame, bound: int) -> int:
    """The smallest power of two such that at most `bound` pairs are counted that often."""
    level = F.floor(F.log2("n")).cast("int")
    rows = sorted(counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("pairs")).collect(), reverse=True)
    least, total = 62, 0
    for r in rows:
        total += r["pairs"]
        if total > bound:
            return least
        least = r["level"]
    return 0


def link_figures(linked: DataFrame, width_b: int, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) of each document: its links counted over the corpus, and those that are their A id's commonest."""
    spark = linked.sparkSession
    counts = materialise(pair_counts(linked), "pair-counts").withColumn("a", F.expr(f"pair div {width_b}"))
    # one row for each id of a vocabulary
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    counted = counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    least = _common(counts, broadcast_pairs)
    common = counted.filter(F.col("n") >= (1 << least)).sort("pair").toArrow()
    held = spark.sparkContext.broadcast([common.column(c).to_numpy() for c in ("pair", "n", "best")])

    def known(batch):
        of, pair, links = _unpacked(batch)
        key, n, best = held.value
        at = np.searchsorted(key, pair)
        found = np.zeros(len(pair), bool) if not len(key) else key[np.minimum(at, len(key) - 1)] == pair
        return of, pair, links, found, n[at[found]], best[at[found]]

    def totals(batches):
        for batch in small_batches(batches, 256):
            of, _, links, found, n, best = known(batch)
            of, links, sums = of[found], links[found], np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], of[best], links[best])
            np.add.at(sums[1], of, links * n)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(s) for s in sums)], names=["row", "n_best", "count_sum"])

    def rest(batches):
        for batch in small_batches(batches, 256):
            of, pair, links, found, _, _ = known(batch)
            row = batch.column("row").take(pa.array(of[~found]))
            yield pa.RecordBatch.from_arrays([row, pa.array(pair[~found]), pa.array(links[~found])], names=["row", "pair", "links"])

    chosen = linked.select("row", "pairs", "links")
    figures = chosen.mapInArrow(totals, "row long, n_best long, count_sum long")
    if least == 0:
        return figures
    rare = counted.filter(F.col("n") < (1 << least))
    more = chosen.mapInArrow(rest, "row long, pair long, links long").join(rare, "pair").select(
        "row", F.when(F.col("best"), F.col("links")).otherwise(0).alias("n_best"), (F.col("links") * F.col("n")).alias("count_sum")
    )
    return figures.union(more).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def link_digest(docs: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, model: str = MODEL) -> DataFrame:
    """Per document: counts of tokens, groups and links, the hash of its groups, and its links' corpus figures.

    Documents without tokens (see `align`) have zeros and an empty hash. Repeated rows count as documents each.
    An empty table gives no rows.
    """
    with arrow_batches(docs.sparkSession, TEXTS_AT_ONCE):
        aligned = align(docs, ident, text, vocabulary, model)
        linked = materialise(digests(aligned, vocabulary, model), "linked")
        figures = materialise(link_figures(linked, len(Sides.shared(vocabulary, model).b_bytes)), "link-figures")
    return linked.join(figures, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op13_interval_coalescing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_digest(table(spark, sf_dir, "documents"))
