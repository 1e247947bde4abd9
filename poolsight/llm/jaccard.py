"""Exact n-gram Jaccard self-join by set-relation skipping.

1. Every text becomes a sorted set of 64-bit shingle hashes. Equal sets collapse into classes.
2. A histogram of a fixed number of buckets over all shingles gives an order from rare to common.
   Any order gives the same links; a good one keeps index lists short.
3. A class enters the lists of its prefix shingles with its position there. Prefixes are a little
   longer than they need be, so that linked sets meet in COMMON lists and not just in one. A list
   falls into blocks of one set size, sorted by position: for two blocks the length and position
   bounds leave only the head of each, the rest is skipped whole. A 128-bit parity of the sets bounds
   their difference. A list answers with one row for each of its sets, holding the partners left.
4. Near-copies mostly share one of four least hashes. A pair goes to the group of the first that
   agrees, or else to the group of its own lesser set. In a group the first set is kept whole and
   each other as its difference from it; a set's overlaps with all its partners follow from the
   differences. A group answers with one row a set: its links counted, and a set they tie it to.
5. Components come from these ties by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsight.llm.catalog import query, table
from poolsight.llm.components import components
from poolsight.llm.histogram import histogram
from poolsight.llm.storage import arrow_batches, materialise
from poolsight.llm.text import Words, mix, small_batches, word_hashes

WORDS = Words(b"\x20\x09\x0a\x0b\x0c\x0d", lower=True)
BUCKETS = 1 << 22
#: Bits of the filter that lets a scan of the texts pass over sets without partners.
FILTER = 1 << 23
#: Lists in which linked sets have to meet, unless they overlap in fewer shingles.
COMMON = 4
#: Rows of group members up to which they are broadcast to the sets (40 bytes each), and texts that cross to Python together.
BROADCAST_MEMBERS, TEXTS_AT_ONCE = 500_000, 1000
#: Classes a task remembers to leave out copies; forgetting some only repeats rows.
REMEMBERED = 500_000
#: Cells of a block pair compared at once, and pairs that a part of a group counts, about.
CELLS, GROUP_PAIRS = 1 << 20, 2_000_000
_U = np.uint64
_ORDER = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(1, 9)], dtype=np.uint64)
NONE = np.zeros(0, dtype=np.uint64)


def shingle_sets(column: pa.Array, n: int, words: Words = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's runs of n words; a shorter text is one run."""
    for _, rows, h, bounds in word_hashes(column, words):
        runs = NONE
        if len(h) >= n:
            runs = mix(sum(h[i : len(h) - n + 1 + i] * _ORDER[i] for i in range(n)))
        for a, b in zip(bounds[:rows].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(runs[a : b - n + 1])
            elif b > a:
                yield mix((h[a:b] * _ORDER[: b - a]).sum(keepdims=True) + _U(b - a))
            else:
                yield NONE


def class_id(s: np.ndarray) -> int:
    return int(mix(mix(s).sum(keepdims=True) + _U(len(s))).view(np.int64)[0])


def least_hashes(s: np.ndarray) -> np.ndarray:
    """Four least hashes of 32 bits, two to a number."""
    spread = [mix(s ^ _U(seed)) for seed in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)]
    halves = [h & _U(0xFFFFFFFF) for h in spread], [h >> _U(32) for h in spread]
    return np.array([int(low.min()) | int(high.min()) << 32 for low, high in zip(*halves, strict=True)], dtype=np.uint64).view(np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """128 bits, each the parity of the elements it stands for: two differ in no more bits than the sets in elements."""
    odd = np.bincount((mix(s ^ _U(0x14057B7EF767814F)) >> _U(57)).astype(np.int64), minlength=128) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def needed(a, b, percent: int):
    """The overlap that sets of sizes a and b need to be linked."""
    return -(-percent * (a + b) // (100 + percent))


def order_of(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return s[np.argsort(rank[(s & _U(len(rank) - 1)).astype(np.int64)], kind="stable")]


class Seen:
    """A bounded memory of what passed."""

    def __init__(self) -> None:
        self.keys: set = set()

    def first(self, key) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= REMEMBERED:
            self.keys.clear()
        self.keys.add(key)
        return True


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


DOCS = pa.schema([(c, pa.int64()) for c in ("doc_id", "text_hash", "n", "h")])


def document_classes(docs: DataFrame, n: int, ident: str, text: str) -> DataFrame:
    """(doc_id, text_hash, n, h): set size and class id; h is null for an empty set."""

    def run(batches):
        for batch in small_batches(batches):
            ids, sizes, classes = batch.column(0).to_pylist(), [], []
            for s in shingle_sets(batch.column(2), n):
                sizes.append(len(s))
                classes.append(class_id(s) if len(s) else None)
            yield _batch(DOCS, [ids, batch.column(1), sizes, classes])

    chosen = docs.select(F.col(ident).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, ", ".join(f"{f.name} long" for f in DOCS))


def shingle_rank(docs: DataFrame, n: int, text: str, buckets: int = BUCKETS) -> np.ndarray:
    """A byte for each bucket of shingles: larger where more shingles of the corpus fall."""

    def extract(batch):
        for part in small_batches([batch]):
            for s in shingle_sets(part.column(0), n):
                if len(s):
                    yield (s & _U(buckets - 1)).astype(np.int64)

    def grouped(batch):
        held, size = [], 0
        for numbers in extract(batch):
            held.append(numbers)
            size += len(numbers)
            if size > CELLS:
                yield np.concatenate(held)
                held, size = [], 0
        if held:
            yield np.concatenate(held)

    counts = histogram(docs.select(F.col(text).alias("text")), buckets, grouped)
    return np.minimum(255, np.round(8 * np.log2(counts + 1.0))).astype(np.uint8)


POSTINGS = pa.schema([(c, pa.int64()) for c in ("token", "n", "pos", "h", "m0", "m1", "b0", "b1")])


def postings(docs: DataFrame, n: int, percent: int, text: str, rank: np.ndarray) -> DataFrame:
    """(token, n, pos, h, least hashes, parity) for each prefix shingle of each class; a task gives a class once."""
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches):
        seen, ranks = Seen(), shared.value
        for batch in small_batches(batches, 256):
            out: list[list] = [[] for _ in POSTINGS]
            for s in shingle_sets(batch.column(0), n):
                size = len(s)
                if not size or not seen.first(h := class_id(s)):
                    continue
                length = min(size, size - needed_alone(size, percent) + COMMON)
                out[0].append(order_of(s, ranks)[:length].view(np.int64))
                out[2].append(np.arange(length))
                for at, value in ((1, size), (3, h), *zip((4, 5), least_hashes(s), strict=True), *zip((6, 7), parity(s), strict=True)):
                    out[at].append(np.full(length, value, dtype=np.int64))
            if out[0]:
                yield _batch(POSTINGS, [np.concatenate(c) for c in out])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, ", ".join(f"{f.name} long" for f in POSTINGS))


def needed_alone(size: int, percent: int) -> int:
    """The least overlap any partner of a set of this size must have with it."""
    return -(-percent * size // 100)


ANSWERS = pa.schema([(c, pa.int64()) for c in ("h", "n", "m0", "m1")] + [(c, pa.list_(pa.int64())) for c in ("hs", "ns", "ways")])
ANSWERS_DDL = "h long, n long, m0 long, m1 long, hs array<long>, ns array<long>, ways array<long>"
#: A pair's way is the first of the least hashes that agrees, or FAR.
WAYS, FAR = 4, -1


def fragments(m0: np.ndarray, m1: np.ndarray) -> np.ndarray:
    """The four least hashes, one row each."""
    m0, m1 = np.asarray(m0).view(np.uint64), np.asarray(m1).view(np.uint64)
    return np.stack([part for m in (m0, m1) for part in (m & _U(0xFFFFFFFF), m >> _U(32))]).astype(np.int64)


def list_answers(run: np.ndarray, percent: int, fresh: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(entry, partner entries) of one index list: columns of POSTINGS, sorted by (n, pos).

    Pairs both of whose entries come before `fresh` are left out.
    """
    n, pos, h = run[1], run[2], run[3]
    sizes, starts = np.unique(n, return_index=True)
    ends = np.append(starts[1:], len(n))
    low, high = run[6].view(np.uint64), run[7].view(np.uint64)
    found: dict[int, list[np.ndarray]] = {}
    for i, a in enumerate(sizes.tolist()):
        for j in range(i, len(sizes)):
            b = int(sizes[j])
            if 100 * a < percent * b:
                break
            if ends[j] <= fresh:
                continue
            alpha = needed(a, b, percent)
            # the heads of both blocks: past them too few shingles are left for one of the first COMMON shared
            spare = COMMON - 1 - alpha
            x1 = starts[i] + int(np.searchsorted(pos[starts[i] : ends[i]], a + spare, side="right"))
            y1 = starts[j] + int(np.searchsorted(pos[starts[j] : ends[j]], b + spare, side="right"))
            ys = np.arange(starts[j], y1)
            if not len(ys):
                continue
            step = max(1, CELLS // len(ys))
            for x0 in range(int(starts[i]), x1, step):
                xs = np.arange(x0, min(x0 + step, x1))
                differ = np.bitwise_count(low[xs][:, None] ^ low[ys][None, :]).astype(np.int64)
                differ += np.bitwise_count(high[xs][:, None] ^ high[ys][None, :])
                keep = (differ <= a + b - 2 * alpha) & (h[xs][:, None] != h[ys][None, :])
                if i == j:
                    keep &= h[xs][:, None] < h[ys][None, :]
                if fresh:
                    keep &= (xs[:, None] >= fresh) | (ys[None, :] >= fresh)
                for r in np.flatnonzero(keep.any(axis=1)):
                    found.setdefault(int(xs[r]), []).append(ys[keep[r]])
    for x, parts in found.items():
        yield x, np.concatenate(parts)


def candidates(lists: DataFrame, percent: int) -> DataFrame:
    """Answers (h, n, m, partners) of all index lists; a pair stands under its end of the lesser (n, h)."""

    def run(batches):
        # rows come sorted by (token, n, pos, h); the last list of a batch may go on in the next
        held = np.zeros((len(POSTINGS), 0), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if held.shape[1] and held[0, 0] != rows[0, 0]:
                held = held[:, :0]  # that list is over, and answered
            fresh = held.shape[1]
            rows = np.concatenate([held, rows], axis=1)
            rows = rows[:, np.append(True, (np.diff(rows[:4], axis=1) != 0).any(axis=0))]  # copies of a class
            cuts = np.flatnonzero(np.diff(rows[0])) + 1
            begins, ends = np.append(0, cuts), np.append(cuts, rows.shape[1])
            out: list[list] = [[] for _ in ANSWERS]
            for b, e in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist(), strict=True):
                part = rows[:, b:e]
                least = None
                for x, ys in list_answers(part, percent, 0 if b else fresh):
                    least = fragments(part[4], part[5]) if least is None else least
                    agree = least[:, ys] == least[:, x, None]
                    way = np.where(agree.any(axis=0), agree.argmax(axis=0), FAR)
                    row = (part[3, x], part[1, x], part[4, x], part[5, x], part[3, ys], part[1, ys], way)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            if out[0]:
                yield _batch(ANSWERS, out)
            last = rows[:, begins[-1] :]
            held = last[:, 100 * last[1] >= percent * last[1, -1]]

    ordered = lists.repartition("token").sortWithinPartitions("token", "n", "pos", "h")
    return ordered.mapInArrow(run, ANSWERS_DDL)


def _union(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Partners once each (sizes, ids, ways, lists in which they were met)."""
    hs, ns, ways, met = (np.concatenate(c) for c in zip(*rows, strict=True))
    _, at, where = np.unique(np.stack([hs, ns]), axis=1, return_index=True, return_inverse=True)
    return hs[at], ns[at], ways[at], np.bincount(where.ravel(), weights=met, minlength=len(at)).astype(np.int64)


def merged(answers: DataFrame, percent: int) -> DataFrame:
    """One row a set: the partners it met in as many lists as linked sets have to."""

    def run(batches):
        key, rows = None, []

        def done():
            hs, ns, ways, met = _union(rows)
            enough = met >= np.minimum(COMMON, needed(key[1], ns, percent))
            if enough.any():
                yield _batch(ANSWERS, [[v] for v in (*key, hs[enough], ns[enough], ways[enough])])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:4]]
            for i, now in enumerate(zip(*columns, strict=True)):
                if now != key:
                    if key is not None:
                        yield from done()
                    key, rows = now, []
                hs, ns, ways = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (4, 5, 6))
                rows.append((hs, ns, ways, np.ones(len(hs))))
                if len(rows) > 256:
                    rows = [_union(rows)]
        if key is not None:
            yield from done()

    return answers.repartition("h", "n").sortWithinPartitions("h", "n").mapInArrow(run, ANSWERS_DDL)


ROUTED = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("hs", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64()))])
ROUTED_DDL = "key long, h long, n long, hs array<long>, ns array<long>"


def routed(answers: DataFrame) -> DataFrame:
    """A set's partners by the group they share with it; those that share none come to the set's own."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            h, n, m0, m1 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            least, out = fragments(m0, m1), [[] for _ in ROUTED]
            for i in range(batch.num_rows):
                hs, ns, ways = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (4, 5, 6))
                for way in np.unique(ways).tolist():
                    key = WAYS << 32 | int(h[i]) & 0xFFFFFFFF if way == FAR else way << 32 | int(least[way, i])
                    for column, value in zip(out, (key, h[i], n[i], hs[ways == way], ns[ways == way]), strict=True):
                        column.append(value)
            yield _batch(ROUTED, out)

    return answers.mapInArrow(run, ROUTED_DDL)


MEMBERS = pa.schema([(c, pa.int64()) for c in ("key", "h", "n")])


def members(routes: DataFrame) -> DataFrame:
    """(key, h, n) of every set that a group needs; repeats are left out batch by batch, then wholly."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            key, h, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            lengths = np.diff(batch.column(3).offsets.to_numpy())
            theirs = np.stack([np.repeat(key, lengths), *(batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (3, 4))])
            yield _batch(MEMBERS, list(np.unique(np.concatenate([np.stack([key, h, n]), theirs], axis=1), axis=1)))

    return routes.mapInArrow(run, "key long, h long, n long").distinct()


SETS_DDL = "h long, n long, shingles array<long>"
SETS = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def sets_of(docs: DataFrame, active: DataFrame, n: int, text: str) -> DataFrame:
    """(h, n, shingles) of the classes in `active`, and of a few more; a task gives a class once."""

    def buckets(batch):
        yield batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64).astype(np.uint64) % _U(FILTER)

    marked = histogram(active.select("h"), FILTER, lambda b: (x.astype(np.int64) for x in buckets(b))) > 0
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marked))

    def run(batches):
        seen, bits = Seen(), shared.value
        for batch in small_batches(batches, 256):
            out: list[list] = [[] for _ in SETS]
            for s in shingle_sets(batch.column(0), n):
                if not len(s):
                    continue
                h = class_id(s)
                at = (h & ((1 << 64) - 1)) % FILTER
                if bits[at >> 3] >> (7 - (at & 7)) & 1 and seen.first(h):
                    for column, value in zip(out, (h, len(s), s.view(np.int64)), strict=True):
                        column.append(value)
            if out[0]:
                yield _batch(SETS, out)

    return docs.select(F.col(text).alias("text")).mapInArrow(run, SETS_DDL)


class Group:
    """Near-copies: the first set whole, each other as its difference from it.

    What sets lack lies inside the first set and what they add outside, so the common part of two
    differences is what both lack and what both add:
    |x & y| = |base| - |lacked by x| - |lacked by y| + |difference of x & difference of y|.
    """

    def __init__(self, base: np.ndarray) -> None:
        self.base, self.at = base, {}
        self.lacks, self.differs, self.copies = [], [], []

    def add(self, key, s: np.ndarray, copies: int) -> None:
        if key not in self.at:
            self.at[key] = len(self.lacks)
            lacks = np.setdiff1d(self.base, s, assume_unique=True)
            self.lacks.append(len(lacks))
            self.differs.append(np.concatenate([lacks, np.setdiff1d(s, self.base, assume_unique=True)]))
            self.copies.append(copies)

    def freeze(self) -> None:
        self.keys, self.parent = list(self.at), list(range(len(self.at)))
        self.lacks, self.copies = np.array(self.lacks), np.array(self.copies, dtype=np.int64)
        lengths = np.array([len(d) for d in self.differs])
        known, self.ids = np.unique(np.concatenate(self.differs), return_inverse=True)
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])
        self.mark, self.differs = np.zeros(len(known), dtype=bool), None
        self.links = np.zeros(len(lengths), dtype=np.int64)

    def overlaps(self, x: int, ys: np.ndarray) -> np.ndarray:
        own = self.ids[self.bounds[x] : self.bounds[x + 1]]
        self.mark[own] = True
        lengths = self.bounds[ys + 1] - self.bounds[ys]
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(self.bounds[ys], lengths)
        common = np.bincount(np.repeat(np.arange(len(ys)), lengths), weights=self.mark[self.ids[place]], minlength=len(ys))
        self.mark[own] = False
        return len(self.base) - self.lacks[x] - self.lacks[ys] + common.astype(np.int64)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def ask(self, key, theirs: list, percent: int) -> None:
        """Count the links of one set with its partners, and tie them together."""
        x, n = self.at[key], key[1]
        ys, sizes = np.array([self.at[y] for y in theirs]), np.array([y[1] for y in theirs])
        linked = ys[self.overlaps(x, ys) >= needed(n, sizes, percent)]
        self.links[x] += self.copies[linked].sum()
        np.add.at(self.links, linked, self.copies[x])
        for y in linked.tolist():
            self.parent[self.root(y)] = self.root(x)

    def rows(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.links)
        return _batch(TIES, [[self.keys[i][0] for i in some], [self.keys[i][1] for i in some], self.links[some], [self.keys[self.root(i)][0] for i in some]])


TIES = pa.schema([(c, pa.int64()) for c in ("h", "n", "outside", "tie")])
TIES_DDL = "h long, n long, outside long, tie long"


def group_ties(routes: DataFrame, sets: DataFrame, percent: int, pairs: int = GROUP_PAIRS) -> DataFrame:
    """(h, n, outside, tie): rows linked with each set inside its groups, and a set of its component.

    A group of very many pairs is asked in several parts, each with all the group's sets.
    """
    loads = routes.groupBy("key").agg(F.sum(F.size("hs")).alias("load")).filter(F.col("load") > pairs)
    loads = loads.select("key", F.ceil(F.col("load") / pairs).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    none = F.lit(None).cast("array<long>")
    asked = routes.join(loads, "key", "left").select(
        "key", F.pmod(F.xxhash64("h", "n"), parts).cast("int").alias("part"), F.lit(1).alias("kind"), "h", "n",
        F.lit(0).cast("long").alias("copies"), none.alias("shingles"), "hs", "ns",
    )
    given = sets.join(loads, "key", "left").select(
        "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("kind"), "h", "n",
        "copies", "shingles", none.alias("hs"), none.alias("ns"),
    )

    def run(batches):
        here, group, open_ = None, None, True
        for batch in batches:
            keys, parts_, kinds, hs, ns, copies = (batch.column(k).to_pylist() for k in range(6))
            for i, now in enumerate(zip(keys, parts_, strict=True)):
                if now != here:
                    if group is not None and not open_:
                        yield group.rows()
                    here, group, open_ = now, None, True
                if kinds[i] == 0:
                    s = batch.column(6)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    group = group or Group(s)
                    group.add((hs[i], ns[i]), s, copies[i])
                    continue
                if open_:
                    group.freeze()
                    open_ = False
                theirs = list(zip(batch.column(7)[i].values.to_pylist(), batch.column(8)[i].values.to_pylist(), strict=True))
                for at in range(0, len(theirs), 4096):
                    group.ask((hs[i], ns[i]), theirs[at : at + 4096], percent)
        if group is not None and not open_:
            yield group.rows()

    both = given.unionByName(asked).repartition("key", "part").sortWithinPartitions("key", "part", "kind", "n", "h")
    return both.mapInArrow(run, TIES_DDL)


def ngram_jaccard_join(
    docs: DataFrame, n: int = 3, percent: int = 90, ident: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row a row of `docs`: doc_id, text_hash, n_shingles, group, component_id, n_links.

    Two rows link when the Jaccard similarity of their sets is at least `percent` per cent; rows of
    equal sets always link. `group` names the rows that links connect (null: alone), component_id is
    the least doc_id among them, n_links the number of rows linked with this one. Null and wordless
    texts have empty sets: they link with nothing. Null ids take no part in minima: a component of
    null ids alone has a null id. Rows of one repeated id are separate rows. An empty table gives no
    rows, other columns are not read. Ids of classes and shingles are 64-bit hashes.
    """
    with arrow_batches(docs.sparkSession, TEXTS_AT_ONCE):
        return _joined(docs, n, percent, ident, text)


def _joined(docs: DataFrame, n: int, percent: int, ident: str, text: str) -> DataFrame:
    rows = materialise(document_classes(docs, n, ident, text), "set-classes")
    full = rows.filter("h is not null")
    classes = full.groupBy("h", "n").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes, "classes")
    rank = shingle_rank(docs, n, text)
    answers = merged(candidates(postings(docs, n, percent, text, rank), percent), percent)
    routes = materialise(routed(answers), "routes")
    needing = members(routes).join(classes.select("h", "n", "copies"), ["h", "n"])
    needing = materialise(needing, "members")
    # a class with copies may come from several tasks; a group takes each set once
    few = needing.count() <= BROADCAST_MEMBERS
    grouped = sets_of(docs, needing, n, text).join(F.broadcast(needing) if few else needing, ["h", "n"])
    ties = materialise(group_ties(routes, grouped, percent), "ties")

    roots = components(ties.select(F.col("h").alias("u"), F.col("tie").alias("v")))
    rooted = classes.join(roots.withColumnRenamed("u", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = ties.groupBy("h", "n").agg(F.sum("outside").alias("outside"))
    verdict = (
        rooted.join(least, "root")
        .join(linked, ["h", "n"], "left")
        .select("h", "n", F.col("root").alias("group"), "component_id", (F.coalesce("outside", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    known = full.join(verdict, ["h", "n"]).select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "group", "component_id", "n_links")
    alone = rows.filter("h is null").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("group"),
        F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"),
    )
    return known.union(alone)


def keep_one(docs: DataFrame, joined: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of `joined` the row of the least (id, text hash) stays, ids before null ids.

    Rows without a group stay. Rows repeated in id and text are one document and stay once.
    """
    key = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    first = joined.filter(F.col("group").isNotNull()).groupBy("group").agg(F.min(key).alias("k"))
    stay = first.select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash")).union(
        joined.filter(F.col("group").isNull()).select("doc_id", "text_hash")
    )
    marked = docs.withColumn("__text_hash", F.xxhash64(F.col(text)))
    same = F.col(ident).eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))
    return marked.join(stay, same, "left_semi").dropDuplicates([ident, "__text_hash"]).drop("__text_hash")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * i >= 90 * (zx.n + zy.n - i)),
reach AS (WITH RECURSIVE r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id WHERE r.c < l.y)
  SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id),
deg AS (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT w.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, reach.component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM w LEFT JOIN z USING (doc_id) LEFT JOIN reach USING (doc_id) LEFT JOIN deg USING (doc_id)
"""


@query("op4_set_relation_join", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_jaccard_join(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id", "n_links")
