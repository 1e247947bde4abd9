"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted in numpy on a bounded sample; every vector is then indexed by descending it to a
leaf. A query walks the tree best bin first: a priority queue holds nodes by the distance of their
centres, leaves come off it nearest first. How many leaves a query visits is calibrated: for a
bounded set of queries the true neighbours are found by brute force in blocks, and visits widen until
enough of those neighbours lie in the visited leaves. Queries and vectors then meet by leaf; a leaf
with many vectors or visits is split into cells, and distances are taken in double precision on the
original vectors.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsight.llm.catalog import query, table
from poolsight.llm.storage import materialise

#: Vectors the tree is fitted on, at most; branches of a node; vectors wanted in a leaf; fitted vectors in a leaf, at least.
FIT_VECTORS, BRANCHES, LEAF_VECTORS, LEAF_FITTED = 32_768, 8, 160, 8
#: Queries that calibrate the visits, at most, and the recall they have to reach.
CALIBRATE, RECALL = 128, 0.97
#: Vectors and queries that meet in one cell, at most.
CELL_VECTORS, CELL_QUERIES, BLOCK = 20_000, 4_000, 2_048


@dataclass
class Tree:
    """Nodes by number: a centre each, children of inner nodes, and the leaves' numbers in order."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def add(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def pack(self) -> "Tree":
        self.around = [np.array([self.centres[c] for c in kids]) if kids else None for kids in self.children]
        return self


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :], 0)


def lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """k-means from spread-out starts; empty means disappear."""
    centres = x[rng.integers(len(x))][None]
    near = squared(x, centres)[:, 0]
    while len(centres) < k and near.max() > 1e-12:
        centres = np.vstack([centres, x[rng.choice(len(x), p=near / near.sum())]])
        near = np.minimum(near, squared(x, centres[-1:])[:, 0])
    for _ in range(rounds):
        owner = squared(x, centres).argmin(1)
        used, owner = np.unique(owner, return_inverse=True)
        centres = np.stack([np.bincount(owner, weights=x[:, j], minlength=len(used)) for j in range(x.shape[1])], 1)
        centres /= np.bincount(owner, minlength=len(used))[:, None]
    return centres, squared(x, centres).argmin(1)


def grow(sample: np.ndarray, leaves: int, branches: int = BRANCHES, seed: int = 11) -> Tree:
    """Split the most populous leaf until there are enough; equal vectors are not split."""
    tree, rng = Tree(), np.random.default_rng(seed)
    members = {tree.add(sample.mean(0) if len(sample) else np.zeros(1)): np.arange(len(sample))}
    queue, count = [(-len(sample), 0)], 1
    while queue and count < leaves:
        size, node = heapq.heappop(queue)
        if -size < 2 * LEAF_FITTED:
            break
        x = sample[members[node]]
        centres, owner = lloyd(x, min(branches, -size // LEAF_FITTED, leaves - count + 1), rng)
        if len(centres) < 2:
            continue
        own = members.pop(node)
        for i, centre in enumerate(centres):
            child = tree.add(centre)
            tree.children[node].append(child)
            members[child] = own[owner == i]
            heapq.heappush(queue, (-len(members[child]), child))
        count += len(centres) - 1
    for node, kids in enumerate(tree.children):
        if not kids:
            tree.leaf[node] = tree.leaves
            tree.leaves += 1
    return tree.pack()


def assign(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf that each vector reaches by the nearest centre at every node."""
    out, todo = np.zeros(len(x), dtype=np.int32), [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if tree.around[node] is None:
            out[rows] = tree.leaf[node]
            continue
        best = squared(x[rows], tree.around[node]).argmin(1)
        todo += [(kid, rows[best == i]) for i, kid in enumerate(tree.children[node]) if (best == i).any()]
    return out


def best_bins(tree: Tree, q: np.ndarray):
    """Leaves in the order in which the priority queue gives them up."""
    queue = [(0.0, 0)]
    while queue:
        _, node = heapq.heappop(queue)
        if tree.around[node] is None:
            yield tree.leaf[node]
            continue
        far = ((tree.around[node] - q) ** 2).sum(1)
        for kid, d in zip(tree.children[node], far.tolist(), strict=True):
            heapq.heappush(queue, (d, kid))


class Nearest:
    """The k nearest (distance, id) so far of each of some queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, vectors, k
        self.norms = (vectors * vectors).sum(1)
        self.scores = np.full((len(ids), k), np.inf)
        self.found = np.zeros((len(ids), k), dtype=np.int64)

    def offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        rough = self.norms[:, None] - 2 * self.q @ x.T + (x * x).sum(1)[None, :]
        rough[self.ids[:, None] == ids[None, :]] = np.inf
        # the product only sifts: whatever rounding could hide is measured exactly
        slack = 1e-9 * (1 + self.norms + (x * x).sum(1).max(initial=0))
        bar = np.minimum(self.scores[:, -1] ** 2, np.inf)
        if rough.shape[1] > self.k:
            bar = np.minimum(bar, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1])
        close = rough <= (bar + slack)[:, None]
        close &= np.isfinite(rough)
        for i in np.flatnonzero(close.any(axis=1)):
            at = np.flatnonzero(close[i])
            d = np.sqrt(((x[at] - self.q[i]) ** 2).sum(axis=1))
            d, n = np.append(self.scores[i], d), np.append(self.found[i], ids[at])
            keep = np.lexsort((n, d))[: self.k]
            self.scores[i], self.found[i] = d[keep], n[keep]

    def rows(self) -> pa.RecordBatch:
        real = np.isfinite(self.scores)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids), pa.array([list(r[m]) for r, m in zip(self.scores, real, strict=True)], pa.list_(pa.float64())), pa.array([list(r[m]) for r, m in zip(self.found, real, strict=True)], pa.list_(pa.int64()))],
            schema=FOUND,
        )


FOUND = pa.schema([("query_id", pa.int64()), ("scores", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))])
FOUND_DDL = "query_id long, scores array<double>, ids array<long>"


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of one length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's answers: at most k from each cell it visited."""
    pairs = F.arrays_zip(F.col("scores").alias("score"), F.col("ids").alias("vec_id"))
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score")
    )


def usable(embedding: Column, dims: int | None) -> Column:
    value = embedding.cast("array<double>")
    good = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    there = embedding.isNotNull() & good & F.exists(value, lambda x: x != 0)
    return F.coalesce(there if dims is None else there & (F.size(embedding) == dims), F.lit(False))


def exact(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Brute force of a bounded block of queries against all vectors, block by block."""
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches):
        nearest = Nearest(*shared.value, k)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                nearest.offer(part.column(0).to_numpy(), matrix(part.column(1)))
        yield nearest.rows()

    return _merge(vectors.select("vec_id", "embedding").mapInArrow(run, FOUND_DDL), k)


def tree_search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    ident: str = "vec_id",
    embedding: str = "embedding",
    recall: float = RECALL,
    leaf_vectors: int = LEAF_VECTORS,
) -> DataFrame:
    """The k nearest found of every query row: query_id, rank from 1, vec_id, score.

    Nearness is the Euclidean distance, ties go to the lesser id, a query's own id is no candidate;
    with fewer than k candidates all are given. Null, zero and non-finite vectors, vectors with null
    components, rows without an id and vectors of another than the most frequent length take no part.
    Repeated rows are candidates each; a query id with several vectors asks with one of them. An
    empty table, or one without queries, gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.withColumn("__q", F.coalesce(is_query, F.lit(False))).select(
        F.col(ident).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), "__q"
    )
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"), None))
    lengths = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__q").cast("int")).alias("q"))
    lengths = lengths.orderBy(F.desc("n"), "d").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not lengths or not lengths[0]["q"]:
        return spark.createDataFrame([], empty)
    dims, total, asked = lengths[0]
    rows = rows.filter(F.size("embedding") == dims)

    def drawn(df: DataFrame, share: float, most: int) -> list:
        """About a share of the rows by a hash of the id, cut to exactly the least hashes before any row leaves Spark."""
        unit = F.shiftrightunsigned(F.xxhash64("vec_id"), 11).cast("double") / F.lit(float(1 << 53))
        found = df.select("vec_id", "embedding", unit.alias("u")).filter(F.col("u") < share)
        return found.orderBy("u", "vec_id", "embedding").limit(most).collect()

    sample = drawn(rows, 1.2 * FIT_VECTORS / total, FIT_VECTORS)
    tree = grow(np.array([r["embedding"] for r in sample]), max(1, min(total // leaf_vectors, len(sample) // LEAF_FITTED)))
    shared = spark.sparkContext.broadcast(tree)
    indexed_schema = pa.schema([("leaf", pa.int32()), ("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("__q", pa.bool_())])

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = np.concatenate([assign(shared.value, matrix(batch.column(1).slice(i, BLOCK))) for i in range(0, batch.num_rows, BLOCK)])
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *[batch.column(i).cast(indexed_schema.field(i + 1).type) for i in range(3)]], schema=indexed_schema)

    indexed = materialise(rows.mapInArrow(index, "leaf int, vec_id long, embedding array<double>, __q boolean"), "tree-index")
    counts = np.zeros(tree.leaves, dtype=np.int64)
    for r in indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["leaf"]] = r["n"]
    queries = indexed.filter("__q").groupBy("vec_id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"))
    visits = calibrate(tree, indexed, drawn(queries, 1.5 * CALIBRATE / asked + 8 / asked, CALIBRATE), k, recall)

    visit_schema = pa.schema([("leaf", pa.int32()), ("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64()))])

    def walk(batches):
        for batch in batches:
            ids, q = batch.column(0).to_pylist(), matrix(batch.column(1)) if batch.num_rows else ()
            leaves, owner = [], []
            for i, vector in enumerate(q):
                near = 0
                for n, leaf in enumerate(best_bins(shared.value, vector)):
                    if n >= visits and near > k:
                        break
                    leaves.append(leaf)
                    owner.append(i)
                    near += counts[leaf]
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaves, pa.int32()), pa.array([ids[i] for i in owner], pa.int64()), batch.column(1).take(pa.array(owner, pa.int64())).cast(visit_schema.field(2).type)],
                schema=visit_schema,
            )

    visiting = queries.select("vec_id", "embedding").mapInArrow(walk, "leaf int, vec_id long, embedding array<double>")
    visiting = materialise(visiting, "tree-visits")
    asks = np.zeros(tree.leaves, dtype=np.int64)
    for r in visiting.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        asks[r["leaf"]] = r["n"]
    splits = F.array(*[F.lit(int(max(1, -(-n // CELL_VECTORS)))) for n in counts])[F.col("leaf")]
    teams = F.array(*[F.lit(int(max(1, -(-n // CELL_QUERIES)))) for n in asks])[F.col("leaf")]
    wanted = F.array(*[F.lit(bool(n)) for n in asks])[F.col("leaf")]
    own = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("__of")).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    given = (
        indexed.filter(wanted).withColumn("__of", splits).withColumn("part", own).withColumn("team", everywhere(teams))
        .select("leaf", "part", "team", F.lit(1).alias("kind"), "vec_id", "embedding")
    )
    asking = (
        visiting.withColumn("__of", teams).withColumn("team", own).withColumn("part", everywhere(splits))
        .select("leaf", "part", "team", F.lit(0).alias("kind"), "vec_id", "embedding")
    )

    def meet(batches):
        here, ids, held, nearest = None, [], [], None
        for batch in batches:
            cell = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]) if batch.num_rows else np.zeros((4, 0), int)
            cuts = np.flatnonzero((np.diff(cell, axis=1) != 0).any(axis=0)) + 1
            for b, e in zip(np.append(0, cuts), np.append(cuts, cell.shape[1]), strict=True):
                if b == e:
                    continue
                part, now = batch.slice(int(b), int(e - b)), tuple(cell[:3, b])
                if now != here:
                    if nearest is not None:
                        yield nearest.rows()
                    here, ids, held, nearest = now, [], [], None
                if cell[3, b] == 0:
                    ids.append(part.column(4).to_numpy())
                    held.append(matrix(part.column(5)))
                    continue
                if not held:
                    continue
                nearest = nearest or Nearest(np.concatenate(ids), np.concatenate(held), k)
                for at in range(0, part.num_rows, BLOCK):
                    block = part.slice(at, BLOCK)
                    nearest.offer(block.column(4).to_numpy(), matrix(block.column(5)))
        if nearest is not None:
            yield nearest.rows()

    cells = given.unionByName(asking).repartition("leaf", "part", "team").sortWithinPartitions("leaf", "part", "team", "kind")
    return _merge(cells.mapInArrow(meet, FOUND_DDL), k)


def calibrate(tree: Tree, indexed: DataFrame, asked: list, k: int, recall: float) -> int:
    """The fewest leaves to visit so that the asked queries' true neighbours are found at the wanted rate."""
    if not asked:
        return 1
    ids, q = np.array([r["vec_id"] for r in asked]), np.array([r["embedding"] for r in asked])
    truth = exact(indexed, ids, q, k)
    leaf_of = indexed.select("vec_id", "leaf").join(F.broadcast(truth.select("vec_id").distinct()), "vec_id", "left_semi")
    leaves = {r["vec_id"]: r["leaf"] for r in leaf_of.collect()}
    place = {}
    for i, vector in zip(ids.tolist(), q, strict=True):
        place[i] = {leaf: n for n, leaf in enumerate(best_bins(tree, vector))}
    needed = sorted(place[r["query_id"]][leaves[r["vec_id"]]] + 1 for r in truth.collect())
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


@query("op7_best_bin_first")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
