"""Approximate nearest neighbours by vantage-point trees, one per shard.

Largest inner products become smallest distances: with one more component, ``sqrt(M*M - |x|**2)`` for the shard's largest norm M, all rows of a shard lie on a sphere, and the distance of a query (with 0
there) falls as its inner product rises. A tree node halves its rows by their distance to a vantage point and keeps the ranges of both halves; by the triangle inequality a half is nowhere nearer to a
query than its range is to the query's own distance. It is skipped when that bound exceeds ``factor`` times the distance of the query's k-th best so far: 1 is exact search, less skips more.
Trees are written to the shared folder. A task holds a block of queries and streams the trees past it, so that what one shard found prunes the next ones: first each query
goes down to the leaf it falls into, then all queries walk the tree together, and each leaf is compared once with those that are left. Scores come from the original vectors in double precision, added in order of their components.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlink.llm import common

NEAREST, FACTOR, EVERY = 20, 1.0, 20
#: Bytes of vectors in a shard and in a block of queries, whatever their length.
SHARD_BYTES, LEAST_SHARDS = 32 << 20, 6
BLOCK_BYTES, LEAST_BLOCKS = 16 << 20, 12
LEAF_ROWS, VANTAGE_TRIES, SPREAD_ROWS = 128, 8, 256
FOUND = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64()), ("seen", pa.float64())])


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component to the last, so that equal vectors have equal scores wherever they stand."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(a.shape[1]):
            total += a[:, k] * b[:, k]
    return total


class Tree:
    """A vantage-point tree over rows (ids, x). Node i: its rows are ``order[lo[i]:hi[i]]``; an inner one has a vantage row, children ``kids[i]``, and the range of distances of each child."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, parts: dict | None = None):
        self.ids, self.x = ids, x
        with np.errstate(over="ignore"):
            self.norms = (x * x).sum(1)
        self.most = float(self.norms.max(initial=0.0))
        self.lift = np.sqrt(np.maximum(self.most - self.norms, 0.0)) if np.isfinite(self.most) else None  # without it (squares overflow) the tree is one leaf
        if parts is None:
            self._build()
        else:
            self.order, self.lo, self.hi, self.vantage, self.kids, self.ranges = (parts[k] for k in self.PARTS)

    PARTS = ("order", "lo", "hi", "vantage", "kids", "ranges")

    def _from(self, v: int, rows: np.ndarray) -> np.ndarray:
        square = self.norms[rows] + self.norms[v] + self.lift[rows] ** 2 + self.lift[v] ** 2 - 2 * (self.x[rows] @ self.x[v] + self.lift[rows] * self.lift[v])
        return np.sqrt(np.maximum(square, 0.0))

    def _build(self) -> None:
        self.order = np.arange(len(self.ids))
        lo, hi, vantage, kids, ranges, todo = [0], [len(self.ids)], [-1], [(-1, -1)], [((0.0, 0.0), (0.0, 0.0))], [0]
        draw = np.random.Generator(np.random.PCG64(len(self.ids)))
        while todo:
            node = todo.pop()
            rows = self.order[lo[node] : hi[node]]
            if len(rows) <= LEAF_ROWS or self.lift is None:
                continue
            some = rows[draw.integers(len(rows), size=SPREAD_ROWS)]
            v = max(rows[draw.integers(len(rows), size=VANTAGE_TRIES)], key=lambda r: self._from(r, some).var())  # one that tells rows apart
            far = self._from(v, rows)
            turn = np.argpartition(far, len(rows) // 2)
            rows, far = rows[turn], far[turn]
            if far.min() == far.max():
                continue  # nothing to tell apart
            self.order[lo[node] : hi[node]] = rows
            mid = len(rows) // 2
            vantage[node], kids[node] = v, (len(lo), len(lo) + 1)
            ranges[node] = ((far[:mid].min(), far[:mid].max()), (far[mid:].min(), far[mid:].max()))
            for a, b in ((lo[node], lo[node] + mid), (lo[node] + mid, hi[node])):
                todo.append(len(lo))
                lo.append(a), hi.append(b), vantage.append(-1), kids.append((-1, -1)), ranges.append(((0.0, 0.0), (0.0, 0.0)))
        self.lo, self.hi, self.vantage, self.kids, self.ranges = map(np.array, (lo, hi, vantage, kids, ranges))

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, x=self.x, **{k: getattr(self, k) for k in self.PARTS})
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as z:
            parts = {k: z[k] for k in z.files}
        return Tree(parts.pop("ids"), parts.pop("x"), parts)


class Search:
    """The k best rows of each query of a block, over any number of trees."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, factor: float):
        self.ids, self.q, self.k, self.factor = ids, q, k, factor
        with np.errstate(over="ignore"):
            self.norms = (q * q).sum(1)
        self.best = np.full((len(ids), k), -np.inf)
        self.near = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.seen = np.zeros(len(ids))

    def _leaf(self, t: Tree, node: int, who: np.ndarray) -> None:
        rows = t.order[t.lo[node] : t.hi[node]]
        step = max(1, 4_000_000 // max(len(rows), 1))
        for at in range(0, len(who), step):
            part = who[at : at + step]
            with np.errstate(over="ignore", invalid="ignore"):
                rough = self.q[part] @ t.x[rows].T
                slack = (self.q.shape[1] + 8) * 1e-15 * np.sqrt(self.norms[part]) * np.sqrt(t.most)  # more than the rounding of the rough products
                good = ~(rough < (self.best[part, -1] - slack)[:, None]) & (self.ids[part][:, None] != t.ids[rows])
            self.seen[part] += len(rows)
            a, b = np.nonzero(good)
            if len(a):
                self._take(part, a, t.ids[rows[b]], inner(self.q[part[a]], t.x[rows[b]]))

    def _take(self, part: np.ndarray, a: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merges candidates (position in part, id, score) with the best so far; ties go to the smaller id."""
        hit, a = np.unique(a, return_inverse=True)
        who = part[hit]
        a = np.concatenate([np.repeat(np.arange(len(who)), self.k), a])
        ids, scores = np.concatenate([self.near[who].ravel(), ids]), np.concatenate([self.best[who].ravel(), np.where(np.isnan(scores), -np.inf, scores)])
        o = np.lexsort((ids, -scores, a))
        first = np.searchsorted(a[o], np.arange(len(who)))
        o = o[first[:, None] + np.arange(self.k)]
        self.best[who], self.near[who] = scores[o], ids[o]

    def _far(self, t: Tree, v: int, who: np.ndarray) -> np.ndarray:
        """Distances to a vantage row, the query's further component being 0."""
        return np.sqrt(np.maximum(self.norms[who] + t.most - 2 * (self.q[who] @ t.x[v]), 0.0))

    def visit(self, t: Tree) -> None:
        everyone = np.arange(len(self.ids))
        if t.lift is None or not np.isfinite(self.norms).all():  # no distances to prune by
            for leaf in np.flatnonzero(t.kids[:, 0] < 0):
                self._leaf(t, leaf, everyone)
            return
        first = np.full(len(self.ids), -1)
        todo = [(0, everyone)]
        while todo:  # down to the leaf that each query falls into
            node, who = todo.pop()
            a, b = t.kids[node]
            if a < 0:
                first[who] = node
                self._leaf(t, node, who)
            elif len(who):
                far, edge = self._far(t, t.vantage[node], who), (t.ranges[node][0][1] + t.ranges[node][1][0]) / 2
                todo += [(a, who[far < edge]), (b, who[far >= edge])]
        scale = np.sqrt(self.norms + t.most)
        todo = [(0, everyone)]
        while todo:
            node, who = todo.pop()
            if t.kids[node][0] < 0:
                who = who[first[who] != node]
                if len(who):
                    self._leaf(t, node, who)
                continue
            far = self._far(t, t.vantage[node], who)
            for kid, (low, high) in zip(t.kids[node], t.ranges[node]):
                worst = np.sqrt(np.maximum(self.norms[who] + t.most - 2 * self.best[who, -1], 0.0))
                bound = np.maximum(low - far, far - high)
                left = who[~(bound > self.factor * worst + 1e-7 * scale[who])]
                if len(left):
                    todo.append((kid, left))

    def found(self) -> pa.RecordBatch:
        at, rank = np.nonzero(self.near < np.iinfo(np.int64).max)
        cols = [self.ids[at], rank + 1, self.near[at, rank], self.best[at, rank], np.where(rank == 0, self.seen[at], 0.0)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, FOUND)], schema=FOUND)


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _tree(key, table):
    """The tree of one shard."""
    dim = key[0].as_py()
    ids = table.column("vec_id").to_numpy()
    x, o = matrix(table.column("v").combine_chunks(), dim), np.argsort(ids)
    return pa.table({"dim": pa.array([dim], pa.int32()), "tree": pa.array([Tree(ids[o], x[o]).pack()], pa.binary())})


def _stored(uri: str, dim: int) -> Iterator[Tree]:
    """The trees of a length in the shared folder, one at a time."""
    import pyarrow.fs
    import pyarrow.parquet

    files, root = pyarrow.fs.FileSystem.from_uri(uri)
    for info in sorted(files.get_file_info(pyarrow.fs.FileSelector(root)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with files.open_input_file(info.path) as f:
                for batch in pyarrow.parquet.ParquetFile(f).iter_batches(batch_size=1):
                    if batch.column("dim")[0].as_py() == dim:
                        yield Tree.unpack(batch.column("tree")[0].as_py())


def _blocks(uri: str, k: int, factor: float, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def ready(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            block = Search(np.concatenate([r[0] for r in rows]), np.vstack([r[1] for r in rows]), k, factor)
            for tree in _stored(uri, dim):
                block.visit(tree)
            return block.found()

        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in map(int, np.unique(dims)):
                some = b.filter(pa.array(dims == dim))
                held.setdefault(dim, []).append((some.column("query_id").to_numpy(), matrix(some.column("v"), dim)))
                if sum(r[1].nbytes for r in held[dim]) >= most:
                    yield ready(dim)
        for dim in list(held):
            yield ready(dim)

    return run


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = NEAREST, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score, seen: the ``k`` rows with the largest inner products for each row whose id is divisible by ``every``; ``seen`` (in rank 1, else 0): rows compared with the query.

    Null, empty or zero vectors, those with null or non-finite components, and null ids take no part; vectors of different lengths are not compared. Ties go to the smaller id. Repeated rows count
    once; of rows with one id and different vectors the least vector counts. A query is never its own neighbour. Fewer candidates than ``k``: all of them. Empty input gives an empty table. Other columns are not read.
    """
    v = F.col(vector).cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.when(usable, F.transform(v, lambda x: x + 0.0)).alias("v")).filter("v is not null and vec_id is not null")
    spark = vectors.sparkSession
    repeated = common.written(rows.groupBy("vec_id").count().filter("count > 1").select("vec_id"), "neighbours-repeated")
    if repeated.limit(1).count():
        ids = common.small(repeated)
        rows = rows.join(ids, "vec_id", "left_anti").unionByName(rows.join(ids, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v")))
    rows = common.written(rows.withColumn("dim", F.size("v")), "neighbours")
    # of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, so a large group of copies leaves each task as k + 1 rows
    copies = rows.withColumn("copy", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).filter(F.col("copy") <= k + 1)
    dims = rows.groupBy("dim").agg(F.count("*").alias("n"))
    shards = F.greatest(F.lit(LEAST_SHARDS), F.ceil(F.col("n") * F.col("dim") * 8 / SHARD_BYTES)).cast("int")
    dealt = copies.join(common.small(common.written(dims, "neighbours-lengths")), "dim").select("dim", F.pmod(F.xxhash64("vec_id"), shards).cast("int").alias("shard"), "vec_id", "v")
    path = common.folder(spark, "trees")
    dealt.groupBy("dim", "shard").applyInArrow(_tree, "dim int, tree binary").write.parquet(path)
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", "dim")
    size = asked.agg(F.coalesce(F.sum(F.col("dim") * 8), F.lit(0))).first()[0]
    blocks = max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))
    return asked.repartition(blocks, "query_id").mapInArrow(_blocks(path, k, factor, 2 * BLOCK_BYTES), "query_id long, rank int, vec_id long, score double, seen double")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings")).drop("seen")


SQL = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
v AS (
  SELECT vec_id, min(e) AS e FROM e
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 GROUP BY vec_id),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {NEAREST}
"""
