"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Equal vectors form a class first, so copies cost one vector. Classes are dealt to shards by hash; each shard's graph is built in a
task of its own, in batches (layers with a sixteenth of the nodes each, neighbours chosen by the diversity rule of Malkov and Yashunin 2018), and written to the shared folder.
Every class then queries every shard: a task holds a block of queries and streams the graphs past it, one at a time, so no vector is shuffled once for each shard. For each graph a task audits itself: the exact
hits of sampled queries, as many as it takes to see ``AUDIT_PAIRS`` true pairs, are compared with the graph's, and the beam widens until their recall is at least ``RECALL``; truths and hits are also counted
over all tasks, and should that recall be below, all is searched again with a wider beam. A query whose beam is full of hits has more than the beam holds
and is compared with its whole shard. Candidates are confirmed in double precision; links are united by connected components.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlink.llm import common

COSINE = 0.9
SHARD_ROWS, LEAST_SHARDS = 50_000, 6
BLOCK_ROWS, LEAST_BLOCKS = 25_000, 2
LINKS, FANOUT, BEAM_BUILD, BEAM = 24, 16, 48, 48
#: Queries of an audit step, steps at most, true pairs that are enough, and the recall wanted.
AUDIT, AUDIT_STEPS, AUDIT_PAIRS, RECALL = 64, 16, 50, 0.99


class Graph:
    """HNSW over unit vectors (float32); searches take many queries at once."""

    def __init__(self, unit: np.ndarray, seed: np.ndarray, layers: list | None = None):
        self.unit = unit
        if layers is not None:
            self.layers = layers
            return
        order = np.argsort(seed, kind="stable")  # a node's level depends on its hash only
        sizes = [len(unit)]
        while sizes[-1] > 4 * FANOUT:
            sizes.append(sizes[-1] // FANOUT)
        self.layers = []  # from the top: (nodes, neighbours by position in nodes)
        for size in reversed(sizes):
            self._build(np.sort(order[:size]))

    def _build(self, nodes: np.ndarray) -> None:
        n = len(nodes)
        near = np.full((n, LINKS), -1, np.int32)
        self.layers.append((nodes, near))
        vec, at = self.unit[nodes], 0
        first = min(n, 512)
        while at < n:
            batch = np.arange(at, min(n, first if at == 0 else at + min(at, 2048)))
            q = vec[batch]
            own = q @ q.T
            np.fill_diagonal(own, -2)
            k = min(BEAM_BUILD, len(batch))
            top = np.argpartition(-own, k - 1, axis=1)[:, :k]
            ids, sims = batch[top], np.take_along_axis(own, top, 1)
            if at:
                old = self._search(q, len(self.layers) - 1, BEAM_BUILD, at)
                ids, sims = np.hstack([ids, old[0]]), np.hstack([sims, old[1]])
            near[batch] = self._choose(vec, ids, sims)
            # links back: each target chooses again among its old neighbours and the nearest newcomers
            src = np.repeat(batch, LINKS)
            dst = near[batch].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            sim = np.einsum("ij,ij->i", vec[src], vec[dst])
            o = np.lexsort((-sim, dst))
            src, dst, sim = src[o], dst[o], sim[o]
            start = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]]) if len(dst) else np.empty(0, int)
            rank = np.arange(len(dst)) - np.repeat(start, np.diff(np.r_[start, len(dst)]))
            src, dst, rank = src[rank < LINKS], dst[rank < LINKS], rank[rank < LINKS]
            targets, row = np.unique(dst, return_inverse=True)
            new = np.full((len(targets), LINKS), -1, np.int64)
            new[row, rank] = src
            for i in range(0, len(targets), 2048):
                t = targets[i : i + 2048]
                ids = np.hstack([near[t], new[i : i + 2048]])
                ids = _once(ids)
                sims = np.where(ids >= 0, np.einsum("ijk,ik->ij", vec[ids], vec[t]), -2)
                near[t] = self._choose(vec, ids, sims)
            at = batch[-1] + 1

    @staticmethod
    def _choose(vec, ids, sims) -> np.ndarray:
        """Diversity rule: a candidate stays if it is nearer to the node than to any neighbour chosen before; free slots go to the nearest left."""
        out = np.full((len(ids), LINKS), -1, np.int32)
        for lo in range(0, len(ids), 1024):
            s = sims[lo : lo + 1024]
            o = np.argsort(-s, axis=1, kind="stable")[:, : 2 * LINKS]
            c, s = np.take_along_axis(ids[lo : lo + 1024], o, 1), np.take_along_axis(s, o, 1)
            v = vec[c]
            between = np.einsum("ijk,ilk->ijl", v, v)
            good = np.zeros(c.shape, bool)
            for j in range(c.shape[1]):
                far = np.where(good[:, :j], between[:, j, :j], -2).max(1, initial=-2) < s[:, j]
                good[:, j] = far & (s[:, j] > -2) & (good[:, :j].sum(1) < LINKS // 2)
            pick = np.argsort(~good * 1000 + (s <= -2) * 10_000 + np.arange(c.shape[1]), axis=1)[:, :LINKS]
            kept = np.where(np.take_along_axis(s, pick, 1) > -2, np.take_along_axis(c, pick, 1), -1)
            out[lo : lo + 1024, : kept.shape[1]] = kept
        return out

    def _search(self, q: np.ndarray, layer: int, beam: int, upto: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(positions in the layer, similarities), -1 and -2 where there are none. ``upto``: only that many nodes are in yet."""
        nodes, near = self.layers[layer]
        n = len(nodes) if upto is None else upto
        vec = self.unit[nodes] if len(nodes) < len(self.unit) else self.unit
        beam = min(beam, n)
        if n <= 4 * FANOUT or layer == 0:
            sims = q @ vec[:n].T
            top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            return top, np.take_along_axis(sims, top, 1)
        up = self._search(q, layer - 1, 8)
        starts = nodes.searchsorted(self.layers[layer - 1][0][up[0]])
        if upto is not None:  # the layer above may know nodes that are not in yet
            starts = np.where(starts < n, starts, np.arange(starts.shape[1]) % n)
        out_i, out_s = np.empty((len(q), beam), np.int64), np.empty((len(q), beam), np.float32)
        step = max(16, min(512, 20_000_000 // n))
        for lo in range(0, len(q), step):
            out_i[lo : lo + step], out_s[lo : lo + step] = self._beam(q[lo : lo + step], vec, near, starts[lo : lo + step], beam, n)
        return out_i, out_s

    @staticmethod
    def _beam(q, vec, near, starts, beam, n):
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n + 1), bool)  # the last column is for "none"
        seen[:, n] = True
        ids, sims, done = np.full((len(q), beam), n), np.full((len(q), beam), -2, np.float32), np.ones((len(q), beam), bool)
        fresh = _once(starts)
        while True:
            fresh = np.where((fresh < 0) | seen[rows, fresh], n, fresh)
            seen[rows, fresh] = True
            width = max(1, int((fresh < n).sum(1).max(initial=0)))
            if width < fresh.shape[1]:
                fresh = np.sort(fresh, axis=1)[:, :width]
            s = np.where(fresh < n, np.einsum("ijk,ik->ij", vec[np.minimum(fresh, n - 1)], q), -2)
            ids, sims, done = np.hstack([ids, fresh]), np.hstack([sims, s]), np.hstack([done, fresh >= n])
            top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            ids, sims, done = (np.take_along_axis(x, top, 1) for x in (ids, sims, done))
            if done.all():
                return np.where(ids < n, ids, -1), sims
            go = np.argpartition(np.where(done, 3, -sims), min(3, beam - 1), axis=1)[:, :4]
            live = ~np.take_along_axis(done, go, 1)
            np.put_along_axis(done, go, True, 1)
            picked = np.where(live, np.take_along_axis(ids, go, 1), n)
            fresh = np.where((picked < n)[:, :, None], near[np.minimum(picked, n - 1)], -1).reshape(len(q), -1)
            fresh = _once(fresh)

    def hits(self, q: np.ndarray, beam: int, least: float) -> list[np.ndarray]:
        """Nodes with similarity >= least for each query: what the beam finds, and the whole shard for queries whose beam is full of hits."""
        nodes = self.layers[-1][0]
        ids, sims = self._search(q, len(self.layers) - 1, beam)
        good = (sims >= least) & (ids >= 0)
        found = [nodes[i[g]] for i, g in zip(ids, good)]
        for lo in range(0, len(full := np.flatnonzero(good.all(1))), 256):
            part = full[lo : lo + 256]
            exact = q[part] @ self.unit.T >= least
            for i, g in zip(part, exact):
                found[i] = np.flatnonzero(g)
        return found


def _once(ids: np.ndarray) -> np.ndarray:
    """Sorted rows with repeats replaced by -1."""
    ids = np.sort(ids, axis=1)
    return np.where(np.c_[np.zeros(len(ids), bool), ids[:, 1:] == ids[:, :-1]], -1, ids)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)  # first by the largest component, so that squares do not overflow
    x = x / big
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in col])


def _graph(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("c")
    x = _matrix(pdf["v"])
    g = Graph(_unit(x).astype(np.float32), pdf["c"].to_numpy() * np.int64(-7046029254386353131))
    out = io.BytesIO()
    arrays = {f"nodes{i}": a for i, (a, _) in enumerate(g.layers)} | {f"near{i}": b for i, (_, b) in enumerate(g.layers)}
    np.savez(out, c=pdf["c"].to_numpy(), w=pdf["w"].to_numpy(), x=x, **arrays)
    return pd.DataFrame({"dim": [int(key[0])], "shard": [int(key[1])], "graph": [out.getvalue()]})


def _open_graphs(uri: str):
    """(dim, c, w, unit vectors in double precision, graph) of each shard in the shared folder, one at a time."""
    import pyarrow.fs
    import pyarrow.parquet

    files, root = pyarrow.fs.FileSystem.from_uri(uri)
    for info in sorted(files.get_file_info(pyarrow.fs.FileSelector(root)), key=lambda i: i.path):
        if not info.path.endswith(".parquet"):
            continue
        with files.open_input_file(info.path) as f:
            for batch in pyarrow.parquet.ParquetFile(f).iter_batches(batch_size=1):
                for row in batch.to_pylist():
                    z = np.load(io.BytesIO(row["graph"]))
                    c, unit = z["c"], _unit(z["x"])
                    depth = sum(k.startswith("nodes") for k in z.files)
                    yield row["dim"], c, z["w"], unit, Graph(unit.astype(np.float32), c, [(z[f"nodes{i}"], z[f"near{i}"]) for i in range(depth)])


def _audited(g: Graph, q: np.ndarray, beam: int, least: float) -> tuple[int, int, int]:
    """(beam, true pairs, found ones): the beam, widened until the audit passes."""
    order = np.random.Generator(np.random.PCG64(len(q))).permutation(len(q))
    sample, truth = [], []
    for i in range(0, min(len(q), AUDIT * AUDIT_STEPS), AUDIT):
        part = order[i : i + AUDIT]
        truth += [set(np.flatnonzero(r)) for r in q[part] @ g.unit.T >= least]
        sample += part.tolist()
        if sum(len(t) > 1 for t in truth) >= AUDIT_PAIRS:  # each query may find itself
            break
    total = sum(map(len, truth))
    while True:
        found = sum(len(t.intersection(f)) for t, f in zip(truth, g.hits(q[sample], beam, least))) if beam < len(g.unit) else total
        if found >= RECALL * total or beam >= len(g.unit):
            return beam, total, found
        beam *= 2


def _search(uri: str, beam: int):
    """Blocks of queries past every graph: rows (c, links) for each query class, forest edges (c, other) of the links met, and what the audits saw (truth, found)."""

    def block(ids: np.ndarray, x: np.ndarray):
        qx = _unit(x)
        q, least = qx.astype(np.float32), COSINE - 1e-4
        parent: dict = {}

        def root(v):
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        links, truth, found = np.zeros(len(q), np.int64), 0, 0
        for dim, c, w, unit, g in _open_graphs(uri):
            if dim != q.shape[1]:
                continue
            wide, t, f = _audited(g, q, beam, least)
            truth, found = truth + t, found + f
            for lo in range(0, len(q), 1024):
                part = q[lo : lo + 1024]
                hits = g.hits(part, wide, least) if wide < len(c) else [np.flatnonzero(r) for r in part @ g.unit.T >= least]
                for i, near in enumerate(hits, lo):
                    near = near[unit[near] @ qx[i] >= COSINE]
                    near = near[c[near] != ids[i]]
                    links[i] += w[near].sum()
                    for o in c[near].tolist() if len(near) else ():
                        a, b = root(int(ids[i])), root(o)
                        if a != b:
                            parent[max(a, b)] = min(a, b)
        edges = [(k, root(k)) for k in list(parent) if root(k) != k]
        parts = [pd.DataFrame({"c": ids, "links": links}), pd.DataFrame(edges, columns=["c", "other"]), pd.DataFrame({"truth": [truth], "found": [found]})]
        return pd.concat([d.reindex(columns=["c", "links", "other", "truth", "found"]).astype("Int64") for d in parts if len(d)])

    def run(batches):
        held: dict[int, list] = {}

        def ready(dim):
            rows = held.pop(dim)
            return block(np.concatenate([r[0] for r in rows]), np.vstack([r[1] for r in rows]))

        for pdf in batches:
            for dim, some in pdf.groupby("dim"):
                held.setdefault(int(dim), []).append((some["c"].to_numpy(np.int64), _matrix(some["v"])))
                if sum(len(r[0]) for r in held[int(dim)]) >= BLOCK_ROWS:
                    yield ready(int(dim))
        for dim in list(held):
            yield ready(dim)

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", beam: int = BEAM) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Null, zero or empty vectors and those with null or non-finite components: no links, component_id = own id. Vectors of different lengths are not
    compared. Repeated vectors, and rows that stand twice, link with each other. A null id never names a component. Empty input gives an empty table. Other columns are not read, so their names cannot clash.
    """
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.when(usable, F.transform(v, lambda x: x + 0.0)).alias("v"))
    exact = rows.filter("v is not null").groupBy("v").agg(F.count("*").alias("w"), F.min("vec_id").alias("least"))  # by the values themselves
    for seed in range(3):
        c = F.xxhash64(F.lit(seed), "v")
        classes = common.written(exact.select(c.alias("c"), "v", "w", "least", F.size("v").alias("dim")), "vectors")
        if not classes.groupBy("c").count().filter("count > 1").limit(1).count():  # two vectors of one number: then other numbers are taken
            break
    else:
        raise RuntimeError("class numbers collide")
    n = classes.count()
    shards, blocks = max(LEAST_SHARDS, -(-n // SHARD_ROWS)), max(LEAST_BLOCKS, -(-n // BLOCK_ROWS))
    shard = F.pmod(F.xxhash64("c"), F.lit(shards)).cast("int")
    graphs = classes.select("dim", shard.alias("shard"), "c", "v", "w").groupBy("dim", "shard").applyInPandas(_graph, "dim int, shard int, graph binary")
    path = common.folder(spark, "graphs")
    graphs.write.parquet(path)
    queries = classes.select("dim", "c", "v").repartition(blocks, "c")
    while True:
        found = common.written(queries.mapInPandas(_search(path, beam), "c long, links long, other long, truth long, found long"), "vector-links")
        truth, hits = found.agg(F.coalesce(F.sum("truth"), F.lit(0)), F.coalesce(F.sum("found"), F.lit(0))).first()
        if hits >= RECALL * truth or beam >= SHARD_ROWS:
            break
        beam *= 2
    links = found.filter("links is not null").groupBy("c").agg(F.sum("links").alias("links"))
    comp = common.components(found.filter("other is not null").select(F.col("c").alias("a"), F.col("other").alias("b")))
    ends = classes.select("c", "w", "least").join(links, "c", "left").join(comp, F.col("c") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "c"))
    ends = ends.select("c", "w", "least", "links", "comp")
    smallest = ends.groupBy("comp").agg(F.min("least").alias("component_id"))
    ends = ends.join(smallest, "comp").select("c", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", F.when(F.col("v").isNotNull(), c).alias("c")).join(ends, "c", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT k, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.k AS a, b.k AS b FROM g a JOIN g b ON a.k <> b.k AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(k, c) AS (SELECT k, k FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.k = l.a),
m AS (SELECT r.k, min(v.vec_id) AS component_id FROM r JOIN v ON r.c = v.k GROUP BY r.k)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.k) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN m ON v.k = m.k
"""
