"""Approximate nearest neighbours by cosine with robust-pruned directed graphs.

Equal vectors are one node with its smallest ids, so copies cost nothing. The distinct vectors are dealt by hash
into shards: as many as the session has cores, if each gets ``SHARD_LEAST`` of them, and more where a shard would have over ``SHARD_ROWS``, which a
task's memory bounds. A search's cost grows with the logarithm of a shard's size, so few large shards cost less than many small ones. Each shard builds a directed graph: nodes start with random
neighbours; then, in two passes, a greedy beam search from the shard's middle proposes neighbours of each node, and
robust pruning keeps the nearest of them and drops all that are nearer to a kept one than to the
node by the factor ``alpha``, so that the kept edges point in diverse directions. Edges are also
added backwards, and lists that get too long are pruned again. Queries go to the shards, as a stream: a task reads a shard's graph once, and runs a beam
search for one batch of queries after the other. A search scores a small share of a large shard's nodes (``beam_search`` counts them). Scores are cosines in double precision on the vectors as they are given, and a query's nearest
are chosen over all shards by score, then by id.

Null vectors, zero vectors and those with null or non-finite components take no part. Vectors of different
lengths never meet. Repeated rows (same id, same vector) count once. Fewer candidates than asked for give
fewer rows; an empty table gives none. A task holds one shard's graph and one batch of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, stored

SHARD_ROWS, SHARD_LEAST, QUERY_BLOCK = 50_000, 4000, 256
DEGREE, BUILD_BEAM, SEARCH_BEAM, EXPAND = 32, 64, 64, 4


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so no square overflows."""
    big = vectors / np.abs(vectors).max(1, keepdims=True)
    return big / np.sqrt(np.einsum("ij,ij->i", big, big))[:, None]


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, asked: np.ndarray, beam: int, expand: int = EXPAND, scored: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``asked`` the ``beam`` nearest nodes met (-1: none) and their negative cosines, nearest first. ``scored``: a list that gets
    the number of nodes scored for each."""
    rows, n = len(asked), len(x)
    ids = np.full((rows, beam), -1)
    far = np.full((rows, beam), np.inf, np.float32)
    ids[:, 0], far[:, 0] = entry, -(asked @ x[entry])
    done = np.zeros((rows, beam), bool)
    met = np.zeros((rows, n), bool)
    met[:, entry] = True
    active = np.arange(rows)
    while len(active):
        fresh = np.where(done[active] | (ids[active] < 0), np.inf, far[active])
        pick = np.argsort(fresh, 1, kind="stable")[:, :expand]
        usable = np.isfinite(np.take_along_axis(fresh, pick, 1))
        going = usable.any(1)
        active, pick, usable = active[going], pick[going], usable[going]
        if not len(active):
            break
        np.put_along_axis(d := done[active], pick, True, 1)
        done[active] = d
        at = np.where(usable, np.take_along_axis(ids[active], pick, 1), -1)
        reach = np.where(at[:, :, None] >= 0, graph[at], -1).reshape(len(active), -1)
        row = np.arange(len(active))[:, None]
        new = (reach >= 0) & ~met[active[:, None], np.maximum(reach, 0)]
        mark = met[active]
        mark[np.broadcast_to(row, reach.shape)[new], reach[new]] = True
        met[active] = mark
        # the same node reached twice in this step counts once
        order = np.argsort(reach, 1, kind="stable")
        again = np.zeros_like(new)
        ordered = np.take_along_axis(reach, order, 1)
        np.put_along_axis(again, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
        new &= ~again
        score = np.full(reach.shape, np.inf, np.float32)
        a, b = np.nonzero(new)
        score[a, b] = -np.einsum("ij,ij->i", x[reach[a, b]], asked[active[a]])
        all_far = np.concatenate((far[active], score), 1)
        best = np.argsort(all_far, 1, kind="stable")[:, :beam]
        far[active] = np.take_along_axis(all_far, best, 1)
        ids[active] = np.where(np.isfinite(far[active]), np.take_along_axis(np.concatenate((ids[active], reach), 1), best, 1), -1)
        done[active] = np.take_along_axis(np.concatenate((done[active], np.zeros_like(new)), 1), best, 1)
    if scored is not None:
        scored.extend(met.sum(1).tolist())
    return ids, far


def robust_prune(x: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """At most ``degree`` of the ``proposed`` (-1: none) for each of ``nodes``. Distances are squared, of unit vectors."""
    proposed = np.where(proposed == nodes[:, None], -1, proposed)
    order = np.argsort(proposed, 1, kind="stable")
    ordered = np.take_along_axis(proposed, order, 1)
    twice = np.zeros(proposed.shape, bool)
    np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
    vectors = x[np.maximum(proposed, 0)]
    to_node = 2 - 2 * np.einsum("ijk,ik->ij", vectors, x[nodes])
    to_node[(proposed < 0) | twice] = np.inf
    out = np.full((len(nodes), degree), -1, np.int32)
    rows = np.arange(len(nodes))
    for k in range(degree):
        pick = to_node.argmin(1)
        live = np.isfinite(to_node[rows, pick])
        if not live.any():
            break
        rows_live, pick = rows[live], pick[live]
        out[rows_live, k] = proposed[rows_live, pick]
        chosen = vectors[rows_live, pick]
        to_chosen = 2 - 2 * np.einsum("ijk,ik->ij", vectors[rows_live], chosen)
        part = to_node[rows_live]
        part[alpha * to_chosen <= part] = np.inf
        part[np.arange(len(pick)), pick] = np.inf
        to_node[rows_live] = part
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alphas: tuple[float, ...] = (1.0, 1.2), batch: int = 512, seed: int = 3) -> tuple[np.ndarray, int]:
    """Neighbours of each row of ``x`` (unit vectors; -1: none), and the entry node."""
    n, rng = len(x), np.random.default_rng(seed)
    entry = int((x @ x.mean(0)).argmax())
    if n <= degree + 1:
        every = np.tile(np.arange(n, dtype=np.int32), (n, 1))
        return np.where(every == np.arange(n)[:, None], -1, every), entry
    graph = rng.integers(0, n, (n, degree)).astype(np.int32)
    for alpha in alphas:
        order = rng.permutation(n)
        for at in range(0, n, batch):
            nodes = order[at : at + batch]
            near, _ = beam_search(x, graph, entry, x[nodes], beam)
            graph[nodes] = robust_prune(x, nodes, np.concatenate((near, graph[nodes]), 1), alpha, degree)
            source, target = np.repeat(nodes, degree), graph[nodes].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            touched, first, count = np.unique(target, return_index=True, return_counts=True)
            for part in np.array_split(np.arange(len(touched)), max(1, len(touched) // 256)):
                if not len(part):
                    continue
                extra = np.full((len(part), int(count[part].max())), -1, np.int64)
                for i, t in enumerate(part):
                    extra[i, : count[t]] = source[first[t] : first[t] + count[t]]
                mine = touched[part]
                both = np.concatenate((graph[mine], extra), 1)
                graph[mine] = robust_prune(x, mine, both, alpha, degree)
    return graph, entry


def _pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _build_shard(table: pa.Table) -> pa.Table:
    dim = table.column("dim")[0].as_py()
    order = np.argsort(table.column("key").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    vectors = _vectors(table.column("vector"), dim)
    graph, entry = build(unit(vectors).astype(np.float32))
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "entry": pa.array([entry], pa.int32()), "vectors": pa.array([_pack(vectors)]),
            "graph": pa.array([_pack(graph.astype(np.int32))]), "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
        }
    )


def valid(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """``vec_id, vector, dim`` of the rows whose vector takes part."""
    v = F.col("vector")
    cast = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("vector"))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return cast.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine).withColumn("dim", F.size("vector"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``dim, vector, key, ids``: each vector once, with the ``k + 1`` smallest ids that have it. That is all that the
    ``k`` nearest can need: a query's own id may be among them."""
    rank = F.row_number().over(Window.partitionBy("dim", "vector").orderBy("vec_id"))
    few = rows.distinct().withColumn("_rank", rank).where(F.col("_rank") <= k + 1)
    return few.groupBy("dim", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("key", F.col("ids")[0])


GRAPH = "dim int, shard int, entry int, vectors binary, graph binary, ids array<array<long>>"


def index(rows: DataFrame, k: int = 5, shard_rows: int | None = None) -> DataFrame:
    """Graphs of ``rows(vec_id, vector, dim)``, a row per shard. ``shard_rows``: another size of shards."""
    spark = ready(rows.sparkSession)
    nodes = stored(distinct_vectors(rows, k))
    n = nodes.count()
    shards = max(1, -(-n // shard_rows) if shard_rows else max(-(-n // SHARD_ROWS), min(spark.sparkContext.defaultParallelism, n // SHARD_LEAST)))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    return dealt.repartitionByRange(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(_build_shard, GRAPH)


def _search(k: int, beam: int):
    """Rows come in order of (dim, shard): the shard's graph, then its queries ``(key, vector)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x, graph, entry, ids = None, None, None, 0, []
        for batch in batches:
            at = list(zip(batch.column("dim").to_pylist(), batch.column("shard").to_pylist()))
            is_graph = batch.column("graph").is_valid().to_numpy(zero_copy_only=False)
            i = 0
            while i < len(batch):
                if is_graph[i]:
                    row = batch.slice(i, 1).to_pylist()[0]
                    x = unit(np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"]))
                    now, graph, entry, ids = at[i], np.frombuffer(row["graph"], np.int32).reshape(len(x), -1), row["entry"], row["ids"]
                    near_x = x.astype(np.float32)
                    i += 1
                    continue
                stop = i + 1
                while stop < min(len(batch), i + QUERY_BLOCK) and at[stop] == at[i] and not is_graph[stop]:
                    stop += 1
                asked, i = batch.slice(i, stop - i), stop
                if at[stop - 1] != now:  # this length has no such shard
                    continue
                keys, q = asked.column("key").to_numpy(), unit(_vectors(asked.column("vector"), now[0]))
                found, _ = beam_search(near_x, graph, entry, q.astype(np.float32), min(beam, len(x)))
                near = found[:, : 3 * (k + 1)]
                a, b = np.nonzero(near >= 0)
                node = near[a, b]
                score = np.einsum("ij,ij->i", x[node], q[a])
                order = np.lexsort((node, -score, a))
                a, node, score = a[order], node[order], score[order]
                top = np.arange(len(a)) - np.searchsorted(a, a) <= k
                a, node, score = a[top], node[top], score[top]
                yield pa.RecordBatch.from_arrays([pa.array(keys[a]), pa.array(score), pa.array([ids[f] for f in node.tolist()], pa.list_(pa.int64()))], ["key", "score", "ids"])

    return run


def search(graphs: DataFrame, queries: DataFrame, k: int = 5, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest of each row of ``queries(vec_id, vector, dim)``, the query's own id left out."""
    ready(graphs.sparkSession)
    least = queries.groupBy("dim", "vector").agg(F.min("vec_id").alias("key"))
    named = stored(queries.distinct().join(least, ["dim", "vector"]).select("vec_id", "key"))
    least = stored(least)
    n_shards = graphs.agg(F.max("shard")).first()[0]
    if n_shards is None:
        return named.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    asked = least.select("dim", F.explode(F.sequence(F.lit(0), F.lit(n_shards))).alias("shard"), none("entry", "int"), none("vectors", "binary"), none("graph", "binary"), none("ids", "array<array<long>>"), "key", "vector")
    visits = graphs.select("dim", "shard", "entry", "vectors", "graph", "ids", none("key", "long"), none("vector", "array<double>")).unionByName(asked)
    ordered = visits.repartitionByRange(n_shards + 1, "dim", "shard").sortWithinPartitions("dim", "shard", F.col("graph").isNull())
    found = ordered.mapInArrow(_search(k, beam), "key long, score double, ids array<long>")
    each = found.select("key", "score", F.explode("ids").alias("vec_id"))
    order = (F.col("score").desc(), F.col("vec_id"))
    best = each.withColumn("_rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("_rank") <= k + 1)
    tops = stored(best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("_rank", "vec_id", "score"))).alias("tops")))
    others = F.slice(F.filter("tops", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    joined = named.withColumnRenamed("vec_id", "query_id").join(tops, "key").select("query_id", F.posexplode(others).alias("_at", "top"))
    return joined.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("top.vec_id").alias("vec_id"), F.col("top.score").alias("score"))


def nearest(rows: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The ``k`` nearest of each row of ``rows(vec_id, embedding)`` whose id is divisible by ``every``, among all other rows."""
    usable = stored(valid(rows))
    graphs = stored(index(usable, k))
    return search(graphs, usable.where(F.col("vec_id") % every == 0), k)
