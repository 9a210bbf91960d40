"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

Equal vectors collapse to one node that remembers its ``k + 1`` smallest ids: no
search for up to ``k`` neighbours can need more of them, whatever row asks. Nodes are
dealt by a hash into shards of bounded size; each round of NN-descent is a
Spark join of every node's neighbours with their neighbours, after which each
shard compares its nodes with the candidates that the join brought and keeps the
nearest. Rounds go on until few lists change, each written to the shared
folder. A query walks the graph of each shard from node to better node with a
beam, and all that the beams of all shards hold is ranked by the exact cosine in
double precision. Queries come in blocks, so a task holds one shard and one block.
Every shard is asked, so the work of a search grows with the queries times the shards.

Edge cases: vectors that are null, zero or hold null or non-finite components
take no part, neither as queries nor as candidates; vectors of different lengths
never meet; rows that repeat an id and a vector count once, rows that repeat an
id with other vectors are all candidates; a query id with several vectors asks
with the smallest of them, number by number; ties go to the smaller id; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.llm.common import column, scope, written

SHARD_ROWS = 8192
NEIGHBOURS, REVERSE = 14, 10
ROUNDS, STILL = 10, 0.002
BEAM, EXPAND, STARTS = 160, 6, 12
QUERY_BLOCK = 1024
NODES = "dim int, node long, vector array<double>, ids array<long>"
GRAPH = "shard int, place int, near array<int>, changed int"
FOUND = "query_id long, vec_id long, score double"


def _distinct(keep: int):
    """Per partition, one row for each vector with its ``keep`` smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            vectors = [np.frombuffer(k) for k in held]
            ids = list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([len(v) for v in vectors], pa.int32()), pa.array([v.tolist() for v in vectors], pa.list_(pa.float64())), pa.array(ids, pa.list_(pa.int64()))], names=["dim", "vector", "ids"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = np.asarray(v, np.float64) + 0.0  # no negative zero
                ids = held.setdefault(v.tobytes(), [])
                if i not in ids:
                    ids.append(i)
                    if len(ids) > keep:
                        ids.remove(max(ids))
            if len(held) > 50_000:
                yield flush()
        yield flush()

    return run


def sound(vector: Column) -> Column:
    """Whether a vector can take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _unit(v: np.ndarray) -> np.ndarray:
    scale = np.abs(v).max(axis=1, keepdims=True)
    v = v / np.where(scale > 0, scale, 1)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    col = table.column(column).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = col.chunk(0) if col.num_chunks else pa.array([], pa.list_(pa.float64()))
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _lists(near: list) -> pa.Array:
    return pa.array([x.tolist() for x in near], pa.list_(pa.int32()))


def _graph(shard: int, near: np.ndarray | list, changed: np.ndarray) -> pa.Table:
    n = len(near)
    return pa.table({"shard": pa.array([shard] * n, pa.int32()), "place": pa.array(range(n), pa.int32()), "near": _lists(list(near)), "changed": pa.array(changed, pa.int32())})


def _best(v: np.ndarray, u: int, cand: np.ndarray, k: int) -> np.ndarray:
    s = v[cand] @ v[u]
    if len(cand) > k:
        at = np.argpartition(-s, k - 1)[:k]
        cand, s = cand[at], s[at]
    return cand[np.argsort(-s, kind="stable")]


def _start(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Random neighbours, drawn from the shard's number."""
    table = table.sort_by("place")
    v = _unit(_matrix(table, "vector"))
    n, rng = len(v), np.random.default_rng(int(key[0].as_py()))
    near = [_best(v, u, c[c != u], NEIGHBOURS) for u, c in enumerate(np.unique(x) for x in rng.integers(0, n, (n, 2 * NEIGHBOURS)))]
    return _graph(key[0].as_py(), near, np.zeros(n, np.int32))


def _improve(key: tuple[pa.Scalar, ...], met: pa.Table, table: pa.Table) -> pa.Table:
    """Keep each node's nearest of its neighbours and of those it has met."""
    table = table.sort_by("place")
    v = _unit(_matrix(table, "vector"))
    near: list = [np.zeros(0, np.int32)] * len(v)
    changed = np.zeros(len(v), np.int32)
    for place, now, cand in zip(met.column("place").to_pylist(), met.column("near").combine_chunks(), met.column("met").combine_chunks(), strict=True):
        old = np.asarray(now.values)
        c = np.unique(np.concatenate([old, np.asarray(cand.values)]))
        near[place] = _best(v, place, c[c != place], NEIGHBOURS)
        changed[place] = len(np.setdiff1d(near[place], old))
    return _graph(key[0].as_py(), near, changed)


def both_ways(near: list[np.ndarray], v: np.ndarray, most: int) -> np.ndarray:
    """Neighbours and reverse neighbours, the nearest ``most``; filled up with the node itself."""
    n = len(near)
    u = np.repeat(np.arange(n), [len(x) for x in near])
    w = np.concatenate(near) if n else np.zeros(0, int)
    a, b = np.r_[u, w], np.r_[w, u]
    pairs = np.unique(a.astype(np.int64) * n + b)
    a, b = pairs // max(n, 1), pairs % max(n, 1)
    s = np.einsum("ij,ij->i", v[a], v[b])
    order = np.lexsort((-s, a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.tile(np.arange(n)[:, None], (1, most))
    out[a[rank < most], rank[rank < most]] = b[rank < most]
    return out


def greedy(v: np.ndarray, links: np.ndarray, q: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """For each query the places of a beam's best finds, nearest first."""
    n, m = len(v), len(q)
    beam = min(beam, n)
    rng = np.random.default_rng(n)
    starts = rng.choice(n, min(n, max(beam, STARTS)), replace=False)
    seen = np.zeros((m, n), bool)
    seen[:, starts] = True
    place = np.tile(starts, (m, 1))
    score = q @ v[starts].T
    order = np.argsort(-score, axis=1)[:, :beam]
    place, score = np.take_along_axis(place, order, 1), np.take_along_axis(score, order, 1)
    done = np.zeros(place.shape, bool)
    rows = np.arange(m)
    while len(rows):
        open_ = np.where(done[rows], -np.inf, score[rows])
        pick = np.argsort(-open_, axis=1)[:, :EXPAND]
        use = np.take_along_axis(open_, pick, 1) > -np.inf
        rows, pick, use = rows[use.any(1)], pick[use.any(1)], use[use.any(1)]
        if not len(rows):
            break
        d = done[rows]
        np.put_along_axis(d, pick, True, 1)
        done[rows] = d
        cand = links[np.take_along_axis(place[rows], pick, 1)]
        cand = np.where(use[:, :, None], cand, place[rows][:, :1, None]).reshape(len(rows), -1)
        new = ~seen[rows[:, None], cand]
        cand_sorted = np.sort(np.where(new, cand, n), axis=1)
        fresh = (cand_sorted < n) & np.c_[np.ones(len(rows), bool), cand_sorted[:, 1:] != cand_sorted[:, :-1]]
        width = int(fresh.sum(1).max())
        if width == 0:
            continue
        at = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
        cand, ok = np.take_along_axis(cand_sorted, at, 1), np.take_along_axis(fresh, at, 1)
        cand = np.where(ok, cand, 0)
        seen[np.repeat(rows, ok.sum(1)), cand[ok]] = True
        s = np.where(ok, np.einsum("ijk,ik->ij", v[cand], q[rows]), -np.inf)
        all_s = np.concatenate([score[rows], s], 1)
        all_p = np.concatenate([place[rows], cand], 1)
        all_d = np.concatenate([done[rows], ~ok], 1)
        keep = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        score[rows], place[rows], done[rows] = (np.take_along_axis(x, keep, 1) for x in (all_s, all_p, all_d))
    return place


def _search(k: int):
    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, index: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if len(queries) and len(index):
            index = index.sort_by("place")
            exact = _matrix(index, "vector")
            v = _unit(exact)
            near = [np.asarray(x.values) for x in index.column("near").combine_chunks()]
            links = both_ways(near, v, NEIGHBOURS + REVERSE)
            ids = index.column("ids").to_pylist()
            asked = _matrix(queries, "vector")
            places = greedy(v, links, _unit(asked), max(BEAM, 2 * k))
            norm = np.sqrt((exact * exact).sum(1))
            for qid, q, found in zip(queries.column("query_id").to_pylist(), asked, places, strict=True):
                s = (exact[found] @ q) / (norm[found] * np.sqrt(q @ q))
                best = heapq.nsmallest(k, ((-x, i) for x, p in zip(s.tolist(), found.tolist(), strict=True) for i in ids[p] if i != qid))
                for x, i in best:
                    out[0].append(qid)
                    out[1].append(i)
                    out[2].append(-x)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def build(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index for up to ``k`` neighbours: (shard, place, node, vector, ids, keep, near) for every vector that takes part."""
    keep = k + 1
    with scope(df.sparkSession):
        rows = df.select(column(df, vec_id).cast("long").alias("id"), column(df, vector).cast("array<double>").alias("v")).where(sound(F.col("v")) & F.col("id").isNotNull())
        partial = rows.mapInArrow(_distinct(keep), "dim int, vector array<double>, ids array<long>")
        ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
        nodes = written(partial.groupBy("dim", "vector").agg(ids.alias("ids")), "nodes")
        # vectors of one length share shards; no shard holds two lengths
        lengths = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("n"))
        lengths = lengths.select("dim", "n", (F.sum("n").over(Window.orderBy("dim")) - F.col("n")).cast("int").alias("first"))
        place = F.row_number().over(Window.partitionBy("shard").orderBy("node", "vector")) - 1
        number = F.col("first") + F.pmod(F.xxhash64(F.col("ids")[0], "dim"), F.col("n")).cast("int")
        nodes = nodes.join(lengths, "dim").select(number.alias("shard"), F.col("ids")[0].alias("node"), "vector", "ids", F.lit(keep).alias("keep"))
        nodes = written(nodes.withColumn("place", place), "placed")
        graph = written(nodes.groupBy("shard").applyInArrow(_start, GRAPH), "graph")
        total = nodes.count()
        for _ in range(ROUNDS if total > 1 else 0):
            out = graph.select("shard", "place", F.posexplode("near").alias("rank", "other"))
            # neighbours and the nearest of those that name this node a neighbour
            back = out.where(F.col("rank") < REVERSE).groupBy("shard", F.col("other").alias("place")).agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", F.col("place").alias("p")))), 1, REVERSE).alias("back"))
            around = graph.join(back, ["shard", "place"], "left").select("shard", "place", "near", F.array_union("near", F.coalesce(F.transform("back", lambda x: x["p"]), F.array().cast("array<int>"))).alias("around"))
            around = written(around, "around")
            hop = around.select("shard", F.col("place").alias("from"), F.explode("around").alias("place")).join(around.select("shard", "place", "around"), ["shard", "place"])
            met = hop.groupBy("shard", F.col("from").alias("place")).agg(F.array_distinct(F.flatten(F.collect_list("around"))).alias("met"))
            met = around.select("shard", "place", "near").join(met, ["shard", "place"], "left").select("shard", "place", "near", F.coalesce("met", F.array().cast("array<int>")).alias("met"))
            graph = written(met.groupBy("shard").cogroup(nodes.groupBy("shard")).applyInArrow(_improve, GRAPH), "graph")
            if (graph.agg(F.sum("changed")).first()[0] or 0) <= STILL * NEIGHBOURS * total:
                break
        return written(nodes.join(graph.select("shard", "place", "near"), ["shard", "place"]), "index", keep=True)


def search(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for (query_id, vector)."""
    kept = index.agg(F.min("keep")).first()[0]
    if kept is not None and k >= kept:
        raise ValueError(f"the index was built for up to {kept - 1} neighbours, not {k}")
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where(sound(F.col("vector")) & F.col("query_id").isNotNull()).groupBy("query_id").agg(F.min("vector").alias("vector"))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int"))
    # a row for each shard: its number and the length of its vectors
    shards = index.select((F.col("shard") + 0).alias("shard"), F.size("vector").alias("dim")).distinct()
    q = q.withColumn("dim", F.size("vector")).join(shards, "dim").drop("dim")
    blocks = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    found = q.groupBy("shard", "block").cogroup(blocks.groupBy("shard", "block")).applyInArrow(_search(k), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, rows_of: DataFrame, queries: DataFrame, k: int = 5) -> float:
    """The part of the true ``k`` nearest of the rows (vec_id, vector), by brute force, that ``found`` holds; for tests."""
    rows = {r.query_id: set(r.ids) for r in found.groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect()}
    asked = [(r.query_id, np.array(r.vector)) for r in queries.collect()]
    all_rows = [(r.vec_id, np.array(r.vector)) for r in rows_of.collect()]
    ids, m = np.array([i for i, _ in all_rows]), np.array([v for _, v in all_rows])
    norm, hit, total = np.linalg.norm(m, axis=1), 0, 0
    for qid, q in asked:
        s = np.where(ids == qid, -np.inf, (m @ q) / (norm * np.linalg.norm(q)))
        true = ids[np.lexsort((ids, -s))[:k]]
        hit, total = hit + len(rows.get(qid, set()) & set(true.tolist())), total + len(true)
    return hit / max(total, 1)
