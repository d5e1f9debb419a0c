"""Embedding near-duplicates: a robust-pruned flat graph over overlapping shards, range-expanding search, exact links.

Equal vectors are one node with a multiplicity. Nodes go to the few shards whose centroids are nearest; each shard builds a
graph whose edges are pruned so that they point in different directions; the edge lists a node has in all its shards are
united; then every node is searched for in its shards, greedily from the medoid, and everything within range is expanded
until nothing new is in range. Pairs found are verified by cosine in double precision. An audit compares a stated set of
queries with brute force, by node, and the overlap is doubled until the audit meets its target; where it never does, all
nodes are compared in blocks.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pinned
from .components import connected_components

THRESHOLD = 0.9
# Centroids are fitted on at most so many vectors, taken by hash; all vectors are indexed.
SAMPLE = 20_000
SHARD_ROWS, BLOCK_ROWS = 512, 1_024
OVERLAP, MOST_OVERLAP = 4, 32
CANDIDATES, DEGREE, ALPHA, BEAM = 48, 16, 1.2, 24
QUERIES_AT_ONCE = 256
AUDIT_QUERIES, AUDIT_RECALL = 400, 0.97
# Nodes with more links than this are audited apart, so that a crowd cannot hide lost pairs.
FEW_LINKS = 8


def usable(vector: Column) -> Column:
    """Neither NULL nor zero, with finite components only."""
    big = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(vectors) -> np.ndarray:
    """Rows of length 1 in double precision; scaled by the greatest component first, so that no square overflows."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x: np.ndarray, number: int, rounds: int = 4) -> np.ndarray:
    """Spherical k-means from evenly spaced starting rows."""
    c = x[np.linspace(0, len(x) - 1, number).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(x[a : a + 4096] @ c.T, axis=1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, nearest, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(length > 0, total / np.maximum(length, 1e-30), c)
    return c


def robust_prune(similarity: np.ndarray) -> list[np.ndarray]:
    """Neighbours of every row: nearest first, leaving out any that a chosen one is ALPHA times nearer to."""
    n = len(similarity)
    k = min(CANDIDATES, n - 1)
    if k < 1:
        return [np.zeros(0, np.int64) for _ in range(n)]
    own = similarity.copy()
    np.fill_diagonal(own, -np.inf)
    candidates = np.argpartition(-own, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(own, candidates, axis=1)
    order = np.argsort(-near, axis=1, kind="stable")
    candidates, near = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(near, order, axis=1)
    open_ = np.ones(candidates.shape, bool)
    chosen = np.full((n, DEGREE), -1, dtype=np.int64)
    rows = np.arange(n)
    for d in range(min(DEGREE, k)):
        first = np.argmax(open_, axis=1)
        alive = open_[rows, first]
        pick = candidates[rows, first]
        chosen[alive, d] = pick[alive]
        covered = ALPHA * (1 - similarity[pick[:, None], candidates]) <= 1 - near
        open_ &= ~covered
        open_[rows, first] = False
    back: list[list[int]] = [[] for _ in range(n)]
    for i, j in zip(np.repeat(rows, DEGREE), chosen.ravel()):
        if j >= 0 and len(back[j]) < DEGREE:
            back[j].append(i)
    return [np.unique(np.concatenate([c[c >= 0], np.array(b, dtype=np.int64)])) for c, b in zip(chosen, back)]


def range_search(x: np.ndarray, graph: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows each row finds within range, as a boolean matrix; `graph` is padded with -1.

    A beam walks greedily from the medoid towards the query. Then every row in range, the query's own included, is expanded,
    and so is whatever comes into range, until nothing new does.
    """
    n, width = len(x), graph.shape[1]
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    out = np.zeros((n, n), bool)
    for a in range(0, n, QUERIES_AT_ONCE):
        q = np.arange(a, min(n, a + QUERIES_AT_ONCE))
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n), bool)
        seen[:, medoid] = True
        beam = np.full((len(q), BEAM), -1, dtype=np.int64)
        score = np.full((len(q), BEAM), -np.inf)
        done = np.ones((len(q), BEAM), bool)
        beam[:, 0], score[:, 0], done[:, 0] = medoid, x[q] @ x[medoid], False
        hits = np.zeros((len(q), n), bool)
        hits[:, medoid] = score[:, 0] >= threshold
        for _ in range(4 * BEAM):
            ready = np.where(done, -np.inf, score)
            best = np.argmax(ready, axis=1)
            alive = ready[rows, best] > -np.inf
            if not alive.any():
                break
            done[rows[alive], best[alive]] = True
            next_ = graph[np.where(alive, beam[rows, best], 0)]
            fresh = (next_ >= 0) & alive[:, None] & ~seen[rows[:, None], next_]
            r, c = np.nonzero(fresh)
            to = next_[r, c]
            value = np.full(next_.shape, -np.inf)
            value[r, c] = np.einsum("ij,ij->i", x[q[r]], x[to])
            seen[r, to] = True
            close = value[r, c] >= threshold
            hits[r[close], to[close]] = True
            all_score = np.concatenate([score, value], axis=1)
            all_beam = np.concatenate([beam, next_], axis=1)
            all_done = np.concatenate([done, ~fresh], axis=1)
            top = np.argsort(-all_score, axis=1, kind="stable")[:, :BEAM]
            score, beam, done = (np.take_along_axis(z, top, axis=1) for z in (all_score, all_beam, all_done))
        hits[rows, q] = True
        seen[rows, q] = True
        edge_r, edge_c = np.nonzero(hits)
        while len(edge_r):
            to = graph[edge_c]
            r = np.repeat(edge_r, width)
            flat = to.ravel()
            keep = flat >= 0
            r, flat = r[keep], flat[keep]
            new = ~seen[r, flat]
            code = np.unique(r[new] * n + flat[new])
            r, flat = code // n, code % n
            seen[r, flat] = True
            close = np.einsum("ij,ij->i", x[q[r]], x[flat]) >= threshold
            edge_r, edge_c = r[close], flat[close]
            hits[edge_r, edge_c] = True
        out[q] = hits
    return out | out.T


def _shards_of(center: np.ndarray, overlap: int):
    def assign(vectors: pd.Series) -> pd.Series:
        out = []
        for a in range(0, len(vectors), 2048):
            near = unit_rows(vectors.iloc[a : a + 2048]) @ center.T
            k = min(overlap, near.shape[1])
            out.extend(np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1).astype(np.int32).tolist())
        return pd.Series(out)

    return F.pandas_udf(assign, "array<int>")


def _units(nodes: DataFrame) -> DataFrame:
    """One row per node and unit. A shard of more than BLOCK_ROWS nodes is cut into blocks, a unit for every two blocks."""
    shard = nodes.withColumn("shard", F.explode("shards"))
    sizes = pinned(shard.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least(other, F.col("own")).alias("i"), F.greatest(other, F.col("own")).alias("j")))
    return (
        shard.join(sizes, "shard").withColumn("own", own).withColumn("unit", F.explode(pairs))
        .withColumns({"i": F.col("unit.i"), "j": F.col("unit.j")}).drop("unit", "blocks")
    )


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id").reset_index(drop=True)
    x, ids = unit_rows(rows["vector"]), rows["id"].to_numpy()
    lists = robust_prune(x @ x.T)
    return pd.DataFrame({"id": ids, "near": [ids[near].tolist() for near in lists]})


def _search(threshold: float, exact: bool = False):
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        x, ids = unit_rows(rows["vector"]), rows["id"].to_numpy()
        own, times = rows["own"].to_numpy(), rows["n"].to_numpy()
        shards, here = np.array(rows["shards"].tolist()), int(rows["shard"].iloc[0])
        lists = []
        for near in rows["near"]:
            at = np.searchsorted(ids, np.asarray(near, dtype=np.int64)).clip(max=len(ids) - 1)
            lists.append(at[ids[at] == np.asarray(near, dtype=np.int64)])
        graph = np.full((len(ids), max(1, max(map(len, lists)))), -1, dtype=np.int64)
        for k, near in enumerate(lists):
            graph[k, : len(near)] = near
        a, b = np.nonzero(np.triu(x @ x.T >= threshold if exact else range_search(x, graph, threshold), 1))
        if rows["i"].iloc[0] != rows["j"].iloc[0]:
            cross = own[a] != own[b]
            a, b = a[cross], b[cross]
        keep = np.zeros(len(a), bool)
        for s in range(0, len(a), 100_000):
            p = slice(s, s + 100_000)
            # Two nodes that meet in several shards are counted in the first of them only.
            met = (shards[a[p]][:, :, None] == shards[b[p]][:, None, :]) & (shards[a[p]][:, :, None] < here)
            keep[p] = ~met.any(axis=(1, 2))
        weight = np.zeros(len(ids), dtype=np.int64)
        np.add.at(weight, a[keep], times[b[keep]])
        np.add.at(weight, b[keep], times[a[keep]])
        root = np.arange(len(ids))
        links = [[] for _ in ids]
        for i, j in zip(a.tolist(), b.tolist()):
            links[j].append(i)
        for j, lower in enumerate(links):
            if lower:
                joined = np.unique(np.append(root[lower], root[j]))
                if len(joined) > 1:
                    root[np.isin(root, joined[1:])] = joined[0]
        use = np.flatnonzero((weight > 0) | (root != np.arange(len(ids))))
        return pd.DataFrame({"a": ids[use], "b": ids[root[use]], "weight": weight[use]})

    return search


def _search_once(nodes: DataFrame, center: np.ndarray, overlap: int, threshold: float) -> DataFrame:
    """Rows `a`, `b`, `weight`: links of a node found in a unit, weighed, and the node's root among the unit's links."""
    spread = pinned(nodes.withColumn("shards", _shards_of(center, overlap)("vector")))
    graphs = _units(spread.select("id", "vector", "shards")).groupBy("shard", "i", "j").applyInPandas(
        _build, "id long, near array<long>")
    united = pinned(graphs.groupBy(F.col("id").alias("of")).agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    linked = spread.join(united, spread["id"] == united["of"]).drop("of")
    return pinned(_units(linked).groupBy("shard", "i", "j").applyInPandas(
        _search(threshold), "a long, b long, weight long"))


def _compare_all(nodes: DataFrame, threshold: float) -> DataFrame:
    """As `_search_once`, but exact: one shard of all nodes, every two of its blocks compared. Quadratic work, in bounded tasks."""
    whole = nodes.withColumns({"shards": F.array(F.lit(0)), "near": F.array().cast("array<long>")})
    return pinned(_units(whole).groupBy("shard", "i", "j").applyInPandas(
        _search(threshold, exact=True), "a long, b long, weight long"))


def _audit(nodes: DataFrame, found: DataFrame, threshold: float) -> float:
    """Recall on AUDIT_QUERIES nodes taken by hash, by brute force against all nodes.

    A node's recall is the share of its links that were found. It is averaged over the nodes with at most FEW_LINKS links
    and over the others; the lesser mean counts. Nodes without a link say nothing.
    """
    queries = nodes.orderBy(F.xxhash64(F.lit("audit"), "id"), "id").limit(AUDIT_QUERIES).select("id", "vector").toPandas()
    q, ids = unit_rows(queries["vector"]), queries["id"].to_numpy()

    def count(batches):
        total = np.zeros(len(ids), dtype=np.int64)
        for rows in batches:
            if len(rows):
                close = q @ unit_rows(rows["vector"]).T >= threshold
                close &= ids[:, None] != rows["id"].to_numpy()[None, :]
                total += close @ rows["n"].to_numpy()
        yield pd.DataFrame({"a": ids, "weight": total})

    real = nodes.select("id", "vector", "n").mapInPandas(count, "a long, weight long").groupBy("a").agg(F.sum("weight").alias("real"))
    got = found.groupBy("a").agg(F.sum("weight").alias("got"))
    recall = F.least(F.col("real"), F.coalesce("got", F.lit(0))) / F.col("real")
    means = real.where("real > 0").join(got, "a", "left").agg(*[
        F.avg(F.when((F.col("real") <= FEW_LINKS) == F.lit(few), recall)) for few in (True, False)]).first()
    return min((m for m in means if m is not None), default=1.0)


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """Links and component of every vector.

    Output: the id, `n_links` (other vectors with cosine of at least `threshold`), `component_id` (smallest id reachable by
    links), `kept` (whether it is its own component's smallest). NULL and zero vectors and those with NULL or non-finite
    components link with nothing, and vectors of different length do not link. Equal vectors link with each other. A row
    with a NULL id counts as a copy but names no component. An empty table gives no rows; extra columns are not read.
    """
    rows = pinned(vectors.select(
        F.col(id_column).alias("id"), F.col(vector_column).alias("vector"), usable(F.col(vector_column)).alias("good"),
        F.xxhash64(F.col(vector_column)).alias("k1"), F.xxhash64(F.lit(1), F.col(vector_column)).alias("k2")))
    nodes = pinned(rows.where("good").groupBy("k1", "k2").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.any_value("vector").alias("vector"))
        .withColumn("length", F.size("vector")))
    found = None
    for row in nodes.where("id IS NOT NULL").groupBy("length").count().orderBy("length").collect():
        part = nodes.where((F.col("length") == row["length"]) & F.col("id").isNotNull())
        sample = part.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toPandas()["vector"]
        center = centroids(unit_rows(sample), max(1, min(len(sample) // 8, -(-row["count"] // SHARD_ROWS))))
        overlap = OVERLAP
        links = _search_once(part, center, overlap, threshold)
        while _audit(part, links, threshold) < AUDIT_RECALL:
            if overlap >= min(MOST_OVERLAP, len(center)):
                links = _compare_all(part, threshold)
                break
            overlap *= 2
            links = _search_once(part, center, overlap, threshold)
        found = links if found is None else found.unionByName(links)
    spark = vectors.sparkSession
    if found is None:
        found = spark.createDataFrame([], "a long, b long, weight long")
    weights = found.groupBy(F.col("a").alias("of")).agg(F.sum("weight").alias("weight"))
    parts = connected_components(found)
    classes = pinned(
        nodes.select("k1", "k2", F.col("id").alias("node_id"), "n")
        .join(weights, F.col("node_id") == F.col("of"), "left").join(parts, F.col("node_id") == F.col("node"), "left")
        .select("k1", "k2", (F.coalesce("weight", F.lit(0)) + F.col("n") - 1).alias("links"),
                F.coalesce("component", "node_id").alias("component")))
    known = rows.where("good").select("id", "k1", "k2").join(classes, ["k1", "k2"]).select(
        "id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("NOT good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return known.unionByName(alone).select(
        F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
