"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Vectors go to the shard of their nearest centroid; a shard too large for a task is split into parts. Each part is a graph
of its own, built in one task: vectors come in batches, find their neighbours among those before them by a beam search
from the top layer down, and among their batch by comparison, and keep the ones that lie in different directions. A graph
is stored as flat neighbour arrays, a row per vector: its place, its level and the places of its neighbours, layer after
layer, filled up to a fixed width with -1.

Queries search the parts of their nearest shards, and what the parts return is merged. How many shards are probed, and how
wide the beam is, is chosen by measurement: drawn queries are compared with all vectors by brute force, and the first of
EFFORTS whose mean recall reaches ENOUGH is taken for all queries; the last probes every shard. Should even that stay below
EXACT_BELOW, or a query find fewer than asked for, these queries are compared with all vectors, a block at a time. The
measured recall is logged and returned.

Scores are cosines of the original vectors in double precision, summed in order, so that equal vectors have equal scores;
ties go to the smaller vec_id. Equal vectors are one node of a graph that carries its least vec_ids, as many as a query can
return, so a very common vector is searched and stored once.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; nor do rows without
vec_id; vectors only meet ones of as many dimensions; rows that repeat vec_id and vector count once, and ones that share a
vec_id only are candidates of each other; where there are fewer candidates, all are returned; no rows, or no queries, give
no rows; other columns are ignored. vec_id is an integer.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .flat_graph import centroids, unit
from .shared import stored

log = logging.getLogger(__name__)

#: Vectors for each shard on average, most of a part, most shards, and the vectors and their entries that centroids are fitted on.
PER_SHARD, PART, MOST_SHARDS, SAMPLE, SAMPLE_ENTRIES = 4000, 8000, 4096, 20_000, 4_000_000
#: Neighbours of a vector in the layers above the lowest, which has twice as many; the beam it is built with.
LINKS, BUILD_BEAM, BATCH = 16, 64, 256
#: Shards to probe (None: all) and beams to search with, the least first.
EFFORTS: tuple[tuple[int | None, int], ...] = ((4, 64), (16, 128), (None, 128), (None, 256), (None, 512))
#: Queries whose recall is measured, at most; the mean recall to reach, and the one below which all vectors are compared.
AUDITED, ENOUGH, EXACT_BELOW = 256, 0.96, 0.92
#: Queries compared with all vectors at a time, and queries that a task searches a part for.
BLOCK, CHUNK = 2000, 4000


# ---- one graph, in one task


@dataclass
class Graph:
    """x: unit vectors, those of higher levels first; links[l]: places of each one's neighbours in layer l, or -1, for the
    vectors that reach the layer."""

    x: np.ndarray
    links: list[np.ndarray]

    def search(self, q: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the k nearest found for each of q, nearest first; -1 where there are fewer."""
        at = np.zeros((len(q), 1), np.int64)
        for layer in range(len(self.links) - 1, 0, -1):
            at, _ = spread(q, self.x, self.links[layer], at, 1)
        at, sims = spread(q, self.x, self.links[0], at, max(beam, k))
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(at, order, 1), np.take_along_axis(sims, order, 1)


def spread(q: np.ndarray, x: np.ndarray, links: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """A beam search of a layer for many queries at once: in each round every query opens the best places of its beam that
    it hasn't opened yet. start: places to begin with, a row per query. Returns places (-1: none) and similarities."""
    n, width = len(x), min(4, beam)
    met = np.zeros(len(q) * n, bool)
    line = np.arange(len(q))[:, None]
    places, sims = start, np.where(start >= 0, np.einsum("rid,rd->ri", x[start], q), -np.inf).astype(np.float32)
    met[(line * n + start)[start >= 0]] = True
    opened = start < 0
    live = np.arange(len(q))
    while len(live):
        waiting = np.where(opened[live], -np.inf, sims[live])
        w = min(width, waiting.shape[1])
        pick = np.argpartition(-waiting, w - 1, axis=1)[:, :w]
        good = np.take_along_axis(waiting, pick, 1) > -np.inf
        going = good.any(1)
        live, pick, good = live[going], pick[going], good[going]
        if not len(live):
            break
        opened[live[:, None], pick] = True
        around = links[places[live[:, None], pick]]
        around[~good] = -1
        row = np.broadcast_to(live[:, None, None], around.shape)
        flat = (row * n + around)[around >= 0]
        flat = np.unique(flat[~met[flat]])
        if not len(flat):
            continue
        met[flat] = True
        row, to = flat // n, flat % n
        found = np.einsum("id,id->i", x[to], q[row])
        counts = np.bincount(row, minlength=len(q))
        column = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        wide = int(counts.max())
        more, similar = np.full((len(q), wide), -1, np.int64), np.full((len(q), wide), -np.inf, np.float32)
        more[row, column], similar[row, column] = to, found
        places, sims = np.concatenate((places, more), 1), np.concatenate((sims, similar), 1)
        opened = np.concatenate((opened, more < 0), 1)
        if places.shape[1] > beam:
            best = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            places, sims, opened = (np.take_along_axis(a, best, 1) for a in (places, sims, opened))
    return places, sims


def diverse(q: np.ndarray, x: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of the places near each of q (-1: none), up to `most`: nearest first, those no nearer to one taken before than to q;
    then the nearest of the others."""
    sims = np.where(near >= 0, np.einsum("rid,rd->ri", x[near], q), -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    among = np.einsum("rid,rjd->rij", x[near], x[near])
    free, taken, line = near >= 0, np.zeros(near.shape, bool), np.arange(len(near))
    for _ in range(min(most, near.shape[1])):
        pick = free.argmax(1)
        some = free[line, pick]
        if not some.any():
            break
        taken[line[some], pick[some]] = True
        free &= ~((among[line, pick] >= sims) & some[:, None])
        free[line, pick] = False
    rank = np.where(taken, 0, np.where(near >= 0, 1, 2))
    best = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(near, best, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _add(links: np.ndarray, x: np.ndarray, of: np.ndarray, new: np.ndarray) -> None:
    """The edges of -> new (a row of places each, -1: none) and back; a list that grows too long is pruned."""
    cap = links.shape[1]
    links[of, : new.shape[1]] = new
    back, to = np.repeat(of, new.shape[1]), new.ravel()
    back, to = back[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    back, to = back[order], to[order]
    targets, counts = np.unique(to, return_counts=True)
    column = np.arange(len(to)) - np.repeat(np.cumsum(counts) - counts, counts)
    more = np.full((len(targets), int(counts.max(initial=0))), -1, np.int64)
    more[np.repeat(np.arange(len(targets)), counts), column] = back
    every = np.concatenate((links[targets], more), 1)
    known = np.sort(every, 1)  # an edge may come from both ends
    twice = np.zeros(known.shape, bool)
    twice[:, 1:] = (known[:, 1:] == known[:, :-1]) & (known[:, 1:] >= 0)
    known[twice] = -1
    known = np.take_along_axis(known, np.argsort(known < 0, axis=1, kind="stable"), 1)
    many = (known >= 0).sum(1) > cap
    links[targets[~many]] = np.pad(known[~many], ((0, 0), (0, max(0, cap - known.shape[1]))), constant_values=-1)[:, :cap]
    for a in range(0, int(many.sum()), BATCH):
        some = np.flatnonzero(many)[a : a + BATCH]
        links[targets[some]] = diverse(x[targets[some]], x, known[some], cap)


def levels(ids: np.ndarray) -> np.ndarray:
    """A level for each id, by hash: a share of 1/LINKS of one layer reaches the next."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    even = ((h >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.floor(-np.log(even) / np.log(LINKS)).astype(np.int64)


def build(x: np.ndarray, level: np.ndarray) -> Graph:
    """The graph of x, whose levels fall."""
    n, top = len(x), int(level[0])
    reach = [int((level >= layer).sum()) for layer in range(top + 1)]
    links = [np.full((reach[layer], LINKS * (1 + (layer == 0))), -1, np.int64) for layer in range(top + 1)]
    a = 1
    while a < n:
        b = min(n, a + min(a, BATCH))
        q, at = x[a:b], np.zeros((b - a, 1), np.int64)
        inside = q @ q.T
        for layer in range(top, -1, -1):
            mine = min(b, reach[layer]) - a  # of the batch, those that reach this layer come first
            at, sims = spread(q, x[: min(a, reach[layer])], links[layer][:a], at, BUILD_BEAM if mine > 0 else 1)
            if mine > 0:
                mates = np.where(np.tri(mine, k=-1, dtype=bool), inside[:mine, :mine], -np.inf)
                near = np.argsort(-mates, axis=1, kind="stable")[:, : 2 * LINKS]
                near = np.where(np.take_along_axis(mates, near, 1) > -np.inf, near + a, -1)
                best = np.take_along_axis(at[:mine], np.argsort(-sims[:mine], axis=1, kind="stable"), 1)
                _add(links[layer], x, np.arange(a, a + mine), diverse(q[:mine], x, np.concatenate((best, near), 1), LINKS))
            if layer:
                at = np.take_along_axis(at, sims.argmax(1)[:, None], 1)
        a = b
    return Graph(x, links)


# ---- graphs as rows

INDEX = "shard int, part int, place int, node long, vector array<double>, members array<long>, links array<int>"


def _built(t: pa.Table) -> pa.Table:
    """The rows of one part's graph."""
    ids = t.column("node").to_numpy()
    level = levels(ids)
    order = np.lexsort((ids, -level))
    t, ids, level = t.take(pa.array(order)), ids[order], level[order]
    graph = build(unit(t.column("vector").to_pylist()).astype(np.float32), level)
    flat = [np.concatenate([graph.links[layer][i] for layer in range(level[i] + 1)]).astype(np.int32) for i in range(len(ids))]
    return pa.table({"shard": t.column("shard"), "part": t.column("part"), "place": pa.array(np.arange(len(ids), dtype=np.int32)), "node": t.column("node"), "vector": t.column("vector"), "members": t.column("members"), "links": pa.array(flat, pa.list_(pa.int32()))})


def _read(t: pa.Table) -> tuple[pa.Table, Graph]:
    t = t.sort_by("place")
    rows = t.column("links").to_pylist()
    links, at = [], 0
    while some := [r[at : at + LINKS * (1 + (at == 0))] for r in rows if len(r) > at]:
        links.append(np.array(some, np.int64))
        at += links[-1].shape[1]
    return t, Graph(unit(t.column("vector").to_pylist()).astype(np.float32), links)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, summed in the order of the dimensions."""
    total = lambda x: np.add.accumulate(x, axis=1)[:, -1]
    with np.errstate(all="ignore"):
        both = total(a * a) * total(b * b)
        out = total(a * b) / np.sqrt(both)
    odd = ~((both > 1e-280) & (both < 1e300))  # squares too large or too small for doubles
    if odd.any():
        out[odd] = total(unit(a[odd]) * unit(b[odd]))
    return np.clip(out, -1.0, 1.0)


HITS = "query long, vec_id long, score double"


def _best(query: np.ndarray, ids: list[list[int]], score: np.ndarray, k: int) -> pa.Table:
    """HITS: of each query the k best members of what it found."""
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    query, score, ids = np.repeat(query, size), np.repeat(score, size), np.array([i for m in ids for i in m], np.int64)
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    return pa.table({"query": query[rank < k], "vec_id": ids[rank < k], "score": score[rank < k]})


def indexed(nodes: DataFrame, c: np.ndarray) -> DataFrame:
    """INDEX of nodes (node, vector, members), by the centroids c."""
    sent = nodes.sparkSession.sparkContext.broadcast(c)  # MOST_SHARDS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                shard = (unit(b.column(1).to_pylist()) @ sent.value.T).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], names=["node", "vector", "members", "shard"])

    put = stored(nodes.select("node", "vector", "members").mapInArrow(run, "node long, vector array<double>, members array<long>, shard int"), "hnsw-shards")
    parts = put.groupBy("shard").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))  # MOST_SHARDS rows
    dealt = put.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts")
    return stored(dealt.groupBy("shard", "part").applyInArrow(_built, INDEX), "hnsw-index")


def probed(queries: DataFrame, c: np.ndarray, probes: int | None) -> DataFrame:
    """queries (node, vector) with each of their nearest shards."""
    sent = queries.sparkSession.sparkContext.broadcast(c)
    k = min(probes or len(c), len(c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), BATCH):
                some = b.slice(at, BATCH)
                near = np.argsort(-(unit(some.column(1).to_pylist()) @ sent.value.T), axis=1, kind="stable")[:, :k]
                rows = pa.array(np.repeat(np.arange(len(some)), k))
                yield pa.RecordBatch.from_arrays([some.column(0).take(rows), some.column(1).take(rows), pa.array(near.ravel().astype(np.int32))], names=["query", "vector", "shard"])

    return queries.select("node", "vector").mapInArrow(run, "query long, vector array<double>, shard int")


def searched(index: DataFrame, asked: DataFrame, beam: int, k: int) -> DataFrame:
    """HITS of asked (query, vector, shard) in the graphs of their shards: k for each part at most."""
    asked = stored(asked, "hnsw-asked")
    load = asked.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))  # MOST_SHARDS rows
    parts = index.groupBy("shard").agg((F.max("part") + 1).alias("parts"))
    dealt = F.broadcast(load.join(parts, "shard"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    graphs = index.join(dealt, "shard").select(*index.columns, every("chunks").alias("chunk"))
    asks = asked.join(dealt, "shard").select("query", "vector", "shard", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int").alias("chunk"), every("parts").alias("part"))

    def run(graph: pa.Table, asks: pa.Table) -> pa.Table:
        if not len(graph) or not len(asks):
            return _best(np.empty(0, np.int64), [], np.empty(0), k)
        t, g = _read(graph)
        x, members, out = np.array(t.column("vector").to_pylist()), t.column("members").to_pylist(), []
        for at in range(0, len(asks), BATCH):
            some = asks.slice(at, BATCH)
            q = some.column("vector").to_pylist()
            places, _ = g.search(unit(q).astype(np.float32), beam, k)
            row, column = np.nonzero(places >= 0)
            to = places[row, column]
            out.append(_best(some.column("query").to_numpy()[row], [members[i] for i in to], cosines(np.array(q)[row], x[to]), k))
        return pa.concat_tables(out)

    keys = ("shard", "part", "chunk")
    return graphs.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(run, HITS)


def compared(nodes: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """HITS of a block of queries by comparing all nodes: k of each batch of nodes at most."""
    sent = nodes.sparkSession.sparkContext.broadcast((ids, q, unit(list(q))))  # BLOCK vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, u = sent.value
        for whole in batches:
            for at in range(0, len(whole), 4096):
                b = whole.slice(at, 4096)
                x, members = np.array(b.column(0).to_pylist()), b.column(1).to_pylist()
                sims = u @ unit(list(x)).T
                most = min(k + 2, len(x))  # products may be off by the last bits
                near = np.argpartition(-sims, most - 1, axis=1)[:, :most]
                row = np.repeat(np.arange(len(own)), most)
                for a in range(0, len(row), 4096):
                    r, to = row[a : a + 4096], near.ravel()[a : a + 4096]
                    yield from _best(own[r], [members[i] for i in to], cosines(q[r], x[to]), k + 2).to_batches()

    return nodes.select("vector", "members").mapInArrow(run, HITS)


def merged_hits(hits: DataFrame, k: int) -> DataFrame:
    """query, found: the k best (score, vec_id) of each query, best first."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = hits.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))


def _vectors(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = rows.select("node", "vector").toArrow()
    return t.column("node").to_numpy(), np.array(t.column("vector").to_pylist(), np.float64)


def _one_size(nodes: DataFrame, queries: DataFrame, size: int, k: int) -> tuple[DataFrame, float]:
    """query, found of the queries (node, vector) among nodes (node, vector, members) of one number of dimensions."""
    count, asked = nodes.count(), queries.count()
    _, sample = _vectors(nodes.orderBy(F.xxhash64("node"), "node").limit(min(SAMPLE, max(256, SAMPLE_ENTRIES // size))))
    c = centroids(unit(list(sample)), int(min(MOST_SHARDS, max(1, count // PER_SHARD), len(sample))))
    index = indexed(nodes, c)
    drawn = stored(queries.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(AUDITED), "hnsw-drawn")
    # AUDITED rows; a query itself is always found and isn't counted
    plain = lambda hits: {r.query: set([x.vec_id for x in r.found if x.vec_id != r.query][: k - 1]) for r in merged_hits(hits, k).collect()}
    truth = plain(compared(nodes, *_vectors(drawn), k))
    recall, efforts = 0.0, [e for e in EFFORTS if e[0] is None or e[0] < len(c)]
    for probes, beam in efforts:
        got = plain(searched(index, probed(drawn, c, probes), beam, k))
        recall = float(np.mean([len(got.get(i, set()) & t) / len(t) if t else 1.0 for i, t in truth.items()]))
        log.info("recall %.4f of %d of %d queries over %d vectors, %s of %d shards, beam %d", recall, len(truth), asked, count, probes or "all", len(c), beam)
        if recall >= ENOUGH:
            break
    found = stored(merged_hits(searched(index, probed(queries, c, probes), beam, k), k), "hnsw-found")
    if recall < EXACT_BELOW:
        log.warning("recall %.4f is below %.2f: comparing %d queries with all vectors", recall, EXACT_BELOW, asked)
        found, rest, recall = found.where("false"), queries, 1.0
    else:  # a graph's part may hold fewer than asked for
        full = found.where(F.size("found") >= k).select(F.col("query").alias("node"))
        rest = stored(queries.join(full, "node", "left_anti"), "hnsw-short")
        found = found.where(F.size("found") >= k)
    n = rest.count()
    blocks = -(-n // BLOCK)
    for b in range(blocks):
        block = rest.where(F.pmod(F.xxhash64("node", F.lit(4)), F.lit(blocks)) == b)
        found = found.unionByName(stored(merged_hits(compared(nodes, *_vectors(block), k), k), "hnsw-exact"))
    return found, recall


def nearest(vectors: DataFrame, asks: Column, k: int = 5) -> tuple[DataFrame, float]:
    """vectors: vec_id, embedding; asks: which rows are queries. Returns query_id, rank, vec_id, score and the least recall
    measured (1 where there is nothing to find)."""
    rows = vectors.withColumn("_asks", F.coalesce(asks, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("_asks").alias("asks"))
    fine = "vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0 AND forall(vector, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')) AND exists(vector, v -> v <> 0)"
    good = rows.where(fine).withColumn("size", F.size("vector")).withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit("again"), "vector")})
    same = ["size", "h1", "h2"]
    least = good.groupBy(*same, "vec_id").agg(F.max("asks").alias("asks")).withColumn("i", F.row_number().over(Window.partitionBy(*same).orderBy("vec_id"))).where(F.col("i") <= k + 1)
    members = least.groupBy(*same).agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    classes = good.groupBy(*same).agg(F.first("vector").alias("vector"), F.min("vec_id").alias("node"), F.max("asks").alias("asks"))
    nodes = stored(classes.join(members, same), "hnsw-nodes")
    mine = stored(good.where("asks").select("vec_id", *same).distinct().join(nodes.select(*same, "node"), same).select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"), "size"), "hnsw-queries")
    out, recall = None, 1.0
    for (size,) in nodes.where("asks").select("size").distinct().orderBy("size").collect():
        own = nodes.where(F.col("size") == size)
        spread_out = stored(own.repartition(max(own.sparkSession.sparkContext.defaultParallelism, own.count() // 10_000), "node"), "hnsw-own")
        found, here = _one_size(spread_out, spread_out.where("asks").select("node", "vector"), size, k + 1)
        found, recall = found.withColumn("size", F.lit(size)), min(recall, here)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double"), recall
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = mine.join(out, ["query", "size"]).select("query_id", F.posexplode(others).alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"), recall
