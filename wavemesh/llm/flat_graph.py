"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors go to the shards of their nearest centroids, so that shards overlap; a shard too large for a task is split into
salted parts. In each part a graph is built whose edges are pruned robustly (an edge goes if a kept neighbour is much
nearer to its end), and a vector's adjacency lists from all its parts are united. Every vector then searches each part
of its shards: greedily from the part's medoids, and once it meets vectors in range, on over the in-range ones until
no more turn up. That tells which vectors have links, from either side. The links of these are verified by cosine in double
precision among all members of the shards they share, and counted at both ends, each in the first shard that both are in; a
pair is not emitted, only each vector's count and its component within the part. The links of vectors drawn by hash are
compared with brute force, vector by vector, until enough that have links are drawn, MOST_DRAWN at most; where the mean
share found is below LEAST_RECALL, everything is done again with more overlap, and where the widest stays below EXACT_BELOW,
all pairs are compared instead. Where few drawn vectors have links, there is more overlap from the start, and the log says
how little the audit has seen.

Equal vectors are searched once and counted as often as they occur, so a very common vector costs a row for each.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do ones
of another number of dimensions; rows that repeat a vec_id and vector are links of each other like other equal vectors,
and are returned each; a null vec_id has a null component and is linked with nothing; no rows give no rows; other
columns, such as labels, are ignored. vec_id is an integer.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import stored

log = logging.getLogger(__name__)

SIMILAR = 0.95
#: Vectors that a part's graph holds, and queries that a task searches it for.
PART = 4000
#: Vectors for each centroid, most centroids, and the vectors they are fitted on.
PER_CENTROID, MOST_CENTROIDS, SAMPLE = 1000, 4096, 20_000
#: Nearest neighbours that pruning chooses from, edges it keeps, how much nearer a neighbour has to be, and the search list.
CANDIDATES, EDGES, ALPHA, LIST, MEDOIDS = 48, 24, 1.2, 48, 8
#: Vectors drawn first to have their links compared with brute force, how many of all drawn have to have links, most that
#: are drawn, the mean share of these links to be found, and the one below which all pairs are compared.
AUDITED, LINKED, MOST_DRAWN, LEAST_RECALL, EXACT_BELOW = 256, 128, 4096, 0.95, 0.9
#: Vectors that are broadcast at a time to be compared with all others, and vectors compared with them at a time.
BLOCK, ROWS = 10_000, 256
OVERLAPS = (3, 6, 12)


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    # scaled first, so that squares of very large or small components stay finite
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the sample's first vectors, a few rounds."""
    c = sample[:k].copy()
    for _ in range(6):
        own = np.concatenate([(sample[i : i + 2000] @ c.T).argmax(1) for i in range(0, len(sample), 2000)])
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def adjacency(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbours of each vector, edges in both directions."""
    n = len(x)
    c = min(CANDIDATES, n - 1)
    out: list[list[int]] = [[] for _ in range(n)]
    if c < 1:
        return [np.empty(0, np.int64) for _ in range(n)]
    for a in range(0, n, 256):
        rows = np.arange(a, min(n, a + 256))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-sims, c - 1, axis=1)[:, :c]
        s = np.take_along_axis(sims, near, 1)
        order = np.argsort(-s, axis=1, kind="stable")
        near, s = np.take_along_axis(near, order, 1), np.take_along_axis(s, order, 1)
        to, among = 1 - s, 1 - np.einsum("rid,rjd->rij", x[near], x[near])
        alive = np.ones(near.shape, bool)
        line = np.arange(len(rows))
        for _ in range(EDGES):
            pick = alive.argmax(1)
            some = alive[line, pick]
            if not some.any():
                break
            for r in line[some]:
                out[rows[r]].append(int(near[r, pick[r]]))
            # squared chords are twice these distances, so alpha counts squared
            alive &= ~((ALPHA**2 * among[line, pick] <= to) & some[:, None])
            alive[line, pick] = False
    both = [set(o) for o in out]
    for u, o in enumerate(out):
        for v in o:
            if len(both[v]) < 3 * EDGES:
                both[v].add(u)
    return [np.fromiter(sorted(b), np.int64, len(b)) for b in both]


def medoids(x: np.ndarray) -> np.ndarray:
    """The vector nearest to the mean, and others far from those chosen before."""
    first = int((x @ x.mean(0)).argmax())
    chosen, nearest = [first], x @ x[first]
    while len(chosen) < min(MEDOIDS, len(x)):
        at = int(nearest.argmin())
        chosen.append(at)
        nearest = np.maximum(nearest, x @ x[at])
    return np.array(chosen)


def search(q: np.ndarray, x: np.ndarray, edges: list[np.ndarray], entries: np.ndarray, own: int | None = None) -> np.ndarray:
    """The places of x in range that a greedy search, then one over the vectors in range, meets. own: the place of q."""
    met = np.zeros(len(x), bool)
    met[entries] = True
    places, sims = entries, x[entries] @ q
    opened = np.zeros(len(entries), bool)
    while True:
        best = np.argsort(-sims, kind="stable")[:LIST]
        places, sims, opened = places[best], sims[best], opened[best]
        front = np.flatnonzero(~opened)[:4]
        if not len(front):
            break
        opened[front] = True
        fresh = np.unique(np.concatenate([edges[p] for p in places[front]]))
        fresh = fresh[~met[fresh]]
        if len(fresh):
            met[fresh] = True
            places, sims, opened = np.concatenate((places, fresh)), np.concatenate((sims, x[fresh] @ q)), np.concatenate((opened, np.zeros(len(fresh), bool)))
        if (sims[places != (-1 if own is None else own)] >= SIMILAR - 1e-9).any():
            break
    found = front_in = places[sims >= SIMILAR]
    done = np.zeros(len(x), bool)
    done[found] = True
    while len(front_in):
        around = np.unique(np.concatenate([edges[p] for p in front_in]))
        around = around[~done[around]]
        done[around] = True
        front_in = around[x[around] @ q >= SIMILAR]
        found = np.concatenate((found, front_in))
    return found


def _built(t: pa.Table) -> pa.Table:
    """The edges of a part: node, near."""
    ids = t.column("node").to_numpy()
    x = unit(t.column("vector").to_pylist())
    edges = adjacency(x)
    return pa.table({"node": pa.array(ids, pa.int64()), "near": pa.array([ids[e] for e in edges], pa.list_(pa.int64()))})


def _opened(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: ids, unit vectors, the places of the part's members and of the queries."""
    ids, x = t.column("node").to_numpy(), unit(t.column("vector").to_pylist())
    places = lambda c: np.flatnonzero(np.array(t.column(c).to_pylist(), bool))
    return ids, x, places("member"), places("asks")


def _searched(t: pa.Table) -> pa.Table:
    """The nodes that a search of the chunk's queries links, both ends of every pair found."""
    ids, x, mine, asks = _opened(t)
    place = {int(i): k for k, i in enumerate(ids[mine])}
    edges = [np.array(sorted({place[v] for v in near or () if v in place} - {k}), np.int64) for k, near in enumerate(t.column("near").take(pa.array(mine)).to_pylist())]
    base, linked = x[mine], np.zeros(len(ids), bool)
    entries = medoids(base) if len(base) else np.empty(0, np.int64)
    for a in asks if len(base) else ():
        own = place.get(int(ids[a]))
        found = mine[search(x[a], base, edges, entries if own is None else np.union1d(entries, [own]), own)]
        found = found[ids[found] != ids[a]]
        if len(found):
            linked[a] = linked[found] = True
    return pa.table({"node": pa.array(np.unique(ids[linked]), pa.int64())})


def _verified(t: pa.Table) -> pa.Table:
    """node, links, root: the links between the chunk's queries, which are linked nodes, and the part's members, by cosine.

    A pair that meets in several shards counts in the first. Between two linked nodes each one's search counts its own end;
    a node that no search linked doesn't ask, so the other end counts for both."""
    ids, x, mine, asks = _opened(t)
    shard, copies = t.column("shard")[0].as_py(), t.column("copies").to_numpy()
    shards, linked = t.column("shards").to_pylist(), np.array(t.column("linked").to_pylist(), bool)
    earlier = {s: k for k, s in enumerate(sorted({s for row in shards for s in row if s < shard}))}
    within = np.zeros((len(ids), max(1, len(earlier))), np.float32)
    for i, row in enumerate(shards):
        within[i, [earlier[s] for s in row if s < shard]] = 1
    least, silent, more = ids[mine].copy(), ~linked[mine], np.zeros(len(mine), np.int64)
    out = []
    for i in range(0, len(asks) if len(mine) else 0, ROWS):
        rows = asks[i : i + ROWS]
        hit = (x[rows] @ x[mine].T >= SIMILAR) & (ids[rows, None] != ids[mine])
        counted = hit & (within[rows] @ within[mine].T == 0)
        out.append(_connected(ids[rows], copies[mine], hit, least, counted))
        more += np.where(silent, copies[rows] @ counted, 0)
    out.append(pa.RecordBatch.from_arrays([pa.array(ids[mine][more > 0], pa.int64()), pa.array(more[more > 0], pa.int64()), pa.array(ids[mine][more > 0], pa.int64())], names=["node", "links", "root"]))
    return pa.Table.from_batches(out)


def _assigned(nodes: DataFrame, c: np.ndarray, overlap: int) -> DataFrame:
    """nodes with the shards of their nearest centroids."""
    sent = nodes.sparkSession.sparkContext.broadcast(c)  # MOST_CENTROIDS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                sims = unit(b.column(1).to_pylist()) @ sent.value.T
                k = min(overlap, sims.shape[1])
                near = np.sort(np.argsort(-sims, axis=1, kind="stable")[:, :k].astype(np.int32), axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(near), pa.list_(pa.int32()))], names=["node", "vector", "copies", "shards"])

    return nodes.select("node", "vector", "copies").mapInArrow(run, "node long, vector array<double>, copies long, shards array<int>")


def found_links(nodes: DataFrame, c: np.ndarray, overlap: int) -> DataFrame:
    """node, links, root: what verified links say of a node, in several rows. nodes: node, vector, copies.

    The graphs are searched for which nodes have links at all; the links of these are then counted, both ways, among all
    members of the shards they share."""
    put = stored(_assigned(nodes, c, overlap), "flat-shards")
    each = put.select("*", F.explode("shards").alias("shard"))
    parts = each.groupBy("shard").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))  # MOST_CENTROIDS rows
    each = stored(each.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "flat-parts")
    edges = each.select("node", "vector", "shard", "part").groupBy("shard", "part").applyInArrow(_built, "node long, near array<long>")
    edges = stored(edges.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "flat-edges")
    each = stored(each.join(edges, "node"), "flat-graph")
    # the queries of a chunk, and all members of the part they search
    chunk = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    all_parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    one = each.where("parts = 1").select("*", F.lit(0).alias("chunk"), F.lit(True).alias("member"), F.lit(True).alias("asks"))
    members = each.where("parts > 1").select("*", all_parts.alias("chunk")).withColumn("asks", F.col("chunk") == chunk).withColumn("member", F.lit(True))
    queries = each.where("parts > 1").withColumn("chunk", chunk).withColumn("own", F.col("part")).drop("part").select("*", all_parts.alias("part")).where("part <> own").drop("own")
    queries = queries.withColumn("near", F.lit(None).cast("array<long>")).withColumn("member", F.lit(False)).withColumn("asks", F.lit(True))
    columns = ["node", "vector", "copies", "shards", "near", "shard", "part", "chunk", "member", "asks"]
    rows = one.select(*columns).unionByName(members.select(*columns)).unionByName(queries.select(*columns))
    by = ("shard", "part", "chunk")
    linked = stored(rows.groupBy(*by).applyInArrow(_searched, "node long").distinct(), "flat-linked")
    # chunks without a linked query have nothing to verify
    asked = rows.drop("near").join(linked.withColumn("linked", F.lit(True)), "node", "left").withColumn("linked", F.coalesce("linked", F.lit(False))).withColumn("asks", F.col("asks") & F.col("linked"))
    busy = asked.where("asks").select(*by).distinct()
    found = asked.where("member OR asks").join(busy, list(by), "left_semi").groupBy(*by).applyInArrow(_verified, "node long, links long, root long")
    # every node has a row, as in exact_links
    return found.unionByName(nodes.selectExpr("node", "0L AS links", "node AS root"))


def true_links(nodes: DataFrame, asked: np.ndarray, ids: np.ndarray) -> dict[int, int]:
    """Links of the asked vectors to all nodes by brute force, in blocks."""
    sent = nodes.sparkSession.sparkContext.broadcast((asked, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = sent.value
        total = np.zeros(len(own), np.int64)
        for b in batches:
            if len(b):
                ids, x, copies = b.column(0).to_numpy(), unit(b.column(1).to_pylist()), b.column(2).to_numpy()
                for i in range(0, len(ids), ROWS):
                    row, col = np.nonzero(x[i : i + ROWS] @ q.T >= SIMILAR)
                    other = ids[i + row] != own[col]
                    np.add.at(total, col[other], copies[i + row[other]])
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total)], names=["node", "links"])

    counted = nodes.select("node", "vector", "copies").mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    return {r.node: r.links for r in counted.collect()}  # as many rows as are asked


def _blocks(nodes: DataFrame, count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All nodes, their unit vectors and copies, about BLOCK at a time, by hash."""
    n = -(-count // BLOCK)
    for b in range(n):
        rows = nodes.where(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(n)) == b).select("node", "vector", "copies").collect()
        if rows:
            yield np.array([r.node for r in rows]), unit([r.vector for r in rows]), np.array([r.copies for r in rows])


def audited(nodes: DataFrame, ids: np.ndarray, x: np.ndarray) -> tuple[dict[int, int], int]:
    """The links of drawn vectors that have some, and how many were drawn: until LINKED have links, MOST_DRAWN at most."""
    truth: dict[int, int] = {}
    at, size = 0, AUDITED
    while at < min(len(ids), MOST_DRAWN) and len(truth) < LINKED:
        size = min(size, MOST_DRAWN - at)
        truth |= {i: n for i, n in true_links(nodes, x[at : at + size], ids[at : at + size]).items() if n}
        at, size = at + size, size * 4
    return truth, min(at, len(ids))


def least_recall(truth: dict[int, int], got: dict[int, int]) -> float:
    """A lower bound of the recall at 95 %: the mean share found, less 1.64 standard errors; 0 without evidence."""
    shares = [min(got.get(i, 0), n) / n for i, n in truth.items()]
    return max(0.0, float(np.mean(shares)) - 1.64 * max(float(np.std(shares)), 0.5 / len(shares)) / len(shares) ** 0.5) if shares else 0.0


def mean_recall(truth: dict[int, int], got: dict[int, int]) -> float:
    """The mean over vectors of the share of links found; no links at all are all found."""
    return float(np.mean([min(got.get(i, 0), n) / n for i, n in truth.items()])) if truth else 1.0


def _connected(ids: np.ndarray, copies: np.ndarray, hit: np.ndarray, least: np.ndarray, counted: np.ndarray | None = None) -> pa.RecordBatch:
    """node, links, root of ids, whose links to a block are hit. least holds what each vector of the block is known to be
    connected with, and is lowered; every step of that is a row as well, so that no connection is lost. counted: the hits
    that count, all if not given."""
    rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    hit, root, none = hit[np.ix_(rows, cols)], ids[rows], np.iinfo(np.int64).max
    links, edges = (hit if counted is None else counted[np.ix_(rows, cols)]) @ copies[cols], []
    while len(rows):
        root = np.minimum(root, np.where(hit, least[cols], none).min(1))
        lower = np.minimum(least[cols], np.where(hit, root[:, None], none).min(0))
        fresh = lower < least[cols]
        if not fresh.any():
            break
        edges.append(np.unique(np.stack([least[cols][fresh], lower[fresh]]), axis=1))
        least[cols] = lower
    more = np.unique(np.concatenate(edges, axis=1), axis=1) if edges else np.empty((2, 0), np.int64)
    out = [np.concatenate((ids[rows], more[0])), np.concatenate((links, np.zeros(more.shape[1], np.int64))), np.concatenate((root, more[1]))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["node", "links", "root"])


def exact_links(nodes: DataFrame, count: int) -> DataFrame:
    """node, links, root by comparing all pairs, in a pass over the nodes for each block."""
    out = None
    for ids, x, copies in _blocks(nodes, count):
        sent = nodes.sparkSession.sparkContext.broadcast((ids, x, copies))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, q, copies = sent.value
            least = own.copy()
            for b in batches:
                if len(b):
                    ids, x = b.column(0).to_numpy(), unit(b.column(1).to_pylist())
                    for i in range(0, len(ids), ROWS):
                        hit = (x[i : i + ROWS] @ q.T >= SIMILAR) & (ids[i : i + ROWS, None] != own)
                        yield _connected(ids[i : i + ROWS], copies, hit, least)

        part = stored(nodes.select("node", "vector").mapInArrow(run, "node long, links long, root long"), "flat-exact")
        out = part if out is None else out.unionByName(part)
    # every node has a row, as in found_links
    return out.unionByName(nodes.selectExpr("node", "0L AS links", "node AS root"))


def near_duplicates(vectors: DataFrame) -> tuple[DataFrame, float]:
    """vectors: vec_id, embedding. Returns vec_id, n_links, component_id, kept for every row, and the audited recall."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = "vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0 AND forall(vector, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')) AND exists(vector, v -> v <> 0)"
    good = rows.where(fine).withColumn("size", F.size("vector")).withColumn("same", F.struct(F.xxhash64("vector"), F.xxhash64(F.lit("again"), "vector")))
    classes = good.groupBy("size", "same").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = stored(classes, "flat-classes")
    mine = stored(good.select("vec_id", "size", "same").join(classes.select("size", "same", "node", "copies"), ["size", "same"]).select("vec_id", "node", "copies"), "flat-copies")
    found, recall = None, 1.0
    for (size,) in classes.select("size").distinct().orderBy("size").collect():
        part, recall_here = _one_size(classes.where(F.col("size") == size))
        found, recall = part if found is None else found.unionByName(part), min(recall, recall_here)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")), recall
    edges = found.selectExpr("node AS a", "root AS b").unionByName(mine.selectExpr("vec_id AS a", "node AS b"))
    comps = components(edges).withColumnRenamed("id", "vec_id")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    counted = mine.join(links, "node").groupBy("vec_id").agg(F.max(F.col("links") + F.col("copies") - 1).alias("n_links"))
    # rows whose vector doesn't qualify stay alone even if another row has their vec_id
    out = rows.withColumn("fine", F.expr(fine)).select("fine", "vec_id").join(counted, "vec_id", "left").join(comps, "vec_id", "left")
    component = F.when(F.col("fine"), F.coalesce("component", "vec_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("fine"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept")), recall


def _one_size(classes: DataFrame) -> tuple[DataFrame, float]:
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("node", "vector").collect()
    x = unit([r.vector for r in sample])
    count = classes.count()
    # every core takes part in the passes over all vectors
    classes = stored(classes.repartition(max(classes.sparkSession.sparkContext.defaultParallelism, count // BLOCK), "node"), "flat-nodes")
    k = int(min(MOST_CENTROIDS, max(1, count // PER_CENTROID), len(x)))
    c = centroids(x, k)
    truth, drawn = audited(classes, np.array([r.node for r in sample]), x)
    # with little evidence there is more overlap from the start
    for overlap in OVERLAPS if len(truth) >= LINKED else OVERLAPS[1:]:
        found = stored(found_links(classes, c, overlap), "flat-found")
        got = {r.node: r.links for r in found.where(F.col("node").isin(list(truth))).groupBy("node").agg(F.sum("links").alias("links")).collect()}
        recall = mean_recall(truth, got)
        log.log(logging.INFO if recall >= LEAST_RECALL else logging.WARNING, "recall %.4f, at least %.4f, over %d vectors with links of %d drawn of %d, overlap %d", recall, least_recall(truth, got), len(truth), drawn, count, overlap)
        if recall >= LEAST_RECALL or overlap >= k:
            break
    if recall < EXACT_BELOW:
        log.warning("recall %.4f is below %.2f: comparing all pairs of %d vectors", recall, EXACT_BELOW, count)
        found, recall = exact_links(classes, count), 1.0
    return found, recall
