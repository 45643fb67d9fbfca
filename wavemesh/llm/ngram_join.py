"""N-gram Jaccard self-join with a token-group matrix.

A document is its set of five-word shingles; two link when their Jaccard similarity is 0.8 or more. The join is exact:

1. In any order of all shingles, two linked sets share one of their first n - ceil(0.8 n) + 1. The order puts shingles
   that many documents have last, the others by hash. Only these prefixes are shuffled. Equal sets become one.
2. Similar documents make a group: of the documents that share a prefix shingle the most central one, that with the most
   shared shingles, leads; a document joins the leader with which it shares most, by frequent shingles first.
3. The matrix holds the groups in blocks of bounded size: a block of the leader alone, and blocks of all members. Of a
   block it knows the union of the members' prefix shingles, the place of the order up to which that union is complete,
   and the least size of a member.
4. A document queries blocks: first its leader's; then, where the leader didn't link with it, all blocks of its group,
   and in any case the blocks of other groups that share a prefix shingle and have a member of fitting size that isn't
   known to be connected with it.
5. Prefix shingles of the document that are missing from the complete part of a union are in none of its members, which
   bounds the overlap with each of them. Only a block whose bound suffices is opened: its members' own prefixes are
   bounded in the same way, and where one may link, the texts are fetched and whole sets compared.

All links but those of equal sets come out of opened blocks. What leaves a task is a forest over its documents, not
pairs, and documents already known to be connected aren't compared, so a large group of near copies costs a row for each
member and block it opens. Queries of one block are dealt over tasks by their number.

Defined cases: null and empty texts, and those of white space only, have an empty set and link with nothing; with fewer
than five words the whole sequence is the one shingle; repeated rows and ties are equal sets; a null doc_id is returned
with its set's size and a null component, and links with nothing; rows that share a doc_id are one node with several
sets; very long texts are compared whole, and go to Python in batches of
few rows; no rows give no rows; columns other than doc_id and text are ignored. doc_id is an integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .graph import components
from .shared import by_ids, few, overlap, shingle_set, small_batches, stored

#: Least similarity, in hundredths.
SIMILAR = 80
#: A shingle of more documents than this stands behind the rarer ones; at most so many shingles do, the most frequent ones.
FREQUENT, MOST_FREQUENT = 8, 1_000_000
#: Hashes (of 62 bits) below FRONT are counted. The order is: these if rare, these if frequent, the others.
FRONT, LATE, REST = (1 << 62) * 3 // 10, 1 << 61, 1 << 62
#: Shingles of the members of a block, and of the queries that a cell opens it for; a leader's block is smaller.
BLOCK, LED = 524_288, 131_072
#: The block that holds only the leader.
LEAD = -1


def least_shared(n: int) -> int:
    return -(-SIMILAR * n // 100)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or 100 * min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= SIMILAR * (len(a) + len(b) - both)


def prefix(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles in the common order, which is that of the numbers returned. frequent: sorted 32-bit marks."""
    n = len(shingles)
    codes = shingles >> np.uint64(2)
    front = int(np.searchsorted(codes, np.uint64(FRONT)))
    head, rest = codes[:front], codes[front:] | np.uint64(REST)
    if front and len(frequent):
        mark = head & np.uint64(0xFFFFFFFF)
        at = np.searchsorted(frequent, mark)
        at[at == len(frequent)] = 0
        late = frequent[at] == mark
        head = np.concatenate((head[~late], head[late] | np.uint64(LATE)))
    return np.concatenate((head, rest))[: n - least_shared(n) + 1 if n else 0].astype(np.int64)


def _texts(batch: pa.RecordBatch, column: int = 1) -> Iterator[str | None]:
    for t in batch.column(column):
        yield t.as_py()


def frequent_marks(docs: DataFrame) -> np.ndarray:
    """The lower 32 bits of counted shingles that many documents have; a fixed number at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [s[: np.searchsorted(s, np.uint64(FRONT << 2))] >> np.uint64(2) for s in map(shingle_set, _texts(b, 0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*codes, np.empty(0, np.uint64)]).astype(np.uint32).view(np.int32))], names=["mark"])

    counts = docs.select("text").mapInArrow(run, "mark int").groupBy("mark").count().where(F.col("count") > FREQUENT)
    found = counts.orderBy(F.desc("count"), "mark").limit(MOST_FREQUENT).select("mark").toPandas()["mark"].to_numpy(np.int32)
    return np.sort(found.view(np.uint32)).astype(np.uint64)


def prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, n (set size), same (128-bit hash of the set), prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)  # 8 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t) for t in _texts(b)]
            heads = [prefix(s, sent.value) for s in sets]
            ends = np.concatenate(([0], np.cumsum([len(h) for h in heads]))).astype(np.int32)
            flat = np.concatenate([*heads, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "n", "same", "prefix"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, same binary, prefix array<long>")


def least_overlap(n: int, m: int) -> int:
    """What two sets of these sizes have to share to link."""
    return -(-SIMILAR * (n + m) // (100 + SIMILAR))


def _longs(array: pa.Array) -> Iterator[np.ndarray]:
    flat, ends = array.values.to_numpy(), array.offsets.to_numpy()
    return (flat[a:b] for a, b in zip(ends, ends[1:], strict=False))


class _Sets:
    """Sets that are asked at once how much each shares with another set."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate([*sets, np.empty(0, sets[0].dtype if sets else np.int64)])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner, self.n = flat[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order], len(sets)

    def shared(self, one: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.flat, one, "left"), np.searchsorted(self.flat, one, "right")
        size = b - a
        at = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return np.bincount(self.owner[at], minlength=self.n)


class Block:
    """A block of the matrix: its members' sizes and prefixes, and what their union bounds."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, prefixes: list[np.ndarray]):
        self.ids, self.sizes, self.lengths = ids, sizes, np.array([len(p) for p in prefixes])
        self.last = np.array([p[-1] for p in prefixes])
        self.low, self.known, self.tokens = int(sizes.min()), int(self.last.min()), np.unique(np.concatenate(prefixes))
        self.members = _Sets(prefixes)

    def opens(self, n: int, prefix: np.ndarray) -> bool:
        """Whether a set of n shingles with this prefix may link with any member, by the union alone."""
        sure = prefix[: int(np.searchsorted(prefix, self.known, "right"))]
        return n - len(sure) + overlap(sure, self.tokens) >= least_overlap(n, max(self.low, least_shared(n)))

    def may_link(self, node: int, n: int, prefix: np.ndarray) -> np.ndarray:
        """The places of the members whose own prefixes and sizes allow a link."""
        inside = self.last <= prefix[-1]  # of these the prefix is known whole, of the others the document's
        rest = np.where(inside, np.minimum(n - np.searchsorted(prefix, self.last, "right"), self.sizes - self.lengths), n - len(prefix))
        fits = 100 * np.minimum(n, self.sizes) >= SIMILAR * np.maximum(n, self.sizes)
        return np.flatnonzero(fits & ((100 + SIMILAR) * (self.members.shared(prefix) + rest) >= SIMILAR * (n + self.sizes)) & (self.ids != node))


def _cells(t: pa.Table) -> Iterator[np.ndarray]:
    """The places of the rows of each block and chunk in a task's share of the matrix."""
    keys = [t.column(c).to_numpy() for c in ("chunk", "block", "group")]
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return iter(np.split(order, np.flatnonzero(new)))


def open_cells(t: pa.Table) -> pa.Table:
    """The rows of those that have to be compared: documents for which a block opens, and members that may link."""
    keep: list[int] = []
    t = t.combine_chunks()
    asks, node, n = (t.column(c).to_numpy() for c in ("asks", "node", "n"))
    prefix = list(_longs(t.column("prefix").chunk(0)))
    for rows in _cells(t):
        members, queries = rows[~asks[rows]], rows[asks[rows]]
        if not len(members) or not len(queries):
            continue
        block = Block(node[members], n[members], [prefix[i] for i in members])
        touched = np.zeros(len(members), bool)
        for q in queries:
            if block.opens(int(n[q]), prefix[q]):
                may = block.may_link(node[q], int(n[q]), prefix[q])
                if len(may):
                    touched[may] = True
                    keep.append(q)
        keep += members[touched].tolist()
    return t.select(["group", "block", "chunk", "node", "asks", "known_as"]).take(pa.array(np.array(sorted(keep), np.int64)))


def compare_cells(t: pa.Table) -> pa.Table:
    """The links (a, b) that connect the documents of each opened block, by their whole sets."""
    left, right = [], []
    asks, node, known = (t.column(c).to_numpy() for c in ("asks", "node", "known_as"))
    sets = [shingle_set(x.as_py()) for x in t.column("text")]
    for rows in _cells(t):
        asking = asks[rows]
        members, queries = rows[~asking], rows[asking]
        alike = np.unique(known[rows], return_inverse=True)[1]  # what each is connected with so far
        ours, sizes, index = np.flatnonzero(~asking), np.array([len(sets[m]) for m in members]), None
        for i, q in zip(np.flatnonzero(asking), queries, strict=True):
            mine, size = sets[q], len(sets[q])
            others = np.flatnonzero((alike[ours] != alike[i]) & (100 * np.minimum(sizes, size) >= SIMILAR * np.maximum(sizes, size)))
            if len(others) > 32:
                index = index or _Sets([sets[m] for m in members])
                both = index.shared(mine)[others]
                others = others[100 * both >= SIMILAR * (size + sizes[others] - both)]
            for k in others:
                if alike[ours[k]] != alike[i] and linked(mine, sets[members[k]]):
                    alike[alike == alike[ours[k]]] = alike[i]
                    left.append(int(node[q])), right.append(int(node[members[k]]))
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def spread(rows: DataFrame, key: list[str], weight: str, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """rows with `name`, into how many parts of a size their key is to be split; and the keys of several parts, few as
    they each hold more than `size`, but counted before they are broadcast."""
    large = stored(rows.groupBy(*key).agg(F.ceil(F.sum(weight) / size).cast("int").alias(name)).where(F.col(name) > 1), "ngram-large")
    return rows.join(few(large), key, "left").withColumn(name, F.coalesce(name, F.lit(1))), large


def opened(queries: DataFrame, members: DataFrame, nodes: DataFrame, docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """The links (a, b) that connect the queries with the members of the blocks that open for them. queries and members:
    group, block, node, n, known_as (documents known as the same are connected already); nodes: node, n, prefix; docs:
    doc_id, text. Queries of more than `size` shingles are dealt over several cells, each with the members of its block."""
    key, columns = ["group", "block"], ["group", "block", "chunk", "node", "asks", "known_as"]
    queries, large = spread(queries, key, "n", size, "chunks")
    queries = queries.withColumns({"chunk": F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"), "asks": F.lit(True)})
    members = members.join(few(large), key, "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))).withColumn("asks", F.lit(False))
    cells = stored(queries.select(*columns, "n").unionByName(members.select(*columns, "n")), "ngram-cells")
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, (cells.agg(F.sum("n")).first()[0] or 0) // BLOCK)

    def dealt(rows: DataFrame) -> GroupedData:
        return rows.groupBy(F.pmod(F.xxhash64("group", "block", "chunk"), F.lit(tasks)))

    # few cells or documents are sent to what they ask for, so that prefixes and texts move once
    found = dealt(nodes.join(few(cells.drop("n")), "node").select(*columns, "n", "prefix"))
    found = stored(found.applyInArrow(open_cells, "group long, block int, chunk int, node long, asks boolean, known_as long"), "ngram-opened")
    texts = by_ids(docs, found.select(F.col("node").alias("doc_id")), "left_semi").withColumnRenamed("doc_id", "node")
    return stored(dealt(texts.join(few(found), "node").select(*columns, "text")).applyInArrow(compare_cells, "a long, b long").distinct(), "ngram-links")


def similar(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. Returns doc_id, n for every row, and the links (a, b) that connect the components: equal
    sets with their least document, and pairs of different sets."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stored(prefixes(docs, frequent_marks(docs)), "ngram-sets")
    filled = sets.where("n > 0 AND doc_id IS NOT NULL")
    firsts = filled.groupBy("same").agg(F.min("doc_id").alias("node"))
    copies = stored(filled.select("same", "doc_id").join(firsts, "same").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct(), "ngram-copies")
    nodes = by_ids(filled, copies.where("a = b").select(F.col("a").alias("doc_id")), "left_semi").select(F.col("doc_id").alias("node"), "n", "prefix")
    nodes = stored(nodes, "ngram-nodes")

    # dealt by shingle once, for the count and for the join with it
    rows = nodes.select("node", F.explode("prefix").alias("shingle")).repartition("shingle")
    several = rows.groupBy("shingle").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("shingle")
    shared = stored(rows.join(several, "shingle"), "ngram-shared")
    nodes = stored(by_ids(nodes, shared.select("node"), "left_semi", "node"), "ngram-meeting")

    # the groups: frequent shingles come first, so that those who have one in the prefix, as near copies do, meet few groups
    central = shared.groupBy("node").agg(F.count("*").alias("central"))
    ranked = shared.join(few(stored(central, "ngram-central")), "node").repartition("shingle")
    lead = ranked.groupBy("shingle").agg(F.max(F.struct("central", (-F.col("node")).alias("node"))).alias("most")).select("shingle", (-F.col("most.node")).alias("leader"))
    ties = ranked.join(lead, "shingle").groupBy("node", "leader").agg(F.struct(F.max(F.col("shingle") >= LATE), F.count("*"), -F.col("leader")).alias("tie"))
    groups = stored(ties.groupBy("node").agg(F.max_by("leader", "tie").alias("group")), "ngram-groups")

    sizes = nodes.select("node", "n")
    follow = groups.where("node <> group").select("node", "group", F.lit(LEAD).alias("block"), F.col("node").alias("known_as")).join(sizes, "node")
    leaders = groups.where("node <> group").select(F.col("group").alias("node"), "group", F.lit(LEAD).alias("block"), F.col("group").alias("known_as")).distinct().join(sizes, "node")
    links = opened(follow, leaders, nodes, docs, LED)

    led = links.select(F.col("a").alias("node"), F.lit(True).alias("led")).distinct()
    groups = groups.join(few(led), "node", "left").withColumn("led", F.expr("led IS NOT NULL OR node = group"))
    # who is linked with a leader is known as that one, or as whom that one is known as
    groups = stored(groups.withColumn("known_as", F.when(F.col("led"), F.col("group")).otherwise(F.col("node"))), "ngram-led")
    for _ in range(2):
        ahead = groups.where("node <> known_as").select(F.col("node").alias("known_as"), F.col("known_as").alias("ahead"))
        groups = stored(groups.join(few(ahead), "known_as", "left").withColumn("known_as", F.coalesce("ahead", "known_as")).drop("ahead"), "ngram-led")
    blocked, _ = spread(groups.join(sizes, "node"), ["group"], "n", BLOCK, "blocks")
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocked = stored(blocked.select("node", "n", "group", "block", "led", "known_as"), "ngram-blocks")
    # shingles whose documents are all known as the same ask for nothing more
    owners = shared.join(few(stored(blocked.select("node", "known_as").distinct(), "ngram-owners")), "node")
    still = owners.groupBy("shingle").agg(F.min("known_as").alias("g"), F.max("known_as").alias("h")).where("g <> h").select("shingle")
    grouped = stored(shared.join(still, "shingle", "left_semi").join(blocked, "node"), "ngram-grouped")
    met = grouped.groupBy("shingle", "group", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("known_as").alias("first"), F.max("known_as").alias("last"))
    queries = grouped.select("shingle", "node", "n", "known_as", "led", F.col("group").alias("own"))
    fits = f"(own > group OR own = group AND NOT led) AND (first <> known_as OR last <> known_as) AND 100 * high >= {SIMILAR} * n AND {SIMILAR} * low <= 100 * n"
    queries = stored(queries.join(met, "shingle").where(fits).select("node", "n", "known_as", "group", "block").distinct(), "ngram-queries")
    members = blocked.join(queries.select("group", "block").distinct(), ["group", "block"], "left_semi")
    links = links.unionByName(opened(queries, members, nodes, docs)).unionByName(copies.where("a <> b"))
    return sets.select("doc_id", "n"), links


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the least document reachable by links."""
    sizes, links = similar(docs)
    found = components(links).withColumnRenamed("id", "doc_id")
    return sizes.join(found, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
