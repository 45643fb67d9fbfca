"""Graph operators over directed links (a, b): every step is a join of a frontier with the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import kept, stored


def undirected(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b both ways, distinct; links that touch a missing node, and loops, drop out. nodes: id."""
    known = links.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi").where("a <> b")
    return known.select("a", "b").unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def degrees(neighbours: DataFrame, nodes: DataFrame) -> DataFrame:
    counts = neighbours.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def reached(links: DataFrame, start: DataFrame, relays: DataFrame | None = None, most_steps: int = 1000) -> DataFrame:
    """start, id, hops: the nodes that each start reaches, itself at 0 hops. Only relays pass traffic on, if they are
    given, but a start always does; others are reached as leaves. start: start; relays: id.

    Each step's result is checkpointed in the shared folder, so that neither plans nor losses grow with the steps."""
    links = links.select("a", "b").distinct()
    front = start.select(F.col("start"), F.col("start").alias("id"), F.lit(0).alias("hops")).distinct()
    seen = front
    for step in range(1, most_steps + 1):
        passing = front if relays is None or step == 1 else front.join(relays.select("id"), "id", "left_semi")
        ahead = passing.join(links, passing["id"] == links["a"]).select("start", F.col("b").alias("id")).distinct()
        front = kept(ahead.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("hops", F.lit(step)))
        if front.isEmpty():
            break
        seen = kept(seen.unionByName(front))
    else:
        raise RuntimeError(f"nodes were still being reached after {most_steps} steps")
    return seen


def widest_hops(links: DataFrame, start: DataFrame, most_hops: int) -> DataFrame:
    """start, id, hops, weakest, path: to each node reached within so many hops a path of fewest hops, of these one whose
    weakest link is strongest, then the least path. links: a, b, margin; start: start. A path holds most_hops + 1 nodes
    at most; each step is a join and an aggregate."""
    links = links.groupBy("a", "b").agg(F.max("margin").alias("margin"))
    front = start.select("start", F.col("start").alias("id"), F.lit(0).alias("hops"), F.lit(float("inf")).alias("weakest"), F.array("start").alias("path")).distinct()
    seen = front
    for hop in range(1, most_hops + 1):
        ahead = front.join(links, front["id"] == links["a"]).select("start", F.col("b").alias("id"), F.struct((-F.least("weakest", "margin")).alias("w"), F.concat("path", F.array("b")).alias("path")).alias("best"))
        ahead = ahead.join(seen.select("start", "id"), ["start", "id"], "left_anti").groupBy("start", "id").agg(F.min("best").alias("best"))
        front = kept(ahead.select("start", "id", F.lit(hop).alias("hops"), (-F.col("best.w")).alias("weakest"), "best.path"))
        if front.isEmpty():
            break
        seen = kept(seen.unionByName(front))
    return seen


def routes(links: DataFrame, ends: DataFrame, targets: tuple[float, ...] = (12.0, 6.0, 0.0), most_hops: int = 8) -> DataFrame:
    """a, b, target, hops, weakest, path, rank: how each pair of ends (a, b) is connected by links (a, b, margin, either
    way) of at least each target margin. Options are ranked by whether their weakest hop is good (the highest target),
    then by fewer hops, then by the stronger weakest hop; of equal paths the one of the higher target stays."""
    both = links.select("a", "b", "margin").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "margin"))
    found = None
    for target in targets:
        part = widest_hops(both.where(F.col("margin") >= target), ends.select(F.col("a").alias("start")).distinct(), most_hops)
        part = part.join(ends, (F.col("start") == F.col("a")) & (F.col("id") == F.col("b"))).select("a", "b", F.lit(target).alias("target"), "hops", "weakest", "path")
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("a", "b", "path", "hops", "weakest").agg(F.max("target").alias("target"))
    order = W.partitionBy("a", "b").orderBy((F.col("weakest") < targets[0]).cast("int"), "hops", F.desc("weakest"), "path")
    return found.withColumn("rank", F.row_number().over(order))


def shortest_path(links: DataFrame, a: int, b: int, most_hops: int = 64) -> list[int]:
    """One shortest path, the least of those; empty if there is none within so many hops."""
    start = links.sparkSession.range(1).select(F.lit(a).cast("long").alias("start"))
    end = widest_hops(links.select("a", "b", F.lit(0.0).alias("margin")), start, most_hops).where(F.col("id") == b).select("path").first()
    return list(end[0]) if end else []


def merges(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """id, ups: for each node of a link (a, b, margin, either way) the components that it comes to be in, round by round,
    each with the margin of the link by which the one before joined it.

    In every round each component picks its strongest link to another one (ties by the ends' ids), and what these links
    join becomes a component, named by a member; the picked links make a maximum spanning forest. The number of
    components that aren't done halves at least, so a node has log2(n) ups at most. The weakest link between two nodes in
    the forest is the weakest of their ups as far as they meet."""
    ends = links.where("a <> b").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max("margin").alias("margin"))
    # tables, since with checkpoints each round took longer to plan than the one before, whatever its rows
    left = stored(ends.select("x", "y", F.struct("margin", (-F.col("x")).alias("x"), (-F.col("y")).alias("y")).alias("link")), "merging")
    ids = left.select(F.col("x").alias("id")).unionByName(left.select(F.col("y").alias("id"))).distinct()
    tree = stored(ids.select("id", F.col("id").alias("of"), F.expr("CAST(array() AS array<struct<of:bigint,weakest:double>>)").alias("ups")), "merges")
    for _ in range(most_rounds):
        if left.isEmpty():
            return tree.select("id", "ups")
        both = left.select(F.col("x").alias("c"), F.col("y").alias("to"), "link").unionByName(left.select(F.col("y").alias("c"), F.col("x").alias("to"), "link"))
        best = kept(both.groupBy("c").agg(F.max(F.struct("link", "to")).alias("best")).select("c", "best.to", F.col("best.link.margin").alias("margin")))
        # two that picked the same link: the lesser one is what the others come to
        mutual = best.select("c", "to").join(best.select(F.col("c").alias("to"), F.col("to").alias("c")), ["c", "to"], "left_semi").where("c < to").select("c", F.lit(True).alias("top"))
        heads = kept(best.join(mutual, "c", "left").select("c", F.when(F.col("top"), F.col("c")).otherwise(F.col("to")).alias("to")))
        while True:
            ahead = heads.join(heads.selectExpr("c AS to", "to AS next"), "to")
            heads = kept(ahead.select("c", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            moved = not heads.where("moved").isEmpty()
            heads = heads.select("c", "to")
            if not moved:
                break
        joined = best.select("c", "margin").join(heads, "c").select(F.col("c").alias("of"), "to", "margin")
        up = F.when(F.col("to").isNull(), F.col("ups")).otherwise(F.concat("ups", F.array(F.struct(F.col("to").alias("of"), F.col("margin").cast("double").alias("weakest")))))
        tree = stored(tree.join(joined, "of", "left").select("id", F.coalesce("to", "of").alias("of"), up.alias("ups")), "merges")
        moved = left.join(heads.selectExpr("c AS x", "to AS u"), "x").join(heads.selectExpr("c AS y", "to AS v"), "y").where("u <> v")
        left = stored(moved.groupBy(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")).agg(F.max("link").alias("link")), "merging")
    raise RuntimeError(f"components were still merging after {most_rounds} rounds")


def widest_between(pairs: DataFrame, merged: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with weakest: the weakest link of the best path between a and b, on which this is as strong as can
    be; infinite from a node to itself, null where no path is. merged: from `merges`. Two joins for any number of pairs."""
    rows = pairs.join(merged.select(F.col("id").alias("a"), F.col("ups").alias("_of_a")), "a", "left").join(merged.select(F.col("id").alias("b"), F.col("ups").alias("_of_b")), "b", "left")
    meet = F.array_position(F.zip_with("_of_a", "_of_b", lambda x, y: F.coalesce(x["of"] == y["of"], F.lit(False))), True).cast("int")
    weakest = lambda c: F.array_min(F.slice(c, F.lit(1), F.col("_meet"))["weakest"])
    rows = rows.withColumn("_meet", meet)
    found = F.when(F.col("a") == F.col("b"), F.lit(float("inf"))).when(F.col("_meet") > 0, F.least(weakest("_of_a"), weakest("_of_b")))
    return rows.select(*pairs.columns, found.alias("weakest"))


def in_triangles(neighbours: DataFrame) -> DataFrame:
    """a, b, both ways, of the edges that lie on a triangle. neighbours: a, b both ways, distinct, a <> b.

    Edges point from the node of fewer neighbours to that of more, so a hub has few edges of its own to pair up: two edges
    that leave a node make a triangle if their ends are joined, and no other pairs are looked at."""
    degree = neighbours.groupBy("a").agg(F.count("*").alias("n"))
    known = neighbours.join(degree, "a").join(degree.selectExpr("a AS b", "n AS m"), "b")
    ahead = kept(known.where("n < m OR n = m AND a < b").select("a", "b", "m"))
    first, second = ahead.selectExpr("a", "b", "m"), ahead.selectExpr("a", "b AS c", "m AS o")
    pairs = first.join(second, "a").where("m < o OR m = o AND b < c").select("a", "b", "c")
    found = kept(pairs.join(ahead.selectExpr("a AS b", "b AS c"), ["b", "c"], "left_semi"))
    sides = found.select("a", "b").unionByName(found.selectExpr("a", "c AS b")).unionByName(found.selectExpr("b AS a", "c AS b"))
    return sides.unionByName(sides.selectExpr("b AS a", "a AS b")).distinct()


def marginal_coverage(neighbours: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, marginal: how many neighbours of a node no other neighbour of it reaches, which are those over edges on no
    triangle. neighbours: a, b both ways, distinct."""
    alone = neighbours.join(in_triangles(neighbours), ["a", "b"], "left_anti").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("marginal"))
    return nodes.select("id").join(alone, "id", "left").select("id", F.coalesce("marginal", F.lit(0)).alias("marginal"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component (the least id reachable) of every node of an edge (a, b), by alternating large and small stars: each
    round links a node's greater neighbours, then its smaller ones, to the least of them, until nothing changes."""
    links = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    last = None
    for _ in range(most_rounds):
        both = links.selectExpr("hi AS u", "lo AS v").unionByName(links.selectExpr("lo AS u", "hi AS v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").selectExpr("v AS hi", "m AS lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        links = kept(large.join(least, "hi").where("lo <> m").selectExpr("lo AS hi", "m AS lo").unionByName(least.selectExpr("hi", "m AS lo")).distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
    else:
        raise RuntimeError(f"components hadn't settled after {most_rounds} rounds")
    return links.selectExpr("hi AS id", "lo AS component").unionByName(links.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


#: Steps of a colouring that are one plan.
STEPS = 4


def strong_components(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """id, component of every node of a link (a, b) whose strongly connected component has other members; all others are
    alone. component is a member.

    Forward and backward colouring: each node takes the greatest id that reaches it as its colour; backwards from a node
    that has its own, within its colour, lies its component. Links between colours, and at what is found, drop out, and so
    do links at nodes that nothing reaches or that reach nothing, until no link is left. Every step is a join and an
    aggregate; a colouring takes as many as its longest way, STEPS of them between checkpoints."""
    left = kept(links.where("a <> b").select("a", "b").distinct())
    found = left.selectExpr("a AS id", "a AS component").where("false")
    for _ in range(most_rounds):
        left = left.join(left.selectExpr("b AS a").distinct(), "a", "left_semi").join(left.selectExpr("a AS b").distinct(), "b", "left_semi")
        left = kept(left.select("a", "b"))
        if left.isEmpty():
            return found
        colours = kept(left.selectExpr("a AS id").distinct().unionByName(left.selectExpr("b AS id").distinct()).distinct().selectExpr("id", "id AS colour"))
        while True:
            better = colours
            for _ in range(STEPS):
                told = left.join(better.selectExpr("id AS a", "colour"), "a").groupBy(F.col("b").alias("id")).agg(F.max("colour").alias("told"))
                better = better.join(told, "id", "left").select("id", F.greatest("colour", "told").alias("colour"))
            better = kept(better.join(colours.withColumnRenamed("colour", "before"), "id"))
            colours = better.select("id", "colour")
            if better.where("colour <> before").isEmpty():
                break
        ends = left.join(colours.selectExpr("id AS a", "colour AS of_a"), "a").join(colours.selectExpr("id AS b", "colour AS of_b"), "b")
        same = kept(ends.where("of_a = of_b").selectExpr("a", "b", "of_a AS colour"))
        inside, size = colours.where("id = colour").select("id", F.col("id").alias("component")), -1
        while True:
            for _ in range(STEPS):
                back = same.join(inside.selectExpr("id AS b", "component"), "b").select(F.col("a").alias("id"), "component")
                inside = inside.unionByName(back).distinct()
            inside = kept(inside)
            if (n := inside.count()) == size:
                break
            size = n
        several = inside.join(inside.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi")
        found = kept(found.unionByName(several.select("id", "component")))
        left = kept(same.join(inside.selectExpr("id AS a"), "a", "left_anti").join(inside.selectExpr("id AS b"), "b", "left_anti"))
    raise RuntimeError(f"strong components hadn't settled after {most_rounds} rounds")


class Reach:
    """What every node reaches over links (a, b), held as reach between components: of relays, the strongly connected ones;
    other nodes end a way and are alone. Only relays pass traffic on, all nodes if not given, but each node sends its own.

    nodes: id, all of them; relays: id. Pairs of nodes are never made: a component's reach is that of all its members."""

    def __init__(self, links: DataFrame, nodes: DataFrame, relays: DataFrame | None = None):
        ids = nodes.select("id").distinct()
        known = links.where("a <> b").select("a", "b").distinct().join(ids.selectExpr("id AS a"), "a", "left_semi").join(ids.selectExpr("id AS b"), "b", "left_semi")
        passing = ids if relays is None else ids.join(relays.select("id").distinct(), "id", "left_semi")
        self.links = kept(known.join(passing.selectExpr("id AS a", "true AS a_passes"), "a", "left").join(passing.selectExpr("id AS b", "true AS b_passes"), "b", "left").na.fill(False))
        found = strong_components(self.links.where("a_passes AND b_passes"))
        rows = ids.join(passing.withColumn("passes", F.lit(True)), "id", "left").join(found, "id", "left")
        #: id, component, passes
        self.members = kept(rows.select("id", F.coalesce("component", "id").alias("component"), F.coalesce("passes", F.lit(False)).alias("passes")))
        of = lambda x: self.members.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}"))
        ends = kept(self.links.join(of("a"), "a").join(of("b"), "b"))
        between = ends.where("a_passes AND of_a <> of_b").selectExpr("of_a AS a", "of_b AS b").distinct()
        sources = self.members.where("passes").select(F.col("component").alias("start")).distinct()
        closed = kept(reached(between, sources).select(F.col("start").cast("string").alias("start"), F.col("id").alias("component")))
        # a node that doesn't pass traffic on starts with its own links; those with links to the same components are one start
        own = ends.where("NOT a_passes").groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_set("of_b")).alias("first"))
        own = own.select("id", "first", F.concat(F.lit("to "), F.md5(F.array_join("first", " "))).alias("start"))
        first = own.groupBy("start").agg(F.first("first").alias("first")).select("start", F.explode("first").alias("component"))
        beyond = first.withColumnRenamed("start", "sender").join(closed, first["component"].cast("string") == closed["start"]).select(F.col("sender").alias("start"), closed["component"])
        #: start (a component that passes traffic on, or those of links) and the components it reaches
        self.closed = kept(closed.unionByName(first).unionByName(beyond).distinct())
        #: id, component, start: where a node's traffic starts
        start = F.when(F.col("passes"), F.col("component").cast("string")).otherwise(F.col("start"))
        self.starts = kept(self.members.join(own.select("id", "start"), "id", "left").select("id", "component", start.alias("start")))

    def counts(self) -> DataFrame:
        """id, reached: how many other nodes each node reaches."""
        sizes = self.members.groupBy("component").agg(F.count("*").alias("size"))
        totals = self.closed.join(sizes, "component").groupBy("start").agg(F.sum("size").alias("total"))
        itself = self.starts.join(self.closed, ["start", "component"], "left_semi").select("id", F.lit(1).alias("itself"))
        rows = self.starts.join(totals, "start", "left").join(itself, "id", "left")
        return rows.select("id", (F.coalesce("total", F.lit(0)) - F.coalesce("itself", F.lit(0))).alias("reached"))

    def shares(self, delivered: DataFrame) -> DataFrame:
        """start, share: the part of what each node reaches that got its message; 1 where it reaches nobody. delivered:
        start, id."""
        sent = self.starts.select(F.col("id").alias("start"), F.col("start").alias("of"))
        got = delivered.where("start <> id").select("start", "id").distinct().join(sent, "start").join(self.members.select("id", "component"), "id")
        hits = got.join(self.closed.withColumnRenamed("start", "of"), ["of", "component"], "left_semi").groupBy("start").agg(F.count("*").alias("hits"))
        rows = self.counts().withColumnRenamed("id", "start").join(hits, "start", "left")
        return rows.select("start", F.when(F.col("reached") > 0, F.coalesce("hits", F.lit(0)) / F.greatest("reached", F.lit(1))).otherwise(1.0).alias("share"))


def articulation_points(neighbours: DataFrame) -> DataFrame:
    """id of the nodes whose removal splits their component. neighbours: a, b both ways, distinct, a <> b.

    A spanning forest is grown breadth-first from the least node of each component. Its nodes are numbered in preorder:
    sizes are summed up level by level, numbers handed down. Each subtree's least and greatest number reached by one edge
    outside the forest go up in the same way. Tree edges that lie on a common cycle are then linked, and a node whose
    tree edges fall into several components of these links is a cut. A step for each level, all of them joins and sums."""
    roots = components(neighbours).where("id = component").select(F.col("id").alias("node"))
    front = kept(roots.select("node", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("level")))
    levels = [front]
    seen = front
    while not levels[-1].isEmpty():
        ahead = levels[-1].select(F.col("node").alias("a")).join(neighbours, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        front = kept(ahead.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(len(levels))))
        levels.append(front)
        seen = kept(seen.unionByName(front))
    levels = levels[:-1]
    if not levels:
        return neighbours.select(F.col("a").alias("id")).where("false")

    # sizes from the leaves up
    sizes = [None] * len(levels)
    below = None
    for k in range(len(levels) - 1, -1, -1):
        rows = levels[k].select("node", "parent")
        inside = F.lit(1).cast("long")
        if below is not None:
            rows = rows.join(below.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("inside")), "node", "left")
            inside = inside + F.coalesce("inside", F.lit(0))
        below = sizes[k] = kept(rows.select("node", "parent", inside.alias("size")))
    # numbers from the roots down: a node's own, then those of its children's subtrees
    ahead = W.partitionBy("parent").orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    numbered = kept(sizes[0].select("node", "parent", "size", F.lit(0).cast("long").alias("pre")))
    every = [numbered]
    for k in range(1, len(levels)):
        before = sizes[k].withColumn("skip", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
        numbered = kept(before.join(every[-1].select(F.col("node").alias("parent"), "pre"), "parent").select("node", "parent", "size", (F.col("pre") + 1 + F.col("skip")).alias("pre")))
        every.append(numbered)
    tree = every[0].withColumn("level", F.lit(0))
    for k, rows in enumerate(every[1:], 1):
        tree = tree.unionByName(rows.withColumn("level", F.lit(k)))
    tree = kept(tree)

    ends = lambda x: tree.select(F.col("node").alias(x), F.col("parent").alias(f"p_{x}"), F.col("pre").alias(f"pre_{x}"), F.col("size").alias(f"size_{x}"))
    others = neighbours.join(ends("a"), "a").join(ends("b"), "b").where("NOT (p_a <=> b) AND NOT (p_b <=> a)")
    others = kept(others)
    own = others.groupBy(F.col("a").alias("node")).agg(F.min("pre_b").alias("lo"), F.max("pre_b").alias("hi"))
    reach = tree.join(own, "node", "left").select("node", "parent", "level", "pre", "size", F.least("pre", "lo").alias("low"), F.greatest("pre", "hi").alias("high"))
    reach = kept(reach)
    below, spans = None, None
    for k in range(len(levels) - 1, -1, -1):
        rows = reach.where(F.col("level") == k)
        if below is not None:
            rows = rows.join(below.groupBy(F.col("parent").alias("node")).agg(F.min("low").alias("l"), F.max("high").alias("h")), "node", "left")
            rows = rows.withColumns({"low": F.least("low", "l"), "high": F.greatest("high", "h")}).drop("l", "h")
        below = kept(rows)
        spans = below if spans is None else spans.unionByName(below)
    spans = kept(spans)
    # a tree edge is named by its lower node
    across = others.where("pre_a + size_a <= pre_b").select("a", "b")
    up = spans.alias("w").join(tree.select(F.col("node").alias("v"), F.col("parent").alias("pv"), F.col("pre").alias("pre_v"), F.col("size").alias("size_v")), F.expr("w.parent = v")).where("pv IS NOT NULL AND (low < pre_v OR high >= pre_v + size_v)").select(F.col("node").alias("a"), F.col("v").alias("b"))
    edges = tree.where("parent IS NOT NULL").select("node", "parent")
    blocks = components(across.unionByName(up)).withColumnRenamed("id", "node").withColumnRenamed("component", "block")
    edges = edges.join(blocks, "node", "left").select("node", "parent", F.coalesce("block", "node").alias("block"))
    touched = edges.select(F.col("node").alias("id"), "block").unionByName(edges.select(F.col("parent").alias("id"), "block"))
    return touched.groupBy("id").agg(F.min("block").alias("x"), F.max("block").alias("y")).where("x <> y").select("id")


def delivered_share(reach: DataFrame, delivered: DataFrame) -> DataFrame:
    """start, share: the part of what a start reaches that got its message; 1 where it reaches nobody."""
    aim = reach.where("hops > 0").select("start", "id")
    got = aim.join(delivered.select("start", "id").distinct().withColumn("ok", F.lit(1)), ["start", "id"], "left")
    shares = got.groupBy("start").agg((F.count("ok") / F.count("*")).alias("share"))
    return reach.where("hops = 0").select("start").join(shares, "start", "left").select("start", F.coalesce("share", F.lit(1.0)).alias("share"))


def ranked_partners(links: DataFrame, k: int) -> DataFrame:
    """The k links of greatest margin of each node, with their rank. links: a, b, margin."""
    return links.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("margin"), "b"))).where(F.col("rank") <= k)
