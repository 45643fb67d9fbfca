"""Configuration policies: ordered rules over node attributes, the settings they give, and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SETTINGS = ("tx_delay", "rx_delay", "flood_max")
#: Rules of a policy, which becomes an expression over each node.
MOST_RULES = 200

# Community methods as policies: method, direction, then rules (kind, threshold, name, tx_delay, rx_delay, direct_tx_delay).
METHODS = (
    ("MeshSydney (NSW)", "hilltop-first", (("none", None, "LOCAL", 1.4, None, None), ("neighbours_at_least", 5.0, "STANDARD", 1.0, None, None), ("neighbours_at_least", 15.0, "LINK", 0.6, None, None), ("neighbours_at_least", 20.0, "CRITICAL", 0.3, None, None))),
    ("WNY MeshCore", "hilltop-last", (("none", None, "LOCAL", 0.3, 3.0, None), ("altitude_at_least", 150.0, "SUBURBAN", 0.8, None, None), ("altitude_at_least", 400.0, "FOOTHILLS", 1.5, None, None), ("altitude_at_least", 700.0, "HILLTOP", 2.0, None, None))),
    ("TennMesh", "dense-slow", (("none", None, "0-1 neighbours", 0.3, 3.0, 0.1), ("neighbours_at_least", 2.0, "2-4 neighbours", 0.5, None, 0.3), ("neighbours_at_least", 5.0, "5-9 neighbours", 1.0, None, 0.5), ("neighbours_at_least", 10.0, "10-14 neighbours", 1.5, None, 1.0), ("neighbours_at_least", 15.0, "15+ neighbours", 2.0, None, 2.0))),
    ("W6HS three-tier", "hilltop-last", (("none", None, "personal/residential/mobile", 0.5, None, None), ("altitude_at_least", 400.0, "high-rise urban", 1.0, None, None), ("altitude_at_least", 700.0, "mountaintop/backbone", 2.0, None, None))),
    ("Upstream proposed minimums (issue #2123)", "global floor, not tiered", (("none", None, "global minimums", 1.6, 3.0, 1.0),)),
)


def methods(spark: SparkSession, has_altitude: bool = True) -> DataFrame:
    """The catalogue: method, direction, rule, kind, threshold, name, tx_delay, rx_delay, direct_tx_delay, flood_max.
    Without altitudes, methods that need them are left out."""
    rows = [(m, d, i, *r, None) for m, d, rules in METHODS if has_altitude or not any(r[0].startswith("altitude") for r in rules) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "method string, direction string, rule int, kind string, threshold double, name string, tx_delay double, rx_delay double, direct_tx_delay double, flood_max int")


def matches(kind: str, threshold: float | None) -> Column:
    """Whether a node's attributes (altitude, neighbours, articulation, marginal) meet a rule; limits are included, and a
    kind that isn't known, or a limit that is missing, matches nothing."""
    if kind == "none":
        return F.lit(True)
    if kind == "articulation":
        return F.coalesce("articulation", F.lit(False))
    attribute, _, side = kind.partition("_at_")
    if attribute not in ("altitude", "neighbours", "marginal") or side not in ("least", "most") or threshold is None:
        return F.lit(False)
    return F.coalesce(F.col(attribute) >= threshold if side == "least" else F.col(attribute) <= threshold, F.lit(False))


def applied(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """node and each setting: that of the last matching rule that gives one, else the node's own; profile: the name of
    the last matching rule that has one. rules: rule, kind, threshold, name and the settings, null where not given. A
    policy is a list of at most MOST_RULES; it becomes one expression, so that no node moves."""
    listed = rules.orderBy(F.desc("rule")).limit(MOST_RULES + 1).collect()
    if len(listed) > MOST_RULES:
        raise ValueError(f"a policy has at most {MOST_RULES} rules")
    last = lambda c: [F.when(matches(r.kind, r.threshold), F.lit(r[c])) for r in listed if r[c] is not None]
    return nodes.select("node", *(F.coalesce(*last(s), F.col(s)).alias(s) for s in SETTINGS), F.coalesce(*last("name"), F.lit("No profile")).alias("profile"))


def profile_groups(settled: DataFrame) -> DataFrame:
    """profile, nodes, with "No profile" last."""
    return settled.groupBy("profile").agg(F.count("*").alias("nodes")).orderBy(F.col("profile") == "No profile", "profile")


def actions(before: DataFrame, after: DataFrame) -> DataFrame:
    """node, setting, value of what changed by more than a rounding error, as commands would set it."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("setting"), F.col(f"b.{s}").cast("double").alias("old"), F.col(f"a.{s}").cast("double").alias("value")) for s in SETTINGS)))
    rows = before.alias("b").join(after.alias("a"), F.expr("a.node = b.node")).select(F.col("a.node").alias("node"), pairs.alias("p"))
    return rows.select("node", "p.*").where("value IS NOT NULL AND (old IS NULL OR abs(value - old) > 1e-9)").drop("old")


def ranked(candidates: DataFrame, keep: int) -> DataFrame:
    """The best candidates (name, delivery, collision): most delivered, then least collided, then by name."""
    return candidates.withColumn("rank", F.row_number().over(W.orderBy(F.desc("delivery"), "collision", "name"))).where(F.col("rank") <= keep)
