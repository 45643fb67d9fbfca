"""Queries over whole networks and their traffic: budgets of senders, widest paths, large snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budgets, graph, nodes, reports
from .registry import query

#: Small enough for the fixture's senders to run out: 5000 ms when full.
BUDGET = budgets.Budget(window_ms=40_000, factor=0.125, gate_ms=250.0)


@query("m1_budgets", """
WITH RECURSIVE sent AS (
  SELECT node, packet, start_ms, air_ms, row_number() OVER w AS i, start_ms - lag(start_ms) OVER w AS gap
  FROM mesh_tx WINDOW w AS (PARTITION BY node ORDER BY start_ms, packet)),
walked AS (
  SELECT node, packet, i, 5000.0::DOUBLE AS before_ms, greatest(0.0::DOUBLE, 5000.0::DOUBLE - air_ms) AS after_ms FROM sent WHERE i = 1
  UNION ALL
  SELECT s.node, s.packet, s.i, least(5000.0::DOUBLE, w.after_ms + s.gap * 0.125::DOUBLE), greatest(0.0::DOUBLE, least(5000.0::DOUBLE, w.after_ms + s.gap * 0.125::DOUBLE) - s.air_ms)
  FROM walked w JOIN sent s ON s.node = w.node AND s.i = w.i + 1)
SELECT node, packet, before_ms, after_ms, CAST(CASE WHEN before_ms < 250 THEN floor((250 - before_ms) / 0.125::DOUBLE) ELSE 0 END AS BIGINT) AS wait_ms FROM walked""")
def m1_budgets(t):
    """Every transmission with its sender's airtime budget around it."""
    sent = t.mesh_tx.select(F.col("node").alias("grp"), F.col("start_ms").alias("at_ms"), F.col("packet").alias("id"), "air_ms")
    return budgets.states(sent, BUDGET).select(F.col("grp").alias("node"), F.col("id").alias("packet"), "before_ms", "after_ms", "wait_ms")


@query("w11_widest_pairs", """
WITH RECURSIVE ends AS (SELECT src AS a, dst AS b, snr FROM mesh_links WHERE src <> dst UNION ALL SELECT dst, src, snr FROM mesh_links WHERE src <> dst),
levels AS (SELECT DISTINCT snr AS level FROM ends),
strong AS MATERIALIZED (SELECT DISTINCT level, a, b FROM ends JOIN levels ON snr >= level),
labels(level, id, label) USING KEY (level, id) AS (
  SELECT DISTINCT level, a, a FROM strong
  UNION
  SELECT s.level, s.b, min(l.label) FROM labels l JOIN strong s ON s.level = l.level AND s.a = l.id JOIN recurring.labels r ON r.level = s.level AND r.id = s.b
  WHERE l.label < r.label GROUP BY s.level, s.b),
done AS MATERIALIZED (SELECT level, id, label FROM labels),
joined AS (SELECT src, peer, max(x.level) AS weakest FROM mesh_reach JOIN done x ON x.id = src JOIN done y ON y.id = peer AND y.level = x.level AND y.label = x.label GROUP BY src, peer)
SELECT src, peer, weakest FROM mesh_reach LEFT JOIN joined USING (src, peer) WHERE src <> peer""")
def w11_widest_pairs(t):
    """The weakest link of the best path between every node and each peer that it has heard."""
    merged = graph.merges(t.mesh_links.selectExpr("src AS a", "dst AS b", "snr AS margin"))
    pairs = t.mesh_reach.where("src <> peer").selectExpr("src AS a", "peer AS b")
    return graph.widest_between(pairs, merged).selectExpr("a AS src", "b AS peer", "weakest")


@query("j17_changed_buckets", """
WITH other AS (SELECT k, CASE WHEN last_heard_ms > 1706572700000 THEN 'other' ELSE role END AS role, name, default_scope FROM mesh_nodes WHERE first_seen_ms IS NOT NULL OR role <> 'sensor')
SELECT coalesce(l.k, r.k) AS k, CASE WHEN r.k IS NULL THEN 'only_left' ELSE 'role' END AS difference
FROM mesh_nodes l LEFT JOIN other r ON l.k = r.k WHERE r.k IS NULL OR l.role <> r.role""")
def j17_changed_buckets(t):
    """All nodes against a later snapshot, in which few have another role or are gone."""
    later = t.mesh_nodes.where("first_seen_ms IS NOT NULL OR role <> 'sensor'").withColumn("role", F.when(F.col("last_heard_ms") > 1706572700000, "other").otherwise(F.col("role")))
    return nodes.bucketed_differences(t.mesh_nodes, later, "k", ["name", "role", "default_scope"])


@query("l6_outcomes", """
WITH h AS (
  SELECT r.node AS listener, t.packet, t.node, t.start_ms, t.start_ms + t.air_ms AS end_ms, t.start_ms + t.air_ms // 4 AS lock_ms, max(r.snr) AS snr
  FROM mesh_rx r JOIN mesh_tx t ON t.packet = r.packet GROUP BY ALL),
met AS (
  SELECT a.listener, a.packet, a.snr, max(b.snr) FILTER (b.start_ms < a.lock_ms) AS early, 10 * log10(sum(power(10.0::DOUBLE, b.snr / 10))) AS level, count(b.packet) AS interferers
  FROM h a LEFT JOIN h b ON a.listener = b.listener AND a.node <> b.node AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms
  GROUP BY a.listener, a.packet, a.snr)
SELECT listener, packet, interferers, CASE WHEN snr - early < 6 - 1e-9 THEN 'no_lock' WHEN snr - level < 6 - 1e-9 THEN 'corrupted' ELSE 'captured' END AS outcome FROM met""")
def l6_outcomes(t):
    """What becomes of every transmission at every listener, if a quarter of its airtime is the preamble."""
    strongest = t.mesh_rx.groupBy("packet", F.col("node").alias("listener")).agg(F.max("snr").alias("snr"))
    heard = strongest.join(t.mesh_tx, "packet").select("listener", F.col("packet").alias("id"), "node", "start_ms", "air_ms", (F.col("air_ms") / 4).alias("preamble_ms"), "snr")
    return reports.capture_outcomes(heard, 1000).select("listener", F.col("id").alias("packet"), "interferers", "outcome")
