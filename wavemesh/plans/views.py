"""Mesh tables made from the star-schema tables, in SQL that Spark and DuckDB read alike.

Only the fixtures share their text; operators are written in the DataFrame API, and the checks as SQL of their own.
Macros in double braces stand for the few functions whose names differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SOURCE_TABLES = ("region", "nation", "customer", "orders", "lineitem", "events", "supplier", "part")

#: name -> (SQL, the views and tables that it reads)
VIEWS = {
    "mesh_nodes": """
        SELECT c_custkey AS k, substr(md5(CAST(c_custkey AS VARCHAR(20))), 1, 16) AS public_key,
          CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name END AS name,
          CASE WHEN c_custkey % 10 < 7 THEN 'repeater' WHEN c_custkey % 10 = 7 THEN 'room_server' WHEN c_custkey % 10 = 8 THEN 'sensor' ELSE 'companion' END AS role,
          CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 55.0e0 + (c_custkey * 37 % 1000) / 250.0e0 END AS lat,
          CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE -6.0e0 + (c_custkey * 61 % 1000) / 200.0e0 END AS lon,
          CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 1706572800000 - (c_custkey * 29 % 3000) * 60000 END AS last_heard_ms,
          CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 1700000000000 + c_custkey * 3600000 END AS first_seen_ms,
          CAST(c_custkey * 3 % 40 AS INT) AS advert_count, CAST(c_custkey * 7 % 50 AS INT) AS relay_count_24h, CAST(c_custkey % 4 AS INT) AS hash_size,
          CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '#' || lower(replace(n_name, '_', '-')) END AS default_scope
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "mesh_scopes": "SELECT CAST(n_nationkey AS BIGINT) AS ord, '#' || lower(replace(n_name, '_', '-')) AS name FROM nation",
    "mesh_reach": """
        SELECT a AS src, b AS peer, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_quantity) AS BIGINT) AS heard, max(l_discount) * 100.0e0 - 5.0e0 AS snr, max(l_linenumber) AS age_days
        FROM (SELECT o_custkey AS a, (o_custkey + l_partkey % 6 + 1) % (SELECT count(*) FROM customer) AS b, l_quantity, l_discount, l_linenumber
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x GROUP BY a, b""",
    "mesh_packets": """
        SELECT event_id AS id, substr(md5('p' || CAST(event_id % 4000 AS VARCHAR(20))), 1, 16) AS hash, {{ms:ts}} AS heard_ms, user_id AS observer,
          CAST(event_id % 4 AS INT) AS route_type, CAST(event_id * 7 % 16 AS INT) AS payload_type, CAST(1 + event_id % 3 AS INT) AS hash_size,
          CAST(event_id * 11 % 6 AS INT) AS hops, CAST(event_id * 5 % 60 AS INT) AS payload_len, event_type, value AS snr, props
        FROM events""",
    "mesh_hops": """
        SELECT id, CAST(i AS INT) AS pos, n AS hop,
          CASE WHEN (id + i) % 9 = 0 THEN '' ELSE substr(md5(CAST(n AS VARCHAR(20))), 1, 2 * hash_size) END AS prefix,
          CASE WHEN (id + i) % 9 = 0 THEN '' WHEN (id + i) % 5 = 0 THEN upper(substr(md5(CAST(n AS VARCHAR(20))), 1, 16)) ELSE substr(md5(CAST(n AS VARCHAR(20))), 1, 16) END AS key
        FROM (SELECT id, i, hash_size, (id * 7 + i * 13) % (SELECT count(*) FROM customer) AS n
          FROM mesh_packets JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) r ON i < hops) x""",
    "mesh_links": """
        SELECT c_custkey AS src, (c_custkey * m.a + m.b) % (SELECT count(*) FROM customer) AS dst, CAST(c_custkey * (m.a + 3) % 31 AS DOUBLE) - 12.0e0 AS snr
        FROM customer CROSS JOIN (SELECT 1 AS a, 1 AS b UNION ALL SELECT 1, 7 UNION ALL SELECT 3, 5) m""",
    "mesh_tx": """
        SELECT o_orderkey AS packet, o_custkey % 60 AS node, CAST(o_orderkey * 37 % 600000 AS BIGINT) AS start_ms, CAST(200 + o_orderkey % 300 AS BIGINT) AS air_ms, o_orderkey % 5 = 0 AS is_origin, o_orderkey % 29 = 0 AS background
        FROM orders""",
    "mesh_rx": """
        SELECT l_orderkey AS packet, o_custkey % 60 AS from_node, l_partkey % 60 AS node, CAST(o_orderkey * 37 % 600000 + 200 + o_orderkey % 300 AS BIGINT) AS at_ms,
          l_suppkey % 7 = 0 AS collided, CASE WHEN l_suppkey % 7 = 0 THEN '' WHEN l_partkey % 8 = 0 THEN 'weak_signal' WHEN l_partkey % 8 = 1 THEN 'tx_busy' WHEN l_partkey % 8 = 2 THEN 'already_seen' WHEN l_partkey % 8 = 3 THEN 'hop_limit' WHEN l_partkey % 8 = 4 THEN 'loop_detect' ELSE '' END AS drop_reason,
          l_quantity - 30.0e0 AS snr, l_suppkey % 7 <> 0 AND l_partkey % 8 = 5 AS relayed
        FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_quantity, o_custkey, o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x
        WHERE o_custkey % 60 <> l_partkey % 60""",
}

MACROS = {
    "spark": {"ms": "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({0} AS TIMESTAMP_NTZ))"},
    "duckdb": {"ms": "epoch_us({0}) // 1000"},
}


def text(view: str, dialect: str) -> str:
    return re.sub(r"\{\{(\w+):(.*?)\}\}", lambda m: MACROS[dialect][m[1]].format(m[2]), VIEWS[view])


def reads(sql: str) -> list[str]:
    return [n for n in (*SOURCE_TABLES, *VIEWS) if re.search(rf"\b{n}\b", sql)]


#: Rows of lineitem that a task joins and makes distinct: these grow in number with the table, not in size.
ROWS_PER_TASK = 250_000


class Tables:
    """The driver's tables and the mesh views of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known, self._parts = spark, sf_dir, {}, None

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in VIEWS:
                sql = text(name, "spark").replace("VARCHAR(20)", "STRING")
                used = reads(sql)
                for n in used:
                    sql = re.sub(rf"\b{n}\b(?!_)", f"{{{n}}}", sql)
                self._known[name] = self.spark.sql(sql, **{n: self._dealt(n) if name == "mesh_rx" else getattr(self, n) for n in used})
            else:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._known[name]

    def _dealt(self, name: str) -> DataFrame:
        """A table of orders' keys dealt by these into so many parts that none grows with the table; small ones as they are.
        What follows by order (the join, the distinct rows, a packet's receptions) stays in these parts."""
        table = getattr(self, name)
        key = {"lineitem": "l_orderkey", "orders": "o_orderkey"}[name]
        return table.repartition(self.parts, key) if self.parts else table

    @property
    def parts(self) -> int | None:
        """How many parts lines are dealt into; none while these are as few as tasks run at once. Of shuffle partitions more
        than that would do no good: adaptive execution puts them together, into ones that grow with the table, but not
        those of a number asked for."""
        if self._parts is None:
            self._parts = -(-self.lineitem.count() // ROWS_PER_TASK)
        few = min(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return self._parts if self._parts > few else None


def oracle(sql: str) -> str:
    """The SQL with the views it needs in front of it."""
    needed: list[str] = []

    def need(q: str) -> None:
        for n in reads(q):
            if n in VIEWS and n not in needed:
                need(VIEWS[n])
                needed.append(n)

    need(sql)
    ctes = ", ".join(f"{n} AS ({text(n, 'duckdb')})" for n in needed)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
