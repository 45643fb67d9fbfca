"""Where queries are registered, and what several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import geo
from .views import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
RADIO = geo.Radio()


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return build

    return register


def duck_haversine(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371.0088 * asin(sqrt(power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))))"


#: Margin in SQL from the distance d and Fresnel parameters v of a path's samples.
DUCK_MARGIN = "129.0 - (20 * log10(greatest(d, 0.001)) + 20 * log10(868) + 32.44) - CASE WHEN max(v) > -0.78 THEN 6.9 + 20 * log10(sqrt(power(max(v) - 0.1, 2) + 1) + max(v) - 0.1) ELSE 0 END"
