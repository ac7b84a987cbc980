"""Where the queries are kept: a function for Spark and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under its name, with its result in SQL if there is one."""

    def register(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def cascade_sql(source: str, stages: list[tuple[list[list[float]], str]], starts: list[list[tuple[float, float]]], name: str) -> str:
    """CTEs of second-order sections one after the other over source (stream, idx, v); the last is called name.

    starts has, for each section of a stage, its two state numbers: as they are ("warm"), times the stage's first
    sample ("cold"), or zeros ("rest").
    """
    ctes, last, k = [], source, 0
    for (sections, start), state in zip(stages, starts, strict=True):
        first = last
        for (b0, b1, b2, _, a1, a2), (s1, s2) in zip(sections, state, strict=True):
            b0, b1, b2, a1, a2, s1, s2 = (f"({float(x)!r}::DOUBLE)" for x in (b0, b1, b2, a1, a2, s1, s2))
            by = "f.v" if start == "cold" else "1"
            y = f"{b0} * x.v + {by} * {s1}"
            step = f"{b0} * x.v + r.s1"
            ctes.append(
                f"{name}r{k} AS (SELECT x.stream, x.idx, {y} AS y, {b1} * x.v - {a1} * ({y}) + {by} * {s2} AS s1, {b2} * x.v - {a2} * ({y}) AS s2 FROM {last} x JOIN {first} f ON f.stream = x.stream AND f.idx = 0 WHERE x.idx = 0 "
                f"UNION ALL SELECT x.stream, x.idx, {step}, {b1} * x.v - {a1} * ({step}) + r.s2, {b2} * x.v - {a2} * ({step}) FROM {name}r{k} r JOIN {last} x ON x.stream = r.stream AND x.idx = r.idx + 1)"
            )
            last = f"{name}{k}"
            ctes.append(f"{last} AS MATERIALIZED (SELECT stream, idx, y AS v FROM {name}r{k})")
            k += 1
    return ", ".join([*ctes, f"{name} AS (SELECT * FROM {last})"])


#: The views of sources.views in SQL.
SIGNAL = "signal AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, ts, value AS v, event_type AS label, event_id FROM events)"
FRAMES = "frames AS (SELECT vec_id AS frame, [x::DOUBLE FOR x IN embedding] AS x, label::BIGINT AS y FROM embeddings)"
SPEC = f"{FRAMES}, spec AS (SELECT frame, unnest(range(len(x))) AS bin, unnest(x) AS v FROM frames)"
