"""The queries by name, each with its SQL if it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common tables of the SQL forms.
TILES = "tiles AS (SELECT vec_id AS tile_id, label AS site, embedding::DOUBLE[] AS v FROM embeddings)"
PAIRS = TILES + ", pairs AS (SELECT a.tile_id, a.site, a.v AS t, b.v AS p FROM tiles a JOIN tiles b ON b.tile_id = a.tile_id + 1)"
SCENES = "scenes AS (SELECT event_id AS scene_id, user_id % 30 AS region, ts::DATE AS acq_date, value % 100.0::DOUBLE AS cloud_pct, value AS v, event_type AS band FROM events)"
RUNLOG = "runlog AS (SELECT extract(day FROM ts)::BIGINT AS epoch, event_id AS iter, event_id % 4 + 1 AS n, event_type AS metric, value FROM events)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def fractal(decay: float, side: int = 8) -> str:
    """Common tables up to fractal (tile_id, f): a fractal of side x side for each tile, a step of midpoint displacement
    at a time, as arrays row by row."""
    draw = "('0x' || substr(md5('plasma|' || tile_id || '|' || k), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1"
    n = side * side
    tables = [f"{TILES}, f0 AS (SELECT tile_id, list_transform(range({n}), lambda k: {draw}) AS n, list_transform(range({n}), lambda k: 0.0::DOUBLE) AS f FROM tiles)"]
    gap, amplitude, used, step = side, 100.0, 0, 0
    while gap > 1:
        half, known = gap // 2, side // gap
        diagonal = [(-half, -half), (-half, half), (half, -half), (half, half)]
        straight = [(-half, 0), (half, 0), (0, -half), (0, half)]
        for row0, column0, around in ((half, half, diagonal), (0, half, straight), (half, 0, straight)):
            at = lambda y, x: f"f[(i // {side} + {side + y}) % {side} * {side} + (i % {side} + {side + x}) % {side} + 1]"  # noqa: B023, E731
            mean = " + ".join(at(y, x) for y, x in around)
            place = f"{used} + (i // {side} - {row0}) // {gap} * {known} + (i % {side} - {column0}) // {gap} + 1"
            new = f"({mean}) / 4 + {amplitude * amplitude!r}::DOUBLE * n[{place}]"
            mine = f"i // {side} % {gap} = {row0} AND i % {side} % {gap} = {column0}"
            cells = f"list_transform(range({n}), lambda i: CASE WHEN {mine} THEN {new} ELSE f[i + 1] END)"
            tables.append(f"f{step + 1} AS (SELECT tile_id, n, {cells} AS f FROM f{step})")
            used, step = used + known * known, step + 1
        gap, amplitude = half, amplitude / decay
    low, high = "list_min(f)", "list_max(f)"
    tables.append(f"fractal AS (SELECT tile_id, list_transform(f, lambda x: (x - {low}) / greatest({high} - {low}, 1e-12)) AS f FROM f{step})")
    return ",\n    ".join(tables)
