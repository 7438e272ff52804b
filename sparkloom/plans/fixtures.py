"""Stand-ins for annotation data over the driver's tables, as SQL that both engines read.

A table name in braces is filled in by `view` for Spark and by `plain` for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


#: Rows of lineitem that one task sorts.
TASK_ROWS = 200_000


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    if LR in sql:
        tables["lineitem"] = _by_order(tables["lineitem"])
    return spark.sql(sql, **tables)


def _by_order(lines: DataFrame) -> DataFrame:
    """Whole orders in as many tasks as the rows ask for: with a fixed number of them each task's sort would grow with the input, and spill."""
    return lines.repartition(max(lines.sparkSession.sparkContext.defaultParallelism, -(-lines.count() // TASK_ROWS)), "l_orderkey")


def dealt(d: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt to all cores by key, for work that is heavy for each row: small files would give a few tasks, and so would joined small partitions."""
    spark = d.sparkSession
    return d.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


_SHIFTED = "bx1 + (l_partkey + l_suppkey) % 11 - 5 AS x1, by1 + l_partkey % 7 - 3 AS y1, bx2 + l_partkey % 5 AS x2, by2 + l_suppkey % 5 AS y2"

# pr are predicted boxes, pc the same clipped at the image's corner
LR = """lr AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM {lineitem}),
bx AS (SELECT l_orderkey AS rec, CAST(rn AS BIGINT) AS rn, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_partkey * 7 % 400 AS bx1, l_suppkey * 13 % 400 AS by1,
  l_partkey * 7 % 400 + 8 + CAST(l_quantity AS BIGINT) AS bx2, l_suppkey * 13 % 400 + 8 + CAST(l_linenumber AS BIGINT) * 6 AS by2 FROM lr),
gt AS (SELECT rec, rn AS g, bx1 AS x1, by1 AS y1, bx2 AS x2, by2 AS y2 FROM bx WHERE l_returnflag <> 'R'),
pr AS (SELECT rec, rn AS p, """ + _SHIFTED + """
  FROM bx WHERE l_linestatus = 'F'),
pc AS (SELECT rec, p, greatest(x1, 0) AS x1, greatest(y1, 0) AS y1, x2, y2 FROM pr)"""

# the boxes of gt (side 0) and pc (side 1) from one pass over the rows; a row may have both
SIDES = f"""WITH {LR}, bp AS (SELECT rec, rn AS z, l_returnflag <> 'R' AS t, l_linestatus = 'F' AS p, bx1, by1, bx2, by2, {_SHIFTED} FROM bx)
SELECT rec, z, inline(filter(array(CASE WHEN t THEN struct(0 AS side, bx1 AS x1, by1 AS y1, bx2 AS x2, by2 AS y2) END,
  CASE WHEN p THEN struct(1 AS side, greatest(x1, 0) AS x1, greatest(y1, 0) AS y1, x2, y2) END), b -> b IS NOT NULL)) FROM bp"""

GT, PR = f"WITH {LR} SELECT * FROM gt", f"WITH {LR} SELECT * FROM pr"

ANNOS = """an AS (SELECT concat('v', CAST(o_custkey AS STRING)) AS vid, CAST(o_orderkey AS STRING) AS eid, o_orderpriority AS caption, o_custkey, o_orderkey FROM {orders})"""

# one row for each step of a user's trace; ordinals stand in for slices
CALLS = """ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM {events}),
calls AS (SELECT user_id AS rec, CAST(pos AS BIGINT) AS pos, CASE WHEN event_type = 'view' THEN 'get_slice' WHEN event_type = 'click' THEN 'scroll' WHEN event_type = 'purchase' THEN 'add_bbox'
  WHEN event_type = 'signup' THEN (CASE WHEN back = 1 THEN 'finish' ELSE 'add_point' END) ELSE 'malformed' END AS name,
  CAST(event_id % 10 AS INT) AS z, CAST(event_id * 7 % 9 - 4 AS INT) AS delta FROM ev)"""

CALL_ROWS = f"WITH {CALLS} SELECT * FROM calls"

# the same on four of ten slices, with propagations
MOVES = f"""{CALLS}, mv AS (SELECT rec, pos, CASE WHEN name = 'malformed' AND z % 2 = 0 THEN 'run_medsam2' ELSE name END AS name, CAST(z % 4 * 3 AS INT) AS z, delta FROM calls)"""

# texts around whole numbers, with and without boxes
TEXTS = """tx AS (SELECT o_orderkey AS id, CASE CAST(o_orderkey % 6 AS INT)
  WHEN 0 THEN concat('boxes: [', CAST(o_custkey AS STRING), ', 2, ', CAST(o_custkey + 9 AS STRING), ', 11.5]')
  WHEN 1 THEN concat('[', CAST(o_custkey AS STRING), ',1,', CAST(o_custkey + 3 AS STRING), ',4] and [5, 6.5, 7, 8]')
  WHEN 2 THEN concat('<|box_start|>(', CAST(o_custkey AS STRING), ',2),(', CAST(o_custkey + 5 AS STRING), ', 9)<|box_end|>')
  WHEN 3 THEN concat('so "bbox_2d": [', CAST(o_custkey AS STRING), ', 1, 999, 7] it is')
  WHEN 4 THEN 'No match for the target.' ELSE 'nothing here' END AS text FROM {orders})"""
