"""How queries get their inputs: projections of the given tables, written once in SQL that both engines read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Name -> SQL over the given tables (in braces) or over earlier inputs.
INPUTS = {
    "datasets": """
        SELECT dataset_id, min(instrument) AS instrument, min(flag) AS flag, min(priority) AS priority, min(ostatus) AS ostatus, min(qty) AS qty, min(exptime) AS exptime FROM (
        SELECT CAST(l_orderkey AS STRING) || ':' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS dataset_id,
               c_mktsegment AS instrument, l_returnflag AS flag, o_orderpriority AS priority, o_orderstatus AS ostatus,
               CAST(CAST(l_quantity AS INT) AS STRING) || '.0' AS qty, l_shipdate AS exptime
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey) x GROUP BY dataset_id""",
    # Datasets of which some have no exposure time, so that lookups fail.
    "exposures": "SELECT dataset_id, instrument, flag, priority, ostatus, qty, CASE WHEN CAST(substring(dataset_id, 1, instr(dataset_id, ':') - 1) AS BIGINT) % 50 <> 7 THEN exptime END AS exptime FROM {datasets}",
    "rules": """
        SELECT c_mktsegment AS rmap, k AS rule_id,
               CASE k % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'N|R' WHEN 2 THEN '*' WHEN 3 THEN 'N/A' WHEN 4 THEN 'not A' ELSE 'R' END AS p_flag,
               CASE k % 5 WHEN 0 THEN o_orderpriority WHEN 1 THEN '1-URGENT|2-*' WHEN 2 THEN 'N/A' WHEN 3 THEN '*' ELSE '((3|4).*)' END AS p_priority,
               CASE k % 7 WHEN 0 THEN 'between 10 30' WHEN 1 THEN '>25' WHEN 2 THEN '<=12' WHEN 4 THEN '*' WHEN 5 THEN '7.0' ELSE 'N/A' END AS p_qty,
               CASE WHEN k % 29 <> 0 THEN o_orderdate END AS useafter,
               CASE WHEN k % 29 = 0 THEN 'N/A' ELSE 'r' || lpad(CAST(k AS STRING), 9, '0') || '_x.fits' END AS reference,
               k % 10 <> 0 AS in_old
        FROM (SELECT *, CAST(o_orderkey / 25 AS BIGINT) AS k FROM {orders} WHERE o_orderkey % 25 = 0) o JOIN {customer} ON o_custkey = c_custkey""",
    "new_rules": "SELECT rmap, rule_id, p_flag, p_priority, p_qty, useafter, CASE WHEN rule_id % 7 = 3 AND reference <> 'N/A' THEN 'n' || reference ELSE reference END AS reference FROM {rules}",
    "old_rules": "SELECT rmap, rule_id, p_flag, p_priority, p_qty, useafter, reference FROM {rules} WHERE in_old",
    # Three levels of mappings in two contexts: region - nation - supplier or customer groups - single files.
    "edges": """
        SELECT context, parent, key, child, sha FROM (
        SELECT v.context AS context, 'ctx' || v.context AS parent, r_name AS key, v.context || '_' || r_name AS child, 's' || r_regionkey || CASE WHEN r_regionkey % 2 = 0 THEN v.context ELSE '' END AS sha FROM {region} CROSS JOIN {versions} v
        UNION ALL SELECT v.context, v.context || '_' || r_name, n_name, CASE WHEN n_nationkey % 3 = 0 THEN v.context ELSE '' END || n_name, 's' || n_nationkey || CASE WHEN n_nationkey % 3 = 0 THEN v.context ELSE '' END
          FROM {nation} JOIN {region} ON n_regionkey = r_regionkey CROSS JOIN {versions} v
        UNION ALL SELECT v.context, CASE WHEN n_nationkey % 3 = 0 THEN v.context ELSE '' END || n_name, CAST(s_suppkey AS STRING), s_name || CASE WHEN s_suppkey % 11 = 0 THEN v.context ELSE '' END, 's' || s_suppkey || CASE WHEN s_suppkey % 11 = 0 THEN v.context ELSE '' END
          FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey CROSS JOIN {versions} v WHERE v.context = 'b' OR s_suppkey % 7 <> 0
        UNION ALL SELECT v.context, CASE WHEN n_nationkey % 3 = 0 THEN v.context ELSE '' END || n_name, 'c' || c_custkey, c_name, 'c' || c_custkey
          FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey CROSS JOIN {versions} v WHERE v.context = 'a' OR c_custkey % 13 <> 0) e""",
    "versions": "SELECT 'a' AS context UNION ALL SELECT 'b' AS context",
    "history": "SELECT CAST(event_id AS INT) AS idx, ts AS start_date, 'ctx_' || lpad(CAST(event_id AS STRING), 8, '0') AS context FROM {events} WHERE event_id % 500 = 0",
    # Two versions of a table of modes: some rows removed, added, changed or doubled.
    "old_table": "SELECT CAST(p_partkey AS BIGINT) AS row_no, p_brand AS mode_a, p_type AS mode_b, CAST(p_size AS BIGINT) AS v1, p_retailprice AS v2 FROM {part} WHERE p_partkey % 10 <> 1",
    "new_table": "SELECT CAST(p_partkey AS BIGINT) AS row_no, p_brand AS mode_a, p_type AS mode_b, CAST(p_size AS BIGINT) + CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END AS v1, p_retailprice AS v2 FROM {part} WHERE p_partkey % 10 <> 2",
    "catalog": "SELECT doc_id, 'f' || doc_id || '.fits' AS name, CAST(n_chars AS BIGINT) AS size, sha1(text) AS sha1, CASE WHEN doc_id % 5 = 0 THEN 'archived' WHEN doc_id % 7 = 0 THEN 'uploaded' ELSE 'operational' END AS state, doc_id % 23 = 0 AS rejected, doc_id % 29 = 0 AS blacklisted, source AS instrument, lang AS filekind FROM {documents}",
    "store": "SELECT doc_id, 'f' || (doc_id + CASE WHEN doc_id % 31 = 0 THEN 1000000 ELSE 0 END) || '.fits' AS name, CAST(n_chars AS BIGINT) + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE sha1(text) END AS sha1 FROM {documents}",
}


def needed(names: list[str]) -> list[str]:
    """Inputs in an order in which each follows those it reads."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out or n in TABLES:
            return
        for m in re.findall(r"\{(\w+)\}", INPUTS[n]):
            visit(m)
        out.append(n)

    for n in names:
        visit(n)
    return out


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or an input made from them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sources = {m: load(spark, sf_dir, m) for m in sorted(set(re.findall(r"\{(\w+)\}", INPUTS[name])))}
    if name == "datasets" and (made := datasets_by_order(**sources)) is not None:
        return made
    return spark.sql(INPUTS[name], **sources)


def datasets_by_order(lineitem: DataFrame, orders: DataFrame, customer: DataFrame) -> DataFrame | None:
    """The input ``datasets`` with lines shuffled once, by order, instead of by order, by customer and by id.

    An id holds its four keys, so lines group by them inside their order's partition, and the least
    value of a pair of groups is the least of either.  Ids without a key fall together; where
    there are any, the result is None and the SQL does it.
    """
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    if not lineitem.where(" or ".join(f"{k} is null" for k in keys)).isEmpty():
        return None
    lines = lineitem.selectExpr(*keys, "l_returnflag", "cast(l_quantity as int) as q", "l_shipdate").repartition("l_orderkey")
    lines = lines.groupBy(*keys).agg(F.min("l_returnflag").alias("flag"), F.min(F.expr("cast(q as string) || '.0'")).alias("qty"), F.min("l_shipdate").alias("exptime"))
    heads = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select("o_orderkey", "c_mktsegment", "o_orderpriority", "o_orderstatus").repartition("o_orderkey")
    heads = heads.groupBy("o_orderkey").agg(F.min("c_mktsegment").alias("instrument"), F.min("o_orderpriority").alias("priority"), F.min("o_orderstatus").alias("ostatus"))
    ident = F.expr("cast(l_orderkey as string) || ':' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey").alias("dataset_id")
    return lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey")).select(ident, "instrument", "flag", "priority", "ostatus", "qty", "exptime")


def query(name: str, inputs: str = "", sql: str | None = None):
    """Register a query: its function gets the inputs as DataFrames; ``sql`` is its twin over the same inputs."""
    names = inputs.split()

    def add(f: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(*(load(spark, sf_dir, n) for n in names))
        if sql:
            parts = [f"{n} AS ({re.sub(r'[{}]', '', INPUTS[n])})" for n in needed(names)]
            own = sql.strip()
            if own.upper().startswith("WITH RECURSIVE "):
                ORACLES[name] = "WITH RECURSIVE " + ", ".join([*parts, own[15:]])
            elif own.upper().startswith("WITH "):
                ORACLES[name] = "WITH " + ", ".join([*parts, own[5:]])
            else:
                ORACLES[name] = (("WITH " + ", ".join(parts) + " ") if parts else "") + own
        return f

    return add
