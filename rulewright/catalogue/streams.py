"""Queries of incremental jobs and hooks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.hooks import apply_hook, hook
from ..operators import selection as S
from ..operators.certify import validate_rules
from ..operators.diffs import insert_headers as insert_by_headers
from ..sources.scratch import stored
from ..streaming.incremental import incremental_history, stream_best_references
from .inputs import query
from .selection import PARAMETERS, best_sql, headers, kept, keyed, matched_sql, status_sql


def _work(spark) -> str:
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("stream_best_references", "datasets rules", f"WITH {matched_sql()}, {best_sql('m', 'b')} SELECT dataset_id, instrument, reference FROM b")
def stream_references(datasets, rules):
    """Headers arrive as files; batches write what the batch operator gives, one folder each."""
    spark = datasets.sparkSession
    arriving = stored(headers(datasets), "arriving")
    work, rules = _work(spark), stored(keyed(rules), "rules")
    source = spark.readStream.schema(arriving.schema).parquet(arriving.inputFiles()[0].rsplit("/", 1)[0])

    def sink(best, number):
        best.select("dataset_id", F.col("rmap").alias("instrument"), "reference").write.mode("overwrite").parquet(f"{work}/out/batch={number}")

    stream_best_references(source, rules, PARAMETERS, sink, f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/out").drop("batch")


@query("incremental_history", "history", "SELECT * FROM (SELECT idx, context AS old_context, lead(context) OVER (ORDER BY idx) AS new_context FROM history) WHERE new_context > old_context")
def incremental(history):
    """History arrives in pieces, one file and one batch each."""
    spark = history.sparkSession
    work = _work(spark)
    cuts = sorted(set(history.approxQuantile("idx", [0.25, 0.5, 0.75], 0.01)))
    for low, high in zip([None, *cuts], [*cuts, None]):
        piece = history if low is None else history.where(F.col("idx") > low)
        piece = piece if high is None else piece.where(F.col("idx") <= high)
        piece.coalesce(1).write.mode("append").parquet(f"{work}/history")
    source = spark.readStream.schema(history.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/history")

    def job(pairs, number):
        pairs.write.mode("overwrite").parquet(f"{work}/out/batch={number}")

    incremental_history(source, job, f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/out").drop("batch")


@hook("precondition", "AUTOMOBILE", "table")
def _generic_flag(rows):
    return rows.withColumn("params", F.transform_values("params", lambda k, v: F.when((k == "FLAG") & (v == "N"), "N/A").otherwise(v)))


@query("hooks", "datasets", "SELECT dataset_id, CASE WHEN instrument = 'AUTOMOBILE' AND flag = 'N' THEN 'N/A' ELSE flag END AS flag FROM datasets WHERE instrument IN ('AUTOMOBILE', 'BUILDING')")
def hooks(datasets):
    parts = [apply_hook("precondition", i, "table", headers(datasets.where(F.col("instrument") == i))) for i in ("AUTOMOBILE", "BUILDING")]
    return parts[0].unionByName(parts[1]).select("dataset_id", F.col("params")["FLAG"].alias("flag"))


@hook("fallback", "BUILDING", "table")
@hook("fallback", "AUTOMOBILE", "table")
def _any_flag(rows):
    return rows.withColumn("params", F.transform_values("params", lambda k, v: F.when(k == "FLAG", "*").otherwise(v)))


FALLBACK_SQL = f"""hd AS (SELECT dataset_id, instrument, CASE WHEN instrument = 'AUTOMOBILE' AND flag = 'N' THEN 'N/A' ELSE flag END AS flag, priority, qty, exptime FROM datasets), {matched_sql()}, {best_sql('m', 'b')}""".replace("FROM datasets d", "FROM hd d").replace("qty FROM datasets)", "qty FROM hd)")
SECOND_SQL = f"""sd AS (SELECT d.* REPLACE ('*' AS flag) FROM hd d JOIN b ON d.dataset_id = b.dataset_id WHERE b.reference LIKE 'NOT FOUND%' AND d.instrument IN ('AUTOMOBILE', 'BUILDING')),
    st AS (SELECT DISTINCT instrument, flag, priority, qty FROM sd),
    s0 AS (SELECT st.*, r.rule_id, r.useafter, r.reference, CASE WHEN p_flag = 'N/A' THEN 0 WHEN p_flag LIKE 'not %' THEN -1 ELSE 1 END AS s_flag, {status_sql('st.priority', 'r.p_priority')} AS s_priority, {status_sql('st.qty', 'r.p_qty')} AS s_qty FROM st JOIN rules r ON st.instrument = r.rmap),
    s AS (SELECT *, CAST(s_flag = 1 AS INT) + CAST(s_priority = 1 AS INT) + CAST(s_qty = 1 AS INT) AS weight FROM s0 WHERE s_flag >= 0 AND s_priority >= 0 AND s_qty >= 0),
    {best_sql('s', 'c')}""".replace("FROM datasets d", "FROM sd d")


@query("fallback_lookup", "datasets rules", f"WITH {FALLBACK_SQL}, {SECOND_SQL} SELECT b.dataset_id, CASE WHEN b.reference LIKE 'NOT FOUND%' AND c.reference NOT LIKE 'NOT FOUND%' THEN c.reference ELSE b.reference END AS outcome FROM b LEFT JOIN c ON b.dataset_id = c.dataset_id")
def fallback_lookup(datasets, rules):
    """Headers are rewritten by the registered hooks before the match, and again after a miss."""
    found = S.hooked_lookup(headers(kept(datasets)), keyed(rules), PARAMETERS, "table")
    return found.select("dataset_id", F.col("reference").alias("outcome"))


@hook("update", "Brand#11", "table")
def _also_any_type(rows):
    """A reference serves the type of its header and all types that have no own one."""
    return rows.unionByName(rows.withColumn("kind", F.lit("N/A")))


@query("insert_headers", "part", """WITH r AS (SELECT DISTINCT upper(p_brand) AS rmap, upper(p_type) AS kind FROM part WHERE p_partkey % 4 <> 0),
    h AS (SELECT upper(p_brand) AS rmap, upper(p_type) AS kind, p_name || p_partkey AS reference, p_partkey FROM part WHERE p_partkey % 3 = 0),
    v AS (SELECT * FROM h UNION ALL SELECT rmap, 'N/A', reference, p_partkey FROM h WHERE rmap = 'BRAND#11'),
    i AS (SELECT rmap, kind, max_by(reference, p_partkey) AS reference, count(*) AS n FROM v GROUP BY rmap, kind)
    SELECT rmap, kind, 'N/A' AS shelf, coalesce(i.reference, 'old') AS reference, CASE WHEN i.n IS NULL THEN 'keep' WHEN o.known IS NULL THEN 'add' ELSE 'replace' END AS action, coalesce(i.n, 0) AS n_inserts
    FROM (SELECT *, 1 AS known FROM r) o FULL JOIN i USING (rmap, kind)""")
def insert_headers(part):
    """References are inserted as the update hooks of their instruments rewrite their headers."""
    rules = part.where("p_partkey % 4 <> 0").selectExpr("p_brand as rmap", "p_type as kind", "'N/A' as shelf", "'old' as reference").distinct()
    new = part.where("p_partkey % 3 = 0").selectExpr("p_brand as rmap", "p_type as kind", "cast(p_size as string) as shelf", "p_name || p_partkey as reference", "p_partkey as n")
    return insert_by_headers(rules, new, "table", ["rmap", "kind", "shelf"], "n", ["shelf"])


@query("validate_expansions", "rules", "SELECT rmap || ':' || rule_id AS ident, 'PRIORITY' AS name, 'error' AS severity, 'illegal value: ' || p_priority AS message FROM rules WHERE p_priority IN ('4-NOT SPECIFIED', '5-LOW')")
def validate_expansions(rules):
    valid = rules.sparkSession.createDataFrame([("PRIORITY", p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM")], "par string, value string")
    literal = rules.where("p_priority not like '%|%'")
    return validate_rules(literal.select("rmap", "rule_id", F.lit("PRIORITY").alias("par"), F.col("p_priority").alias("pattern")), valid)
