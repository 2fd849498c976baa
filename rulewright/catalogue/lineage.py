"""Queries of contexts, lineage and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contexts as C
from ..operators import reprocess as R
from ..operators import selection as S
from .inputs import query

ROOTS = "(VALUES ('ctxa'), ('ctxb')) r(root)"
CLOSURE = f"""l AS (SELECT DISTINCT parent, child FROM edges), c1 AS (SELECT root, child AS name FROM {ROOTS} JOIN l ON root = parent),
    c2 AS (SELECT DISTINCT root, child AS name FROM c1 JOIN l ON name = parent), x3 AS (SELECT DISTINCT root, child AS name FROM c2 JOIN l ON name = parent),
    c3 AS (SELECT * FROM (SELECT * FROM c1 UNION SELECT * FROM c2 UNION SELECT * FROM x3) WHERE name NOT IN (SELECT parent FROM l))"""


def roots(edges):
    return edges.sparkSession.createDataFrame([("ctxa",), ("ctxb",)], "root string")


@query("context_mappings", "edges", f"WITH {CLOSURE} SELECT root, name, 1 AS depth FROM c1 UNION ALL SELECT root, name, 2 FROM c2 UNION ALL SELECT root, name, 3 FROM x3")
def context_mappings(edges):
    return C.context_closure(edges, roots(edges))


ORPHANS = "SELECT c_name AS name FROM customer UNION ALL SELECT p_brand || p_partkey FROM part"


@query("context_files", "edges customer part", f"WITH {CLOSURE}, f AS (SELECT root, name, 1 AS depth FROM c1 UNION ALL SELECT root, name, 2 FROM c2 UNION ALL SELECT root, name, 3 FROM x3), o AS ({ORPHANS}) SELECT * FROM f UNION ALL SELECT DISTINCT NULL, name, NULL FROM o WHERE name NOT IN (SELECT name FROM f)")
def context_files(edges, customer, part):
    """Files of both contexts, and those of the catalog that neither has."""
    catalog = customer.select(F.col("c_name").alias("name")).unionAll(part.select(F.concat("p_brand", F.col("p_partkey").cast("string"))))
    return C.context_closure(edges, roots(edges), catalog)


@query("bad_context_files", "edges nation supplier", f"WITH {CLOSURE}, f AS (SELECT * FROM c1 UNION SELECT * FROM c2 UNION SELECT * FROM x3) SELECT root, name FROM f WHERE lower(name) IN (SELECT lower(n_name) FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT lower(s_name) FROM supplier WHERE s_suppkey % 5 = 0)")
def bad_context_files(edges, nation, supplier):
    """Rule files and references of both contexts that are listed as bad."""
    bad = nation.where("n_nationkey % 4 = 1").select(F.lower("n_name").alias("name")).unionAll(supplier.where("s_suppkey % 5 = 0").select("s_name"))
    return S.bad_context_files(C.context_closure(edges, roots(edges)), bad)


@query("context_references", "edges", f"WITH {CLOSURE} SELECT root, name AS reference FROM c3")
def context_references(edges):
    return C.context_references(edges, roots(edges))


@query("added_references", "edges", f"WITH {CLOSURE} SELECT name AS reference FROM c3 WHERE root = 'ctxb' EXCEPT SELECT name FROM c3 WHERE root = 'ctxa'")
def added_references(edges):
    refs = context_references(edges)
    return C.added_references(refs.where("root = 'ctxa'"), refs.where("root = 'ctxb'"))


@query("deleted_references", "edges", f"WITH {CLOSURE} SELECT name AS reference FROM c3 WHERE root = 'ctxa' EXCEPT SELECT name FROM c3 WHERE root = 'ctxb'")
def deleted_references(edges):
    refs = context_references(edges)
    return C.added_references(refs.where("root = 'ctxb'"), refs.where("root = 'ctxa'"))


@query("updated_files", "history events", "WITH f AS (SELECT 'ctx_' || lpad(CAST(event_id - event_id % 500 AS STRING), 8, '0') AS context, event_type || (user_id % 100) AS name FROM events), m AS (SELECT min(context) AS a, max(context) AS b FROM history) SELECT DISTINCT name FROM f, m WHERE context > a AND context <= b EXCEPT SELECT name FROM f, m WHERE context = a")
def updated_files(history, events):
    files = events.select(F.concat(F.lit("ctx_"), F.lpad((F.col("event_id") - F.col("event_id") % 500).cast("string"), 8, "0")).alias("context"), F.concat("event_type", F.col("user_id") % 100).alias("name"))
    a, b = history.agg(F.min("context"), F.max("context")).first()
    return C.updated_files(history, files, a, b)


USED = "a AS (SELECT DISTINCT c_name AS name FROM customer WHERE c_custkey % 10 = 0)"


@query("uses", "edges customer", f"WITH {USED}, l AS (SELECT DISTINCT parent, child FROM edges), u1 AS (SELECT DISTINCT name, parent AS u FROM a JOIN l ON name = child), u2 AS (SELECT DISTINCT name, parent AS u FROM u1 JOIN l ON u = child), u3 AS (SELECT DISTINCT name, parent AS u FROM u2 JOIN l ON u = child), z AS (SELECT name, u, 1 AS depth FROM u1 UNION ALL SELECT name, u, 2 FROM u2 UNION ALL SELECT name, u, 3 FROM u3) SELECT name, u AS user, min(depth) AS depth FROM z GROUP BY ALL")
def uses(edges, customer):
    return C.uses(edges, customer.where("c_custkey % 10 = 0").select(F.col("c_name").alias("name")).distinct())


PATH = "'FLAG=' || p_flag || ',PRIORITY=' || p_priority"


def _keyed(rules):
    key = F.array(F.struct(F.lit("FLAG").alias("par"), F.col("p_flag").alias("pattern")), F.struct(F.lit("PRIORITY").alias("par"), F.col("p_priority").alias("pattern")))
    return rules.withColumn("match_key", key)


@query("match_paths", "rules", f"SELECT rmap, reference, {PATH} AS path, useafter FROM rules WHERE reference IN (SELECT reference FROM rules WHERE rule_id % 4 = 1)")
def match_paths(rules):
    return C.match_paths(_keyed(rules), rules.where("rule_id % 4 = 1")).drop("match_key")


@query("filter_match_paths", "rules", f"SELECT rmap, reference, {PATH} AS path, useafter FROM rules WHERE contains('|' || p_flag || '|', '|R|')")
def filter_match_paths(rules):
    return C.filter_match_paths(C.match_paths(_keyed(rules), rules), {"FLAG": "R", "OTHER": "x"}).drop("match_key")


@query("minimum_exptime", "rules", "SELECT reference, min(useafter) AS exptime FROM rules WHERE rule_id % 4 = 1 OR reference = 'N/A' AND EXISTS (SELECT 1 FROM rules WHERE rule_id % 4 = 1 AND reference = 'N/A') GROUP BY reference")
def minimum_exptime(rules):
    return C.minimum_exptime(C.match_paths(_keyed(rules), rules.where("rule_id % 4 = 1")))


@query("unreferenced", "edges supplier customer", f"WITH {CLOSURE} SELECT name FROM (SELECT s_name AS name FROM supplier UNION SELECT c_name FROM customer) f WHERE name NOT IN (SELECT name FROM c3 WHERE root = 'ctxb')")
def unreferenced(edges, supplier, customer):
    files = supplier.select(F.col("s_name").alias("name")).union(customer.select("c_name")).distinct()
    return C.unreferenced(files, context_references(edges).where("root = 'ctxb'"))


@query("missing_files", "edges supplier", f"WITH {CLOSURE} SELECT DISTINCT name FROM c3 WHERE name NOT IN (SELECT s_name FROM supplier)")
def missing_files(edges, supplier):
    return C.missing_files(context_references(edges), supplier.select(F.col("s_name").alias("name")))


@query("derivation_parents", "part", "WITH h AS (SELECT p_partkey, 'p' || p_partkey AS name, CASE p_partkey % 4 WHEN 0 THEN 'generated' WHEN 1 THEN 'p' || (p_partkey - 1) WHEN 2 THEN 'q' || p_partkey END AS parent FROM part) SELECT name, parent, parent IN (SELECT name FROM h) AS found FROM h WHERE parent <> 'generated'")
def derivation_parents(part):
    return C.derivation_parents(part.selectExpr("'p' || p_partkey as name", "case p_partkey % 4 when 0 then 'generated' when 1 then 'p' || (p_partkey - 1) when 2 then 'q' || p_partkey end as derived_from"))


TREES = """p1 AS (SELECT context, key AS path, child, sha, 1 AS depth FROM edges WHERE parent IN ('ctxa', 'ctxb')),
    p2 AS (SELECT p.context, p.path || '/' || e.key AS path, e.child, e.sha, 2 AS depth FROM p1 p JOIN edges e ON p.child = e.parent AND p.context = e.context),
    p3 AS (SELECT p.context, p.path || '/' || e.key AS path, e.child, e.sha, 3 AS depth FROM p2 p JOIN edges e ON p.child = e.parent AND p.context = e.context), p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)"""


def _level_sql(k: int, above: str, where: str) -> str:
    """CTE ``d{k}``: differing children of the pairs of nodes ``above``."""
    def side(c: str) -> str:
        return f"(SELECT e.*, u.path AS above FROM {above} u JOIN edges e ON e.context = '{c}' AND e.parent = u.{c} {where})"

    return f"""d{k} AS (SELECT CASE WHEN coalesce(x.above, y.above) = '' THEN '' ELSE coalesce(x.above, y.above) || '/' END || coalesce(x.key, y.key) AS path, x.child AS a, y.child AS b
      FROM {side('a')} x FULL JOIN {side('b')} y ON x.above = y.above AND x.key = y.key WHERE x.sha IS DISTINCT FROM y.sha)"""


def tree_sql(where: str = "") -> str:
    levels = ["d0 AS (SELECT '' AS path, 'ctxa' AS a, 'ctxb' AS b)", *(_level_sql(k, f"d{k - 1}", where) for k in (1, 2, 3))]
    action = "CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'deleted' ELSE 'replaced' END AS action"
    return f"WITH {', '.join(levels)} " + " UNION ALL ".join(f"SELECT path, {action}, a AS old_child, b AS new_child FROM d{k}" for k in (1, 2, 3))


def _trees(edges):
    return (edges.where(F.col("context") == c) for c in "ab")


@query("diff_contexts", "edges", f"""WITH {TREES} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'replaced' END AS action, a.child AS old_child, b.child AS new_child
    FROM (SELECT * FROM p WHERE context = 'a') a FULL JOIN (SELECT * FROM p WHERE context = 'b') b ON a.path = b.path WHERE a.sha IS DISTINCT FROM b.sha""")
def diff_contexts(edges):
    """Both trees whole: every path is compared."""
    return C.diff_whole_contexts(*_trees(edges), "ctxa", "ctxb")


@query("diff_contexts_expanded", "edges", tree_sql())
def diff_contexts_expanded(edges):
    """With all that lies below added and deleted mappings."""
    return C.diff_contexts(*_trees(edges), "ctxa", "ctxb", expand=True)


@query("with_children", "edges", "WITH o AS (SELECT parent, key, child, sha FROM edges WHERE context = 'a'), u AS (SELECT DISTINCT parent, key, 'new_' || child AS child, 'n' || sha AS sha FROM o WHERE key LIKE '%1') SELECT o.parent, o.key, coalesce(u.child, o.child) AS child, coalesce(u.sha, o.sha) AS sha FROM o LEFT JOIN u ON o.parent = u.parent AND o.key = u.key")
def with_children(edges):
    old = edges.where("context = 'a'").select("parent", "key", "child", "sha")
    return C.with_children(old, old.where("key like '%1'").selectExpr("parent", "key", "'new_' || child as child", "'n' || sha as sha"))


@query("history_pairs", "history", "SELECT * FROM (SELECT idx, context AS old_context, lead(context) OVER (ORDER BY idx) AS new_context FROM history WHERE idx >= 500) WHERE new_context > old_context")
def history_pairs(history):
    return C.history_pairs(history, start=500)


@query("history_span", "history", "SELECT * FROM (SELECT idx, context AS old_context, lead(context) OVER (ORDER BY idx) AS new_context FROM history WHERE idx >= (SELECT min(idx) FROM history WHERE start_date >= TIMESTAMP '2024-01-02') AND idx <= (SELECT min(idx) FROM history WHERE contains(context, '9000'))) WHERE new_context > old_context")
def history_span(history):
    """From a date to a part of a name."""
    return C.history_pairs(history, start="2024-01-02", stop="9000")


@query("latest_contexts", "history", "SELECT idx, context FROM history ORDER BY idx DESC LIMIT 5")
def latest_contexts(history):
    return C.latest_contexts(history, 5).select("idx", "context")


@query("contexts_between", "history", "SELECT idx, context FROM history WHERE context >= 'ctx_00001000' AND context <= 'ctx_00005000'")
def contexts_between(history):
    return C.contexts_between(history, "ctx_00001000", "ctx_00005000").select("idx", "context")


@query("context_by_date", "history events", "SELECT (SELECT max_by(context, idx) FROM history WHERE start_date <= TIMESTAMP '2024-01-10') AS context, count(*) AS n FROM events")
def context_by_date(history, events):
    context = S.active_context(history, "2024-01-10 00:00:00")
    return events.agg(F.lit(context).alias("context"), F.count("*").alias("n")).select(F.col("context").cast("string").alias("context"), "n")


@query("history_affected", "history events", """WITH p AS (SELECT * FROM (SELECT context AS o, lead(context) OVER (ORDER BY idx) AS n FROM history) WHERE n > o), e AS (SELECT 'ctx_' || lpad(CAST(event_id - event_id % 500 AS STRING), 8, '0') AS o, 'ctx_' || lpad(CAST(event_id - event_id % 500 + 500 AS STRING), 8, '0') AS n, 'd' || user_id AS dataset_id, event_id % 9 AS s FROM events)
    SELECT DISTINCT dataset_id FROM e WHERE (o, n) IN (SELECT (o, n) FROM p) AND s <> 0""")
def history_affected(history, events):
    c = "'ctx_' || lpad(cast(event_id - event_id % 500 + {} as string), 8, '0')"
    effects = events.selectExpr(f"{c.format(0)} as old_context", f"{c.format(500)} as new_context", "'d' || user_id as dataset_id", "case when event_id % 9 = 0 then 'errors' else 'ok' end as status")
    return R.history_affected(effects, C.history_pairs(history), drop_errors=True)


@query("result_plugins", "history events", """WITH p AS (SELECT * FROM (SELECT context AS o, lead(context) OVER (ORDER BY idx) AS n FROM history) WHERE n > o), e AS (SELECT 'ctx_' || lpad(CAST(event_id - event_id % 500 AS STRING), 8, '0') AS o, 'ctx_' || lpad(CAST(event_id - event_id % 500 + 500 AS STRING), 8, '0') AS n, 'd' || user_id AS dataset_id, event_id % 9 AS s FROM events)
    SELECT e.o AS old_context, e.n AS new_context, CASE WHEN s = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM e JOIN p ON e.o = p.o AND e.n = p.n GROUP BY ALL""")
def result_plugins(history, events):
    """What a plug-in is given of the effects of every change."""
    name = "'ctx_' || lpad(cast({} as string), 8, '0')"
    effects = events.selectExpr(f"{name.format('event_id - event_id % 500')} as old_context", f"{name.format('event_id - event_id % 500 + 500')} as new_context", "'d' || user_id as dataset_id", "case when event_id % 9 = 0 then 'failed' else 'ok' end as status")
    seen = []
    R.process_history(effects, C.history_pairs(history), R.ResultPlugins(log_affected=seen.append))
    return seen[0]
