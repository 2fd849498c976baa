"""Queries of differences, tables, certification and component tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import certify as V
from ..operators import components as G
from ..operators import contexts as C
from ..operators import diffs as D
from ..operators import tables as T
from .inputs import query

RULE_DIFF = """k AS (SELECT rmap || '/' || rule_id AS key, reference FROM old_rules), n AS (SELECT rmap || '/' || rule_id AS key, reference FROM new_rules WHERE rule_id % 13 <> 5),
    d AS (SELECT coalesce(k.key, n.key) AS key, CASE WHEN k.reference IS NULL THEN 'add' WHEN n.reference IS NULL THEN 'delete' ELSE 'replace' END AS action, k.reference AS old_value, n.reference AS new_value FROM k FULL JOIN n ON k.key = n.key WHERE k.reference IS DISTINCT FROM n.reference)"""


def rule_diff(old_rules, new_rules):
    return D.diff_rules(*(df.select(F.concat_ws("/", "rmap", "rule_id").alias("key"), "reference") for df in (old_rules, new_rules.where("rule_id % 13 <> 5"))), ["key"])


@query("diff_rules", "old_rules new_rules", f"WITH {RULE_DIFF} SELECT * FROM d")
def diff_rules(old_rules, new_rules):
    return rule_diff(old_rules, new_rules)


HEADERS = "SELECT 'r' || p_partkey AS rmap, p_brand AS a, p_name AS name, p_type AS t FROM part"


def header_diff(part):
    old = part.select(F.concat(F.lit("r"), "p_partkey").alias("rmap"), F.create_map(F.lit("brand"), "p_brand", F.lit("name"), "p_name", F.lit("gone"), F.lit("1")).alias("header"))
    new = part.select(F.concat(F.lit("r"), "p_partkey").alias("rmap"), F.create_map(F.lit("brand"), F.expr("case when p_partkey % 5 = 0 then 'b' else p_brand end"), F.lit("name"), F.concat("p_name", F.lit("2"))).alias("header"))
    return D.diff_headers(old, new)


HEADER_DIFF = """h AS (SELECT 'r' || p_partkey AS rmap, 'brand' AS key, 'replace_header' AS action, p_brand AS old_value, 'b' AS new_value FROM part WHERE p_partkey % 5 = 0 AND p_brand <> 'b'
    UNION ALL SELECT 'r' || p_partkey, 'name', 'replace_header', p_name, p_name || '2' FROM part UNION ALL SELECT 'r' || p_partkey, 'gone', 'delete_header', '1', NULL FROM part)"""


@query("diff_headers", "part", f"WITH {HEADER_DIFF} SELECT * FROM h")
def diff_headers(part):
    return header_diff(part)


@query("remove_boring", "part", f"WITH {HEADER_DIFF} SELECT * FROM h WHERE key <> 'name'")
def remove_boring(part):
    return D.remove_boring(header_diff(part))


@query("check_diffs", "supplier", "SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'deletion' ELSE 'reversion' END AS warning FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey > s_nationkey")
def check_diffs(supplier):
    name = "'obs_ins_dark_' || lpad(cast({} as string), 6, '0') || '.fits'"
    d = supplier.selectExpr("s_suppkey as key", "case when s_suppkey % 3 = 0 then 'delete' else 'replace' end as action", f"{name.format('s_suppkey')} as old_value", f"case when s_suppkey % 3 > 0 then {name.format('s_nationkey')} end as new_value")
    return D.check_diffs(d).select("key", "warning")


@query("affected_modes", "old_rules new_rules", f"WITH {RULE_DIFF} SELECT split_part(key, '/', 1) AS instrument, action, count(*) AS n_diffs FROM d GROUP BY ALL")
def affected_modes(old_rules, new_rules):
    return D.affected_modes(rule_diff(old_rules, new_rules).withColumn("instrument", F.substring_index("key", "/", 1)), ["instrument", "action"])


@query("affected_types", "old_rules new_rules", f"WITH {RULE_DIFF} SELECT split_part(key, '/', 1) AS instrument, string_agg(DISTINCT action, ' ' ORDER BY action) AS filekinds FROM d GROUP BY 1")
def affected_types(old_rules, new_rules):
    return D.affected_types(rule_diff(old_rules, new_rules).select(F.substring_index("key", "/", 1).alias("instrument"), F.col("action").alias("filekind")))


@query("check_modifications", "old_rules new_rules", f"WITH {RULE_DIFF} SELECT action, count(*) AS n, count(DISTINCT old_value) AS n_old, count(DISTINCT new_value) AS n_new, action IN ('add', 'replace') AS expected FROM d GROUP BY action")
def check_modifications(old_rules, new_rules):
    return D.check_modifications(rule_diff(old_rules, new_rules), ["add", "replace"])


@query("insert_references", "part", """WITH r AS (SELECT DISTINCT upper(p_brand) AS a, upper(p_type) AS b, 'old' AS reference FROM part WHERE p_partkey % 4 <> 0), i AS (SELECT upper(p_brand) AS a, upper(p_type) AS b, max_by(p_name || p_partkey, p_partkey) AS n, count(*) AS c FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL)
    SELECT coalesce(r.a, i.a) AS a, coalesce(r.b, i.b) AS b, coalesce(i.n, r.reference) AS reference, CASE WHEN i.n IS NULL THEN 'keep' WHEN r.reference IS NULL THEN 'add' ELSE 'replace' END AS action, coalesce(i.c, 0) AS n_inserts FROM r FULL JOIN i ON r.a = i.a AND r.b = i.b""")
def insert_references(part):
    rules = part.where("p_partkey % 4 <> 0").selectExpr("p_brand as a", "p_type as b", "'old' as reference").distinct()
    return D.insert_references(rules, part.where("p_partkey % 3 = 0").selectExpr("p_brand as a", "p_type as b", "p_name || p_partkey as reference", "p_partkey as o"), ["a", "b"], "o")


@query("delete_references", "rules", "SELECT rmap, rule_id, reference FROM rules WHERE reference NOT IN (SELECT reference FROM rules WHERE rule_id % 5 = 2)")
def delete_references(rules):
    return D.delete_references(rules.select("rmap", "rule_id", "reference"), rules.where("rule_id % 5 = 2"))[0]


@query("undeleted_references", "rules supplier", "SELECT DISTINCT s_name AS reference FROM supplier WHERE s_name NOT IN (SELECT reference FROM rules)")
def undeleted_references(rules, supplier):
    return D.delete_references(rules.select("reference"), supplier.select(F.col("s_name").alias("reference")))[1]


def keyed(rules):
    return rules.withColumn("match_key", F.array(*(F.struct(F.lit(p).alias("par"), F.col(c).alias("pattern")) for p, c in (("FLAG", "p_flag"), ("PRIORITY", "p_priority"), ("QTY", "p_qty")))))


@query("drop_parameter", "rules", "SELECT rmap, rule_id, 'FLAG=' || p_flag || ',QTY=' || p_qty AS path FROM rules")
def drop_parameter(rules):
    return D.drop_parameter(keyed(rules), "PRIORITY").select("rmap", "rule_id", D.key_text(F.col("match_key")).alias("path"))


@query("duplicate_keys", "rules", "SELECT rmap, p_flag, p_qty, count(*) AS n_rules FROM rules GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(rules):
    return D.duplicate_keys(rules, ["rmap", "p_flag", "p_qty"])


FIELDS = ("p_flag", "p_priority", "p_qty")
MEMBERS = "list_distinct(string_split({}, '|'))"


def covers_sql(a: str, b: str) -> str:
    """Pattern ``a`` covers pattern ``b``."""
    more = f"len({MEMBERS.format(a)}) > len({MEMBERS.format(b)}) AND list_has_all({MEMBERS.format(a)}, {MEMBERS.format(b)})"
    return f"({a} = {b} OR {a} = '*' OR {b} = 'N/A' OR {a} = 'N/A' AND {b} = '*' OR {b} <> '*' AND {a} <> 'N/A' AND {more})"


def _key_sql(t: str) -> str:
    return " || '/' || ".join(f"{t}.{c}" for c in FIELDS)


@query("ambiguous_rules", "rules", f"WITH k AS (SELECT DISTINCT rmap, {', '.join(FIELDS)} FROM rules) SELECT b.rmap, {_key_sql('b')} AS covered, {_key_sql('a')} AS covering FROM k a JOIN k b ON a.rmap = b.rmap AND {_key_sql('a')} <> {_key_sql('b')} AND " + " AND ".join(covers_sql(f"a.{c}", f"b.{c}") for c in FIELDS) + " AND " + " + ".join(f"CAST(b.{c} = 'N/A' AS INT) - CAST(a.{c} = 'N/A' AS INT)" for c in FIELDS) + " = 0")
def ambiguous_rules(rules):
    found = D.ambiguous_rules(keyed(rules))
    return found.select("rmap", F.array_join("covered", "/").alias("covered"), F.array_join("covering", "/").alias("covering"))


# --- tables ---------------------------------------------------------------------

COMMON = "row_no, mode_a, mode_b, v1, v2"


@query("row_diff", "old_table new_table", f"SELECT {COMMON}, 'removed' AS change, 1 AS n FROM (SELECT {COMMON} FROM old_table EXCEPT ALL SELECT {COMMON} FROM new_table) UNION ALL SELECT {COMMON}, 'added', 1 FROM (SELECT {COMMON} FROM new_table EXCEPT ALL SELECT {COMMON} FROM old_table)")
def row_diff(old_table, new_table):
    return T.row_diff(old_table, new_table)


#: Steps of the ordered difference where no two rows of a table have the same content: blocks ``x`` of rows that stay, changes ``c``.
ALIGNED = """a AS (SELECT *, row_number() OVER (ORDER BY row_no) - 1 AS i FROM old_table), b AS (SELECT *, row_number() OVER (ORDER BY row_no) - 1 AS j FROM new_table),
    m AS (SELECT i, j FROM a JOIN b USING (row_no, mode_a, mode_b, v1, v2)),
    g AS (SELECT i, j, sum(fresh) OVER (ORDER BY i) AS k FROM (SELECT i, j, CASE WHEN lag(i) OVER (ORDER BY i) = i - 1 AND lag(j) OVER (ORDER BY i) = j - 1 THEN 0 ELSE 1 END AS fresh FROM m)),
    x AS (SELECT min(i) AS i1, max(i) + 1 AS i2, min(j) AS j1, max(j) + 1 AS j2 FROM g GROUP BY k UNION ALL SELECT n, n, o, o FROM (SELECT count(*) AS n FROM a), (SELECT count(*) AS o FROM b)),
    y AS (SELECT coalesce(lag(i2) OVER w, 0) AS a1, i1 AS a2, coalesce(lag(j2) OVER w, 0) AS b1, j1 AS b2, coalesce(lag(i2 - i1) OVER w, 0) AS before, i2 - i1 AS after FROM x WINDOW w AS (ORDER BY i1, i2)),
    c AS (SELECT * FROM y WHERE a2 > a1 OR b2 > b1)"""


def ordered(old_table, new_table):
    return A.OrderedDiff(old_table, new_table, "row_no")


@query("row_opcodes", "old_table new_table", f"WITH {ALIGNED} SELECT 'equal' AS tag, i1, i2, j1, j2 FROM x WHERE i2 > i1 UNION ALL SELECT CASE WHEN a2 = a1 THEN 'insert' WHEN b2 = b1 THEN 'delete' ELSE 'replace' END, a1, a2, b1, b2 FROM c")
def row_opcodes(old_table, new_table):
    return ordered(old_table, new_table).opcodes()


@query("row_hunks", "old_table new_table", f"""WITH {ALIGNED}, h AS (SELECT *, sum(CASE WHEN before > 6 THEN 1 ELSE 0 END) OVER (ORDER BY a1, b1) AS hunk FROM c)
    SELECT min(a1 - least(before, 3)) AS i1, max(a2 + least(after, 3)) AS i2, min(b1 - least(before, 3)) AS j1, max(b2 + least(after, 3)) AS j2, CAST(sum(a2 - a1) AS BIGINT) AS removed, CAST(sum(b2 - b1) AS BIGINT) AS added FROM h GROUP BY hunk""")
def row_hunks(old_table, new_table):
    return ordered(old_table, new_table).hunks()


@query("row_similarity", "old_table new_table", f"WITH {ALIGNED} SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b, (SELECT count(*) FROM m) AS matched, 2.0 * (SELECT count(*) FROM m) / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b)) AS ratio")
def row_similarity(old_table, new_table):
    return ordered(old_table, new_table).similarity()


@query("changed_rows", "old_table new_table", "SELECT row_no, o.v1 AS old_v1, o.v2 AS old_v2, n.v1 AS new_v1, n.v2 AS new_v2 FROM old_table o JOIN new_table n USING (row_no) WHERE o.v1 <> n.v1 OR o.v2 <> n.v2")
def changed_rows(old_table, new_table):
    return T.changed_rows(old_table, new_table, ["row_no"], ["v1", "v2"])


@query("first_of_duplicates", "old_table", "SELECT mode_a, mode_b, min(row_no) AS row_no, min_by(v1, row_no) AS v1, min_by(v2, row_no) AS v2, count(*) AS n_rows FROM old_table GROUP BY mode_a, mode_b")
def first_of_duplicates(old_table):
    return T.first_of_duplicates(old_table, ["mode_a", "mode_b"])


@query("mode_diff", "old_table new_table", """WITH a AS (SELECT DISTINCT mode_a FROM (SELECT mode_a FROM old_table UNION SELECT mode_a FROM new_table)), b AS (SELECT DISTINCT mode_b FROM (SELECT mode_b FROM old_table UNION SELECT mode_b FROM new_table)),
    c AS (SELECT mode_a, mode_b, (SELECT count(*) FROM old_table o WHERE o.mode_a = a.mode_a AND o.mode_b = b.mode_b) AS n_a, (SELECT count(*) FROM new_table o WHERE o.mode_a = a.mode_a AND o.mode_b = b.mode_b) AS n_b FROM a, b) SELECT * FROM c WHERE n_a <> 1 OR n_b <> 1""")
def mode_diff(old_table, new_table):
    return T.mode_diff(old_table, new_table, ["mode_a", "mode_b"])


@query("changed_modes", "old_table new_table", """WITH o AS (SELECT mode_a, mode_b, row_no % 397 AS slot, min(v1) AS v1, min(v2) AS v2 FROM old_table GROUP BY ALL HAVING count(*) = 1), n AS (SELECT mode_a, mode_b, row_no % 397 AS slot, min(v1) AS v1, min(v2) AS v2 FROM new_table GROUP BY ALL HAVING count(*) = 1)
    SELECT mode_a, mode_b, slot, o.v1 AS old_v1, o.v2 AS old_v2, n.v1 AS new_v1, n.v2 AS new_v2 FROM o JOIN n USING (mode_a, mode_b, slot) WHERE (o.v1 <> n.v1 OR o.v2 <> n.v2) AND mode_a <> 'Brand#11'""")
def changed_modes(old_table, new_table):
    """Modes of three columns, of all brands but one."""
    old, new = (t.withColumn("slot", F.col("row_no") % 397) for t in (old_table, new_table))
    brands = [r.mode_a for r in old.select("mode_a").union(new.select("mode_a")).distinct().collect() if r.mode_a != "Brand#11"]  # a few dozen
    return T.changed_modes(old, new, ["mode_a", "mode_b", "slot"], ["v1", "v2"], only={"mode_a": brands})


@query("check_table_modes", "old_table new_table", """WITH o AS (SELECT mode_a, mode_b, min_by(v1, row_no) AS v1, min_by(v2, row_no) AS v2 FROM old_table GROUP BY ALL), n AS (SELECT mode_a, mode_b, min_by(v1, row_no) AS v1, min_by(v2, row_no) AS v2, count(*) AS c FROM new_table GROUP BY ALL),
    f AS (SELECT coalesce(o.mode_a, n.mode_a) AS mode_a, coalesce(o.mode_b, n.mode_b) AS mode_b, CASE WHEN n.mode_a IS NULL THEN 'missing' WHEN c > 1 THEN 'duplicate' WHEN o.mode_a IS NULL THEN 'new' WHEN o.v1 <> n.v1 OR o.v2 <> n.v2 THEN 'changed' END AS finding FROM o FULL JOIN n ON o.mode_a = n.mode_a AND o.mode_b = n.mode_b) SELECT * FROM f WHERE finding IS NOT NULL""")
def check_table_modes(old_table, new_table):
    return T.check_table_modes(old_table, new_table, ["mode_a", "mode_b", "absent"], ["v1", "v2"])


UPDATES = "u AS (SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS dataset_id, 'o' AS old_reference, 'n' AS new_reference, p_brand AS mode_a, CASE WHEN l_partkey % 50 = 0 THEN 'UNDEFINED' ELSE p_type END AS mode_b FROM lineitem JOIN part ON l_partkey = p_partkey)"
ROWS = "t AS (SELECT 'o' AS reference, mode_a, CASE WHEN row_no % 40 = 0 THEN 'ANY' ELSE mode_b END AS mode_b, v1, v2 FROM old_table UNION ALL SELECT 'n', mode_a, CASE WHEN row_no % 40 = 0 THEN 'ANY' ELSE mode_b END, v1, v2 FROM new_table)"


@query("reprocessing_required", "lineitem part old_table new_table", f"""WITH {UPDATES}, {ROWS}, c AS (SELECT DISTINCT mode_a, mode_b FROM u WHERE mode_b <> 'UNDEFINED'),
    s AS (SELECT c.mode_a, c.mode_b, list_sort(list((t.mode_a, t.mode_b, v1, v2)) FILTER (reference = 'o')) AS lo, list_sort(list((t.mode_a, t.mode_b, v1, v2)) FILTER (reference = 'n')) AS ln
      FROM c LEFT JOIN t ON contains(c.mode_a, t.mode_a) AND (t.mode_b = 'ANY' OR contains(c.mode_b, t.mode_b)) GROUP BY ALL)
    SELECT u.* FROM u LEFT JOIN s ON u.mode_a = s.mode_a AND u.mode_b = s.mode_b WHERE s.mode_a IS NULL OR lo IS DISTINCT FROM ln""")
def reprocessing_required(lineitem, part, old_table, new_table):
    u = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey as dataset_id", "'o' as old_reference", "'n' as new_reference", "p_brand as mode_a", "case when l_partkey % 50 = 0 then 'UNDEFINED' else p_type end as mode_b")
    mode = "case when row_no % 40 = 0 then 'ANY' else mode_b end as mode_b"
    rows = old_table.selectExpr("'o' as reference", "mode_a", mode, "v1", "v2").unionAll(new_table.selectExpr("'n' as reference", "mode_a", mode, "v1", "v2"))
    return T.reprocessing_required(u, rows, ["mode_a", "mode_b"], ["v1", "v2"]).select("dataset_id", "old_reference", "new_reference", "mode_a", "mode_b")


EFFECTIVE = "CASE WHEN l_partkey % 5 = 1 THEN 'always' WHEN l_partkey % 5 = 2 THEN 'unknown' WHEN l_partkey % 5 = 3 THEN 'wide' ELSE 'modes' END"
#: Header values: a brand that stands for two, undefined types, a number written in its own way.
MODES = "CASE WHEN p_brand = 'Brand#13' THEN 'BOTH' ELSE p_brand END AS mode_a, CASE WHEN l_partkey % 50 = 0 THEN 'UNDEFINED' ELSE p_type END AS mode_b, CAST(l_linenumber % 5 AS STRING) || '.0' AS slot"
CELLS = "mode_a, CASE WHEN row_no % 40 = 0 THEN 'ANY' ELSE mode_b END AS mode_b, CASE WHEN row_no % 9 = 0 THEN '-1' WHEN row_no % 50 = 7 THEN 'ANY' ELSE CAST(row_no % 4 AS STRING) END AS slot, v1, v2"


@query("effective_updates", "lineitem part old_table new_table", f"""WITH t AS (SELECT 'o' AS reference, {CELLS} FROM old_table UNION ALL SELECT 'n', {CELLS} FROM new_table),
    k AS (SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS dataset_id, {EFFECTIVE} AS filekind, CASE WHEN l_partkey % 11 = 0 THEN 'N/A' WHEN {EFFECTIVE} = 'wide' THEN 'w' ELSE 'n' END AS new_reference, {MODES} FROM lineitem JOIN part ON l_partkey = p_partkey),
    c AS (SELECT DISTINCT mode_a, mode_b, slot FROM k WHERE mode_b <> 'UNDEFINED'),
    s AS (SELECT c.mode_a, c.mode_b, c.slot, list_sort(list((t.mode_a, t.mode_b, t.slot, v1, v2)) FILTER (reference = 'o')) AS lo, list_sort(list((t.mode_a, t.mode_b, t.slot, v1, v2)) FILTER (reference = 'n')) AS ln
      FROM c LEFT JOIN t ON CASE WHEN c.mode_a = 'BOTH' THEN t.mode_a IN ('Brand#11', 'Brand#12') ELSE contains(c.mode_a, t.mode_a) END AND (t.mode_b = 'ANY' OR contains(c.mode_b, t.mode_b)) AND (t.slot = '-1' OR t.slot || '.0' = c.slot) GROUP BY ALL)
    SELECT k.dataset_id, k.filekind, k.new_reference FROM k LEFT JOIN s ON k.mode_a = s.mode_a AND k.mode_b = s.mode_b AND k.slot = s.slot WHERE k.filekind <> 'modes' OR k.new_reference <> 'n' OR s.mode_a IS NULL OR lo IS DISTINCT FROM ln""")
def effective_updates(lineitem, part, old_table, new_table):
    """Wildcards of a field's own, a header value that stands for two, numbers by value, selections of nothing."""
    u = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    new = f"case when l_partkey % 11 = 0 then 'N/A' when {EFFECTIVE} = 'wide' then 'w' else 'n' end as new_reference"
    u = u.selectExpr("l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey as dataset_id", "'cam' as instrument", f"{EFFECTIVE} as filekind", "'o' as old_reference", new, *(f"{c} AS {n}" for c, n in (x.rsplit(" AS ", 1) for x in MODES.split(", "))))
    u = u.withColumn("params", F.create_map(F.lit("MODE_A"), "mode_a", F.lit("MODE_B"), "mode_b", F.lit("SLOT"), "slot")).drop("mode_a", "mode_b", "slot")
    cells = F.create_map(*(x for c in ("mode_a", "mode_b", "slot", "v1", "v2") for x in (F.lit(c.upper()), F.col(c).cast("string"))))
    side = lambda t, name, c=cells: t.selectExpr(*CELLS.split(", ")).select(F.lit(name).alias("reference"), c.alias("cells"))
    rows = side(old_table, "o").unionAll(side(new_table, "n")).unionAll(side(old_table, "w", F.map_concat(F.create_map(F.lit("EXTRA"), F.lit("x")), cells)))
    fields = [T.ModeField("MODE_A", metavalues={"BOTH": ["Brand#11", "Brand#12"]}), "MODE_B", T.ModeField("SLOT", ("-1",))]
    registry = T.mode_registry(part.sparkSession, {("cam", "modes"): fields, ("cam", "wide"): fields[:2], ("cam", "always"): None})
    return T.effective_updates(u, rows, registry).select("dataset_id", "filekind", "new_reference")


@query("mode_select", "part", "SELECT p_partkey FROM part WHERE contains('Brand#1 Brand#11 Brand#12 Brand#23', p_brand) AND (p_size = 7 OR p_size = 9)")
def mode_select(part):
    return T.mode_select(part, {"p_brand": "Brand#1 Brand#11 Brand#12 Brand#23", "p_size": "7.0"}, {"p_size": ["9.0"]}).select("p_partkey")


# --- certification -----------------------------------------------------------------

PART_HEADERS = "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice, p_partkey % 3 AS m FROM part"


def part_headers(part):
    params = F.expr("map('BRAND', case when p_partkey % 7 = 0 then 'UNDEFINED' else p_brand end, 'SIZE', p_size || case when p_partkey % 11 = 0 then '.5' else '' end, 'PRICE', cast(cast(p_retailprice as decimal(12,2)) as string), 'SUBARRAY', case p_partkey % 3 when 0 then 'FULL' when 1 then 'SUB64' else 'GENERIC' end, 'FLAG', case p_partkey % 4 when 0 then 'T' when 1 then 'x' else 'F' end)")
    return part.select(F.col("p_partkey").alias("ident"), F.lit("part").alias("instrument"), F.lit("k").alias("filekind"), params.alias("params"))


def constraints(spark, rows):
    return spark.createDataFrame([("part", "k", n, d, p, v) for n, d, p, v in rows], "instrument string, filekind string, name string, datatype string, presence string, values array<string>")


@query("check_presence", "part", """SELECT p_partkey AS ident, 'BRAND' AS name, 'error' AS severity, 'is missing' AS message FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey, 'SIZE', 'error', 'must not be there' FROM part
    UNION ALL SELECT p_partkey, 'NOTE', 'warning', 'is missing' FROM part UNION ALL SELECT p_partkey, 'WIDE', 'error', 'is missing' FROM part WHERE p_partkey % 3 <> 1 UNION ALL SELECT p_partkey, 'PIECE', 'error', 'is missing' FROM part WHERE p_partkey % 3 = 1""")
def check_presence(part):
    c = constraints(part.sparkSession, [("BRAND", "C", "R", []), ("SIZE", "I", "E", []), ("NOTE", "C", "W", []), ("MAYBE", "C", "O", []), ("WIDE", "C", "F", []), ("PIECE", "C", "S", [])])
    return V.check_presence(part_headers(part), c)


@query("check_conditional_presence", "part", """SELECT p_partkey AS ident, 'BRAND' AS name, 'error' AS severity, 'is missing' AS message FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey, 'NOTE', 'error', 'is missing' FROM part WHERE p_partkey % 3 = 1 AND p_size >= 20
    UNION ALL SELECT p_partkey, 'HINT', 'warning', 'is missing' FROM part WHERE p_partkey % 3 <> 1 UNION ALL SELECT p_partkey, 'LOUD', CASE WHEN p_partkey % 4 = 0 THEN 'error' ELSE 'warning' END, 'is missing' FROM part""")
def check_conditional_presence(part):
    """Conditions in parentheses, and an optional parameter that rules match by."""
    c = constraints(part.sparkSession, [("BRAND", "C", "O", []), ("NOTE", "C", "(is_subarray() and SIZE >= 20)", []), ("HINT", "C", "(warning(is_full_frame()))", []), ("LOUD", "C", "(warn_only(FLAG == 'T'))", []), ("MAYBE", "C", "O", []), ("BROKEN", "C", "(no such thing)", [])])
    matching = part.sparkSession.createDataFrame([("part", "k", "BRAND")], "instrument string, filekind string, name string")
    return V.check_presence(part_headers(part), c, matching)


@query("check_columns", "lineitem", """WITH n AS (SELECT l_linestatus AS ident, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS a, count(*) FILTER (NOT (l_linenumber BETWEEN 1 AND 4 OR l_linenumber = 6)) AS b, count(*) FILTER (l_tax > 0.05 + 1e-8) AS c FROM lineitem GROUP BY 1)
    SELECT ident, 'l_returnflag' AS name, 'error' AS severity, a || ' cells not allowed' AS message FROM n WHERE a > 0 UNION ALL SELECT ident, 'l_linenumber', 'error', b || ' cells not allowed' FROM n WHERE b > 0
    UNION ALL SELECT ident, 'l_tax', 'error', c || ' cells not allowed' FROM n WHERE c > 0 UNION ALL SELECT ident, 'l_weight', 'error', 'column is missing' FROM n UNION ALL SELECT ident, 'l_note', 'warning', 'column is missing' FROM n""")
def check_columns(lineitem):
    return V.check_columns(lineitem, [("l_returnflag", "C", "R", ["a", "n"]), ("l_linenumber", "I", "R", ["1:4", "6"]), ("l_tax", "D", "O", ["0:0.05"]), ("l_weight", "D", "R", []), ("l_note", "C", "W", []), ("l_other", "C", "O", [])], "l_linestatus")


@query("check_allowed_values", "part", "SELECT p_partkey AS ident, 'BRAND' AS name, 'error' AS severity, 'value not allowed: ' || p_brand AS message FROM part WHERE p_partkey % 7 <> 0 AND upper(p_brand) NOT IN ('BRAND#1', 'BRAND#12', 'BRAND#13') UNION ALL SELECT p_partkey, 'FLAG', 'error', 'value not allowed: x' FROM part WHERE p_partkey % 4 = 1")
def check_allowed_values(part):
    c = constraints(part.sparkSession, [("BRAND", "C", "O", ["brand#1", "BRAND#12", "BRAND#13"]), ("FLAG", "L", "O", [])])
    return V.check_allowed_values(V.with_constraints(part_headers(part), c))


@query("check_numeric", "part", "SELECT p_partkey AS ident, 'SIZE' AS name, 'error' AS severity, 'number not allowed: ' || p_size || CASE WHEN p_partkey % 11 = 0 THEN '.5' ELSE '' END AS message FROM part WHERE p_partkey % 11 = 0 OR NOT (p_size BETWEEN 5 AND 30 OR p_size = 42)")
def check_numeric(part):
    return V.check_numeric(V.with_constraints(part_headers(part), constraints(part.sparkSession, [("SIZE", "I", "O", ["5:30", "42"])])))


@query("check_column_values", "lineitem", "SELECT l_linestatus AS ident, 'l_returnflag' AS name, 'error' AS severity, count(*) || ' cells not allowed' AS message FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY l_linestatus")
def check_column_values(lineitem):
    return V.check_column_values(lineitem, "l_returnflag", ["a", "N"], "l_linestatus")


@query("check_expression", "part", "SELECT p_partkey AS ident, 'brand rule' AS name, 'error' AS severity, 'fails: BRAND != ''Brand#1'' or SIZE < 20' AS message FROM part WHERE p_partkey % 7 <> 0 AND p_brand = 'Brand#1' AND p_size + CASE WHEN p_partkey % 11 = 0 THEN 0.5 ELSE 0 END >= 20")
def check_expression(part):
    return V.check_expression(part_headers(part), "brand rule", "BRAND != 'Brand#1' or SIZE < 20")


@query("check_column_expression", "lineitem", "SELECT l_returnflag AS ident, 'l_tax' AS name, 'error' AS severity, count(*) || ' cells fail' AS message FROM lineitem WHERE NOT (l_tax <= l_discount + 0.05) GROUP BY l_returnflag")
def check_column_expression(lineitem):
    return V.check_column_expression(lineitem, "l_tax", F.col("l_tax") <= F.col("l_discount") + 0.05, "l_returnflag")


@query("check_pedigree", "part", "SELECT p_partkey AS ident, 'PEDIGREE' AS name, 'error' AS severity, CASE p_partkey % 6 WHEN 1 THEN 'unknown kind' WHEN 2 THEN 'dates missing' WHEN 3 THEN 'dates not expected' WHEN 4 THEN 'bad date' ELSE 'start after stop' END AS message FROM part WHERE p_partkey % 6 <> 0")
def check_pedigree(part):
    text = F.expr("case p_partkey % 6 when 0 then 'Inflight 01/02/2001 03/04/2002' when 1 then 'foo' when 2 then 'INFLIGHT' when 3 then 'GROUND 01/02/2001 03/04/2002' when 4 then 'INFLIGHT 41/02/2001 03/04/2002' else 'INFLIGHT 01/02/2003 03/04/2002' end")
    return V.check_pedigree(part.withColumnRenamed("p_partkey", "ident").withColumn("p_partkey", F.col("ident")), text)


@query("check_dates", "events", "SELECT event_id AS ident, 'DATE' AS name, CASE WHEN event_id % 3 = 1 THEN 'warning' ELSE 'error' END AS severity, 'date format' AS message FROM events WHERE event_id % 3 <> 0")
def check_dates(events):
    text = F.expr("case event_id % 3 when 0 then date_format(ts, 'yyyy-MM-dd') when 1 then date_format(ts, 'MM/dd/yyyy') else 'soon' end")
    return V.check_dates(events.withColumn("ident", F.col("event_id")), text, "dash", "DATE")


@query("check_kernel_unity", "embeddings", "WITH k AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s, embedding[len(embedding) // 2 + 1] AS c FROM embeddings) SELECT vec_id AS ident, 'embedding' AS name, CASE WHEN abs(s - 1) > 0.5 THEN 'error' ELSE 'warning' END AS severity, 'kernel' AS message FROM k WHERE abs(s - 1) > 0.5 OR c >= 1")
def check_kernel_unity(embeddings):
    return V.check_kernel_unity(embeddings, "embedding", "vec_id", tolerance=0.5)


@query("check_isomorphic_stack", "part", "WITH n AS (SELECT p_brand AS ident, p_type AS name, count(DISTINCT p_size % 2) AS kinds, count(*) AS n FROM part GROUP BY ALL) SELECT ident, name, 'error' AS severity, CASE WHEN kinds > 1 THEN 'versions differ' ELSE 'number of versions' END AS message FROM n WHERE kinds > 1 OR n <> 2")
def check_isomorphic_stack(part):
    return V.check_isomorphic_stack(part.selectExpr("p_brand as reference", "p_type as name", "array(p_size % 2, 4) as shape", "'f4' as dtype"), 2)


@query("check_file_exists", "store catalog", "SELECT doc_id AS ident, 'path' AS name, 'error' AS severity, 'no such file: ' || name AS message FROM store WHERE name NOT IN (SELECT name FROM catalog)")
def check_file_exists(store, catalog):
    return V.check_file_exists(store.withColumn("path", F.concat(F.lit("xref$"), F.upper("name"), F.lit("[sci,1]"))), "path", catalog, "doc_id")


@query("validate_rules", "rules", "WITH b AS (SELECT rmap, rule_id, unnest(string_split(p_flag, '|')) AS v FROM rules WHERE p_flag NOT LIKE 'not %' AND p_flag NOT IN ('*', 'N/A')) SELECT rmap || ':' || rule_id AS ident, 'FLAG' AS name, 'error' AS severity, 'illegal value: ' || v AS message FROM b WHERE v NOT IN ('A', 'N')")
def validate_rules(rules):
    valid = rules.sparkSession.createDataFrame([("FLAG", "A"), ("FLAG", "N")], "par string, value string")
    return V.validate_rules(rules.selectExpr("rmap", "rule_id", "stack(2, 'FLAG', p_flag, 'QTY', p_qty) as (par, pattern)"), valid)


@query("validate_rule_keys", "rules", """WITH k AS (SELECT rmap || ':' || rule_id AS ident, rule_id % 5 AS c, rule_id FROM rules)
    SELECT ident, 'match_key' AS name, 'error' AS severity, 'key length differs' AS message FROM k WHERE rule_id % 17 = 0 UNION ALL SELECT ident, 'select_key', 'error', 'bad date: soon' FROM k WHERE c = 0 AND rule_id % 3 = 0
    UNION ALL SELECT ident, 'select_key', 'error', 'bad number: 1,5' FROM k WHERE c = 1 AND rule_id % 3 = 0 UNION ALL SELECT ident, 'select_key', 'error', 'bad version: 1.2.3.4' FROM k WHERE c = 2 AND rule_id % 3 = 0
    UNION ALL SELECT ident, 'select_key', 'error', 'bad relation: >2.1' FROM k WHERE c = 3 AND rule_id % 3 = 0 UNION ALL SELECT DISTINCT rmap, 'parent', 'error', 'type differs from its place' FROM rules WHERE rmap = 'BUILDING'""")
def validate_rule_keys(rules):
    bad = "rule_id % 3 = 0"
    select = f"case rule_id % 5 when 0 then if({bad}, 'soon', date_format(coalesce(useafter, timestamp'2001-01-01'), 'yyyy-MM-dd HH:mm:ss')) when 1 then if({bad}, '1,5', '1.5') when 2 then if({bad}, '1.2.3.4', '1.2') when 3 then if({bad}, '>2.1', '<2.1') else null end as select_key"
    kind = "element_at(array('UseAfter', 'GeometricallyNearest', 'VersionAfter', 'SelectVersion', 'Match'), cast(rule_id % 5 + 1 as int)) as select_class"
    keys = keyed(rules).withColumn("match_key", F.when(F.col("rule_id") % 17 == 0, F.slice("match_key", 1, 2)).otherwise(F.col("match_key")))
    heads = rules.select("rmap").distinct().select("rmap", F.array(*map(F.lit, ("FLAG", "PRIORITY", "QTY"))).alias("parkey"), F.lit("cam").alias("instrument"), F.lit("dark").alias("filekind"))
    edges = heads.select(F.lit("top").alias("parent"), F.when(F.col("rmap") == "BUILDING", "flat").otherwise("dark").alias("key"), F.col("rmap").alias("child"), "instrument")
    return V.validate_rule_keys(keys.selectExpr("rmap", "rule_id", "match_key", kind, select), heads, edges)


@query("valid_values", "part", "WITH v AS (SELECT p_brand AS instrument, p_type AS name, CAST(unnest(range(p_size % 5, p_size % 5 + 3)) AS STRING) AS v FROM part UNION ALL SELECT p_brand, p_type, p_brand FROM part WHERE p_size <> 7) SELECT instrument, name, string_agg(DISTINCT v, ' ' ORDER BY v) AS legal FROM v GROUP BY ALL")
def valid_values(part):
    return V.valid_values(part.selectExpr("p_brand as instrument", "p_type as name", "array((p_size % 5) || ':' || (p_size % 5 + 2), case when p_size = 7 then 'N/A' else p_brand end) as values"))


@query("duplicate_files", "catalog", "WITH k AS (SELECT sha1, min(name) AS same_as FROM catalog GROUP BY sha1) SELECT name, same_as FROM catalog JOIN k USING (sha1) WHERE name <> same_as")
def duplicate_files(catalog):
    return V.duplicate_files(catalog.select("name", "sha1"), catalog)


VERIFY = """f AS (SELECT s.name, CASE WHEN c.name IS NULL THEN 'unknown file' WHEN s.size <> c.size THEN 'size differs' WHEN s.sha1 <> c.sha1 THEN 'checksum differs' WHEN state NOT IN ('operational', 'archived') THEN 'unusual state' WHEN rejected THEN 'rejected' WHEN blacklisted THEN 'blacklisted' END AS finding
    FROM store s LEFT JOIN catalog c ON s.name = c.name)"""


@query("verify_catalog", "store catalog", f"WITH {VERIFY} SELECT * FROM f WHERE finding IS NOT NULL")
def verify_catalog(store, catalog):
    return V.verify_catalog(store.select("name", "size", "sha1"), catalog)


@query("findings", "part lineitem", "SELECT 'BRAND' AS name, 'error' AS severity, count(*) AS n FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT 'l_returnflag', 'error', count(DISTINCT l_linestatus) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')")
def findings(part, lineitem):
    c = constraints(part.sparkSession, [("BRAND", "C", "R", [])])
    a = V.check_presence(part_headers(part), c).withColumn("ident", F.col("ident").cast("string"))
    return V.findings(a, V.check_column_values(lineitem, "l_returnflag", ["A", "N"], "l_linestatus")).groupBy("name", "severity").agg(F.count("*").alias("n"))


@query("catalog_totals", "catalog", "SELECT filekind, count(*) AS files, sum(size)::BIGINT AS bytes FROM catalog GROUP BY filekind")
def catalog_totals(catalog):
    return C.catalog_totals(catalog, ["filekind"])


@query("organize_files", "catalog", "SELECT instrument, filekind, name, count(*) OVER (PARTITION BY instrument, filekind) AS n FROM catalog")
def organize_files(catalog):
    return C.organize_files(catalog, ["instrument", "filekind"])


@query("min_level_per_type", "part", "SELECT p_type AS filekind, min(p_size) AS level FROM part GROUP BY p_type")
def min_level_per_type(part):
    return C.min_level_per_type(part.groupBy(F.col("p_size").alias("level")).agg(F.collect_set("p_type").alias("types")))


# --- component tables ------------------------------------------------------------------

PREFIXES = {"Supplier#00000000": "first", "Supplier#0000000": "second", "Supplier": "other"}


@query("upsert_lookup", "supplier", "SELECT s_name AS compname, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS time, CASE WHEN s_suppkey % 3 = 0 THEN 'n.fits' ELSE 'o.fits' END AS filename, 'c' AS comment FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def upsert_lookup(supplier):
    old = supplier.where("s_suppkey % 2 = 0").selectExpr("s_name as compname", "'old' as time", "'o.fits' as filename", "'c' as comment")
    return G.upsert_lookup(old, supplier.where("s_suppkey % 3 = 0").selectExpr("s_name as compname", "'new' as time", "'n.fits' as filename", "'c' as comment"))


@query("time_span", "events", "SELECT 'INFLIGHT ' || strftime(min(ts), '%d/%m/%Y') || ' ' || strftime(max(ts), '%d/%m/%Y') AS pedigree FROM events")
def time_span(events):
    return G.time_span(events.select(F.col("ts").alias("time")))


@query("check_lookup_filenames", "supplier", "SELECT s_name AS compname, 'x' AS filename, CASE WHEN s_name LIKE 'Supplier#00000000%' THEN 'first' WHEN s_name LIKE 'Supplier#0000000%' THEN 'second' WHEN s_name LIKE 'Supplier%' THEN 'other' ELSE 'unknown' END || '$' || s_name || '_syn.fits' AS expected FROM supplier")
def check_lookup_filenames(supplier):
    return G.check_lookup_filenames(supplier.select(F.col("s_name").alias("compname"), F.lit("x").alias("filename")), PREFIXES)


@query("parametrised_filenames", "part", """WITH c AS (SELECT p_partkey, 'lens' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '_MJD' WHEN 1 THEN '_aper' WHEN 2 THEN '_th' ELSE '' END AS compname FROM part)
    SELECT compname, 'x' AS filename, 'cam$' || compname || CASE WHEN p_partkey % 5 = 2 THEN '' ELSE '_syn' END || '.fits' || CASE WHEN p_partkey % 5 = 0 THEN '[mjd#]' WHEN p_partkey % 5 = 1 THEN '[aper#]' WHEN p_partkey = 13 THEN '[cont#]' ELSE '' END AS expected FROM c""")
def parametrised_filenames(part):
    names = part.selectExpr("'lens' || p_partkey || case p_partkey % 5 when 0 then '_MJD' when 1 then '_aper' when 2 then '_th' else '' end as compname", "'x' as filename")
    return G.check_lookup_filenames(names, {"lens": "cam"}, named={"lens13": "cont#"})


@query("name_agreement", "supplier", "SELECT s_name AS name, 'a' AS side FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 UNION SELECT s_name, 'b' FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 <> 0")
def name_agreement(supplier):
    n = supplier.select(F.col("s_name").alias("name"), "s_suppkey")
    return G.name_agreement(n.where("s_suppkey % 2 = 0"), n.where("s_suppkey % 3 = 0"), n.where("s_suppkey % 5 = 0"))


GRAPH = "SELECT CAST(s_suppkey AS BIGINT) AS innode, CAST(s_suppkey * 2 + s_nationkey % 3 - 1 AS BIGINT) AS outnode FROM supplier UNION ALL SELECT s_suppkey, s_suppkey + 7 - s_nationkey FROM supplier"


@query("unreachable_rows", "supplier", f"WITH RECURSIVE g AS ({GRAPH}), r AS (SELECT 1::BIGINT AS node UNION SELECT outnode FROM r JOIN g ON node = innode) SELECT innode, outnode FROM g WHERE innode NOT IN (SELECT node FROM r)")
def unreachable_rows(supplier):
    a = supplier.selectExpr("cast(s_suppkey as bigint) as innode", "cast(s_suppkey * 2 + s_nationkey % 3 - 1 as bigint) as outnode")
    return G.unreachable_rows(a.unionAll(supplier.selectExpr("cast(s_suppkey as bigint) as innode", "cast(s_suppkey + 7 - s_nationkey as bigint) as outnode")), 1)


@query("graph_direction", "supplier", f"SELECT * FROM ({GRAPH}) WHERE innode >= outnode")
def graph_direction(supplier):
    a = supplier.selectExpr("cast(s_suppkey as bigint) as innode", "cast(s_suppkey * 2 + s_nationkey % 3 - 1 as bigint) as outnode")
    return G.graph_direction(a.unionAll(supplier.selectExpr("cast(s_suppkey as bigint) as innode", "cast(s_suppkey + 7 - s_nationkey as bigint) as outnode")))


@query("endpoint_zero", "lineitem", "SELECT l_suppkey AS curve, min_by(v, k) AS first, max_by(v, k) AS last FROM (SELECT l_suppkey, CAST(l_quantity AS BIGINT) % 3 AS v, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 3 + CAST(l_quantity AS BIGINT) % 3 AS k FROM lineitem) GROUP BY l_suppkey HAVING first <> 0 OR last <> 0")
def endpoint_zero(lineitem):
    t = lineitem.selectExpr("l_suppkey as curve", "cast(l_quantity as bigint) % 3 as v", "l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 3 + cast(l_quantity as bigint) % 3 as k")
    return G.endpoint_zero(t, "curve", "k", "v")


@query("version_increases", "supplier", "SELECT s_name AS compname, CASE WHEN s_suppkey % 4 = 0 THEN 'a.fits' ELSE 'a_' || lpad(CAST(s_suppkey % 7 AS STRING), 3, '0') || '_syn.fits' END AS filename, CASE WHEN s_suppkey % 4 = 0 THEN 'no number' ELSE 'not larger' END AS finding FROM supplier WHERE s_suppkey % 4 = 0 OR s_suppkey % 7 <= 3")
def version_increases(supplier):
    new = supplier.selectExpr("s_name as compname", "case when s_suppkey % 4 = 0 then 'a.fits' else 'a_' || lpad(cast(s_suppkey % 7 as string), 3, '0') || '_syn.fits' end as filename")
    return G.version_increases(new, supplier.selectExpr("s_name as compname", "'a_003_syn.fits' as filename"))
