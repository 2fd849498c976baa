"""Queries of normal forms, predicates and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.expressions import translate
from ..functions.patterns import match_status
from ..operators import certify as V
from ..operators import diffs as D
from ..operators.selection import do_not_reprocess as do_not_reprocess_of
from ..sources import headers as H
from ..sources.tables import read_reference_table as read_table
from .inputs import ORACLES, QUERIES, query
from .selection import status_sql

SAMPLE_VALUES = "CASE o_orderkey % 12 WHEN 0 THEN 'any' WHEN 1 THEN CAST(o_custkey AS STRING) WHEN 2 THEN ' ' || o_orderpriority WHEN 3 THEN 'n/a' WHEN 4 THEN 'true' WHEN 5 THEN 'F' WHEN 6 THEN '4294967295' WHEN 7 THEN '()x' WHEN 8 THEN '-' || o_custkey || '.' WHEN 9 THEN '.5' WHEN 10 THEN 'not applicable' ELSE 'Foo_bar' END"
CONDITIONED = "CASE o_orderkey % 12 WHEN 0 THEN '*' WHEN 1 THEN o_custkey || '.0' WHEN 2 THEN upper(o_orderpriority) WHEN 3 THEN 'N/A' WHEN 4 THEN 'T' WHEN 5 THEN 'F' WHEN 6 THEN '-1.0' WHEN 7 THEN 'N/A' WHEN 8 THEN '-' || o_custkey || '.0' WHEN 9 THEN '0.5' WHEN 10 THEN 'N/A' ELSE 'FOO_BAR' END"


@query("condition_value", "orders", f"SELECT o_orderkey, {CONDITIONED} AS value FROM orders")
def condition_value(orders):
    return orders.select("o_orderkey", N.condition_value(F.expr(SAMPLE_VALUES)).alias("value"))


@query("condition_header", "orders", f"SELECT o_orderkey, {CONDITIONED} AS a, upper(o_orderstatus) AS b FROM orders")
def condition_header(orders):
    m = N.condition_header(F.create_map(F.lit("a"), F.expr(SAMPLE_VALUES), F.lit("b"), F.col("o_orderstatus"), F.lit("c"), F.lit("x")), ["a", "b"])
    return orders.withColumn("m", m).select("o_orderkey", F.col("m")["A"].alias("a"), F.col("m")["B"].alias("b"))


@query("bestrefs_condition", "orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE upper(o_orderpriority) END AS value FROM orders")
def bestrefs_condition(orders):
    return orders.select("o_orderkey", N.bestrefs_condition(F.expr("case when o_orderkey % 3 = 0 then 'not found n/a' else o_orderpriority end")).alias("value"))


@query("clean_ref_path", "supplier", "SELECT s_suppkey, s_name AS name FROM supplier")
def clean_ref_path(supplier):
    return supplier.select("s_suppkey", N.clean_ref_path(F.expr("case s_suppkey % 3 when 0 then 'xref$' || s_name when 1 then 'data://' || s_name else s_name end")).alias("name"))


@query("glob_compress", "orders", "SELECT DISTINCT o_orderpriority || o_orderstatus AS id, least(o_orderpriority, 'm' || o_orderstatus) || '|' || greatest(o_orderpriority, 'm' || o_orderstatus) AS pattern FROM orders")
def glob_compress(orders):
    return orders.select(F.concat("o_orderpriority", "o_orderstatus").alias("id"), N.glob_compress(F.expr("'m' || o_orderstatus || ' | ' || o_orderpriority || '||' || o_orderpriority")).alias("pattern")).distinct()


@query("minimize_header", "customer", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'UNDEFINED' END AS segment, c_name AS name FROM customer")
def minimize_header(customer):
    params = F.expr("case when c_custkey % 2 = 0 then map('SEGMENT', c_mktsegment, 'name', c_name, 'NAME', 'other') else map('name', c_name, 'EXTRA', '1') end")
    m = N.minimize_header(params, ["SEGMENT", "NAME"])
    return customer.withColumn("m", m).select("c_custkey", F.col("m")["SEGMENT"].alias("segment"), F.col("m")["NAME"].alias("name"))


@query("required_parameters", "rules", "SELECT rmap, 'FLAG PRIORITY QTY' AS parameters FROM rules GROUP BY rmap")
def required_parameters(rules):
    return D.required_parameters(rules.select("rmap", F.explode(F.array(*(F.lit(p) for p in ("QTY", "FLAG", "PRIORITY")))).alias("par")))


DATES = {
    "MM/dd/yyyy HH:mm:ss": "%m/%d/%Y %H:%M:%S",
    "yyyy-MM-dd'T'HH:mm:ss": "%Y-%m-%dT%H:%M:%S",
    "MMM dd yyyy hh:mm a": "%b %d %Y %I:%M %p",
    "yyyyMMdd:HHmmss": "%Y%m%d:%H%M%S",
    "yyyy/MM/dd HH:mm": "%Y/%m/%d %H:%M",
    "dd MMM yyyy": "%d %b %Y",
}


@query("parse_date", "events", "SELECT event_id, CASE event_id % 6 WHEN 2 THEN date_trunc('minute', ts) WHEN 4 THEN date_trunc('minute', ts) WHEN 5 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS parsed FROM events")
def parse_date(events):
    forms = list(DATES)
    text = F.expr("case event_id % 6 " + " ".join(f"when {i} then date_format(ts, '{f.replace(chr(39), chr(92) + chr(39))}')" for i, f in enumerate(forms)) + " end || case when event_id % 6 in (0, 2) then ' UT' else '' end")
    return events.select("event_id", N.parse_date(text).cast("timestamp_ntz").alias("parsed"))


@query("date_format_ok", "events", "SELECT event_id, event_id % 4 = 0 AS slash, event_id % 4 = 1 AS dash, event_id % 4 <= 2 AS anyone FROM events")
def date_format_ok(events):
    text = F.expr("case event_id % 4 when 0 then date_format(ts, 'dd/MM/yyyy') when 1 then date_format(ts, 'yyyy-MM-dd') when 2 then date_format(ts, 'MMM dd yyyy HH:mm:ss') else date_format(ts, 'yyyy-13-dd') end")
    return events.select("event_id", N.date_format_ok(text, "slash").alias("slash"), N.date_format_ok(text, "dash").alias("dash"), N.date_format_ok(text, "any").alias("anyone"))


@query("useafter_of", "orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN TIMESTAMP '1900-01-01' ELSE date_trunc('second', o_orderdate) END AS useafter FROM orders")
def useafter_of(orders):
    params = F.expr("case o_orderkey % 3 when 0 then map('USEAFTER', date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')) when 1 then map('useafter', date_format(o_orderdate, 'MM/dd/yyyy HH:mm:ss')) else map('USEAFTER', 'junk') end")
    return orders.select("o_orderkey", N.useafter_of(params, "1900-01-01 00:00:00").cast("timestamp_ntz").alias("useafter"))


@query("exptime_of", "orders", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '2001-02-03 04:05:06' WHEN 1 THEN '1999-09-09 01:02:03' ELSE '1900-01-01 00:00:00' END AS exptime FROM orders")
def exptime_of(orders):
    params = F.expr("case o_orderkey % 3 when 0 then map('DATE-OBS', '2001-02-03', 'TIME-OBS', '04:05:06') when 1 then map('DATE-OBS', 'UNDEFINED', 'TIME-OBS', '1', 'DATE', '1999-09-09', 'TIME', '01:02:03') else map('x', 'y') end")
    return orders.select("o_orderkey", N.exptime_of(params, [("DATE-OBS", "TIME-OBS"), ("DATE", "TIME")]).alias("exptime"))


@query("version_key", "part", "SELECT p_partkey, p_size::INT AS major, (p_partkey % 10)::INT AS minor, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END AS point FROM part")
def version_key(part):
    text = F.expr("'v' || p_size || '.' || (p_partkey % 10) || case when p_partkey % 2 = 0 then '.3dev' else '' end")
    return part.select("p_partkey", N.version_key(text).alias("v")).select("p_partkey", "v.*")


@query("normalize_dataset_id", "supplier", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) || '.DET:' || upper(s_name) || '.DET' ELSE 'A' || s_suppkey || ':B' || s_suppkey END AS dataset_id, CASE WHEN s_suppkey % 2 = 0 THEN lower(s_name) || '.det' ELSE 'a' || s_suppkey END AS product_id FROM supplier")
def normalize_dataset_id(supplier):
    i = N.normalize_dataset_id(F.expr("case when s_suppkey % 2 = 0 then s_name || '_det' else 'a' || s_suppkey || ':b' || s_suppkey end"))
    return supplier.select("s_suppkey", i.alias("dataset_id"), N.product_id(i).alias("product_id"))


@query("instrument_of", "customer", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'UNDEFINED' WHEN c_mktsegment = 'MACHINERY' THEN 'ENGINES' ELSE c_mktsegment END AS instrument FROM customer")
def instrument_of(customer):
    params = F.expr("case c_custkey % 3 when 0 then map('INSTRUME', lower(c_mktsegment)) when 1 then map('INSTRUME', 'UNDEFINED', 'INSTRUMENT', c_mktsegment) else map('a', 'b') end")
    return customer.select("c_custkey", N.instrument_of(params, synonyms={"MACHINERY": "ENGINES"}).alias("instrument"))


@query("apply_substitutions", "rules", "SELECT rule_id, par, CASE WHEN par = 'FLAG' AND pattern = 'R' THEN 'R|A' WHEN par = 'PRIORITY' AND pattern = '5-LOW' THEN 'N/A' ELSE pattern END AS pattern FROM (SELECT rule_id, 'FLAG' AS par, p_flag AS pattern FROM rules UNION ALL SELECT rule_id, 'PRIORITY', p_priority FROM rules) f")
def apply_substitutions(rules):
    fields = rules.selectExpr("rule_id", "stack(2, 'FLAG', p_flag, 'PRIORITY', p_priority) as (par, pattern)")
    subs = rules.sparkSession.createDataFrame([("FLAG", "R", ["R", "A"]), ("PRIORITY", "5-LOW", ["N/A"])], "par string, value string, replacement array<string>")
    return D.apply_substitutions(fields, subs)


@query("expand_wildcards", "datasets", "SELECT dataset_id, CASE WHEN priority = '5-LOW' THEN 'B' WHEN ostatus = 'F' THEN 'A' ELSE flag END AS flag, CASE WHEN flag = 'N' THEN 'N/A' ELSE priority END AS priority FROM datasets")
def expand_wildcards(datasets):
    params = F.create_map(F.lit("FLAG"), "flag", F.lit("PRIORITY"), "priority")
    rules = [(F.col("ostatus") == "F", "FLAG", "A"), (F.col("priority") == "5-LOW", "FLAG", "B"), (F.col("flag") == "N", "PRIORITY", "N/A")]
    m = datasets.select("dataset_id", N.expand_wildcards(params, rules).alias("m"))
    return m.select("dataset_id", F.col("m")["FLAG"].alias("flag"), F.col("m")["PRIORITY"].alias("priority"))


@query("irrelevant_to_na", "datasets", "SELECT dataset_id, CASE WHEN priority IN ('1-URGENT', '2-HIGH') AND qty <> '7.0' THEN flag ELSE 'N/A' END AS flag FROM datasets")
def irrelevant_to_na(datasets):
    params = F.create_map(F.lit("FLAG"), "flag", F.lit("PRIORITY"), "priority", F.lit("QTY"), "qty")
    relevant = translate("PRIORITY in ('1-URGENT', '2-HIGH') and not QTY == '7.0'", params)
    return datasets.select("dataset_id", N.irrelevant_to_na(params, {"FLAG": relevant})["FLAG"].alias("flag"))


@query("reference_to_dataset_header", "supplier", "SELECT s_suppkey, upper(s_name) AS target, s_nationkey || '.0' AS nation, 'N/A' AS extra FROM supplier")
def reference_to_dataset_header(supplier):
    m = N.reference_to_dataset_header(F.create_map(F.lit("r_name"), "s_name", F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("EXTRA"), F.lit("1")), {"R_NAME": "TARGET"}, extra=["EXTRA"])
    return supplier.select("s_suppkey", m.alias("m")).select("s_suppkey", F.col("m")["TARGET"].alias("target"), F.col("m")["NATION"].alias("nation"), F.col("m")["EXTRA"].alias("extra"))


@query("classify_name", "supplier", "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'current' WHEN 1 THEN 'old' WHEN 2 THEN 'new' WHEN 3 THEN 'newcomponent' ELSE 'oldcomponent' END AS kind, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey ELSE -1 END AS serial FROM supplier")
def classify_name(supplier):
    name = F.expr("case s_suppkey % 5 when 0 then 'obs_ins_dark_' || lpad(s_suppkey, 5, '0') || '.fits' when 1 then 'k' || lpad(s_suppkey, 8, '3') || '_sky.fits' when 2 then '4' || lpad(s_suppkey, 8, 'c') || '_sky.fits' when 3 then '2' || lpad(s_suppkey, 8, 'd') || '_syn.fits' else 'm' || lpad(s_suppkey, 8, 'e') || '_th.fits' end")
    return supplier.select("s_suppkey", N.classify_name(name).alias("kind"), N.serial_of(name).alias("serial"))


@query("is_newer", "supplier", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey > s_nationkey WHEN 1 THEN true WHEN 2 THEN false ELSE true END AS newer FROM supplier")
def is_newer(supplier):
    a = F.expr("case s_suppkey % 4 when 0 then 'obs_ins_dark_' || lpad(s_suppkey, 6, '0') || '.fits' when 1 then 'obs_ins_dark_0004.asdf' when 2 then 'k' || lpad(s_suppkey, 8, '3') || '_sky.fits' else 'obs_ins_dark_' || lpad(s_suppkey, 4, '0') || '.fits' end")
    b = F.expr("case s_suppkey % 4 when 0 then 'obs_ins_dark_' || lpad(s_nationkey, 4, '0') || '.fits' when 1 then 'obs_ins_dark_' || lpad(s_suppkey, 5, '0') || '.fits' when 2 then '4' || lpad(s_nationkey, 8, 'c') || '_sky.fits' else 'N/A' end")
    return supplier.select("s_suppkey", N.is_newer(a, b).alias("newer"))


@query("compare_text", "part", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN p_name ELSE p_size || '.5' END AS text FROM part")
def compare_text(part):
    return part.select("p_partkey", N.compare_text(F.expr("case p_partkey % 3 when 0 then p_size || '.0' when 1 then ' ' || p_name else p_size || '.50' end")).alias("text"))


@query("param_combinations", "nation region", "SELECT n_name, r_name, f FROM nation, region, (VALUES ('A'), ('N'), ('R')) t(f)")
def param_combinations(nation, region):
    from ..operators.tables import mode_product

    flags = nation.sparkSession.createDataFrame([("A",), ("N",), ("R",)], "f string")
    both = nation.select("n_name").crossJoin(region.select("r_name")).crossJoin(flags)
    return mode_product(both, ["n_name", "r_name", "f"])


@query("cross_strap", "datasets", "SELECT dataset_id, flag AS a, CASE WHEN flag = 'N' THEN flag ELSE 'x' END AS b FROM datasets")
def cross_strap(datasets):
    params = F.create_map(F.lit("A"), "flag", F.lit("B"), F.when(F.col("flag") == "N", "UNDEFINED").otherwise("x"))
    m = N.cross_strap(params, [("B", "A"), ("A", "B")])
    return datasets.select("dataset_id", m.alias("m")).select("dataset_id", F.col("m")["A"].alias("a"), F.col("m")["B"].alias("b"))


@query("file_properties", "supplier", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 'obs' END AS observatory, CASE WHEN s_suppkey % 3 > 0 THEN 'ins' || s_nationkey END AS instrument, CASE WHEN s_suppkey % 3 > 0 THEN lpad(CAST(s_suppkey AS STRING), 4, '0') END AS serial FROM supplier")
def file_properties(supplier):
    name = F.expr("case when s_suppkey % 3 > 0 then '/a/obs_ins' || s_nationkey || '_dark_' || lpad(s_suppkey, 4, '0') || '.fits' else 'bad-name.fits' end")
    return supplier.select("s_suppkey", N.file_properties(name).alias("p")).select("s_suppkey", "p.observatory", "p.instrument", "p.serial")


@query("match_status", "rules datasets", f"WITH v AS (SELECT DISTINCT qty FROM datasets UNION SELECT '*' UNION SELECT 'N/A'), p AS (SELECT DISTINCT p_qty FROM rules) SELECT qty, p_qty, CASE WHEN qty = '*' THEN CASE WHEN p_qty = 'N/A' THEN 0 ELSE 1 END ELSE {status_sql('qty', 'p_qty')} END AS status FROM v, p")
def match_status_query(rules, datasets):
    spark = rules.sparkSession
    v = datasets.select("qty").union(spark.createDataFrame([("*",), ("N/A",)], "qty string")).distinct()
    return v.crossJoin(F.broadcast(rules.select("p_qty").distinct())).select("qty", "p_qty", match_status(F.col("qty"), F.col("p_qty")).alias("status"))  # both are distinct values of one parameter


@query("match_logical", "datasets", """WITH v AS (SELECT DISTINCT qty, CAST(qty AS DOUBLE) AS q FROM datasets) SELECT qty, pattern, CASE WHEN CASE n WHEN 0 THEN q > 10 AND q <= 30 WHEN 1 THEN q < 5 OR q > 45 WHEN 2 THEN qty = '7.0' WHEN 3 THEN qty = '7.0' OR qty LIKE '1_.0' ELSE NOT (q > 10 AND q < 20) END THEN 1 ELSE -1 END AS status
    FROM v, (VALUES (0, '# >10 and <=30 #'), (1, '# <5 or >45 #'), (2, '{7.0}'), (3, '# 7.0 or 1?.0 #'), (4, 'not # >10 and <20 #')) p(n, pattern)""")
def match_logical(datasets):
    """Logical patterns and braces against every quantity."""
    patterns = F.array(*map(F.lit, ("# >10 and <=30 #", "# <5 or >45 #", "{7.0}", "# 7.0 or 1?.0 #", "not # >10 and <20 #")))
    rows = datasets.select("qty").distinct().withColumn("pattern", F.explode(patterns))
    return rows.select("qty", "pattern", match_status(F.col("qty"), F.col("pattern")).alias("status"))


@query("file_findings", "supplier", """WITH n AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'odd name' ELSE 'obs_ins' || s_nationkey || '_' || CASE WHEN s_suppkey % 7 = 0 THEN 'dusk' ELSE 'dark' END || '_' || lpad(CAST(s_suppkey AS STRING), 4, '0') || '.fits' END AS name FROM supplier)
    SELECT name, CASE WHEN s_suppkey % 3 = 0 THEN 'no four-part name' WHEN s_suppkey % 25 >= 0 AND name LIKE '%ins2%' THEN 'unknown instrument' ELSE 'unknown type' END AS finding FROM n WHERE s_suppkey % 3 = 0 OR name LIKE '%ins2%' OR s_suppkey % 7 = 0""")
def file_findings(supplier):
    name = F.expr("case when s_suppkey % 3 = 0 then 'odd name' else 'obs_ins' || s_nationkey || '_' || if(s_suppkey % 7 = 0, 'dusk', 'dark') || '_' || lpad(cast(s_suppkey as string), 4, '0') || '.fits' end")
    known = supplier.select(F.concat(F.lit("ins"), F.col("s_nationkey").cast("string")).alias("instrument"), F.lit("dark").alias("type")).where("instrument not like 'ins2%'").distinct()
    return V.file_findings(supplier.select(name.alias("name")), known)


@query("constraint_helpers", "part", "SELECT p_partkey, p_partkey % 3 <> 1 AS full_frame, p_partkey % 3 = 1 AS subarray, p_size > 25 AS image, p_size <= 25 AND p_partkey % 2 = 0 AS wide_table, p_brand IN ('Brand#1', 'Brand#12') AS listed, p_size % 4 IN (1, 2) AS imaging, p_size % 5 = 0 AS irs2 FROM part")
def constraint_helpers(part):
    p = F.expr("map('SUBARRAY', case p_partkey % 3 when 0 then 'FULL' when 1 then 'SUB64' else 'GENERIC' end, 'SCI.KIND', if(p_size > 25, 'IMAGE', 'TABLE'), 'SCI.SHAPE', '10,20', 'SCI.COLUMNS', if(p_partkey % 2 = 0, 'wave, flux,err', 'WAVE'), 'FLUX.TYPE', 'float', 'BRAND', p_brand, 'EXP_TYPE', element_at(array('NRS_IFU', 'MIR_IMAGE', 'FGS_ID-STACK', 'IMAGE'), cast(p_size % 4 + 1 as int)), 'READPATT', if(p_size % 5 = 0, 'NRSIRS2RAPID', 'NRSN32R8'))")
    made = {"full_frame": "is_full_frame()", "subarray": "is_subarray()", "image": "is_image('SCI') and array_ndim('SCI', 2)", "wide_table": "is_table('SCI') and array_has_columns('SCI', 'FLUX', 'err') and has_column_type('FLUX', 'FLOAT')", "listed": "one_of('BRAND', 'Brand#1', 'Brand#12') and not is_defined('NONE')", "imaging": "is_imaging_mode()", "irs2": "is_irs2()"}
    return part.select("p_partkey", *(translate(text, p).alias(name) for name, text in made.items()))


@query("is_relevant", "datasets", "SELECT dataset_id, flag = 'R' AND priority <> '5-LOW' OR qty IN ('1.0', '2.0') AS relevant, NOT (CAST(qty AS DOUBLE) >= 20) AS omitted FROM datasets")
def is_relevant(datasets):
    p = F.create_map(F.lit("FLAG"), "flag", F.lit("PRIORITY"), "priority", F.lit("QTY"), "qty")
    return datasets.select("dataset_id", translate("FLAG == 'R' and PRIORITY != '5-LOW' or QTY in ['1.0', '2.0']", p).alias("relevant"), translate("not (QTY >= 20)", p).alias("omitted"))


@query("header_value_valid", "rules datasets", "WITH u AS (SELECT DISTINCT rmap, p_flag FROM rules) SELECT DISTINCT instrument, flag, (EXISTS (SELECT 1 FROM u WHERE rmap = instrument AND (p_flag IN ('*', 'N/A') OR p_flag LIKE 'not %' OR contains('|' || p_flag || '|', '|' || flag || '|')))) AS valid FROM datasets")
def header_value_valid(rules, datasets):
    used = D.values_in_use(rules.select("rmap", F.lit("FLAG").alias("par"), F.col("p_flag").alias("pattern")))
    v = F.split("in_use", " ")
    free = F.col("unchecked") | F.arrays_overlap(v, F.array(F.lit("*"), F.lit("N/A"), F.lit("ANY")))
    both = datasets.select("instrument", "flag").distinct().join(F.broadcast(used), F.col("instrument") == F.col("rmap"), "left")  # a row per rule set
    return both.select("instrument", "flag", F.coalesce(free | F.array_contains(v, F.col("flag")), F.lit(False)).alias("valid"))


@query("do_not_reprocess", "datasets", "SELECT dataset_id, CASE WHEN ostatus = 'P' AND (flag = 'N' AND qty IN ('1.0', '2.0') OR priority = '5-LOW') THEN 'N/A' WHEN ostatus = 'P' THEN 'NOT FOUND No match found.' ELSE 'r' || flag END AS reference FROM datasets")
def do_not_reprocess(datasets):
    params = F.create_map(F.lit("FLAG"), "flag", F.lit("PRIORITY"), "priority", F.lit("QTY"), "qty")
    found = F.when(F.col("ostatus") == "P", "NOT FOUND No match found.").otherwise(F.concat(F.lit("r"), "flag"))
    exempt = [{"FLAG": ["N"], "QTY": ["1.0", "2.0"]}, {"PRIORITY": ["5-LOW"]}]
    return datasets.select("dataset_id", do_not_reprocess_of(found, params, exempt).alias("reference"))


@query("values_in_use", "rules", "WITH b AS (SELECT rmap, unnest(string_split(p_flag, '|')) AS v, p_flag LIKE 'not %' AS s FROM rules) SELECT rmap, 'FLAG' AS par, string_agg(DISTINCT v, ' ' ORDER BY v) FILTER (NOT s) AS in_use, bool_or(s) AS unchecked FROM b GROUP BY rmap")
def values_in_use(rules):
    return D.values_in_use(rules.select("rmap", F.lit("FLAG").alias("par"), F.col("p_flag").alias("pattern")))


@query("parse_headers", "events", "SELECT 'e' || event_id AS dataset_id, event_type AS kind, CAST(user_id AS STRING) AS user_id FROM events")
def parse_headers(events):
    lines = events.select(F.to_json(F.create_map(F.concat(F.lit("e"), "event_id"), F.create_map(F.lit("KIND"), "event_type", F.lit("USER"), F.col("user_id").cast("string")))).alias("value"))
    return H.parse_headers(lines).select("dataset_id", F.col("params")["KIND"].alias("kind"), F.col("params")["USER"].alias("user_id"))


@query("header_lines", "customer", """SELECT 'c' || c_custkey AS dataset_id, '{"c' || c_custkey || '":{"A":"' || c_mktsegment || '","B":"' || c_name || '"}}' AS value FROM customer WHERE c_custkey % 2 = 0""")
def header_lines(customer):
    h = customer.select(F.concat(F.lit("c"), "c_custkey").alias("dataset_id"), F.create_map(F.lit("B"), "c_name", F.lit("A"), "c_mktsegment").alias("params"))
    return H.header_lines(h, customer.where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("dataset_id")))


@query("merge_header_sources", "customer", "SELECT c_custkey AS dataset_id, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE upper(c_name) END AS a, c_nationkey || '.0' AS b, CASE WHEN c_custkey % 2 = 0 THEN 'T' END AS c FROM customer")
def merge_header_sources(customer):
    first = customer.select(F.col("c_custkey").alias("dataset_id"), F.create_map(F.lit("a"), "c_name", F.lit("B"), F.col("c_nationkey").cast("string")).alias("params"))
    second = customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("dataset_id"), F.create_map(F.lit("A"), F.lit("new"), F.lit("c"), F.lit("true")).alias("params"))
    m = H.merge_header_sources([first, second])
    return m.select("dataset_id", F.col("params")["A"].alias("a"), F.col("params")["B"].alias("b"), F.col("params")["C"].alias("c"))


@query("flatten_rules", "rules", "SELECT rmap, p_flag, p_priority, CAST(CAST(useafter AS DATE) AS STRING) AS useafter, max(reference) AS reference FROM rules WHERE useafter IS NOT NULL GROUP BY ALL")
def flatten_rules(rules):
    one = rules.where("useafter is not null").groupBy("rmap", "p_flag", "p_priority", F.date_format("useafter", "yyyy-MM-dd").alias("d")).agg(F.max("reference").alias("r"))
    dates = one.groupBy("rmap", "p_flag", "p_priority").agg(F.map_from_entries(F.collect_list(F.struct("d", "r"))).alias("dates"))
    nested = dates.groupBy("rmap").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", F.replace("p_flag", F.lit("/"), F.lit(" ")), F.replace("p_priority", F.lit("/"), F.lit(" "))), "dates"))).alias("choices"))
    flat = H.flatten_rules(nested, ["FLAG", "PRIORITY"])
    return flat.select("rmap", F.regexp_replace(F.col("match_key")[0]["pattern"], "^N A$", "N/A").alias("p_flag"), F.regexp_replace(F.col("match_key")[1]["pattern"], "^N A$", "N/A").alias("p_priority"), "useafter", "reference")


@query("parse_id_list", "supplier", "SELECT s_name AS word FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'x' || s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0")
def parse_id_list(supplier):
    return H.parse_id_list(supplier.select(F.expr("case when s_suppkey % 3 = 0 then '# ' || s_name else '  ' || s_name || '   x' || s_suppkey end").alias("value")))


@query("catalog_query", "catalog", "SELECT instrument, state, count(*) AS n, sum(size)::BIGINT AS bytes FROM catalog WHERE NOT rejected GROUP BY ALL")
def catalog_query(catalog):
    return H.catalog_query(catalog, "SELECT instrument, state, count(*) AS n, sum(size) AS bytes FROM {catalog} WHERE NOT rejected GROUP BY instrument, state")


def read_reference_table(spark, sf_dir):
    """The table of parts as a reader finds it: capitals, segment and row numbers in file order."""
    table = read_table(spark, f"{sf_dir}/part.parquet", "parts")
    return table.select("P_PARTKEY", "P_BRAND", "P_RETAILPRICE", "reference", "segment", "row_no")


QUERIES["read_reference_table"] = read_reference_table
ORACLES["read_reference_table"] = "SELECT p_partkey AS \"P_PARTKEY\", p_brand AS \"P_BRAND\", p_retailprice AS \"P_RETAILPRICE\", 'parts' AS reference, 1 AS segment, row_number() OVER () AS row_no FROM part"


@query("updated_headers", "customer", "SELECT c_custkey AS dataset_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'N/A' ELSE lower(c_mktsegment) END AS dark FROM customer")
def updated_headers(customer):
    h = customer.select(F.col("c_custkey").alias("dataset_id"), F.create_map(F.lit("NAME"), "c_name", F.lit("DARK"), F.lit("old")).alias("params"))
    u = customer.select(F.col("c_custkey").alias("dataset_id"), F.lit("dark").alias("filekind"), F.expr("case when c_custkey % 3 = 0 then 'n/a' else c_mktsegment end").alias("new_reference"))
    return H.updated_headers(h, u).select("dataset_id", F.col("params")["NAME"].alias("name"), F.col("params")["DARK"].alias("dark"))


@query("error_ids", "datasets", "SELECT DISTINCT dataset_id FROM datasets WHERE flag = 'N'")
def error_ids(datasets):
    return H.error_ids(datasets.where("flag = 'N'"))
