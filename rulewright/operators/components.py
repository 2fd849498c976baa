"""Component tables: lookups, names and the throughput graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reach import reachable


def upsert_lookup(lookup: DataFrame, delivered: DataFrame) -> DataFrame:
    """A known component takes the delivered time, file and comment; others are appended."""
    fields = ["time", "filename", "comment"]
    d = delivered.select("compname", *(F.col(f).alias(f"d_{f}") for f in fields))
    both = lookup.join(d, "compname", "full_outer")
    return both.select("compname", *(F.coalesce(f"d_{f}", f).alias(f) for f in fields))


def time_span(lookup: DataFrame) -> DataFrame:
    text = F.concat(F.lit("INFLIGHT "), F.date_format(F.min("time"), "dd/MM/yyyy"), F.lit(" "), F.date_format(F.max("time"), "dd/MM/yyyy"))
    return lookup.agg(text.alias("pedigree"))


def component_instrument(name: Column, prefixes: dict[str, str]) -> Column:
    """Instrument of a component by the first prefix that fits."""
    out = F.lit("unknown")
    for prefix, instrument in reversed(prefixes.items()):
        out = F.when(name.startswith(prefix), instrument).otherwise(out)
    return out


#: Ends of component names and the keyword that their tables are parametrised by (fixed values).
PARAMETER_ENDS = {"_mjd": "mjd#", "_m": "mjd#", "_aper": "aper#"}


def parameter_keyword(name: Column, named: dict[str, str] | None = None) -> Column:
    """Keyword of a parametrised component: by the end of its name, else by the name itself; null where it has none."""
    low = F.lower(name)
    out = F.lit(None).cast("string")
    for component, keyword in (named or {}).items():
        out = F.when(low == component, keyword).otherwise(out)
    for end, keyword in PARAMETER_ENDS.items():
        out = F.when(low.endswith(end), keyword).otherwise(out)
    return out


def lookup_filename(name: Column, prefixes: dict[str, str], thermal: str = "_th", suffix: str = "_syn", named: dict[str, str] | None = None) -> Column:
    """Expected entry: instrument, component, a suffix that thermal components have their own of, and the keyword in brackets if parametrised."""
    keyword = parameter_keyword(name, named)
    stem = F.concat(component_instrument(name, prefixes), F.lit("$"), name, F.when(name.endswith(thermal), "").otherwise(suffix), F.lit(".fits"))
    return F.concat(stem, F.coalesce(F.concat(F.lit("["), keyword, F.lit("]")), F.lit("")))


def check_lookup_filenames(lookup: DataFrame, prefixes: dict[str, str], named: dict[str, str] | None = None) -> DataFrame:
    return lookup.withColumn("expected", lookup_filename(F.col("compname"), prefixes, named=named)).where("filename <> expected").select("compname", "filename", "expected")


def name_agreement(a: DataFrame, b: DataFrame, known_a: DataFrame | None = None, known_b: DataFrame | None = None) -> DataFrame:
    """Names in one table and not in the other, known exceptions left out."""
    only_a, only_b = a.select("name").subtract(b.select("name")), b.select("name").subtract(a.select("name"))
    only_a = only_a if known_a is None else only_a.subtract(known_a.select("name"))
    only_b = only_b if known_b is None else only_b.subtract(known_b.select("name"))
    return only_a.withColumn("side", F.lit("a")).union(only_b.withColumn("side", F.lit("b")))


def graph_reachable(edges: DataFrame, start: int) -> DataFrame:
    """Nodes that ``edges(innode, outnode)`` reach from ``start``, itself included, however far."""
    starts = edges.sparkSession.createDataFrame([(start, start)], "root long, node long")
    links = edges.select(F.col("innode").cast("long").alias("a"), F.col("outnode").cast("long").alias("b"))
    return reachable(links, starts).select("node")


def unreachable_rows(edges: DataFrame, start: int) -> DataFrame:
    return edges.join(graph_reachable(edges, start).withColumnRenamed("node", "innode"), "innode", "left_anti")


def graph_direction(edges: DataFrame) -> DataFrame:
    return edges.where("innode >= outnode")


def endpoint_zero(table: DataFrame, curve: str, order: str, value: str) -> DataFrame:
    """Curves whose first or last value is not zero."""
    ends = table.groupBy(curve).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    return ends.where("first <> 0 or last <> 0")


def version_increases(new: DataFrame, old: DataFrame) -> DataFrame:
    """Files whose ``_NNN_`` number is missing or not above that of the latest file of the component."""
    number = lambda c: F.regexp_extract(c, r"_(\d{3})_", 1).try_cast("int")
    last = old.groupBy("compname").agg(F.max(number(F.col("filename"))).alias("old_number"))
    both = new.withColumn("number", number(F.col("filename"))).join(last, "compname", "left")
    finding = F.when(F.col("number").isNull(), "no number").when(F.col("number") <= F.col("old_number"), "not larger")
    return both.withColumn("finding", finding).where("finding is not null").select("compname", "filename", "finding")
