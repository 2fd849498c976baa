"""Certification: headers, columns and arrays against declarative constraints.

Every check returns findings (ident, name, severity, message), so that ``findings``
can union them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import FULL_FRAME, BadExpression, names_in, presence_of, translate
from ..functions.normalize import UNDEFINED, clean_ref_path, date_format_ok, file_properties, parse_date
from .meeting import small

FINDING = ["ident", "name", "severity", "message"]


def _value(name: Column) -> Column:
    return F.coalesce(F.try_element_at("params", name), F.lit(UNDEFINED))


def with_constraints(headers: DataFrame, constraints: DataFrame) -> DataFrame:
    """headers(ident, instrument, filekind, params) with each constraint of their type."""
    return headers.join(small(constraints), ["instrument", "filekind"]).withColumn("value", _value(F.col("name")))


def _applies(constraints: DataFrame) -> Column:
    """Presence with conditions ``(expression)`` decided per header; O where one cannot be read."""
    p = F.col("presence")
    texts = [r.presence for r in constraints.where(p.startswith("(")).select("presence").distinct().limit(1001).collect()]
    if len(texts) > 1000:
        raise ValueError("more than 1000 presence conditions")
    out = p
    for text in texts:
        try:
            decided = presence_of(text, F.col("params"))
        except BadExpression:
            decided = F.lit("O")
        out = F.when(p == text, decided).otherwise(out)
    return F.when(out == "P", "R").otherwise(out)


def check_presence(headers: DataFrame, constraints: DataFrame, matching: DataFrame | None = None) -> DataFrame:
    """R and P required, W warn, E excluded, O optional, F full frame only, S subarray only, A with a subarray only, or a condition in parentheses.

    ``matching(instrument, filekind, name)`` are the parameters that rules match by:
    where they are optional they are required all the same.
    """
    rows = with_constraints(headers, constraints).withColumn("presence", _applies(constraints))
    if matching is not None:
        named = small(matching.select("instrument", "filekind", "name", F.lit(True).alias("_matching")).distinct())
        rows = rows.join(named, ["instrument", "filekind", "name"], "left").withColumn("presence", F.when(F.col("_matching") & (F.col("presence") == "O"), "R").otherwise(F.col("presence")))
    here = F.col("value") != UNDEFINED
    sub = _value(F.lit("SUBARRAY"))
    full = sub.isin(FULL_FRAME)
    p = F.col("presence")
    needs = (p == "R") | (p == "F") & full | (p == "S") & ~full & (sub != UNDEFINED)
    severity = F.when(needs & ~here, "error").when((p == "E") & here, "error").when((p == "W") & ~here, "warning")
    message = F.when((p == "E") & here, "must not be there").otherwise("is missing")
    return rows.select("ident", "name", severity.alias("severity"), message.alias("message")).where("severity is not null")


def check_allowed_values(rows: DataFrame) -> DataFrame:
    """C upper-cased text by or-parts, X case-sensitive text, L logical."""
    text = F.trim(F.col("value"))
    parts = F.when(F.col("datatype") == "X", F.array(text)).otherwise(F.transform(F.split(F.upper(text), r"\|"), lambda x: F.trim(x)))
    allowed = F.when(F.col("datatype") == "X", F.col("values")).when(F.col("datatype") == "L", F.array(F.lit("T"), F.lit("F"))).otherwise(F.transform("values", lambda x: F.upper(x)))
    bad = F.col("datatype").isin("C", "X", "L") & (F.col("value") != UNDEFINED) & (F.size(allowed) > 0) & ~F.forall(parts, lambda x: F.array_contains(allowed, x))
    return rows.where(bad).select("ident", "name", F.lit("error").alias("severity"), F.concat(F.lit("value not allowed: "), "value").alias("message"))


def number_allowed(value: Column, values: Column, datatype: Column) -> Column:
    """A number in a list of numbers or ``low:high`` ranges; R and D compare with 1e-7 and 1e-14 relative and 1e-8 absolute tolerance."""
    v = value.try_cast("double")
    rtol = F.when(datatype == "R", 1e-7).when(datatype == "D", 1e-14).otherwise(0.0)
    atol = F.when(datatype == "I", 0.0).otherwise(1e-8)

    def fits(x: Column) -> Column:
        low, high = F.substring_index(x, ":", 1).try_cast("double"), F.substring_index(x, ":", -1).try_cast("double")
        return F.when(x.contains(":"), v.between(low, high)).otherwise(F.abs(v - low) <= atol + rtol * F.abs(low))

    return F.coalesce(v.isNotNull() & ((datatype != "I") | (v == F.floor(v))) & ((F.size(values) == 0) | F.exists(values, fits)), F.lit(False))


def check_numeric(rows: DataFrame) -> DataFrame:
    asked = rows.where(F.col("datatype").isin("I", "R", "D") & (F.col("value") != UNDEFINED))
    return asked.where(~number_allowed(F.col("value"), F.col("values"), F.col("datatype"))).select("ident", "name", F.lit("error").alias("severity"), F.concat(F.lit("number not allowed: "), "value").alias("message"))


def check_column_values(table: DataFrame, column: str, allowed: list[str], ident: str = "reference") -> DataFrame:
    """Cells of a column outside the allowed texts, counted per reference."""
    bad = table.where(F.col(column).isNull() | ~F.upper(F.trim(F.col(column))).isin([a.upper() for a in allowed]))
    n = bad.groupBy(F.col(ident).alias("ident")).agg(F.count("*").alias("n"))
    return n.select("ident", F.lit(column).alias("name"), F.lit("error").alias("severity"), F.concat("n", F.lit(" cells not allowed")).alias("message"))


def check_columns(table: DataFrame, constraints: list[tuple[str, str, str, list[str]]], ident: str = "reference") -> DataFrame:
    """Cells of several columns against (name, datatype, presence, values), counted per reference in one aggregation.

    Datatypes are those of ``check_allowed_values`` and ``check_numeric``; null cells
    count as bad.  An absent column is reported where it is required or suggested.
    """
    there, counts, missing = [], [], []
    for name, datatype, presence, values in constraints:
        if name not in table.columns:
            if presence in ("R", "P", "W"):
                missing.append((name, "warning" if presence == "W" else "error"))
            continue
        cell, listed = F.trim(F.col(name).cast("string")), F.array(*map(F.lit, values)).cast("array<string>")
        if datatype in ("I", "R", "D"):
            good = number_allowed(cell, listed, F.lit(datatype))
        elif datatype == "L":
            good = F.upper(cell).isin("T", "F", "TRUE", "FALSE")
        else:
            good = F.lit(True) if not values else cell.isin(values) if datatype == "X" else F.upper(cell).isin([v.upper() for v in values])
        there.append(name)
        counts.append(F.count_if(~F.coalesce(good, F.lit(False))).alias(f"_n{len(there)}"))
    n = table.groupBy(F.col(ident).alias("ident")).agg(*(counts or [F.count("*").alias("_n0")]))
    each = [F.struct(F.lit(name).alias("name"), F.lit("error").alias("severity"), F.concat(F.col(f"_n{k + 1}"), F.lit(" cells not allowed")).alias("message"), (F.col(f"_n{k + 1}") > 0).alias("bad")) for k, name in enumerate(there)]
    each += [F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.lit("column is missing").alias("message"), F.lit(True).alias("bad")) for name, severity in missing]
    if not each:
        return n.select("ident", *(F.lit("").alias(c) for c in FINDING[1:])).where(F.lit(False))
    return n.select("ident", F.explode(F.array(*each)).alias("f")).where("f.bad").select("ident", "f.name", "f.severity", "f.message")


def check_expression(headers: DataFrame, name: str, expression: str, warn: bool = False) -> DataFrame:
    """Headers for which a condition fails; one that reads an undefined key is skipped."""
    defined = reduce(lambda c, k: c & (_value(F.lit(k)) != UNDEFINED), names_in(expression), F.lit(True))
    bad = headers.where(defined & ~F.coalesce(translate(expression, F.col("params")), F.lit(False)))
    return bad.select("ident", F.lit(name).alias("name"), F.lit("warning" if warn else "error").alias("severity"), F.lit(f"fails: {expression}").alias("message"))


def check_column_expression(table: DataFrame, column: str, condition: Column, ident: str = "reference") -> DataFrame:
    bad = table.where(~F.coalesce(condition, F.lit(False))).groupBy(F.col(ident).alias("ident")).agg(F.count("*").alias("n"))
    return bad.select("ident", F.lit(column).alias("name"), F.lit("error").alias("severity"), F.concat("n", F.lit(" cells fail")).alias("message"))


def pedigree_finding(text: Column) -> Column:
    """What is wrong with ``KIND [start stop]``: kinds INFLIGHT (dates needed), GROUND, DUMMY, MODEL, SIMULATION; null if nothing."""
    parts = F.split(F.trim(F.upper(text)), r"\s+")
    kind, start, stop = parts[0], F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))
    dated = start.isNotNull()
    return (
        F.when(~kind.isin("INFLIGHT", "GROUND", "DUMMY", "MODEL", "SIMULATION"), "unknown kind")
        .when((kind == "INFLIGHT") & (~dated | stop.isNull()), "dates missing")
        .when((kind != "INFLIGHT") & dated, "dates not expected")
        .when(dated & ~(date_format_ok(start, "slash") & date_format_ok(stop, "slash")), "bad date")
        .when(dated & (F.try_to_timestamp(start, F.lit("dd/MM/yyyy")) > F.try_to_timestamp(stop, F.lit("dd/MM/yyyy"))), "start after stop")
    )


def check_pedigree(headers: DataFrame, text: Column) -> DataFrame:
    return headers.withColumn("message", pedigree_finding(text)).where("message is not null").select("ident", F.lit("PEDIGREE").alias("name"), F.lit("error").alias("severity"), "message")


def check_dates(headers: DataFrame, text: Column, kind: str, name: str) -> DataFrame:
    """Dates of a strict kind; another readable form is a warning."""
    severity = F.when(date_format_ok(text, kind), None).when(parse_date(text).isNotNull(), "warning").otherwise("error")
    return headers.withColumn("severity", severity).where("severity is not null").select("ident", F.lit(name).alias("name"), "severity", F.lit("date format").alias("message"))


def check_kernel_unity(kernels: DataFrame, kernel: str, ident: str, tolerance: float = 1e-6) -> DataFrame:
    """Kernels whose values do not sum to one; a centre of one or more is a warning."""
    total = F.aggregate(kernel, F.lit(0.0), lambda s, x: s + x.cast("double"))
    centre = F.col(kernel)[F.floor(F.size(kernel) / 2).cast("int")].cast("double")
    severity = F.when(F.abs(total - 1) > tolerance, "error").when(centre >= 1, "warning")
    return kernels.withColumn("severity", severity).where("severity is not null").select(F.col(ident).alias("ident"), F.lit(kernel).alias("name"), "severity", F.lit("kernel").alias("message"))


def check_isomorphic_stack(arrays: DataFrame, expected: int) -> DataFrame:
    """Arrays (reference, name, shape, dtype) whose versions differ in shape or type or are not ``expected`` in number."""
    n = arrays.groupBy(F.col("reference").alias("ident"), "name").agg(F.countDistinct("shape", "dtype").alias("kinds"), F.count("*").alias("n"))
    message = F.when(F.col("kinds") > 1, "versions differ").when(F.col("n") != expected, "number of versions")
    return n.withColumn("message", message).where("message is not null").select("ident", "name", F.lit("error").alias("severity"), "message")


def check_file_exists(rows: DataFrame, column: str, catalog: DataFrame, ident: str) -> DataFrame:
    """File names of a column, paths and ``[...]`` stripped, that the catalog lacks."""
    name = F.lower(F.trim(F.regexp_replace(clean_ref_path(F.col(column)), r"\[.*\]$", "")))
    missing = rows.select(F.col(ident).alias("ident"), name.alias("file")).join(catalog.select(F.lower("name").alias("file")).distinct(), "file", "left_anti")
    return missing.select("ident", F.lit(column).alias("name"), F.lit("error").alias("severity"), F.concat(F.lit("no such file: "), "file").alias("message"))


def validate_rules(fields: DataFrame, valid: DataFrame) -> DataFrame:
    """Fields (rmap, rule_id, par, pattern) with a branch that valid(par, value) does not list; wildcards, N/A and other kinds pass."""
    special = F.col("pattern").rlike(r"^([({#<>=]|between |not )|[*?\[]") | (F.col("pattern") == "N/A")
    parts = fields.where(~special).select("rmap", "rule_id", "par", F.explode(F.split("pattern", r"\|")).alias("value")).withColumn("value", F.trim("value"))
    checked = parts.join(F.broadcast(valid.select("par").distinct()), "par", "left_semi")  # one row per parameter
    return checked.join(valid.select("par", "value").distinct(), ["par", "value"], "left_anti").select(F.concat_ws(":", "rmap", "rule_id").alias("ident"), F.col("par").alias("name"), F.lit("error").alias("severity"), F.concat(F.lit("illegal value: "), "value").alias("message"))


#: How the key of a choice is written, by the class of the choice.
SELECT_KEYS = {"UseAfter": "date", "ClosestTime": "date", "GeometricallyNearest": "number", "Bracket": "number", "VersionAfter": "version", "SelectVersion": "relation"}


def validate_rule_keys(rules: DataFrame, headers: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Rules whose keys are not well formed, and rule sets that disagree with their parent.

    ``rules(rmap, rule_id, match_key, select_class, select_key)``, ``headers(rmap,
    parkey array, instrument, filekind)`` and ``edges(parent, key, child,
    instrument)``: keys as long as the rule set's parameters, dates, numbers, versions
    and version relations that can be read, and children of the parent's instrument and
    of the type they are listed under.
    """
    heads = headers.select("rmap", F.size("parkey").alias("_n"))
    both = rules.join(heads, "rmap", "left")
    key = F.col("select_key")
    kind = reduce(lambda c, kv: F.when(F.col("select_class") == kv[0], kv[1]).otherwise(c), SELECT_KEYS.items(), F.lit(None).cast("string"))
    version = r"^\d+(\.\d+){0,2}[a-z0-9]*$"
    good = (
        F.when(kind == "date", parse_date(key).isNotNull())
        .when(kind == "number", key.try_cast("double").isNotNull())
        .when(kind == "version", key.rlike(version))
        .when(kind == "relation", (key == "default") | F.regexp_replace(key, r"^[<=]\s*", "").rlike(version) & key.rlike("^[<=]"))
        .otherwise(True)
    )
    size = F.when(F.col("_n").isNull(), "no header").when(F.size("match_key") != F.col("_n"), "key length differs")
    form = F.when(~F.coalesce(good, F.lit(False)), F.concat(F.lit("bad "), kind, F.lit(": "), F.coalesce(key, F.lit("nothing"))))
    each = both.select(F.concat_ws(":", "rmap", "rule_id").alias("ident"), F.explode(F.array(F.struct(F.lit("match_key").alias("name"), size.alias("message")), F.struct(F.lit("select_key").alias("name"), form.alias("message")))).alias("f"))
    out = each.where("f.message is not null").select("ident", "f.name", F.lit("error").alias("severity"), "f.message")
    if edges is None:
        return out
    child = headers.select(F.col("rmap").alias("child"), F.col("instrument").alias("_i"), F.col("filekind").alias("_k"))
    differs = F.when(F.col("_i") != F.col("instrument"), "instrument differs from the parent's").when(F.col("_k") != F.col("key"), "type differs from its place")
    nested = edges.join(child, "child").withColumn("message", differs).where("message is not null")
    return out.unionByName(nested.select(F.col("child").alias("ident"), F.lit("parent").alias("name"), F.lit("error").alias("severity"), "message"))


def valid_values(constraints: DataFrame) -> DataFrame:
    """Legal values per (instrument, name) over all types; integer ranges are expanded, ANY and N/A left out."""
    each = constraints.select("instrument", "name", F.explode_outer("values").alias("v"))
    range_of = F.col("v").rlike(r"^-?\d+:-?\d+$")
    span = F.transform(F.sequence(F.substring_index("v", ":", 1).try_cast("int"), F.substring_index("v", ":", -1).try_cast("int")), lambda x: x.cast("string"))
    values = each.select("instrument", "name", F.explode_outer(F.when(range_of, span).otherwise(F.array("v"))).alias("value"))
    return values.groupBy("instrument", "name").agg(F.array_join(F.array_sort(F.collect_set(F.when(~F.col("value").isin("ANY", "N/A"), F.col("value")))), " ").alias("legal"))


def duplicate_files(new: DataFrame, catalog: DataFrame) -> DataFrame:
    """New files whose checksum a catalogued file has, with the first such file."""
    known = catalog.groupBy("sha1").agg(F.min("name").alias("same_as"))
    return new.join(known, "sha1").where("name <> same_as").select("name", "same_as")


def verify_catalog(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files of a store against the catalog: the first of unknown, size, checksum, state, rejected, blacklisted that applies."""
    c = catalog.select("name", F.col("size").alias("c_size"), F.col("sha1").alias("c_sha1"), "state", "rejected", "blacklisted", F.lit(True).alias("known"))
    both = files.join(c, "name", "left")
    finding = (
        F.when(F.col("known").isNull(), "unknown file")
        .when(F.col("size") != F.col("c_size"), "size differs")
        .when(F.col("sha1") != F.col("c_sha1"), "checksum differs")
        .when(~F.col("state").isin("operational", "archived"), "unusual state")
        .when(F.col("rejected"), "rejected")
        .when(F.col("blacklisted"), "blacklisted")
    )
    return both.select("name", finding.alias("finding")).where("finding is not null")


def findings(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (c.select(*FINDING) for c in checks))


def file_findings(files: DataFrame, legal: DataFrame) -> DataFrame:
    """(name, finding) of files(name) whose name has another form than four parts, or an instrument or type that legal(instrument, type) lacks."""
    known = small(legal.select("instrument").distinct().withColumn("_i", F.lit(True)))
    pairs = small(legal.select("instrument", "type").distinct().withColumn("_t", F.lit(True)))
    rows = files.select("name", file_properties(F.col("name")).alias("p")).select("name", "p.instrument", "p.type")
    rows = rows.join(known, "instrument", "left").join(pairs, ["instrument", "type"], "left")
    finding = F.when(F.col("instrument").isNull(), "no four-part name").when(F.col("_i").isNull(), "unknown instrument").when(F.col("_t").isNull(), "unknown type")
    return rows.select("name", finding.alias("finding")).where("finding is not null")
