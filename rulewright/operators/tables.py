"""Comparison of reference tables by row and by mode, and whether a change of tables matters to a dataset."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalize import compare_text
from ..sources.scratch import dropped, stored
from .meeting import meet, small

#: Table values that fit every header value, unless a field has others.
WILDCARDS = ("ANY",)


def row_diff(a: DataFrame, b: DataFrame, fields: list[str] | None = None, ignore: list[str] = ()) -> DataFrame:
    """Rows of the common columns removed from ``a`` and added in ``b``, as a multiset: (change, n, columns)."""
    if fields and ignore:
        raise ValueError("fields and ignore exclude each other")
    common = [c for c in a.columns if c in b.columns and c not in ignore and (not fields or c in fields)]
    signed = a.select(*common, F.lit(1).alias("s")).unionAll(b.select(*common, F.lit(-1).alias("s")))
    net = signed.groupBy(*common).agg(F.sum("s").alias("net")).where("net <> 0")
    return net.select(*common, F.when(F.col("net") > 0, "removed").otherwise("added").alias("change"), F.abs("net").alias("n"))


def changed_rows(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows with the same key and other values; NaN equals NaN and null equals null."""
    x, y = a.select(*key, F.struct(*values).alias("old")), b.select(*key, F.struct(*values).alias("new"))
    both = x.join(y, key).where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(*key, *(F.col(f"old.{v}").alias(f"old_{v}") for v in values), *(F.col(f"new.{v}").alias(f"new_{v}") for v in values))


def first_of_duplicates(table: DataFrame, keys: list[str], row_no: str = "row_no") -> DataFrame:
    """First row per mode in file order, with how many rows the mode has; minima combine before the shuffle."""
    values = [c for c in table.columns if c not in keys]
    return table.groupBy(*keys).agg(F.min(F.struct(row_no, *(c for c in values if c != row_no))).alias("r"), F.count("*").alias("n_rows")).select(*keys, *(F.col(f"r.{v}").alias(v) for v in values), "n_rows")


#: Modes that a product of mode values may have.
MOST_MODES = 10_000_000


def mode_product(table: DataFrame, keys: list[str]) -> DataFrame:
    """All combinations of the values of the mode columns; the size is checked before they are built."""
    lists = [table.select(k).distinct() for k in keys]
    size = reduce(lambda n, df: n * df.count(), lists, 1)
    if size > MOST_MODES:
        raise ValueError(f"{size} modes are more than {MOST_MODES}")
    return reduce(lambda x, y: x.crossJoin(y), lists)


def _chosen(table: DataFrame, only: dict[str, list] | None) -> DataFrame:
    """Rows whose mode values are among the listed ones."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]).isin(kv[1])), (only or {}).items(), table)


def changed_modes(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], only: dict[str, list] | None = None) -> DataFrame:
    """Modes that both tables have once, with other values: old_ and new_ columns."""
    once = [first_of_duplicates(_chosen(t, only), keys).where("n_rows = 1") for t in (a, b)]
    return changed_rows(once[0], once[1], keys, values)


def mode_diff(a: DataFrame, b: DataFrame, keys: list[str], only: dict[str, list] | None = None) -> DataFrame:
    """Per mode of the product of both tables' values: rows in a and in b, where one lacks it or has it twice or they differ in number.

    ``only`` limits the values of mode columns.
    """
    a, b = _chosen(a, only), _chosen(b, only)
    both = a.select(*keys).unionAll(b.select(*keys))
    na = a.groupBy(*keys).agg(F.count("*").alias("n_a"))
    nb = b.groupBy(*keys).agg(F.count("*").alias("n_b"))
    out = mode_product(both, keys).join(na, keys, "left").join(nb, keys, "left")
    out = out.select(*keys, F.coalesce("n_a", F.lit(0)).cast("long").alias("n_a"), F.coalesce("n_b", F.lit(0)).cast("long").alias("n_b"))
    return out.where("n_a <> 1 or n_b <> 1")


def check_table_modes(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Findings per mode: missing, new, changed, duplicate.  Keys and values are those that both tables have.

    Where the columns of the tables differ in name or order, their rows cannot be compared: one row without mode says ``row format``
    (none if a table is empty).
    """
    common = [c for c in old.columns if c in new.columns]
    keys, values = [k for k in keys if k in common], [v for v in values if v in common]
    if not keys:
        raise ValueError("the tables have none of the mode columns in common")
    if old.columns != new.columns:
        found = old.sparkSession.range(0 if old.isEmpty() or new.isEmpty() else 1)
        return found.select(*(F.lit(None).cast(old.schema[k].dataType).alias(k) for k in keys), F.lit("row format").alias("finding"))
    old, new = (t.withColumn("_row", F.struct(*values, F.lit(0).alias("_"))) for t in (old, new))
    a = first_of_duplicates(old, keys).select(*keys, F.col("_row").alias("old"))
    b = first_of_duplicates(new, keys).select(*keys, F.col("_row").alias("new"), "n_rows")
    both = a.join(b, keys, "full_outer")
    finding = F.when(F.col("new").isNull(), "missing").when(F.col("n_rows") > 1, "duplicate").when(F.col("old").isNull(), "new").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(*keys, finding.alias("finding")).where("finding is not null")


def mode_matches(table_value: Column, header_value: Column, wildcards: list[str] = WILDCARDS) -> Column:
    """A table's mode value fits a header's: a wildcard fits all, a number equals a number, text is part of the header's text."""
    t, h = compare_text(table_value), compare_text(header_value)
    wild = t.isin([*wildcards]) | t.isin([_plain(w) for w in wildcards])
    return F.coalesce(F.when(wild, True).when(is_number(h), t == h).when(is_number(t), False).otherwise(F.instr(h, t) > 0), F.lit(False))


def is_number(value: Column) -> Column:
    return value.try_cast("double").isNotNull()


def _plain(value: str) -> str:
    """A number as ``compare_text`` writes it."""
    try:
        number = float(value)
    except ValueError:
        return value.strip()
    return str(int(number)) if number.is_integer() else str(number)


def mode_select(table: DataFrame, constraints: dict[str, str | list[str]], wildcards: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of a table whose mode columns fit the given header values.

    A list of values (of a value that stands for several) is met by any that is equal.
    ``wildcards`` are those of a field; a field without an entry has ``ANY``.
    """
    def fits(name: str, value: str | list[str]) -> Column:
        wild = (wildcards or {}).get(name, WILDCARDS)
        if isinstance(value, str):
            return mode_matches(F.col(name), F.lit(value), wild)
        return compare_text(F.col(name)).isin([_plain(v) for v in (*value, *wild)])

    return reduce(lambda df, kv: df.where(fits(*kv)), constraints.items(), table)


@dataclass(frozen=True)
class ModeField:
    """A header key that selects rows of a type's tables: its wildcards in the table, and header values that stand for several."""

    name: str
    wildcards: tuple[str, ...] = ("ANY",)
    metavalues: dict[str, list[str]] | None = None


#: References that are no tables; an update from or to one is always kept.
SPECIAL = r"(?i)^(n/a|undefined|not found)"
FIELDS = "array<struct<name:string,wildcards:array<string>,metavalues:array<struct<value:string,several:array<string>>>>>"
#: Fills up shorter tuples of mode values.
PAD = "\x01"


def mode_registry(spark: SparkSession, fields: dict[tuple[str, str], list[str | ModeField] | None]) -> DataFrame:
    """(instrument, filekind, fields): which header keys select the rows of a type's tables, and how; None where a change always matters."""
    def row(f: str | ModeField) -> tuple:
        f = ModeField(f) if isinstance(f, str) else f
        return f.name, [_plain(w) for w in f.wildcards], [(_plain(k), [_plain(v) for v in vs]) for k, vs in (f.metavalues or {}).items()]

    rows = [(i, k, None if f is None else [row(x) for x in f]) for (i, k), f in fields.items()]
    return spark.createDataFrame(rows, f"instrument string, filekind string, fields {FIELDS}")


def _value_fits(values: DataFrame, patterns: DataFrame) -> DataFrame:
    """Which table values of a field a header value selects: (kind, i, value, pattern, score).

    ``values(kind, i, value, field)`` and ``patterns(kind, i, pattern)`` are distinct.
    Texts are cut into their parts of the lengths that table values have, so
    containment is an equality too.
    """
    key = ["kind", "i"]
    field = values.withColumn("several", F.get(F.filter("field.metavalues", lambda m: m["value"] == F.col("value")), F.lit(0))["several"])
    wild = field.select(*key, "value", F.explode("field.wildcards").alias("pattern")).join(patterns, [*key, "pattern"], "left_semi")
    plain = field.select(*key, "value", F.explode(F.coalesce("several", F.when(is_number(F.col("value")), F.array("value")))).alias("pattern")).join(patterns, [*key, "pattern"], "left_semi")
    texts = patterns.where(~is_number(F.col("pattern")))
    lengths = texts.select(*key, F.length("pattern").alias("l")).distinct()
    cut = field.where(F.col("several").isNull() & ~is_number(F.col("value"))).join(lengths, key).where(F.length("value") >= F.col("l"))
    starts = F.explode(F.when(F.col("l") == 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.length("value") - F.col("l") + 1)))
    cut = cut.select(*key, "value", "l", starts.alias("at")).select(*key, "value", F.substring("value", F.col("at"), F.col("l")).alias("pattern"))
    held = cut.distinct().join(texts, [*key, "pattern"], "left_semi")
    return wild.unionByName(plain).unionByName(held).distinct().withColumn("score", F.lit(0))


def same_selection(cases: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Of cases(old_reference, new_reference, kind, fields, values) those whose mode values select the same multiset of rows from both tables.

    ``rows(reference, cells map<string,string>)`` holds one row per table row.  A table's
    rows are summed up by their mode values first: how many, and two sums of hashes.
    The header's values then meet the distinct mode values field by field.  Nothing
    selected on both sides is the same, too.
    """
    pair = ["old_reference", "new_reference"]
    sides = [cases.select(F.col(p).alias("reference"), "kind", "fields", "values") for p in pair]
    asked = stored(sides[0].unionByName(sides[1]).distinct(), "asked")
    fill = lambda c: F.concat(c, F.array_repeat(F.lit(PAD), F.greatest(F.lit(0), F.lit(size) - F.size(c))))
    group = F.struct("reference", "kind").alias("group")
    tuples = asked.select("kind", group, fill(F.col("values")).alias("tuple"))
    cells = rows.join(small(asked.select("reference", "kind", "fields").distinct()), "reference")
    key = F.transform("fields", lambda f: compare_text(F.try_element_at("cells", f["name"])))
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("cells"))))
    keyed = cells.select(group, fill(key).alias("key"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit("second"), text).alias("g"))
    sums = keyed.groupBy("group", "key").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.sum(F.col("g").cast("decimal(38,0)")).alias("q"))
    sums = stored(sums, "mode-sums")
    pad = F.struct(F.lit(PAD).alias("name"), F.array().cast("array<string>").alias("wildcards"), F.array().cast("array<struct<value:string,several:array<string>>>").alias("metavalues"))
    per = asked.select("kind", F.posexplode(F.arrays_zip(fill(F.col("values")).alias("value"), F.concat("fields", F.array_repeat(pad, size)).alias("field"))).alias("i", "z"))
    values = per.where("z.value is not null").select("kind", "i", "z.value", "z.field").dropDuplicates(["kind", "i", "value"])
    patterns = sums.select("group.kind", F.posexplode("key").alias("i", "pattern")).where("pattern is not null").distinct()
    fits = stored(_value_fits(values, patterns), "mode-fits")
    met = meet(tuples, sums.select("group", "key"), fits, size)
    got = met.join(sums, ["group", "key"]).groupBy("group", "tuple").agg(*(F.sum(c).alias(c) for c in "nsq"))
    got = stored(got, "selected")
    out = cases.withColumn("tuple", fill(F.col("values")))
    for side in ("old", "new"):
        own = got.select(F.struct(F.col("group.reference").alias("r"), F.col("group.kind").alias("k"), F.col("tuple").alias("t")).alias("_g"), *(F.col(c).alias(f"{side}_{c}") for c in "nsq"))
        out = out.join(own, F.struct(F.col(f"{side}_reference").alias("r"), F.col("kind").alias("k"), F.col("tuple").alias("t")) == F.col("_g"), "left").drop("_g")
    same = reduce(and_, (F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in "nsq"))
    out = stored(out.where(same).select(*pair, "kind", "values"), "same-selection")
    dropped(asked, sums, fits, got)
    return out


def raw_values(fields: Column, params: Column) -> Column:
    """A header's values under the mode fields as they are; null where one is missing or UNDEFINED."""
    return F.transform(fields, lambda f: F.nullif(F.try_element_at(params, f["name"]), F.lit("UNDEFINED")))


def decided_cases(updates: DataFrame, rows: DataFrame, registry: DataFrame) -> DataFrame:
    """(instrument, filekind, old_reference, new_reference, raw) of updates whose change of tables makes no difference.

    ``updates`` has those columns but ``raw``, and params; ``raw`` are the header's mode values as
    they are.  Each distinct case is decided once.
    """
    types = small(registry.where(F.size("fields") > 0))
    pair, kind = ["old_reference", "new_reference"], F.struct("instrument", "filekind").alias("kind")
    named = updates.join(types, ["instrument", "filekind"]).withColumn("raw", raw_values(F.col("fields"), F.col("params")))
    known = F.forall("raw", lambda v: v.isNotNull()) & ~F.col("old_reference").rlike(SPECIAL) & ~F.col("new_reference").rlike(SPECIAL)
    cases = named.where(known).select(*pair, kind, "raw").distinct()
    cases = stored(cases.withColumn("values", F.transform("raw", compare_text)), "cases")
    fields = types.select(kind, "fields")
    names = F.array_sort(F.map_keys("cells"))
    columns = rows.groupBy("reference").agg(F.min(names).alias("low"), F.max(names).alias("high")).where("low = high").select("reference", F.col("low").alias("names"))
    wide = cases.select(*pair, "kind", "values").distinct().join(fields, "kind")
    for side in ("old", "new"):
        wide = wide.join(columns.withColumnsRenamed({"reference": f"{side}_reference", "names": f"{side}_names"}), f"{side}_reference")
    # Columns alike on both sides, and the mode fields among them.
    wide = wide.where((F.col("old_names") == F.col("new_names")) & F.forall("fields", lambda f: F.array_contains("old_names", f["name"]))).drop("old_names", "new_names")
    wide = stored(wide, "wide-cases")
    size = registry.agg(F.max(F.size("fields")).alias("n")).first()["n"] or 1
    same = same_selection(wide, rows, max(1, size))
    dropped(wide)
    out = stored(cases.join(same, [*pair, "kind", "values"]).select("kind.instrument", "kind.filekind", *pair, "raw"), "same-cases")
    dropped(cases, same)
    return out


def effective_updates(updates: DataFrame, rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Updates whose change of tables matters to the dataset.

    ``updates(dataset_id, instrument, filekind, old_reference, new_reference, params)``
    and ``rows(reference, cells map<string,string>)``, one per table row.  An update is
    dropped if the rows that the dataset's mode values select are the same multiset in
    both tables, none at all included.  It is kept in any other case: a special reference on either side, a
    type that the registry lacks or marks as always, a mode value missing in the
    header, tables with other columns or without rows.  How a table's value is met is
    the registry's: a field's wildcards, header values that stand for several, numbers
    by value, and text that is part of the header's text.
    """
    same = decided_cases(updates, rows, registry)
    named = updates.join(small(registry), ["instrument", "filekind"], "left").withColumn("raw", raw_values(F.col("fields"), F.col("params")))
    return named.join(same, ["instrument", "filekind", "old_reference", "new_reference", "raw"], "left_anti").select(*updates.columns)


def reprocessing_required(updates: DataFrame, rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``effective_updates`` for one type: ``updates`` has the header's mode values under ``keys``, ``rows`` has reference, ``keys`` and ``values``."""
    registry = mode_registry(updates.sparkSession, {("", ""): list(keys)})
    cells = F.create_map(*(x for c in (*keys, *values) for x in (F.lit(c), F.col(c).cast("string"))))
    params = F.create_map(*(x for k in keys for x in (F.lit(k), F.col(k))))
    named = updates.select(*updates.columns, F.lit("").alias("instrument"), F.lit("").alias("filekind"), params.alias("params"))
    return effective_updates(named, rows.select("reference", cells.alias("cells")), registry).select(*updates.columns)


def with_row_numbers(table: DataFrame, order: list[str]) -> DataFrame:
    return table.withColumn("row_no", F.row_number().over(W.orderBy(*order)))
