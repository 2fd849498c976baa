"""Normal forms of header values, dates, names and ids, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNDEFINED = "UNDEFINED"
NUMBER = r"^([-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?|[+-]?[0-9]+\.)$"
#: Spellings of "don't care"; the middle ones match as prefixes.
DONT_CARE = r"^(-2147483648\.0|\(\)|N/A|NOT APPLICABLE|NOT_APPLICABLE$)"


def float_text(x: Column) -> Column:
    """A double as the shortest text with a fractional part; exponents from 1e16 up and below 1e-4."""
    s = x.cast("double").cast("string")
    exponent = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(s, r"^([^E]*)E", 1), r"\.0$", "")
    fixed = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", ".0")
    far = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return F.when(exponent.isNull(), s).when((exponent > -5) & (exponent < 16), fixed).otherwise(far)


def condition_value(value: Column) -> Column:
    """Normal form of a header value: upper case, numbers as floats, one spelling of N/A, * and the booleans."""
    v = F.upper(F.trim(value.cast("string")))
    v = F.when(v.rlike(NUMBER), float_text(v.try_cast("double"))).otherwise(v)
    v = F.when(v.rlike(DONT_CARE), "N/A").otherwise(v)
    return F.when(v == "ANY", "*").when(v == "4294967295.0", "-1.0").when(v.isin("T", "TRUE"), "T").when(v.isin("F", "FALSE"), "F").otherwise(v)


def condition_header(params: Column, keys: Iterable[str] | None = None) -> Column:
    """``condition_value`` over a map, keys upper-cased, only ``keys`` if given."""
    out = F.transform_values(F.transform_keys(params, lambda k, v: F.upper(k)), lambda k, v: condition_value(v))
    return out if keys is None else F.map_filter(out, lambda k, v: k.isin([k.upper() for k in keys]))


def bestrefs_condition(value: Column) -> Column:
    """Normal form of a recorded reference: a failed lookup that is natural counts as N/A."""
    v = condition_value(value)
    return F.when(v == "NOT FOUND N/A", "N/A").otherwise(v)


def clean_ref_path(value: Column) -> Column:
    """``xref$name`` and ``scheme://name`` as ``name``."""
    return F.regexp_replace(F.substring_index(value, "$", -1), r"^[a-z]+://", "")


def glob_list(pattern: Column) -> Column:
    """Sorted branches of an or-pattern; patterns of other kinds stay whole."""
    branches = F.filter(F.transform(F.split(pattern, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    whole = pattern.rlike(r"^([({#<>=]|between |not )")
    return F.when(whole, F.array(pattern)).otherwise(F.array_sort(branches))


def glob_compress(pattern: Column) -> Column:
    return F.array_join(F.array_distinct(glob_list(pattern)), "|")


def minimize_header(params: Column, keys: Iterable[str]) -> Column:
    """Only the required keys; a lower-case key wins over its upper-case form, a missing one is UNDEFINED."""
    pairs: list = []
    for k in keys:
        pairs += [F.lit(k), F.coalesce(F.try_element_at(params, F.lit(k.lower())), F.try_element_at(params, F.lit(k.upper())), F.lit(UNDEFINED))]
    return F.create_map(*pairs)


def parse_time(text: Column) -> Column:
    """Seconds of the day of hh:mm[:ss[.f]] with or without AM and PM."""
    t = F.upper(F.regexp_replace(F.trim(text), r"\s+(?=[AaPp][Mm]$)", ""))
    part = lambda k: F.regexp_extract(t, r"^(\d+):(\d+)(?::(\d+(?:\.\d*)?))?", k)
    hour = part(1).try_cast("int")
    hour = F.when(t.endswith("PM") & (hour < 12), hour + 12).when(t.endswith("AM") & (hour == 12), 0).otherwise(hour)
    return hour * 3600 + part(2).try_cast("int") * 60 + F.coalesce(F.nullif(part(3), F.lit("")).try_cast("decimal(12,6)"), F.lit(0))


def parse_date(text: Column) -> Column:
    """A timestamp of any of the usual spellings, null for what is none.

    Numeric dates with - or /, ISO with T, YYYYMMDD:HHMMSS, month names before or
    after the day, AM and PM, a trailing UT, two-digit years 90 to 99 and 00 to 39.
    """
    t = F.regexp_replace(F.trim(text), r"(?i)\s+(UT|UTC|Z)$", "")
    t = F.regexp_replace(t, r"^(\d{4}-\d\d-\d\d)T", "$1 ")
    compact = F.regexp_extract(t, r"^(\d{8}):(\d{6})$", 0)
    d = F.replace(F.regexp_replace(F.regexp_extract(t, r"^(.*?\d)(?:\s+\d+:.*)?$", 1), r"[-/,]+", " "), F.lit("  "), F.lit(" "))
    clock = F.regexp_extract(t, r"\s(\d+:\d.*)$", 1)
    seconds = F.when(clock == "", F.lit(0).cast("decimal(20,6)")).otherwise(parse_time(clock).cast("decimal(20,6)"))

    def of(pattern: str, order: str, prefix: str = "") -> Column:
        part = {x: F.regexp_extract(d, pattern, k + 1) for k, x in enumerate(order)}
        month = part["m"] if "m" in part else F.lpad(((F.instr(F.lit("JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"), F.upper(F.substring(part["M"], 1, 3))) + 2) / 3).cast("int").cast("string"), 2, "0")
        day = F.when(d.rlike(pattern), F.concat_ws("-", F.concat(F.lit(prefix), part["y"]), F.lpad(month, 2, "0"), F.lpad(part["d"], 2, "0")))
        return F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))

    names = "(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* "
    date = F.coalesce(
        of(r"^(\d\d) (\d\d) (\d{4})$", "mdy"),
        of(r"^(\d{4}) (\d\d) (\d\d)$", "ymd"),
        of(r"^(\d\d) (\d\d) (9\d)$", "dmy", "19"),
        of(r"^(\d\d) (\d\d) ([0-3]\d)$", "dmy", "20"),
        of(names + r"(\d{1,2}) (\d{4})$", "Mdy"),
        of(r"(?i)^(\d{1,2}) ((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*) (\d{4})$", "dMy"),
    )
    micros = F.timestamp_micros(F.unix_micros(date) + (seconds * 1_000_000).cast("long"))
    return F.when(compact != "", F.try_to_timestamp(F.replace(compact, F.lit(":"), F.lit(" ")), F.lit("yyyyMMdd HHmmss"))).otherwise(micros)


#: Strict recognisers, as patterns over the whole text.
DATE_KINDS = {
    "slash": (r"^\s*(\d\d)\s*/\s*(\d\d)\s*/\s*(\d{4})\s*$", "dmy"),
    "dash": (r"^\s*(\d{4})-(\d\d)-(\d\d)\s*$", "ymd"),
    "iso": (r"^\s*(\d{4})-(\d\d)-(\d\d)T\d\d:\d\d:\d\d\s*$", "ymd"),
    "month": (r"(?i)^\s*(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+(\d{1,2})\s*,?\s+(\d{4})(\s+\d\d:\d\d:\d\d)?\s*$", "Mdy"),
}


def date_format_ok(text: Column, kind: str) -> Column:
    """Whether a text is a valid date of one strict kind, or of ``any`` of them."""
    if kind == "any":
        return reduce(lambda a, b: a | b, (date_format_ok(text, k) for k in DATE_KINDS))
    pattern, order = DATE_KINDS[kind]
    part = {x: F.regexp_extract(text, pattern, k + 1) for k, x in enumerate(order)}
    month = part["m"] if "m" in part else ((F.instr(F.lit("JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"), F.upper(F.substring(part["M"], 1, 3))) + 2) / 3).cast("int").cast("string")
    day = F.concat_ws("-", part["y"], F.lpad(month, 2, "0"), F.lpad(part["d"], 2, "0"))
    return F.coalesce(text.rlike(pattern) & F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def useafter_of(params: Column, default: str | None = None) -> Column:
    """First of the three spellings of the use-after date, parsed; ``default`` for junk if given."""
    found = F.coalesce(*(F.try_element_at(params, F.lit(k)) for k in ("USEAFTER", "useafter", "UseAfter")))
    parsed = parse_date(found)
    return parsed if default is None else F.coalesce(parsed, F.lit(default).cast("timestamp"))


def exptime_of(params: Column, pairs: list[tuple[str, str]], singles: Iterable[str] = ()) -> Column:
    """``date time`` of the first pair of keys that is defined, else of the singles, else 1900-01-01."""
    value = lambda k: F.nullif(F.try_element_at(params, F.lit(k)), F.lit(UNDEFINED))
    found = [F.when(value(a).isNotNull() & value(b).isNotNull(), F.concat_ws(" ", value(a), value(b))) for a, b in pairs]
    return F.coalesce(*found, *(value(k) for k in singles), F.lit("1900-01-01 00:00:00"))


def version_key(text: Column) -> Column:
    """(major, minor, point) of a version text; missing parts are 0, a suffix is dropped."""
    part = lambda k: F.coalesce(F.regexp_extract(text, r"^\D*?(\d+)(?:\.(\d+))?(?:\.(\d+))?", k).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("point"))


def normalize_dataset_id(ident: Column) -> Column:
    """Upper-cased two-part id; ``x_det`` becomes ``X.det``, and one part stands for both."""
    base = F.upper(ident)
    dotted = F.regexp_replace(base, r"_([A-Z]+)$", ".$1")
    return F.when(base.contains(":"), base).otherwise(F.concat(dotted, F.lit(":"), dotted))


def product_id(ident: Column) -> Column:
    return F.lower(F.substring_index(ident, ":", 1))


def instrument_of(params: Column, keys: Iterable[str] = ("INSTRUME", "INSTRUMENT"), synonyms: dict[str, str] | None = None) -> Column:
    """First instrument keyword that is defined, upper-cased, synonyms replaced."""
    found = F.upper(F.coalesce(*(F.nullif(F.try_element_at(params, F.lit(k)), F.lit(UNDEFINED)) for k in keys), F.lit(UNDEFINED)))
    return found if not synonyms else reduce(lambda c, kv: F.when(found == kv[0], kv[1]).otherwise(c), synonyms.items(), found)


def expand_wildcards(params: Column, rules: Iterable[tuple[Column, str, str]]) -> Column:
    """Set a key where a condition on the original header holds; of several rules for a key the last wins."""
    return reduce(lambda m, r: F.when(r[0], F.map_concat(F.map_filter(m, lambda k, v: k != r[1]), F.create_map(F.lit(r[1]), F.lit(r[2])))).otherwise(m), rules, params)


def irrelevant_to_na(params: Column, relevance: dict[str, Column]) -> Column:
    """Keys whose relevance condition is false become N/A."""
    return F.transform_values(params, lambda k, v: reduce(lambda c, kv: F.when((k == kv[0]) & ~F.coalesce(kv[1], F.lit(True)), "N/A").otherwise(c), relevance.items(), v))


def reference_to_dataset_header(params: Column, renames: dict[str, str], extra: Iterable[str] = (), expansions: Iterable = (), relevance: dict[str, Column] | None = None) -> Column:
    """A reference's header in the words of dataset headers: keys renamed, wildcards expanded, values in normal form."""
    named = F.transform_keys(params, lambda k, v: reduce(lambda c, kv: F.when(F.upper(k) == kv[0], kv[1]).otherwise(c), renames.items(), F.upper(k)))
    out = condition_header(expand_wildcards(named, expansions))
    out = irrelevant_to_na(out, relevance or {})
    extra = list(extra)
    return out if not extra else F.map_concat(F.map_filter(out, lambda k, v: ~k.isin(extra)), F.create_map(*(F.lit(x) for k in extra for x in (k, "N/A"))))


#: Fixed patterns: file-name classes from newest to oldest convention.
NAME_CLASSES = [("current", r"^\w+_\d+\.\w+$|^\w+\.[pir]map$"), ("oldcomponent", r"^[a-z][a-z0-9]{8,9}_(tm[cgt]|syn|th)\.fits$"), ("newcomponent", r"^[0-9][a-z0-9]{8,9}_(tm[cgt]|syn|th)\.fits$"), ("old", r"^[a-z][a-z0-9]{8}_\w+\.\w+$"), ("new", r"^[0-9][a-z0-9]{7,8}_\w+\.\w+$")]


def classify_name(name: Column) -> Column:
    base = F.substring_index(name, "/", -1)
    return reduce(lambda c, kv: F.when(base.rlike(kv[1]), kv[0]).otherwise(c), reversed(NAME_CLASSES), F.when(base == "N/A", "current").otherwise("old"))


def serial_of(name: Column) -> Column:
    """The serial number before a name's suffix, -1 without one."""
    return F.coalesce(F.regexp_extract(name, r"_(\d+)\.\w+", 1).try_cast("long"), F.lit(-1).cast("long"))


def extension_rank(name: Column) -> Column:
    ext = F.regexp_extract(name, r"(\.[^./]*)$", 1)
    return F.when(ext.rlike(r"^\.r\d[hd]"), 0).when(ext == ".fits", 1).when(ext == ".json", 2).when(ext == ".yaml", 3).when(ext == ".asdf", 4).otherwise(5)


def is_newer(a: Column, b: Column) -> Column:
    """Whether file name ``a`` is newer than ``b``; null where names have no order between them.

    A name has a family (component tables and all other files), a generation inside it
    (names that begin with a letter are the first one, but for the current form) and,
    inside a form, a place: extension and serial number for the current form, the text
    itself for the others.  Families are never compared, nor two forms of one
    generation.  N/A is older than any file.
    """

    def place(name: Column) -> Column:
        base = F.substring_index(name, "/", -1)
        form = classify_name(base)
        numbered = form == "current"
        return F.struct(
            form.endswith("component").alias("family"),
            F.when(form.startswith("old"), 0).otherwise(1).alias("generation"),
            form.alias("form"),
            F.struct(F.when(numbered, extension_rank(base)).alias("rank"), F.when(numbered, serial_of(base)).alias("serial"), F.when(~numbered, base).alias("text")).alias("order"),
            (name == "N/A").alias("nothing"),
        )

    x, y = place(a), place(b)
    inside = F.when(x["generation"] != y["generation"], x["generation"] > y["generation"]).when(x["form"] == y["form"], x["order"] > y["order"])
    return F.when(x["nothing"] | y["nothing"], ~x["nothing"]).when(x["family"] == y["family"], inside)


def compare_text(value: Column) -> Column:
    """One text for equal numbers, else the trimmed text.

    Only what begins like a number is read as one: a failed reading is slow.
    """
    t = F.trim(value.cast("string"))
    number = t.try_cast("double")
    whole = F.coalesce(t.try_cast("long").cast("string"), F.when(number == F.floor(number), number.cast("long").cast("string")), number.cast("string"), t)
    return F.when(t.rlike(r"(?i)^[+-]?(\d|\.\d|inf|nan)"), whole).otherwise(t)


def _with(params: Column, key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(params, lambda k, v: k != key), F.create_map(F.lit(key), value))


def cross_strap(params: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """For each (master, slave) in order: an undefined slave takes the master's value if that is defined."""
    out = params
    for master, slave in pairs:
        m, s = (F.coalesce(F.try_element_at(out, F.lit(k)), F.lit(UNDEFINED)) for k in (master, slave))
        out = F.when((s == UNDEFINED) & (m != UNDEFINED), _with(out, slave, m)).otherwise(out)
    return out


def file_properties(name: Column) -> Column:
    """(observatory, instrument, type, serial, extension) of a four-part file name; nulls where it has another form."""
    base = F.substring_index(name, "/", -1)
    part = lambda k: F.nullif(F.regexp_extract(base, r"^([a-z]+)_([a-z0-9]+)_([a-z0-9-]+)_(\d+)\.(\w+)$", k), F.lit(""))
    return F.struct(*(part(k + 1).alias(n) for k, n in enumerate(("observatory", "instrument", "type", "serial", "extension"))))
