"""Reading and writing headers, id lists, rules and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import condition_value

HEADER = "map<string,map<string,string>>"


def parse_headers(lines: DataFrame) -> DataFrame:
    """Lines(value) of ``{id: {key: value}}`` objects as (dataset_id, params); several ids a line are allowed."""
    parsed = lines.select(F.from_json("value", HEADER).alias("h")).where("h is not null")
    return parsed.select(F.explode("h").alias("dataset_id", "params"))


def read_headers_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object per line; a path whose lines are no objects is read as whole documents."""
    lines = spark.read.text(path)
    if parse_headers(lines).isEmpty():
        lines = spark.read.text(path, wholetext=True)
    return parse_headers(lines)


def header_lines(headers: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Headers as (dataset_id, value) lines, optionally of listed ids only."""
    out = headers if only is None else headers.join(only.select("dataset_id").distinct(), "dataset_id", "left_semi")
    sorted_params = F.map_from_entries(F.array_sort(F.map_entries("params")))
    return out.select("dataset_id", F.to_json(F.create_map("dataset_id", sorted_params)).alias("value"))


def write_headers_jsonl(headers: DataFrame, path: str, only: DataFrame | None = None) -> None:
    """One line per header; files are sorted by id among and within themselves."""
    header_lines(headers, only).repartitionByRange("dataset_id").sortWithinPartitions("dataset_id").select("value").write.text(path)


def merge_header_sources(sources: list[DataFrame]) -> DataFrame:
    """The first source gives the headers, later ones override key by key; error headers (null params) are dropped."""
    rows = None
    for n, df in enumerate(sources):
        each = df.where("params is not null").select("dataset_id", F.lit(n).alias("n"), F.explode("params").alias("k", "v"))
        rows = each if rows is None else rows.unionByName(each)
    one = rows.groupBy("dataset_id", F.upper("k").alias("k")).agg(F.max_by(condition_value(F.col("v")), "n").alias("v"))
    return one.groupBy("dataset_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("params"))


def flatten_rules(nested: DataFrame, parameters: list[str]) -> DataFrame:
    """rules(rmap, choices map<array values, map<useafter, reference>>) as one row per terminal with its key path."""
    level = nested.select("rmap", F.explode("choices").alias("key", "dates"))
    match_key = F.transform(F.split("key", "/"), lambda x, i: F.named_struct(F.lit("par"), F.get(F.array(*map(F.lit, parameters)), i), F.lit("pattern"), x))
    return level.select("rmap", match_key.alias("match_key"), F.explode("dates").alias("useafter", "reference"))


def parse_id_list(lines: DataFrame) -> DataFrame:
    """Words of lines(value) that are no comments; ``@name`` words are left for another pass."""
    words = lines.where(~F.col("value").rlike(r"^\s*#")).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("word"))
    return words.where("word <> ''")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """An id list with nested ``@file`` words, one pass per level; a list is read once however often it is named.

    The names of lists on one level come to the driver: more than 1,000 are an error.
    """
    words, known = parse_id_list(spark.read.text(path)), {path}
    out = words.where("word not like '@%'")
    while True:
        names = {r.word[1:] for r in words.where("word like '@%'").distinct().limit(1001).collect()}
        if len(names) > 1000:
            raise ValueError("more than 1000 nested lists on one level")
        new = sorted(names - known)
        if not new:
            return out
        known |= names
        words = parse_id_list(spark.read.text(new))
        out = out.union(words.where("word not like '@%'"))


def catalog_query(catalog: DataFrame, sql: str) -> DataFrame:
    """SQL over the file catalog, named ``{catalog}``."""
    return catalog.sparkSession.sql(sql, catalog=catalog)


def list_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Names of a catalog's tables with their number of columns, in order."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(n, len(tables[n].columns)) for n in sorted(tables)], "table string, columns int")


def list_columns(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "column string, type string")


def updated_headers(headers: DataFrame, updates: DataFrame) -> DataFrame:
    """New references written into the headers under the type's name: N/A upper-cased, others lower-cased.  A dataset has a few dozen types."""
    value = F.when(F.upper("new_reference") == "N/A", "N/A").otherwise(F.lower("new_reference"))
    news = updates.groupBy("dataset_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.upper("filekind"), value.alias("v"))))).alias("news"))
    both = headers.join(news, "dataset_id")
    return both.select("dataset_id", F.map_concat(F.map_filter("params", lambda k, v: ~F.array_contains(F.map_keys("news"), k)), "news").alias("params"))


def error_ids(errors: DataFrame) -> DataFrame:
    return errors.select("dataset_id").distinct()


def write_error_ids(errors: DataFrame, path: str, unique: DataFrame) -> None:
    """Id lists as text, sorted: ``path/all`` of all errors, ``path/unique`` of the first dataset of each class of ``unique(first_id)``."""
    for name, ids in (("all", error_ids(errors)), ("unique", unique.select(F.col("first_id").alias("dataset_id")).distinct())):
        ids.orderBy("dataset_id").write.mode("overwrite").text(f"{path}/{name}")


SCHEMA = T.StructType([T.StructField("dataset_id", T.StringType()), T.StructField("params", T.MapType(T.StringType(), T.StringType()))])
