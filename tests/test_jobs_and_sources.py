"""The job on stored tables, and reading and writing of headers and lists."""

import os
import time

import pytest
from pyspark.sql import functions as F

from rulewright.catalogue import QUERIES
from rulewright.catalogue.inputs import load
from rulewright.catalogue.selection import PARAMETERS, headers, keyed
from rulewright.functions.expressions import presence_of
from rulewright.functions.patterns import match_status
from rulewright.jobs import affected_datasets
from rulewright.operators import reprocess as R
from rulewright.sources import headers as H
from rulewright.sources import scratch
from rulewright.sources.tables import read_reference_table


def test_job_equals_the_query(spark, sf, tmp_path):
    headers(load(spark, sf, "exposures")).withColumnRenamed("rmap", "instrument").write.parquet(f"{tmp_path}/d")
    for name in ("old_rules", "new_rules"):
        keyed(load(spark, sf, name)).withColumnRenamed("rmap", "instrument").withColumn("filekind", F.lit("table")).write.parquet(f"{tmp_path}/{name}")
    want = {tuple(r) for r in QUERIES["affected_datasets"](spark, sf).collect()}
    failed = {r.dataset_id for r in QUERIES["failed_datasets"](spark, sf).collect()}
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    for since in (None, "all"):
        affected_datasets.run(spark, f"{tmp_path}/d", f"{tmp_path}/old_rules", f"{tmp_path}/new_rules", PARAMETERS, f"{tmp_path}/out", since=since)
        assert {tuple(r) for r in read("updates").collect()} == want
        errors = {r.dataset_id for r in read("errors").collect()}
        # Datasets that no changed rule reaches are not looked at unless all are asked for.
        assert errors and errors <= failed and (since is None or errors == failed)
    total = read("counts").where("instrument is null").first().n_updates
    assert total == len(want) and read("needed").count() > 0 and read("needed").where("reference like 'not found%'").count() == 0


def test_headers_there_and_back(spark, tmp_path):
    df = spark.createDataFrame([("b:2", {"K": "v", "A": "1"}), ("a:1", {"K": "w"}), ("c:3", {})], "dataset_id string, params map<string,string>")
    H.write_headers_jsonl(df, f"{tmp_path}/h")
    assert {r.dataset_id: r.params for r in H.read_headers_jsonl(spark, f"{tmp_path}/h").collect()} == {"b:2": {"K": "v", "A": "1"}, "a:1": {"K": "w"}, "c:3": {}}
    H.write_headers_jsonl(df, f"{tmp_path}/few", df.where("dataset_id = 'a:1'"))
    assert [r.dataset_id for r in H.read_headers_jsonl(spark, f"{tmp_path}/few").collect()] == ["a:1"]
    (tmp_path / "whole.json").write_text('{\n "x:1": {"K": "v"},\n "y:2": {"K": "w"}\n}\n')
    assert {r.dataset_id for r in H.read_headers_jsonl(spark, str(tmp_path / "whole.json")).collect()} == {"x:1", "y:2"}


def test_id_lists_nest_to_any_depth(spark, tmp_path):
    for k in range(9):
        (tmp_path / f"l{k}").write_text(f"# list {k}\nid{k} other{k}\n@{tmp_path}/l{k + 1}\n@{tmp_path}/l0\n")
    (tmp_path / "l9").write_text("last\n")
    got = sorted(r.word for r in H.read_id_list(spark, str(tmp_path / "l0")).collect())
    assert got == sorted([f"id{k}" for k in range(9)] + [f"other{k}" for k in range(9)] + ["last"])


def test_columns_are_listed(spark):
    assert [tuple(r) for r in H.list_columns(spark.createDataFrame([(1, "x")], "a int, b string")).collect()] == [("a", "int"), ("b", "string")]


@pytest.mark.parametrize(("text", "want"), [("required(is_defined('A'))", "R"), ("optional(is_defined('A'))", "O"), ("warning(is_defined('B'))", "O"), ("warn_only(is_defined('B'))", "W"), ("subarray()", "S"), ("full_frame(A == 'x')", "F"), ("A == 'y'", "O"), ("all_subarray(contains('A', 'x'))", "A")])
def test_conditional_presence(spark, text, want):
    p = F.create_map(F.lit("A"), F.lit("x"))
    assert spark.range(1).select(presence_of(text, p).alias("x")).first().x == want


@pytest.mark.parametrize(("value", "pattern", "want"), [("7", "# <5 and >1 or #", -1), ("# 1 OR 2 #", "# 1 or 2 #", 1), ("9", "not # 8 or 9 #", -1), ("*", "# 1 and 2 #", 1), ("N/A", "# 1 and 2 #", 0), (None, "A", -1)])
def test_logical_patterns(spark, value, pattern, want):
    assert spark.range(1).select(match_status(F.lit(value).cast("string"), F.lit(pattern)).alias("x")).first().x == want


def test_the_shared_folder(spark):
    df = scratch.stored(spark.range(3), "three")
    assert df._stored_at.startswith(spark.conf.get("spark.checkpoint.dir")) and df.count() == 3
    scratch.dropped(df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        spark.read.parquet(df._stored_at).count()


def shuffle_files(spark):
    """Names of the shuffle files that the session holds."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {name for d in dirs for _, _, names in os.walk(d) for name in names if name.startswith("shuffle_")}


def test_stored_leaves_no_shuffle_files(spark):
    """What a step has shuffled goes as the step ends; the session's own setting is as it was, after a failure too."""
    setting = spark.conf.get(scratch.CLEANUP, None)
    rows = spark.range(400_000).select("id", F.xxhash64("id").alias("x"))
    before = shuffle_files(spark)
    tables = [scratch.stored(rows.repartition(4, F.col("x") + k), "moved") for k in range(3)]
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert [t.distinct().count() for t in tables] == [400_000] * 3
    assert spark.conf.get(scratch.CLEANUP, None) == setting
    with pytest.raises(Exception, match="no such number"):
        scratch.stored(rows.select(F.raise_error(F.lit("no such number"))), "failing")
    assert spark.conf.get(scratch.CLEANUP, None) == setting
    scratch.dropped(*tables)


def test_error_lists_and_catalog(spark, tmp_path):
    errors = spark.createDataFrame([("b", "cam", "dark", "NOT FOUND x"), ("a", "cam", "dark", "NOT FOUND x"), ("c", "cam", "flat", "NOT FOUND y"), ("a", "cam", "flat", "NOT FOUND y")], "dataset_id string, instrument string, filekind string, message string")
    H.write_error_ids(errors, f"{tmp_path}/e", R.unique_errors(errors))
    lists = {n: [r.value for r in spark.read.text(f"{tmp_path}/e/{n}").collect()] for n in ("all", "unique")}
    assert lists == {"all": ["a", "b", "c"], "unique": ["a"]}
    assert [tuple(r) for r in H.list_tables({"z": errors, "e": errors.select("message")}).collect()] == [("e", 1), ("z", 4)]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_reference_table_reader(spark, tmp_path, fmt):
    """Segments with columns of their own, several files and parts of files, rows in file order."""
    rows = spark.range(5000).selectExpr("id * 7 % 5000 as Value", "'mode' || id % 3 as Mode")
    first, second = f"{tmp_path}/{fmt}/segment=1", f"{tmp_path}/{fmt}/segment=2"
    writer = lambda df: df.write.option("header", True).format(fmt)
    writer(rows.repartitionByRange(3, "Value")).save(first)
    writer(spark.createDataFrame([(1, "x")], "other int, text string").coalesce(1)).save(second)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        out = read_reference_table(spark, f"{tmp_path}/{fmt}", "ref.fits", 1, fmt)
        got = [tuple(r) for r in out.orderBy("row_no").select("VALUE", "MODE", "row_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert out.columns == ["VALUE", "MODE", "reference", "segment", "row_no"]
    files = sorted(p for p in (tmp_path / fmt / "segment=1").iterdir() if p.suffix == f".{fmt}")
    want = [tuple(r) for f in files for r in spark.read.option("header", True).option("inferSchema", True).format(fmt).load(str(f)).coalesce(1).collect()]
    assert got == [(*r, k + 1) for k, r in enumerate(want)]
    assert read_reference_table(spark, f"{tmp_path}/{fmt}", "r", 2, fmt).columns[:2] == ["OTHER", "TEXT"]
    with pytest.raises(KeyError):
        read_reference_table(spark, f"{tmp_path}/{fmt}", "r", 3, fmt)
