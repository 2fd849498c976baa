"""Reference tables: rows in file order with upper-cased columns, segment by segment."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.meeting import small
from .scratch import dropped, stored


def table_segments(spark: SparkSession, path: str) -> dict[int, str]:
    """Where the segments of a table lie: its folders ``segment=N``, or the path itself as the only one."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        raise FileNotFoundError(path)
    names = [s.getPath().getName() for s in system.listStatus(root)] if system.getFileStatus(root).isDirectory() else []
    found = {int(m[1]): f"{path.rstrip('/')}/{n}" for n in names if (m := re.match(r"^segment=(\d+)$", n))}
    return dict(sorted(found.items())) or {1: path}


def numbered_rows(rows: DataFrame, column: str = "row_no") -> DataFrame:
    """Rows of files with their number from 1, files in order of their names and rows as they stand in them.

    ``rows`` come straight from a file source.  A part of a file is read in order by one task, so a
    row's number is its place in the part and the number of rows of all parts before;
    only the parts' sizes are put in order in one place.
    """
    names = rows.columns
    marked = rows.select(*names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    marked = stored(marked, "rows")
    parts = marked.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1))
    parts = stored(parts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n"), "parts")
    out = marked.join(small(parts), ["_file", "_start"])
    out = stored(out.select(*names, (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias(column)), "numbered")
    dropped(marked, parts)
    return out


def read_reference_table(spark: SparkSession, path: str, reference: str, segment: int = 1, fmt: str = "parquet") -> DataFrame:
    """A segment's rows with upper-cased column names, and reference, segment and row_no (in file order, from 1).

    ``path`` is a Parquet or CSV file or folder (CSV with a header, types inferred), or
    a folder of ``segment=N`` folders, each with columns of its own.  A segment that is not there raises
    ``KeyError``; names that differ only in case raise ``ValueError``.
    """
    places = table_segments(spark, path)
    if segment not in places:
        raise KeyError(f"{path} has no segment {segment}")
    reader = spark.read.option("header", True).option("inferSchema", True) if fmt == "csv" else spark.read
    rows = reader.format(fmt).load(places[segment])
    upper = [c.upper() for c in rows.columns]
    if len(set(upper)) < len(upper):
        raise ValueError(f"column names of {path} are the same in capitals")
    numbered = numbered_rows(rows, "row_no")
    return numbered.select(*(F.col(c).alias(c.upper()) for c in rows.columns), F.lit(reference).alias("reference"), F.lit(segment).alias("segment"), F.col("row_no").cast("long").alias("row_no"))
