"""What a change of context does to the datasets: updates, errors, counts, products and needed files.

    spark-submit -m rulewright.jobs.affected_datasets --datasets D --old-rules A --new-rules B --parameters FLAG,QTY --out O

``datasets`` (Parquet) has dataset_id, instrument, params (map) and exptime; rule tables
have instrument, filekind, match_key (array of par, pattern), useafter and reference.
``--tables`` names rows(reference, cells map) of reference tables and ``--modes`` a registry of mode
fields (Parquet, as ``mode_registry`` makes it); with them, updates whose tables select the same rows are left out.
``out`` gets the folders findings (all of them, with their kind and whether the dataset is
killed), updates, errors, counts, products and needed; a rerun replaces them.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reprocess as R
from ..operators import selection as S


def reached(rows: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Datasets that a changed rule can reach: those of its instrument, exposed from its date on."""
    a, b = (r.select("instrument", "filekind", "match_key", "useafter", "reference") for r in (old, new))
    changed = a.subtract(b).union(b.subtract(a))
    # A rule without a date counts always, so its instrument is looked at from the beginning.
    cut = changed.groupBy("instrument").agg(F.min("useafter").alias("_from"), F.max(F.col("useafter").isNull()).alias("_always"))
    late = F.col("_always") | F.col("exptime").isNull() | (F.col("exptime") >= F.col("_from"))
    return rows.join(cut, "instrument").where(late).select(*rows.columns)


def run(spark: SparkSession, datasets: str, old_rules: str, new_rules: str, parameters: list[str], out: str, since: str | None = None, include: list[str] | None = None, tables: str | None = None, modes: str | None = None) -> None:
    """Only datasets that a changed rule can reach are joined, all their types at once; errors among them included.

    ``since`` sets a date by hand; ``all`` turns the pruning off.
    """
    old, new, rows = (spark.read.parquet(p) for p in (old_rules, new_rules, datasets))
    if since is None:
        rows = reached(rows, old, new)
    elif since != "all":
        rows = rows.where((F.col("exptime") >= F.lit(since).cast("timestamp")) | F.col("exptime").isNull())
    sides = []
    for rules in (old, new):
        own = rules.withColumn("rmap", F.struct("instrument", "filekind"))
        sides.append((own.select("instrument", "filekind", "rmap").distinct(), own.drop("instrument", "filekind")))
    effects = (spark.read.parquet(tables), spark.read.parquet(modes)) if tables and modes else None
    found = R.with_killed(S.compared_references(rows, *sides, parameters, include, tables=effects))
    found.write.mode("overwrite").parquet(f"{out}/findings")
    findings = spark.read.parquet(f"{out}/findings")
    findings.where("kind = 'error'").select("dataset_id", "instrument", "filekind", F.col("new_reference").alias("message")).write.mode("overwrite").parquet(f"{out}/errors")
    findings.where("kind = 'update' and not killed").drop("kind", "killed").write.mode("overwrite").parquet(f"{out}/updates")
    updates = spark.read.parquet(f"{out}/updates")
    R.update_counts(updates).write.mode("overwrite").parquet(f"{out}/counts")
    R.affected_products(updates).write.mode("overwrite").parquet(f"{out}/products")
    R.needed_references(updates).write.mode("overwrite").parquet(f"{out}/needed")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    for name in ("datasets", "old-rules", "new-rules", "parameters", "out"):
        p.add_argument(f"--{name}", required=True)
    for name in ("since", "include", "tables", "modes"):
        p.add_argument(f"--{name}")
    a = p.parse_args()
    include = a.include.split(",") if a.include else None
    run(SparkSession.builder.getOrCreate(), a.datasets, a.old_rules, a.new_rules, a.parameters.split(","), a.out, a.since, include, a.tables, a.modes)


if __name__ == "__main__":
    main()
