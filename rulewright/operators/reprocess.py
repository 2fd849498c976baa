"""The reprocessing workload: compare references of two contexts, screen and report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalize import normalize_dataset_id, product_id
from .meeting import small
from .results import resolve_result

def screen_references(new: DataFrame, undefined_matters: bool = False) -> tuple[DataFrame, DataFrame]:
    """Results of one context as (updates, errors)."""
    ok, ref = resolve_result(F.col("reference"), undefined_matters)
    rows = new.withColumn("ok", ok).withColumn("new_reference", ref)
    return rows.where("ok").drop("ok", "reference"), rows.where("not ok").select("dataset_id", "instrument", "filekind", F.col("reference").alias("message"))


def compare_references(old: DataFrame, new: DataFrame, undefined_matters: bool = False) -> DataFrame:
    """Old and new results per (dataset, type): ``kind`` is update, error or same; a missing side is UNDEFINED.

    A new failure is an error whatever the old result; an old failure is a value like
    others.  Whether changes from or to N/A count is for ``regression_differences``.
    """
    key = ["dataset_id", "instrument", "filekind"]
    a = old.select(*key, F.col("reference").alias("old_raw"))
    b = new.select(*key, F.col("reference").alias("new_raw"))
    both = a.join(b, key, "full_outer")
    ok, new_ref = resolve_result(F.col("new_raw"), undefined_matters)
    _, old_ref = resolve_result(F.col("old_raw"), undefined_matters)
    kind = F.when(~ok, "error").when(old_ref != new_ref, "update").otherwise("same")
    return both.select(*key, old_ref.alias("old_reference"), new_ref.alias("new_reference"), kind.alias("kind"))


def regression_differences(compared: DataFrame, na_matters: bool = False) -> DataFrame:
    """Updates that count as regressions: those with N/A on either side only if N/A matters."""
    rows = compared.where("kind = 'update'")
    return rows if na_matters else rows.where("old_reference <> 'N/A' and new_reference <> 'N/A'")


def unkilled_updates(compared: DataFrame) -> DataFrame:
    """Updates of datasets without any failed type."""
    killed = compared.where("kind = 'error'").select("dataset_id").distinct()
    return compared.where("kind = 'update'").join(killed, "dataset_id", "left_anti")


def with_killed(compared: DataFrame) -> DataFrame:
    """Findings with a column ``killed``: whether some type of the dataset failed, so that none of its updates is made."""
    killed = compared.where("kind = 'error'").select(F.col("dataset_id").alias("_id")).distinct()
    both = compared.join(killed, F.col("dataset_id") == F.col("_id"), "left")
    return both.withColumn("killed", F.col("_id").isNotNull()).drop("_id")


def affected_products(updates: DataFrame) -> DataFrame:
    return updates.select(product_id(F.col("dataset_id")).alias("product_id")).distinct()


def affected_details(updates: DataFrame) -> DataFrame:
    """One row per dataset with its sorted types; a dataset has a few dozen types at most."""
    return updates.groupBy("dataset_id", "instrument").agg(F.array_join(F.array_sort(F.collect_set("filekind")), " ").alias("filekinds"), F.count("*").alias("n_updates"))


def needed_references(updates: DataFrame) -> DataFrame:
    return updates.select(F.lower("new_reference").alias("reference")).where("reference <> 'n/a'").distinct()


def update_counts(updates: DataFrame) -> DataFrame:
    """Updates per instrument and type, with totals (null) from a rollup."""
    return updates.rollup("instrument", "filekind").agg(F.count("*").alias("n_updates"))


def unique_errors(errors: DataFrame, threshold: int = 1, listed: int = 3) -> DataFrame:
    """Error classes without the dataset: count, first dataset and the first ones listed, in order of id.

    A filter on a row number is cut down inside each task before the shuffle, so a
    class that holds most errors sends a few rows from each task.
    """
    key = ["instrument", "filekind", "message"]
    counts = errors.groupBy(*key).agg(F.count("*").alias("n_errors"), F.min("dataset_id").alias("first_id")).where(F.col("n_errors") >= threshold)
    order = F.row_number().over(W.partitionBy(*key).orderBy("dataset_id"))
    # Ranks by id: the listed ones are few per class, so the array stays short.
    top = errors.select(*key, "dataset_id").distinct().withColumn("o", order).where(F.col("o") <= listed).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("dataset_id")), " ").alias("examples"))
    return counts.join(top, key)


def coverage_cases(results: DataFrame) -> DataFrame:
    """Datasets with the same full set of results: count and example."""
    sets = results.groupBy("dataset_id", "instrument").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "filekind", "reference"))), " ").alias("results"))
    return cases_of_sets(sets)


def cases_of_sets(sets: DataFrame) -> DataFrame:
    """``coverage_cases`` of (dataset_id, instrument, results) that stand one row a dataset already."""
    return sets.groupBy("instrument", "results").agg(F.count("*").alias("n_datasets"), F.min("dataset_id").alias("example"))


def datasets_since(datasets: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Datasets exposed at or after their instrument's cut-off; an instrument without one keeps all."""
    cuts = small(cutoffs.select(F.col("instrument").alias("cut_instrument"), "cutoff"))
    both = datasets.join(cuts, datasets["instrument"] == cuts["cut_instrument"], "left")
    return both.where(F.col("cutoff").isNull() | (F.col("exptime") >= F.col("cutoff"))).select(*datasets.columns)


def filter_ids(datasets: DataFrame, only: DataFrame | None = None, drop: DataFrame | None = None) -> DataFrame:
    """Keep and drop listed datasets; a dropped one is dropped even if it is listed to keep."""
    ident = normalize_dataset_id(F.col("dataset_id"))
    out = datasets.withColumn("_id", ident)
    if drop is not None:
        out = out.join(drop.select(normalize_dataset_id(F.col("dataset_id")).alias("_id")).distinct(), "_id", "left_anti")
    if only is not None:
        out = out.join(only.select(normalize_dataset_id(F.col("dataset_id")).alias("_id")).distinct(), "_id", "left_semi")
    return out.drop("_id")


def resolve_dataset_ids(ids: DataFrame, datasets: DataFrame) -> DataFrame:
    """Asked ids as full ids: two parts as they are, one part as the first full id that has it; null if there is none."""
    up = ids.select("asked", F.upper("asked").alias("part"))
    full = datasets.select(F.upper("dataset_id").alias("full"))
    parts = full.select("full", F.explode(F.array_distinct(F.array(F.substring_index("full", ":", 1), F.substring_index("full", ":", -1), F.col("full")))).alias("part"))
    first = parts.join(up.select("part").distinct(), "part").groupBy("part").agg(F.min("full").alias("full"))
    return up.join(first, "part", "left").select("asked", F.when(F.col("part").contains(":"), F.col("part")).otherwise(F.col("full")).alias("dataset_id"))


def first_exposures(datasets: DataFrame) -> DataFrame:
    """The first exposure of each product by id; minima combine before the shuffle."""
    return datasets.groupBy(product_id(F.col("dataset_id")).alias("product_id")).agg(F.min("dataset_id").alias("dataset_id"))


def history_affected(effects: DataFrame, pairs: DataFrame, drop_errors: bool = False) -> DataFrame:
    """Distinct ids affected by any of the context changes; runs with errors are kept unless dropped."""
    rows = effects.join(small(pairs), ["old_context", "new_context"], "left_semi")
    return (rows.where("status = 'ok'") if drop_errors else rows).select("dataset_id").distinct()


@dataclass(frozen=True)
class ResultPlugins:
    """What to do with the results of a piece of history; each is called with one DataFrame."""

    use_affected: Callable[[DataFrame], None] | None = None
    log_affected: Callable[[DataFrame], None] | None = None
    use_all_ids: Callable[[DataFrame], None] | None = None
    log_all_ids: Callable[[DataFrame], None] | None = None


def process_history(effects: DataFrame, pairs: DataFrame, plugins: ResultPlugins, drop_errors: bool = False) -> DataFrame:
    """Distinct ids affected by the changes ``pairs``, after the plug-ins have seen them.

    ``use_affected`` gets the effects of the changes, ``log_affected`` their number per
    change and status, ``use_all_ids`` the distinct ids and ``log_all_ids`` one row with
    the number of changes that contributed and of ids.
    """
    rows = effects.join(small(pairs), ["old_context", "new_context"], "left_semi")
    if plugins.log_affected:
        plugins.log_affected(rows.groupBy("old_context", "new_context", "status").agg(F.count("*").alias("n")))
    rows = rows.where("status = 'ok'") if drop_errors else rows
    ids = history_affected(effects, pairs, drop_errors)
    if plugins.use_affected:
        plugins.use_affected(rows)
    if plugins.use_all_ids:
        plugins.use_all_ids(ids)
    if plugins.log_all_ids:
        plugins.log_all_ids(rows.agg(F.countDistinct("old_context", "new_context").alias("changes"), F.countDistinct("dataset_id").alias("ids")))
    return ids
