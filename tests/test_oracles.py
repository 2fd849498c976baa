"""Every registered core query against its SQL twin on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from rulewright.catalogue import ORACLES, QUERIES
from rulewright.catalogue.inputs import TABLES, load
from rulewright.operators.contexts import history_pairs
from rulewright.streaming.incremental import incremental_history


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def normal(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(normal(r[c] for c in columns) for r in df.collect())
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(normal(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_incremental_history_equals_batch(spark, sf):
    history = load(spark, sf, "history")
    want = Counter(tuple(r) for r in history_pairs(history).select("idx", "old_context", "new_context").collect())
    got = Counter(tuple(r) for r in QUERIES["incremental_history"](spark, sf).select("idx", "old_context", "new_context").collect())
    assert got == want


def test_incremental_history_one_change_a_batch(spark, tmp_path):
    """One change a batch, one step back among them, and a restart between."""
    contexts, got = ["a", "c", "b", "d", "e"], []
    for part in (range(3), range(3, 5)):
        for k in part:
            spark.createDataFrame([(k, contexts[k])], "idx int, context string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("idx int, context string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        incremental_history(source, lambda pairs, number: got.extend(tuple(r) for r in pairs.collect()), f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(got) == [(0, "a", "c"), (2, "b", "d"), (3, "d", "e")]


def test_stream_equals_batch(spark, sf):
    a = {tuple(r) for r in QUERIES["stream_best_references"](spark, sf).collect()}
    assert a == {tuple(r) for r in QUERIES["best_reference"](spark, sf).collect()}
