"""Insertion by headers with and without update hooks."""

from pyspark.sql import functions as F

from rulewright.functions.hooks import hook
from rulewright.operators.diffs import insert_headers


def test_update_hooks_at_insertion(spark):
    @hook("update", "cam", "lamp")
    def both_sides(rows):
        return rows.withColumn("side", F.explode(F.array(F.lit("L"), F.lit("R"))))

    rules = spark.createDataFrame([("cam", "L", "N/A", "old"), ("eye", "M", "N/A", "keep")], "rmap string, side string, aid string, reference string")
    new = spark.createDataFrame([("cam", "X", "9", "a", 1), ("cam", "Y", "8", "b", 2), ("eye", "Z", "7", "c", 3), (None, "Z", "7", "d", 4)], "rmap string, side string, aid string, reference string, n int")
    got = insert_headers(rules, new, "lamp", ["rmap", "side", "aid"], "n", ["aid"])
    found = {(r.rmap, r.side, r.aid, r.reference, r.action, r.n_inserts) for r in got.where("rmap <> 'UNDEFINED'").collect()}
    assert found == {("CAM", "L", "N/A", "b", "replace", 2), ("CAM", "R", "N/A", "b", "add", 2), ("EYE", "M", "N/A", "keep", "keep", 0), ("EYE", "Z", "N/A", "c", "add", 1)}
    # Another type has no hook: the header's own value is the rule's.
    plain = insert_headers(rules.limit(0), new.where("n = 1"), "flat", ["rmap", "side", "aid"], "n", ["aid"]).collect()
    assert [(r.side, r.aid, r.action) for r in plain] == [("X", "N/A", "add")]
    assert insert_headers(rules.limit(0), new.limit(0), "lamp", ["rmap", "side", "aid"], "n").count() == 0
