"""As-of joins: rule-side choices become disjoint spans per key, and each row finds the one span that holds its value.

A row is never joined with all spans of its key.  Spans are dealt into cells of the
value's range, about two of them in a cell wherever they crowd, and rows meet only the spans of their
own cell by an equi-join, which Spark can broadcast, shuffle or split where it is
skewed.  Rows stay as narrow as they came.
"""

from __future__ import annotations

from functools import reduce
from math import isfinite
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Spans that may be broadcast: narrow rows, so some 20 MB at most.  Beyond it the join shuffles.
BROADCAST_SPANS = 200_000
#: Cells that a key's range may be cut into, and the quantiles of the spans' bounds between which they are equally wide.
MOST_CELLS, KNOTS = 1 << 20, 32


def as_number(df: DataFrame, column: str) -> Column:
    """A number in the order of a column of times or numbers."""
    kind = df.schema[column].dataType.simpleString()
    c = F.col(column)
    return F.unix_micros(c.cast("timestamp")).cast("double") if kind.startswith(("timestamp", "date")) else c.cast("double")


def running_best(points: DataFrame, key: list[str], at: str, order: list[str]) -> DataFrame:
    """Of points that count from ``at`` on (null: always), those that are the best so far by ``order``, as spans.

    Returns key, low, high (null: open) and the other columns; within a key spans
    are disjoint.  The window runs inside a key of the rules, not of the data.
    """
    others = [c for c in points.columns if c not in (*key, at)]
    best = F.max(F.struct(*order, *(c for c in others if c not in order))).alias("b")
    one = points.groupBy(*key, at).agg(best).select(*key, F.col(at).alias("low"), *(F.col(f"b.{c}").alias(c) for c in others))
    line = W.partitionBy(*key).orderBy(F.col("low").asc_nulls_first())
    before = F.max(F.struct(*order)).over(line.rowsBetween(W.unboundedPreceding, -1))
    kept = one.withColumn("_before", before).where(F.col("_before").isNull() | (F.struct(*order) >= F.col("_before"))).drop("_before")
    return kept.withColumn("high", F.lead("low").over(line))


def span_join(rows: DataFrame, spans: DataFrame, key: list[str], at: str, how: str = "left") -> DataFrame:
    """``rows`` with the columns of the span of their key with low <= ``at`` < high.

    ``spans(key, low, high, ...)`` are disjoint within a key; null bounds are open.  A
    row with a null value meets only spans marked by a true column ``unknown``, if
    there is one.  ``key``, low, high and unknown are not handed on.
    """
    spans = stored(spans, "spans")
    marked = "unknown" in spans.columns
    known = spans.where(~F.col("unknown")) if marked else spans
    low, high = as_number(spans, "low"), as_number(spans, "high")
    shares = F.percentile_approx(F.coalesce(low, high), F.array(*(F.lit(k / KNOTS) for k in range(KNOTS + 1))), F.lit(10_000))
    size = known.agg(F.count("*").alias("n"), shares.alias("knots"), F.max(high).alias("most"), F.approx_count_distinct(F.struct(*key)).alias("keys")).first()
    knots = sorted({k for k in [*(size.knots or []), size.most] if k is not None and isfinite(k)})
    wanted = max(1, min(MOST_CELLS, size.n // (2 * max(1, size.keys))))
    knots = knots[:: max(1, (len(knots) - 1) // wanted)] if len(knots) > 1 else [*knots, *(k + 1 for k in knots)] or [0.0, 1.0]
    each = max(1, wanted // (len(knots) - 1))
    cells = each * (len(knots) - 1)

    def cell(value: str) -> str:
        """Cells of equal width between two knots, which have about equally many spans between them; written in SQL, one call."""

        def inside(a: int, b: int) -> str:
            if b - a > 1:
                middle = (a + b) // 2
                return f"if({value} < {knots[middle]!r}D, {inside(a, middle)}, {inside(middle, b)})"
            part = f"floor(({value} - {knots[a]!r}D) / {knots[b] - knots[a]!r}D * {each})"
            return f"{a * each} + greatest(0, least({each}, {part}))"

        return f"cast({inside(0, len(knots) - 1)} as int)"

    spans = spans.withColumns({"_low": low, "_high": high})
    first = F.when(F.col("low").isNull(), 0).otherwise(F.expr(cell("_low")))
    last = F.when(F.col("high").isNull(), cells).otherwise(F.expr(cell("_high")))
    covered = F.sequence(first, last)
    if marked:
        covered = F.when(F.col("unknown"), F.array(F.lit(-1))).otherwise(covered)
    others = [c for c in spans.columns if c not in (*key, "low", "high", "unknown", "_low", "_high")]
    dealt = spans.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), "low", "high", *others, F.explode(covered).alias("_cell"))
    if size.n + size.keys * (cells + 2) <= BROADCAST_SPANS:
        dealt = F.broadcast(dealt)
    else:
        # A table of the spans of a partition is small, and rows need not be sorted.
        dealt = dealt.hint("shuffle_hash")
    value = F.when(F.col("_number").isNotNull(), F.expr(cell("_number")))
    asked = rows.withColumn("_number", as_number(rows, at)).withColumn("_at", F.coalesce(value, F.lit(-1)) if marked else value)
    same = reduce(and_, (F.col(k) == F.col(f"_k{i}") for i, k in enumerate(key)))
    inside = F.coalesce(F.col(at) >= F.col("low"), F.lit(True)) & F.coalesce(F.col(at) < F.col("high"), F.lit(True))
    return asked.join(dealt, same & (F.col("_at") == F.col("_cell")) & inside, how).select(*rows.columns, *others)


def neighbours(points: DataFrame, key: list[str], at: str) -> DataFrame:
    """Spans between consecutive points(key, at, value columns): the point below, the one above, and the one before that below.

    Columns below, above and second are structs of ``at`` and the other columns, null
    where there is none.  The points of a key are distinct in ``at``.
    """
    point = F.struct(F.col(at).alias("at"), *(c for c in points.columns if c not in (*key, at)))
    one = points.select(*key, F.col(at).alias("low"), point.alias("below"))
    line = W.partitionBy(*key).orderBy("low")
    inner = one.withColumn("above", F.lead("below").over(line)).withColumn("high", F.lead("low").over(line)).withColumn("second", F.lag("below").over(line))
    first = one.groupBy(*key).agg(F.min("low").alias("high"), F.min_by("below", "low").alias("above"))
    return inner.unionByName(first, allowMissingColumns=True)


def last_not_after(rows: DataFrame, points: DataFrame, key: list[str], at: str, order: Column, point: Column, last: Column) -> DataFrame:
    """Per row the greatest ``last`` of the points of its key whose ``point`` is not above its ``order``.

    For values of which a key has few (versions): distinct asked values and points
    are sorted together per key, and the answers, stored so that Spark knows how few
    they are, join back by equality.
    """
    asked = rows.select(*key, order.alias("_o")).distinct()
    both = asked.withColumn("_v", F.lit(None).cast(points.select(last.alias("v")).schema["v"].dataType)).withColumn("_asked", F.lit(True))
    both = both.unionByName(points.select(*key, point.alias("_o"), last.alias("_v"), F.lit(False).alias("_asked")))
    line = W.partitionBy(*key).orderBy("_o").rangeBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("_best", F.max("_v").over(line)).where("_asked").select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_o").alias("_order"), F.col("_best"))
    found = stored(found, "answers")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)))
    return rows.withColumn("_o", order).join(found, same & F.col("_o").eqNullSafe(F.col("_order")), "left").select(*rows.columns, F.col("_best").alias(at))
