"""Quality rules: decision lists learned from labelled statistics by sequential covering.

Every text gets counts made by built-in functions alone.  From the counts of
labelled texts a list of rules is learned: a rule is a conjunction of thresholds
that grows condition by condition on one part of the labelled texts, is pruned
on the other, and is kept if it is precise enough there; then the texts that it
covers are taken away and the next rule is learned.  The list becomes one
ordered Spark conditional expression.  All counting of labelled rows is grouped
aggregation; the driver only sees counts per (statistic, threshold).
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, dropped, stored

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Labelled texts that the rules are learned from at most, those with the smallest hashes of their ids.
LABELLED = 20_000
#: Candidate thresholds of each statistic.
STEPS = 48
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines"]
#: What rules may test: name -> SQL over the counts.
STATISTICS = {
    "n_words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "mark_ratio": "n_marks / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
}


def with_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with the columns of ``COUNTS`` (long), replacing columns of these names.

    Words are runs of non-space characters of the whole text; null counts as a
    text without words.  n_repeat_words: words inside a window of five words that
    occurs twice or more, the first occurrence included.  Windows are compared by
    64-bit hashes sorted with their positions, so a text of n words costs n log n.
    """
    d = documents.drop(*COUNTS)
    t = F.coalesce(F.col(text), F.lit(""))
    d = d.withColumn("__h", F.transform(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    size = F.size("__h")
    run = F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.struct(F.xxhash64(*(F.get("__h", i + k) for k in range(WINDOW))).alias("h"), i.alias("i")))
    d = d.withColumn("__n", size).withColumn("__w", F.when(size >= WINDOW, F.sort_array(run)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    again = F.filter("__w", lambda x, k: (x["h"] == F.get("__w", k - 1)["h"]) | (x["h"] == F.get("__w", k + 1)["h"]))
    d = d.withColumn("__p", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate("__p", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")), lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["at"])).alias("n"), i.alias("at")))["n"]
    length = F.length(t)
    d = d.withColumn("__l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    without = lambda letters: F.length(F.translate(t, letters, ""))
    counts = {
        "n_words": F.col("__n"),
        "word_chars": without(SPACES),
        "n_symbols": length - without(SYMBOLS),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": covered,
        "n_upper": length - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_marks": length - without("!?"),
        "n_lines": F.size("__l"),
    }
    # One row in, one row out: a filter on the counts stays above this step.  Pushed below,
    # it would be rewritten over the arrays and compute them anew for every element.
    d = d.withColumn("__c", F.explode(F.array(F.struct(*(v.cast("long").alias(k) for k, v in counts.items())))))
    return d.withColumns({k: F.col(f"__c.{k}") for k in COUNTS}).drop("__h", "__n", "__w", "__p", "__l", "__c")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(STATISTICS[self.statistic])
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the first rule that covers a text rejects it, else it is kept."""
    out = F
    for rule in rules:
        out = out.when(covers(rule), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    return bad * (log2(bad / (bad + good)) - log2(bad0 / (bad0 + good0))) if bad and bad0 else 0.0


def learn_rules(labelled: DataFrame, precision: float = 0.98, least: int = 8, most_rules: int = 10, most_conditions: int = 3) -> list[Rule]:
    """Rules for texts to reject from ``labelled(bad boolean, part 0|1|2, COUNTS)``; parts 0 and 1 grow, part 2 prunes.

    A rule is kept if it covers ``least`` bad texts, and on the pruning part at
    least ``precision`` of what it covers is bad.  Without labelled rows, or with
    none that is bad, there are no rules.
    """
    values = labelled.select("bad", (F.col("part") == 2).alias("prune"), *(F.expr(s).alias(k) for k, s in STATISTICS.items()))
    cuts = values.select(*(F.percentile_approx(k, [i / STEPS for i in range(1, STEPS)], 10_000).alias(k) for k in STATISTICS)).first()
    grid = {k: sorted(set(cuts[k] or [])) for k in STATISTICS}
    grid = {k: v for k, v in grid.items() if v}
    if not grid:
        return []
    # How many thresholds each statistic passes, once for all steps.
    passed = {k: _passed(k, v) for k, v in grid.items()}
    binned = stored(values.select("bad", "prune", *STATISTICS, *(c.alias(f"b_{k}") for k, c in passed.items())), "binned")
    rules: list[Rule] = []
    while len(rules) < most_rules:
        open_rows = binned.where(_kept_so_far(rules))
        rule: Rule = ()
        steps: list[tuple[Rule, tuple[int, int]]] = []
        while len(rule) < most_conditions:
            each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"b_{k}").alias("b")) for k in grid))).alias("x")
            counts = open_rows.where(_on_values(rule)).select("bad", "prune", each).groupBy("x.k", "x.b", "prune").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
            table: dict = {}
            for r in counts:
                table.setdefault((r.k, r.prune), {})[r.b] = (r.bad, r.good)
            best = None
            for k in grid:
                grow, prune = table.get((k, False), {}), table.get((k, True), {})
                bad0, good0 = (sum(v[x] for v in grow.values()) for x in (0, 1))
                for n, t in enumerate(grid[k]):
                    for above in (True, False):
                        bad, good = _side(grow, n, above)
                        gain = _gain(bad, good, bad0, good0)
                        if bad >= least and gain > 0 and (best is None or (gain, k, -t) > best[0]):
                            best = ((gain, k, -t), Condition(k, above, float(t)), (bad, good), _side(prune, n, above))
            if best is None:
                break
            rule = (*rule, best[1])
            steps.append((rule, best[3]))
            if best[2][1] == 0:
                break
        # Prune: of the prefixes that are precise enough on rows the rule was not grown on, the one that parts them best.
        good_enough = [(b - g, -len(r), r) for r, (b, g) in steps if b and b >= precision * (b + g)]
        if not good_enough:
            break
        rules.append(_widened(max(good_enough, key=lambda x: x[:2])[2], open_rows.where("bad")))
    dropped(binned)
    return rules


def _passed(name: str, thresholds: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col(name) > t))


def _side(counts: dict, n: int, above: bool) -> tuple[int, int]:
    """(bad, good) on one side of threshold ``n``: a row above it passes more than n thresholds."""
    chosen = [v for b, v in counts.items() if (b > n) == above]
    return sum(v[0] for v in chosen), sum(v[1] for v in chosen)


def _on_values(rule: Rule) -> Column:
    """``covers`` where the statistics are columns."""
    out = F.lit(True)
    for c in rule:
        out = out & ((F.col(c.statistic) > c.threshold) if c.above else (F.col(c.statistic) <= c.threshold))
    return out


def _kept_so_far(rules: list[Rule]) -> Column:
    out = F.lit(True)
    for rule in rules:
        out = out & ~_on_values(rule)
    return out


def _widened(rule: Rule, bad: DataFrame) -> Rule:
    """The same rule with each threshold moved half way to the bulk of the bad texts that it covers.

    Of the thresholds that part the labelled texts alike, the middle one leaves
    most room for good texts unlike those seen.
    """
    tail = [F.percentile_approx(c.statistic, 0.02 if c.above else 0.98, 10_000).alias(f"c{i}") for i, c in enumerate(rule)]
    bulk = bad.where(_on_values(rule)).select(*tail).first()
    return tuple(Condition(c.statistic, c.above, (c.threshold + b) / 2) for c, b in zip(rule, bulk))


def labelled_counts(documents: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """Counts of at most ``bound`` labelled documents (a row has bad: quality 0 in any of its labels)."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)))
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return with_counts(found).drop("text")


def quality_verdicts(documents: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """``documents`` with COUNTS, base_failed and kept; columns of these names are replaced.

    The rules are learned on labelled documents of this very table.  A null or
    empty text has no words, so it fails the base rule.  Rows are judged one by
    one: repeated rows get the same verdict, an empty table gives an empty result.
    """
    learned = stored(labelled_counts(documents, labels, bound).where(~base_failed()), "labelled")
    rules = learn_rules(learned)
    dropped(learned)
    counted = with_counts(documents.drop("base_failed", "kept"))
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
