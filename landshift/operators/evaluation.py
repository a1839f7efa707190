"""Expected against actual outcomes: counts, metrics, groups, gate, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(results: DataFrame) -> DataFrame:
    """tp, fp, fn of each example from expected, actual, n (findings), m (matching ones), min_count and max_count."""
    m, n, lo, hi = (F.col(c) for c in ("m", "n", "min_count", "max_count"))
    want, got = F.col("expected") == "findings", F.col("actual") == "findings"
    zero = F.lit(0)
    return results.withColumns(
        {
            "tp": F.when(want & got, F.least(m, hi)).otherwise(zero).cast("long"),
            "fp": F.when(want & got, n - m + F.greatest(zero, m - hi)).when(~want & got, n).otherwise(zero).cast("long"),
            "fn": F.when(want & got, F.greatest(zero, lo - m)).when(want, F.greatest(F.lit(1), lo)).otherwise(zero).cast("long"),
        }
    )


def ratio(a: Column, b: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(empty))


def metrics() -> list[Column]:
    """Aggregates of a table of counted examples; all 0 where it is empty."""
    tp, fp, fn, n = F.sum("tp"), F.sum("fp"), F.sum("fn"), F.count("*")
    told = F.greatest(F.count_if(F.col("actual") == "abstention"), F.count_if(F.col("expected") == "abstention"))
    right = F.count_if((F.col("actual") == "abstention") & (F.col("expected") == "abstention"))
    some = lambda c: F.when(n > 0, c).otherwise(0.0)
    return [
        some(ratio(tp, tp + fp, 1.0)).alias("precision_at_k"),
        some(ratio(tp, tp + fn, 1.0)).alias("recall_at_k"),
        some(ratio(fp * 100, n, 0.0)).alias("fp_rate"),
        some(ratio(right, told, 1.0)).alias("abstention_accuracy"),
        some(F.coalesce(F.avg("n"), F.lit(0.0))).alias("mean_finding_count"),
        n.alias("n_examples"),
    ]


def gate(baseline: DataFrame, other: DataFrame, min_examples: int = 10, gain: float = 0.10) -> DataFrame:
    """One row: both arms' precision, their difference, and the decision.  Both sides are one row."""
    a, b = baseline.agg(*metrics()), other.agg(*metrics())
    both = a.select(F.lit(1).alias("k"), F.col("precision_at_k").alias("baseline_precision"), "n_examples").join(b.select(F.lit(1).alias("k"), F.col("precision_at_k").alias("other_precision")), "k").drop("k")
    delta = F.col("other_precision") - F.col("baseline_precision")
    decision = F.when(F.col("n_examples") < min_examples, "insufficient_data").when(delta >= gain, "other_wins").when(delta < 0, "baseline_wins").otherwise("tie")
    return both.withColumns({"delta_precision": delta, "decision": decision})


def paired(baseline: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Both arms' counts of each example, 1:1: an example that one arm lacks, or has twice, ends the job with an error."""
    one = lambda df, side: df.groupBy(key).agg(F.count("*").alias(f"n_{side}"), *(F.first(c).alias(f"{c}_{side}") for c in ("tp", "fp", "fn")))
    both = one(baseline, "baseline").join(one(other, "other"), key, "full")
    fine = (F.col("n_baseline") == 1) & (F.col("n_other") == 1)
    checked = F.when(F.coalesce(fine, F.lit(False)), F.col("tp_baseline")).otherwise(F.raise_error(F.concat(F.lit("arms don't pair at example "), F.col(key).cast("string"))).cast("long"))
    return both.withColumn("tp_baseline", checked).drop("n_baseline", "n_other")


def deltas(baseline: DataFrame, other: DataFrame) -> DataFrame:
    """One row: the second arm's metrics less the first one's."""
    names = ("precision_at_k", "recall_at_k", "fp_rate", "abstention_accuracy", "mean_finding_count")
    both = [df.agg(*metrics()).select(F.lit(1).alias("k"), *(F.col(n).alias(f"{n}_{side}") for n in names)) for df, side in ((baseline, "a"), (other, "b"))]
    return both[0].join(both[1], "k").select(*((F.col(f"{n}_b") - F.col(f"{n}_a")).alias(f"delta_{n}") for n in names))


def report_lines(groups: DataFrame, name: str) -> DataFrame:
    """Sorted lines ``group: precision of the first arm, of the second, their difference, examples``."""
    line = F.format_string("| %s | %.4f | %.4f | %+.4f | %d |", F.col(name), F.col("baseline_precision"), F.col("other_precision"), F.col("other_precision") - F.col("baseline_precision"), F.col("n_examples"))
    return groups.select(F.col(name), line.alias("line"))
