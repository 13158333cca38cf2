"""Aggregate reports: distributions, confusion counts, metrics, rates and overlaps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions.numeric import micro, ratio


def distributions(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(axis, value, n) of several columns in one scan."""
    entries = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])
    return df.select(F.explode(entries).alias("e")).groupBy("e.axis", "e.value").agg(F.count("*").alias("n"))


def exploded_counts(df: DataFrame, array: str, name: str = "value") -> DataFrame:
    return df.select(F.explode(array).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def diversity(df: DataFrame, column: str) -> DataFrame:
    """(total, distinct_values, diversity in millionths)."""
    out = df.agg(F.count("*").alias("total"), F.count_distinct(column).alias("distinct_values"))
    return out.withColumn("diversity_micro", micro(ratio(F.col("distinct_values"), F.col("total"))))


def binary_metrics(df: DataFrame, truth: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and accuracy, precision, recall and F1 (0 where undefined); rows with an unknown label are left out."""
    known = df.withColumn("__t", truth).withColumn("__p", predicted).filter(F.col("__t").isNotNull())
    t, p = F.col("__t") == 1, F.coalesce(F.col("__p") == 1, F.lit(False))
    counts = known.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return counts.select(
        *by, "tp", "fp", "tn", "fn", ratio(F.col("tp") + F.col("tn"), n).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
    )


def confusion_matrix(df: DataFrame, gold: str, predicted: str, classes: Sequence[str] = ("FAKE", "REAL", "UNCERTAIN")) -> DataFrame:
    """One row for each gold class, one column for each predicted class."""
    known = df.filter(F.col(gold).isin(list(classes)) & F.col(predicted).isNotNull())
    return known.groupBy(F.col(gold).alias("gold")).agg(*[F.count_if(F.col(predicted) == c).alias(c) for c in classes])


def detector_scores(df: DataFrame, id_col: str, detectors: Sequence[str], others: Sequence[str] = ()) -> DataFrame:
    """(id, others, detector, score): the detectors' columns as rows."""
    return df.unpivot([id_col, *others], list(detectors), "detector", "score")


def stratum_accuracy(df: DataFrame, gold: str, predicted: str, stratum: Column) -> DataFrame:
    each = df.select(F.coalesce(stratum, F.lit("unknown")).alias("stratum"), (F.col(gold) == F.col(predicted)).cast("int").alias("ok"))
    return each.groupBy("stratum").agg(F.count("*").alias("n"), F.sum("ok").alias("correct")).withColumn("accuracy_micro", micro(ratio(F.col("correct"), F.col("n"))))


def run_stats(df: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """Runs, mean and population deviation."""
    return df.groupBy(*by).agg(F.count("*").alias("runs"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def paired_t(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(n, t) of the paired differences; null for fewer than three pairs or no spread."""
    d = df.select((a - b).alias("d")).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return d.select("n", F.when((F.col("n") >= 3) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt("n"))).alias("t"))


def t_p_value(t: float, df: int) -> float:
    """The two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def dominant_bin(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(axis, value, n, share in millionths) of the largest bin of each axis, ties to the smaller value."""
    counts = distributions(df, axes)
    w = W.partitionBy("axis")
    ranked = counts.withColumn("__r", F.row_number().over(w.orderBy(F.desc("n"), "value"))).withColumn("__all", F.sum("n").over(w))
    return ranked.filter("__r = 1").select("axis", "value", "n", micro(F.col("n") / F.col("__all")).alias("share_micro"))


def empirical_rates(df: DataFrame, group: str, codes: str, all_codes: Sequence[str]) -> DataFrame:
    """(group, code, fired, total, rate in millionths) over every group and listed code, 0 where none fired."""
    spark = df.sparkSession
    totals = df.groupBy(group).agg(F.count("*").alias("total"))
    fired = df.select(group, F.explode(F.array_distinct(codes)).alias("code")).groupBy(group, "code").agg(F.count("*").alias("fired"))
    dims = spark.createDataFrame([(c,) for c in all_codes], "code string")
    grid = totals.crossJoin(F.broadcast(dims))  # a fixed list of codes
    out = grid.join(fired, [group, "code"], "left").withColumn("fired", F.coalesce("fired", F.lit(0)))
    return out.select(group, "code", "fired", "total", micro(ratio(F.col("fired"), F.col("total"))).alias("rate_micro"))


def deck_overlap(decks: DataFrame, user: str, item: str) -> DataFrame:
    """(a, b, common, overlap in millionths of the smaller deck) of users who share an item. ``decks`` is a bounded selection of users."""
    held = decks.select(F.col(user).alias("u"), F.col(item).alias("i")).distinct()
    sizes = held.groupBy("u").agg(F.count("*").alias("n"))
    pairs = held.alias("x").join(held.alias("y"), (F.col("x.i") == F.col("y.i")) & (F.col("x.u") < F.col("y.u")))
    common = pairs.groupBy(F.col("x.u").alias("a"), F.col("y.u").alias("b")).agg(F.count("*").alias("common"))
    sized = common.join(sizes.withColumnRenamed("u", "a").withColumnRenamed("n", "na"), "a").join(sizes.withColumnRenamed("u", "b").withColumnRenamed("n", "nb"), "b")
    return sized.select("a", "b", "common", micro(F.col("common") / F.least("na", "nb")).alias("overlap_micro"))


def overlap_summary(decks: DataFrame, user: str, item: str, users: int = 25) -> DataFrame:
    """One row over all pairs of the first ``users`` users: n_pairs, and mean, max and min of the share of a deck that the next user's holds, in percent."""
    first = decks.select(F.col(user).alias("u")).distinct().orderBy("u").limit(users)
    held = decks.select(F.col(user).alias("u"), F.col(item).alias("i")).distinct().join(first, "u")
    sizes = held.groupBy("u").agg(F.count("*").alias("n"))
    common = held.alias("x").join(held.alias("y"), (F.col("x.i") == F.col("y.i")) & (F.col("x.u") < F.col("y.u"))).groupBy(F.col("x.u").alias("a"), F.col("y.u").alias("b")).agg(F.count("*").alias("common"))
    # pairs without a common item count with share 0; at most users * users rows
    pairs = sizes.select(F.col("u").alias("a"), "n").join(sizes.select(F.col("u").alias("b")), F.col("a") < F.col("b")).join(common, ["a", "b"], "left")
    share = 100.0 * F.coalesce("common", F.lit(0)) / F.col("n")
    return pairs.agg(F.count("*").alias("n_pairs"), F.round(F.avg(share), 2).alias("mean_overlap_pct"), F.round(F.max(share), 2).alias("max_overlap_pct"), F.round(F.min(share), 2).alias("min_overlap_pct"))


def capacity(pool: DataFrame, days: int = 7, per_day: int = 8) -> DataFrame:
    """One row on how many decks a pool can serve without repeats: pool_size, capacity, expected_overlap_pct."""
    n, deck = F.count("*"), days * per_day
    return pool.agg(n.alias("pool_size"), F.floor(n / deck).alias("capacity"), F.round(100.0 * deck / F.greatest(n, F.lit(1)), 2).alias("expected_overlap_pct"))


def top_frequencies(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def examples(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each group, cut before they are shuffled."""
    return df.withColumn("example", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("example") <= n)


def issue_breakdown(audited: DataFrame, issues: str) -> DataFrame:
    """(issue, n): rows with the issue, and all passing rows as ``passed``."""
    each = audited.select(F.explode(F.when(F.size(issues) == 0, F.array(F.lit("passed"))).otherwise(F.array_distinct(issues))).alias("issue"))
    return each.groupBy("issue").agg(F.count("*").alias("n"))


def detector_report(df: DataFrame, verdict: str, detectors: Sequence[str], ensemble: str, strata: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """(axis, value, n, correct, accuracy in millionths) of rows that are FAKE or REAL: each detector over all, and the ensemble in each stratum.

    Where the rows were chosen by the same detectors, this is a check of consistency, not of accuracy.
    """
    known = df.filter(F.col(verdict).isin("FAKE", "REAL"))
    right = lambda d: F.coalesce(((F.col(d) >= threshold) == (F.col(verdict) == "FAKE")).cast("int"), F.lit(0))
    axes = [F.struct(F.lit("detector").alias("axis"), F.lit(d).alias("value"), right(d).alias("right")) for d in detectors]
    axes += [F.struct(F.lit(s).alias("axis"), F.col(s).cast("string").alias("value"), right(ensemble).alias("right")) for s in strata]
    each = known.select(F.explode(F.array(*axes)).alias("r")).select("r.*")
    counted = each.groupBy("axis", "value").agg(F.count("*").alias("n"), F.sum("right").alias("correct"))
    return counted.withColumn("accuracy_micro", micro(F.col("correct") / F.col("n")))


def deck_report(decks: DataFrame, pool: DataFrame, days: int, per_day: int, candidate: str = "candidate") -> DataFrame:
    """(user_id, cards, exhausted, least_candidates): for each deck whether the pool ran out, and how many candidates its poorest day shows."""
    named = decks.join(pool.select("id", F.col(candidate).alias("__c")), "id", "left")
    daily = named.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.count_distinct("__c").alias("c"))
    return daily.groupBy("user_id").agg(F.sum("n").alias("cards"), (F.sum("n") < days * per_day).alias("exhausted"), F.min("c").alias("least_candidates"))
