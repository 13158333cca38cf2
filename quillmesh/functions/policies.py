"""Named classification and binning policies; thresholds are arguments with the usual defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions import lexicons as L
from quillmesh.functions.arrays import literals
from quillmesh.functions.hashing import stable_index
from quillmesh.functions.numeric import known
from quillmesh.functions.text import preview, text_or_empty

# Fixed values: (FAKE at or above, REAL at or below) by policy.
VERDICTS = {"explain": (0.6, 0.4), "merge": (0.65, 0.35), "validate": (0.55, 0.45)}
# Margins (easy, medium) by policy.
DIFFICULTIES = {"explain": (0.35, 0.15), "merge": (0.30, 0.10)}


def verdict(p: Column, policy: str = "explain") -> Column:
    high, low = VERDICTS[policy]
    return F.when(p >= high, "FAKE").when(p <= low, "REAL").otherwise("UNCERTAIN")


def difficulty(margin: Column, policy: str = "explain") -> Column:
    easy, medium = DIFFICULTIES[policy]
    return F.when(margin >= easy, "easy").when(margin >= medium, "medium").otherwise("hard")


def binary(p: Column, threshold: float = 0.5) -> Column:
    """1 at or above the threshold; null and NaN give 0."""
    return F.coalesce((known(p) >= threshold).cast("int"), F.lit(0))


def align(verdict_: Column, fake_percent: Column, fired: Column) -> Column:
    """Verdict, percentage and flags after the alignment guard."""
    demoted = (verdict_ == "REAL") & (F.size(fired) >= 3)
    return F.struct(
        F.when(demoted, "UNCERTAIN").otherwise(verdict_).alias("verdict"),
        F.when(demoted, F.greatest(fake_percent, F.lit(41.0))).otherwise(fake_percent).alias("fake_percent"),
        ((verdict_ == "FAKE") & (F.size(fired) == 0)).alias("fake_no_indicators"),
        demoted.alias("demoted_real_to_uncertain"),
    )


def bin3(p: Column, low: Column | float, high: Column | float) -> Column:
    v = known(p)
    return F.when(v.isNull(), "unk").when(v >= high, "high").when(v >= low, "mid").otherwise("low")


#: Accuracy of the sketch that brackets a percentile, and buckets that its bracket is cut into.
SKETCH = 10_000
BUCKETS = 1024


def percentiles(values: DataFrame, shares: Sequence[float]) -> DataFrame:
    """One row (n, p): exact percentiles, interpolated, of the column v, which has no nulls.

    A sketch brackets each percentile, the bracket is cut into buckets, and only
    the values of the buckets that hold its ranks are put in order; no buffer
    holds more.
    """
    near = [min(1.0, max(0.0, s + d / SKETCH)) for s in shares for d in (-2, 2)]
    sketch = values.agg(F.count("*").alias("n"), F.percentile_approx("v", F.array(*map(F.lit, near)), SKETCH).alias("s"), F.min("v").alias("least"), F.max("v").alias("most"))
    few = F.col("n") <= 4 * SKETCH  # neighbouring ranks may lie beyond the sketch's values
    lo, hi = (lambda k: F.when(few, F.col("least")).otherwise(F.col("s")[2 * k])), (lambda k: F.when(few, F.col("most")).otherwise(F.col("s")[2 * k + 1]))
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), lo(k).alias("lo"), hi(k).alias("hi"), ((F.col("n") - 1) * s).alias("at")) for k, s in enumerate(shares)])
    brackets = sketch.select("n", F.explode(wanted).alias("w")).select("n", "w.*")
    # a row for each share
    near_rows = values.join(F.broadcast(brackets), F.col("v") <= F.col("hi"))
    part = F.when(F.col("v") < F.col("lo"), -1).otherwise(F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * (BUCKETS - 1)), F.lit(0)))
    parted = near_rows.withColumn("part", part.cast("int"))
    sizes = parted.groupBy("k", "part", "at").agg(F.count("*").alias("m"))  # BUCKETS + 1 rows a share
    below = F.coalesce(F.sum("m").over(W.partitionBy("k").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.withColumn("below", below)
    chosen = placed.filter((F.col("below") <= F.ceil("at")) & (F.floor("at") < F.col("below") + F.col("m"))).select("k", "part", "below")
    counted = parted.join(F.broadcast(chosen), ["k", "part"]).groupBy("k", "part", "below", "at", "v").agg(F.count("*").alias("c"))
    upto = F.col("below") + F.sum("c").over(W.partitionBy("k", "part").orderBy("v"))
    ranked = counted.withColumn("upto", upto)
    value_at = lambda rank: F.min(F.when(rank < F.col("upto"), F.col("v")))
    found = ranked.groupBy("k", "at").agg(value_at(F.floor("at")).alias("a"), value_at(F.ceil("at")).alias("b"))
    share = F.col("at") - F.floor("at")
    each = found.select("k", ((1 - share) * F.col("a") + share * F.col("b")).alias("p"))
    one = each.agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("e")).select(F.transform("e", lambda e: e["p"]).alias("p"))
    return sketch.select("n").crossJoin(F.broadcast(one))  # one row each


def thresholds(df: DataFrame, value: Column, shares: Sequence[float] = (0.33, 0.67), fallback: Sequence[float] = (0.6, 0.8), least: int = 10) -> DataFrame:
    """One row (t_low, t_high): exact percentiles of the known values, or the fallback for fewer than ``least``.

    A degenerate pair is spread by a millionth.
    """
    p = percentiles(df.select(known(value).alias("v")).filter("v IS NOT NULL"), shares)
    low = F.when(F.col("n") < least, F.lit(float(fallback[0]))).otherwise(F.col("p")[0])
    high = F.when(F.col("n") < least, F.lit(float(fallback[1]))).otherwise(F.col("p")[1])
    both = p.select(low.alias("t_low"), high.alias("t_high"))
    spread = F.col("t_low") + F.greatest(F.lit(1e-6), F.abs(F.col("t_low")) * 1e-6)
    return both.select("t_low", F.when(F.col("t_high") <= F.col("t_low"), spread).otherwise(F.col("t_high")).alias("t_high"))


def tier_from_margin(margin: Column, proficient: Column | float, novice: Column | float) -> Column:
    """Large margins are easy and go to novices."""
    v = known(margin)
    return F.when(v.isNull(), "unk").when(v >= novice, "novice").when(v >= proficient, "proficient").otherwise("advanced")


def tier_by_position(i: Column, total: Column | None = None) -> Column:
    """By position from 0: shares 40/35/25 of a known total, else the first 10 and the next 15."""
    if total is None:
        return F.when(i < 10, "novice").when(i < 25, "proficient").otherwise("advanced")
    return F.when(i < F.floor(total * 0.40), "novice").when(i < F.floor(total * 0.75), "proficient").otherwise("advanced")


def place_category(name: Column) -> Column:
    low = F.lower(name)
    out = F.when(low.isin(list(L.PLACE_SETS["region"])), "region")
    for kind in ("metropolitan_area", "landmark", "island_group"):
        out = out.when(low.isin(list(L.PLACE_SETS[kind])), kind)
    return out.when(low.isin(list(L.KNOWN_CITIES)) | F.endswith(low, F.lit(" city")), "city").otherwise("province")


def schema_error_category(message: Column) -> Column:
    """The coarse reason of a validation message; the first test that holds decides."""
    low = F.lower(message)
    has = lambda t, c=low: F.contains(c, F.lit(t))
    return (
        F.when(has("extra_forbidden") | has("extra inputs are not permitted"), "extra_forbidden_field")
        .when(has("field required"), "missing_required_field")
        .when(has("input should be") | has("value is not a valid"), "wrong_field_type")
        .when(has("candidate"), "invalid_candidate_code")
        .when(has("verdict"), "invalid_verdict")
        .when(has("indicator"), "invalid_indicator")
        .otherwise("other")
    )


def archetype(t: Column, cues: dict[str, Sequence[str]] = L.ARCHETYPES, least: int = 2) -> Column:
    """The archetype with most cues present (the first of equals), null under ``least``."""
    scores = {a: sum((F.regexp_like(text_or_empty(t), F.lit(f"(?iu){p}")).cast("int") for p in ps), F.lit(0)) for a, ps in cues.items()}
    best = F.greatest(*scores.values())
    out = F.when(best < least, F.lit(None).cast("string"))
    for a, n in scores.items():
        out = out.when(n == best, a)
    return out


def fallback_candidate(name: Column, t: Column, codes: Sequence[str]) -> Column:
    """A fixed candidate for a name, or for the head of a text without one."""
    key = F.coalesce(F.nullif(F.trim(name), F.lit("")), preview(t, 80))
    return F.element_at(literals(list(codes)), (stable_index(key, len(codes)) + 1).cast("int"))


def lookup(value: Column, table: dict[str, object], default: object = None) -> Column:
    """A CASE over literal pairs: batch sizes by device, texts by archetype, scores by verdict."""
    out = None
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))
