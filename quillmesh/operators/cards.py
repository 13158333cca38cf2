"""Scored records and cards: feature scoring, card construction, profiles, hold-out evaluation and the dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import lexicons as L
from quillmesh.functions import numeric as N
from quillmesh.functions import policies as P
from quillmesh.functions.arrays import by_priority, fired_from_map, literals, top_by_size
from quillmesh.functions.equation import compile_equation
from quillmesh.functions.indicators import fired_codes, named_features
from quillmesh.operators.gates import truncation
from quillmesh.operators.reports import binary_metrics, empirical_rates


def score_records(df: DataFrame, text: str, detectors: Sequence[str], equation: str | None = None, threshold: float = 0.5) -> DataFrame:
    """``df`` with named_features, p_ensemble (mean of the known detectors, 0.5 without any), the equation's score and truncation.

    ``equation`` may refer to any column of ``df`` and to p_ensemble.
    """
    scored = df.withColumn("named_features", named_features(F.col(text))).withColumn("p_ensemble", N.mean_known(*map(F.col, detectors), default=0.5))
    own = compile_equation(equation, scored.columns) if equation else F.lit(None).cast("double")
    scored = scored.withColumn("score", F.coalesce(own, F.col("p_ensemble"))).withColumn("pred", P.binary(F.col("score"), threshold))
    return scored.withColumn("top_factors", top_by_size(F.col("named_features"))).withColumn("truncation_flag", truncation(F.col(text)))


def build_cards(df: DataFrame, key: str, text: str, score: Column, candidate: Column, policy: str = "explain") -> DataFrame:
    """Cards of scored texts: verdict, percentages, difficulty and fired codes after the alignment guard."""
    coded = df.withColumn("__fired", fired_codes(F.col(text))).withColumn("__p", N.clip(score, 0.0, 1.0))
    aligned = coded.withColumn("__a", P.align(P.verdict(F.col("__p"), policy), 100 * F.col("__p"), F.col("__fired")))
    return aligned.select(
        F.concat(F.lit("card_"), F.col(key).cast("string")).alias("id"), candidate.alias("candidate"), F.col(text).alias("text"), F.col("__a.verdict").alias("verdict"),
        F.col("__a.fake_percent").alias("fake_likelihood_percent"), (100 - F.col("__a.fake_percent")).alias("credibility_percent"),
        P.difficulty(N.margin(F.col("__p")), policy).alias("difficulty_bin"), F.col("__fired").alias("fired_indicators"),
        by_priority(F.col("__fired"), L.PRIORITY).alias("shown_indicators"),
        F.struct(F.col("__a.fake_no_indicators").alias("fake_no_indicators"), F.col("__a.demoted_real_to_uncertain").alias("demoted")).alias("flags"),
    )


def stamp(df: DataFrame, provenance: str, script: str) -> DataFrame:
    """``df`` with a script added to the chain of its provenance struct, and the time of it."""
    p = F.col(provenance)
    chain = F.array_append(F.coalesce(p["script_chain"], literals([])), F.lit(script))
    return df.withColumn(provenance, p.withField("script_chain", chain).withField("generated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")))


def from_features(df: DataFrame, key: str, features: str, score: str) -> DataFrame:
    """Cards of records that carry a flat feature map: their codes, verdict and difficulty by the merge policy."""
    p = F.col(score)
    return df.select(key, fired_from_map(F.col(features)).alias("fired_indicators"), P.verdict(p, "merge").alias("verdict"), P.difficulty(N.margin(p), "merge").alias("difficulty_bin"))


def profiles(cards: DataFrame, candidate: str, fired: str, prior: DataFrame, codes: Sequence[str] = L.CODES) -> DataFrame:
    """(candidate, code, rate, prior): empirical rates of the codes beside the registry's prior(candidate, code, prior)."""
    rates = empirical_rates(cards, candidate, fired, codes)
    return rates.join(prior, [candidate, "code"], "left").select(candidate, "code", "fired", "total", "rate_micro", "prior")


def evaluate_holdout(df: DataFrame, label: str, detectors: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Metrics of each detector and of their ensemble over rows with a known label."""
    ensemble = df.withColumn("ensemble", N.mean_known(*map(F.col, detectors)))
    each = ensemble.unpivot([label], [*detectors, "ensemble"], "detector", "p")
    return binary_metrics(each, F.col(label), P.binary(F.col("p"), threshold), ["detector"])


def dashboard(values: DataFrame, targets: dict[str, tuple[str, float]]) -> DataFrame:
    """(metric, value, target, passed) of values(metric, value); targets hold a comparison (>=, <=) and a number."""
    out, test = F.lit(None).cast("double"), F.lit(None).cast("boolean")
    for name, (op, bound) in targets.items():
        here = F.col("metric") == name
        out = F.when(here, F.lit(float(bound))).otherwise(out)
        test = F.when(here, F.col("value") >= bound if op == ">=" else F.col("value") <= bound).otherwise(test)
    return values.withColumn("target", out).withColumn("passed", test)


def assert_registry(registry: DataFrame, code: str = "code", archetype: str = "archetype", names: Sequence[str] = ("display_name",), n: int = 3) -> DataFrame:
    """(check, ok): the registry's invariants, one row each."""
    named = F.lit(True)
    for c in names:
        named = named & F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
    one = registry.agg(
        (F.count_distinct(code) == n).alias("unique_codes"), (F.count_distinct(archetype) == n).alias("archetypes"), F.coalesce(F.bool_and(named), F.lit(False)).alias("names"),
        F.coalesce(F.bool_and(F.col(code).rlike(r"^(?:NONE|C-[A-Z0-9\-]{1,8})$")), F.lit(False)).alias("code_format"),
    )
    return one.unpivot([], ["unique_codes", "archetypes", "names", "code_format"], "check", "ok")


def term_sets(registry: DataFrame, name: str = "display_name", aliases: str = "aliases") -> DataFrame:
    """(term): all words of names and aliases, lower-cased and distinct."""
    words = F.split(F.lower(F.concat_ws(" ", F.col(name), F.array_join(F.coalesce(aliases, literals([])), " "))), r"\s+")
    return registry.select(F.explode(words).alias("term")).filter("term <> ''").distinct()
