"""Composite plans: the conditioned corpus and the card tail, as one lazy plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import numeric as N
from quillmesh.functions import policies as P
from quillmesh.functions import text as X
from quillmesh.functions.equation import compile_equation
from quillmesh.functions.indicators import fired_codes


def conditioned_corpus(docs: DataFrame, labels: DataFrame, key: str, text: str, score: str, equation: str | None = None) -> DataFrame:
    """(key, line): texts behind control tokens for label, confidence bin and difficulty tier.

    ``docs``(key, text, score, features) joins ``labels``(key, label); the score, or
    an equation over the features, gives the confidence in the label. Bins are
    percentiles of the rows at hand.
    """
    joined = docs.join(labels, key)
    p = F.col(score) if equation is None else N.mean_known(F.col(score), compile_equation(equation, docs.columns))
    scored = joined.withColumn("__p", p).withColumn("__conf", N.confidence(F.col("__p"), F.col("label"))).withColumn("__m", N.margin(F.col("__p")))
    bins = P.thresholds(scored, F.col("__conf"))
    tiers = P.thresholds(scored, F.col("__m"), fallback=(0.10, 0.30)).select(F.col("t_low").alias("__prof"), F.col("t_high").alias("__nov"))
    cut = scored.crossJoin(F.broadcast(bins)).crossJoin(F.broadcast(tiers))  # one row each
    tokens = [
        X.control_token("label", F.when(F.col("label") == 1, "fake").otherwise("real")),
        X.control_token("ensem", P.bin3(F.col("__conf"), F.col("t_low"), F.col("t_high"))),
        X.control_token("tier", P.tier_from_margin(F.col("__m"), F.col("__prof"), F.col("__nov"))),
    ]
    return cut.select(key, X.conditioned_line(tokens, F.col(text)).alias("line"))


def flagship(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Clean, de-duplicate, derive indicators, decide a verdict, count by language."""
    from quillmesh.operators.ranking import keep_first

    cleaned = docs.select("doc_id", "lang", X.clean_text(F.col("text")).alias("text")).filter(F.length("text") > 10)
    first = keep_first(cleaned, ["text"], [F.col("doc_id")])
    fired = first.withColumn("fired", fired_codes(F.col("text")))
    joined = fired.join(labels.select("doc_id", "quality"), "doc_id", "left")
    p = N.mean_known(F.size("fired") / F.lit(4.0), F.col("quality").cast("double"), default=0.5)
    return joined.withColumn("verdict", P.verdict(p)).groupBy("lang", "verdict").agg(F.count("*").alias("n"), F.sum(F.size("fired")).alias("fired"))
