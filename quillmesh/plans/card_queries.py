"""Queries over scored records, cards, profiles and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import numeric as N
from quillmesh.operators import cards as C
from quillmesh.plans.gate_queries import CUT
from quillmesh.plans.rank_queries import cards
from quillmesh.plans.registry import CANDIDATE, P_FAKE, micro, query
from quillmesh.plans.text_queries import candidate, p_fake

A, B = P_FAKE, "(doc_id % 10) / 10.0::DOUBLE"
MEAN = f"CASE WHEN doc_id % 5 = 0 THEN {A} ELSE ({A} + {B}) / 2 END"


@query("q_score_records", f"SELECT doc_id, {micro(MEAN)} AS p, ({MEAN} >= 0.5)::BIGINT AS pred, {CUT} AS cut FROM documents")
def score_records(t):
    rows = t("documents").select("doc_id", "text", p_fake().alias("a"), F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 10) / F.lit(10.0)).alias("b"))
    s = C.score_records(rows, "text", ["a", "b"])
    return s.select("doc_id", N.micro(F.col("p_ensemble")).alias("p"), "pred", F.col("truncation_flag.reason").alias("cut"))


@query("q_score_equation", f"SELECT doc_id, {micro('1 / (1 + exp(-least(greatest(2 * ' + P_FAKE + ' - 1, -60), 60)))')} AS score FROM documents")
def score_equation(t):
    rows = t("documents").select("doc_id", "text", p_fake().alias("p_roberta_fake"))
    s = C.score_records(rows, "text", ["p_roberta_fake"], "logreg(2*probertafake - 1)")
    return s.select("doc_id", N.micro(F.col("score")).alias("score"))


@query(
    "q_build_cards",
    f"""SELECT 'card_' || doc_id AS id, {CANDIDATE} AS candidate, CASE WHEN abs({P_FAKE} - 0.5) >= 0.35::DOUBLE THEN 'easy' WHEN abs({P_FAKE} - 0.5) >= 0.15::DOUBLE THEN 'medium' ELSE 'hard' END AS difficulty_bin FROM documents""",
)
def build_cards(t):
    made = C.build_cards(t("documents"), "doc_id", "text", p_fake(), candidate())
    return made.select("id", "candidate", "difficulty_bin")


@query(
    "q_record_cards",
    f"""SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'EMO' ELSE 'MISS' END AS codes, CASE WHEN {P_FAKE} >= 0.65::DOUBLE THEN 'FAKE' WHEN {P_FAKE} <= 0.35::DOUBLE THEN 'REAL' ELSE 'UNCERTAIN' END AS verdict FROM documents""",
)
def record_cards(t):
    rows = t("documents").select("doc_id", F.create_map(F.lit("ind_emo_fired"), (F.col("doc_id") % 2).cast("double")).alias("f"), p_fake().alias("p"))
    return C.from_features(rows, "doc_id", "f", "p").select("doc_id", F.array_join("fired_indicators", ",").alias("codes"), "verdict")


@query(
    "q_profiles",
    f"""WITH g AS (SELECT candidate, count(*) AS total, count(*) FILTER (doc_id % 4 = 0) AS fired FROM (SELECT doc_id, {CANDIDATE} AS candidate FROM documents) GROUP BY 1)
      SELECT candidate, 'EMO' AS code, fired, total, {micro('fired / total')} AS rate_micro, CASE candidate WHEN 'C-A' THEN 10 END::BIGINT AS prior FROM g""",
)
def profiles(t):
    rows = cards(t).select("candidate", F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("EMO"))).otherwise(F.array().cast("array<string>")).alias("codes"))
    prior = rows.sparkSession.createDataFrame([("C-A", "EMO", 10)], "candidate string, code string, prior bigint")
    return C.profiles(rows, "candidate", "codes", prior, ["EMO"])


@query(
    "q_holdout_metrics",
    f"""WITH d AS (SELECT quality AS y, unnest([{{'detector': 'a', 'p': {A}}}, {{'detector': 'b', 'p': {B}}}, {{'detector': 'ensemble', 'p': ({A} + {B}) / 2}}], recursive := true) FROM labels)
      SELECT detector, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 1 AND p < 0.5) AS fn FROM d GROUP BY 1""",
)
def holdout(t):
    rows = t("labels").select("quality", p_fake().alias("a"), ((F.col("doc_id") % 10) / F.lit(10.0)).alias("b"))
    return C.evaluate_holdout(rows, "quality", ["a", "b"]).select("detector", "tp", "fp", "tn", "fn")


@query("q_dashboard", "SELECT axis AS metric, n::DOUBLE AS value, 100.0::DOUBLE AS target, n >= 100 AS passed FROM (SELECT lang AS axis, count(*) AS n FROM documents GROUP BY 1)")
def dashboard(t):
    values = t("documents").groupBy(F.col("lang").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return C.dashboard(values, {k: (">=", 100.0) for k in ("en", "fr", "de", "es")})


@query("q_term_sets", "SELECT DISTINCT unnest(string_split(lower(n_name || ' ' || r_name), ' ')) AS term FROM nation JOIN region ON n_regionkey = r_regionkey")
def term_sets(t):
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("display_name"), F.array("r_name").alias("aliases"))
    return C.term_sets(rows)
