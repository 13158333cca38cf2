"""Queries over indicators, gates and policies.

The tables' prose is invented, so the default lists hardly ever match; words
and patterns that do occur are passed beside them.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillmesh.functions import indicators as I
from quillmesh.functions import lexicons as L
from quillmesh.functions import numeric as N
from quillmesh.functions import policies as P
from quillmesh.operators import gates as G
from quillmesh.operators import reports as R
from quillmesh.plans.registry import P_FAKE, clean, count, micro, query, sql_list
from quillmesh.plans.text_queries import CAPS_SQL, WORDS, p_fake

EMOTIVE = (*L.EMOTIVE, "the", "and", "les", "que", "der", "die")
URGENT = (*L.URGENT, "of the", "de la", "in the")
EXTRA = {
    "ANON": (r"the\s+of",), "POL": (r"of\s+the",), "CONS": (r"and\s+the", r"in\s+and"), "DISC": (r"que\s+de",), "IMP": (r"der\s+die",),
    "REV": (r"les\s+de",), "ENDO": (r"to\s+the",), "RECF": (r"que\s+el",),
}
PATTERNS = {code: (*L.PATTERNS[code], *more) for code, more in EXTRA.items()}


def portable(pattern: str) -> str:
    """The pattern without look-ahead, which the oracle's engine lacks; no look-ahead decides on these tables."""
    return re.sub(r"\(\?!(?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)", "", pattern)


def options() -> dict:
    return {"emotive_words": EMOTIVE, "urgent_phrases": URGENT, "patterns": PATTERNS}


WORD_LIST = f"regexp_extract_all(lower(coalesce(text, '')), '{WORDS}')"
LOW = "lower(coalesce(text, ''))"
URLS = count(r"(?i)https?://[^\s)\]]+")
NAMED = count(
    r"[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,3}\s+(?:said|told|stated|announced|confirmed|sabi|sinabi|ayon\s+kay|nagsabi)\b"
)
LONG_QUOTES = """len(list_filter(regexp_extract_all(coalesce(text, ''), '["“”]([^"“”]{8,400})["“”]', 1), lambda q: len(regexp_extract_all(q, '[^\\s\\p{Z}]+')) >= 8))"""
EMO_HITS = f"len(list_intersect(list_distinct({WORD_LIST}), {sql_list(sorted(set(EMOTIVE)))}))"
URG_HITS = f"len(list_filter({sql_list(sorted(set(URGENT)))}, lambda p: contains({LOW}, p)))"
CAPS = CAPS_SQL.format("text")


def pattern_total(code: str) -> str:
    return "(" + " + ".join(count(f"(?i){portable(p)}") for p in PATTERNS[code]) + ")"


FIRED_SQL = {
    "EMO": f"({EMO_HITS} >= 2 OR {EMO_HITS} / greatest({count(WORDS)}, 1)::DOUBLE >= 0.025)",
    "URG": f"({URG_HITS} > 0 OR {CAPS} >= 3 OR {count('!')} >= 3)",
    "MISS": f"({URLS} = 0 AND {NAMED} = 0)",
    "FAB": f"({LONG_QUOTES} > 0 AND {URLS} = 0)",
} | {code: f"({pattern_total(code)} > 0)" for code in PATTERNS}
SCORE_SQL = {
    "EMO": f"least({EMO_HITS} / greatest({count(WORDS)}, 1)::DOUBLE * 20, 1.0)",
    "URG": f"least(0.3::DOUBLE * {URG_HITS} + 0.1::DOUBLE * {CAPS} + 0.1::DOUBLE * {count('!')}, 1.0)",
    "MISS": f"({FIRED_SQL['MISS']})::INT::DOUBLE",
    "FAB": f"({FIRED_SQL['FAB']})::INT::DOUBLE",
    "IMP": f"({FIRED_SQL['IMP']})::INT::DOUBLE",
} | {code: f"least({L.WEIGHTS[code][0]}::DOUBLE * {pattern_total(code)}, 1.0)" for code in PATTERNS if code != "IMP"}


def _indicator(code: str) -> None:
    @query(f"q_ind_{code.lower()}", f"SELECT doc_id, {FIRED_SQL[code]} AS fired, {micro(SCORE_SQL[code])} AS score FROM documents")
    def one(t):
        h = I.detectors(F.col("text"), **options())[code]
        return t("documents").select("doc_id", h["fired"].alias("fired"), N.micro(h["score"]).alias("score"))


for _code in L.CODES:
    _indicator(_code)

FIRED_LIST = "list_filter([" + ", ".join(f"CASE WHEN coalesce(text, '') <> '' AND {FIRED_SQL[c]} THEN '{c}' END" for c in L.CODES) + "], lambda x: x IS NOT NULL)"


@query("q_fired_codes", f"SELECT doc_id, array_to_string({FIRED_LIST}, ',') AS codes FROM documents")
def fired(t):
    return t("documents").select("doc_id", F.array_join(I.fired_codes(F.col("text"), **options()), ",").alias("codes"))


@query("q_indicator_coverage", f"SELECT code, count(*) AS n FROM (SELECT unnest({FIRED_LIST}) AS code FROM documents) GROUP BY code")
def coverage(t):
    return R.exploded_counts(t("documents").select(I.fired_codes(F.col("text"), **options()).alias("codes")), "codes", "code")


@query(
    "q_indicator_map",
    f"SELECT doc_id, 12 AS n, {FIRED_SQL['EMO']} AS emo, {micro(SCORE_SQL['POL'])} AS pol_score FROM documents".replace("12 AS n", "12::BIGINT AS n"),
)
def indicator_map(t):
    m = I.indicator_map(F.col("text"), **options())
    return t("documents").withColumn("m", m).select("doc_id", F.size("m").alias("n"), F.col("m")["EMO"]["fired"].alias("emo"), N.micro(F.col("m")["POL"]["score"]).alias("pol_score"))


POSITIVE = (*L.ON_THEME, "the", "les", "los", "und")
NEGATIVE = (*L.OFF_THEME, "being", "que", "ung", "ción")


def _kw(words) -> str:
    return f"len(list_filter({sql_list(sorted({w.lower() for w in words}))}, lambda w: contains({LOW}, w)))"


KEYWORDS = f"SELECT *, {_kw(POSITIVE)} AS pos, {_kw(NEGATIVE)} AS neg FROM documents"
SCORED = f"SELECT *, CASE WHEN {LOW} = '' THEN 0.0 ELSE 1 / (1 + pow(2.71828::DOUBLE, -0.7::DOUBLE * ((pos - neg)::DOUBLE - CASE WHEN neg >= pos AND neg >= 2 THEN 1.5 ELSE 0 END))) END AS score FROM ({KEYWORDS})"


@query("q_keyword_score", f"SELECT doc_id, pos, neg, {micro('score')} AS score FROM ({SCORED})")
def keyword_score(t):
    k = G.keyword_score(F.col("text"), POSITIVE, NEGATIVE)
    return t("documents").withColumn("k", k).select("doc_id", "k.pos", "k.neg", N.micro(F.col("k.score")).alias("score"))


LAST = f"""rtrim(lower(string_split({clean()}, ' ')[-1]), '.,;:!?"”')"""
CUT = f"CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN length(trim(text)) < 30 THEN 'too_short' WHEN list_contains({sql_list(L.DANGLERS)}, {LAST}) THEN 'dangling_function_word' ELSE 'ok' END"


@query("q_truncation_reason", f"SELECT doc_id, {CUT} <> 'ok' AS is_truncated, {CUT} AS reason FROM documents")
def truncation(t):
    return t("documents").withColumn("c", G.truncation(F.col("text"))).select("doc_id", "c.is_truncated", "c.reason")


HEAD = "regexp_extract(trim(coalesce(text, '')), '(?s)^(.*[.!?])', 1)"
STATUS = f"CASE WHEN regexp_matches(trim(coalesce(text, '')), '[.!?]$') THEN 'ok' WHEN length({HEAD}) >= 80 THEN 'trimmed' ELSE 'unrecoverable' END"
RECOVERED = f"CASE {STATUS} WHEN 'ok' THEN trim(text) WHEN 'trimmed' THEN {HEAD} END"


@query("q_recover_truncated", f"SELECT conv_id, turn, {STATUS} AS status, {RECOVERED} AS recovered FROM conversations")
def recover(t):
    return t("conversations").withColumn("r", G.recover(F.col("text"))).select("conv_id", "turn", "r.status", F.col("r.text").alias("recovered"))


QUALITY = f"""CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_text' WHEN {STATUS} = 'unrecoverable' THEN 'unrecoverable_truncation'
  WHEN length({RECOVERED}) < 80 THEN 'too_short' WHEN length({RECOVERED}) > 1200 THEN 'too_long' END"""


@query("q_quality_filter", f"SELECT conv_id, turn, {QUALITY} AS reason FROM conversations")
def quality(t):
    return t("conversations").select("conv_id", "turn", G.quality(F.col("text")).alias("reason"))


NAMED_TEXT = "(SELECT doc_id, source, 'Candidate ' || ['A', 'DTQ', 'ZZ', 'B'][(doc_id % 4 + 1)::INT] || ' met Person ' || chr(65 + (doc_id % 5)::INT) || '. ' || coalesce(text, '') AS text FROM documents)"


def named_text(t):
    docs = t("documents")
    code = F.element_at(F.array(*map(F.lit, ("A", "DTQ", "ZZ", "B"))), (F.col("doc_id") % 4 + 1).cast("int"))
    person = F.char(F.lit(65) + (F.col("doc_id") % 5).cast("int"))
    return docs.select("doc_id", "source", F.concat(F.lit("Candidate "), code, F.lit(" met Person "), person, F.lit(". "), F.coalesce("text", F.lit(""))).alias("text"))


OFFENDERS = f"list_sort(list_filter(list_distinct(regexp_extract_all(text, '\\b(?:Candidate|Entity|Person)\\s+[A-Z]{{1,3}}\\b')), lambda x: NOT list_contains({sql_list(L.CANONICAL_NAMES)}, x)))"


@query("q_placeholder_offenders", f"SELECT doc_id, array_to_string({OFFENDERS}, ', ') AS offenders FROM {NAMED_TEXT}")
def offenders(t):
    return named_text(t).select("doc_id", F.array_join(G.placeholders(F.col("text")), ", ").alias("offenders"))


REGISTRY = (("C-A", ("Candidate A", "zzz")), ("C-B", ("Candidate B",)), ("C-C", ("ZZ",)))
MENTION = "CASE WHEN contains(lower(text), 'candidate a') OR contains(lower(text), 'zzz') THEN 'C-A' WHEN contains(lower(text), 'candidate b') THEN 'C-B' WHEN contains(lower(text), 'zz') THEN 'C-C' END"


@query("q_entity_mention", f"SELECT doc_id, {MENTION} AS code FROM {NAMED_TEXT}")
def mention(t):
    return named_text(t).select("doc_id", G.entity_mention(F.col("text"), REGISTRY).alias("code"))


def gated(t):
    return G.run_gates(named_text(t), "text", REGISTRY, positive=POSITIVE, negative=NEGATIVE)


DEFAULT_FIRED = "(" + " OR ".join(
    [f"(len(list_intersect(list_distinct({WORD_LIST}), {sql_list(sorted(set(L.EMOTIVE)))})) >= 2)", f"{CAPS} >= 3 OR {count('!')} >= 3", f"({URLS} = 0 AND {NAMED} = 0)", FIRED_SQL["FAB"]]
) + ")"


def gated_sql(source: str, mention: bool = True) -> str:
    missing = "CASE WHEN electoral AND mention IS NULL THEN 'no_candidate_mention' END" if mention else "NULL"
    return f"""
  SELECT *, list_filter([CASE WHEN NOT electoral AND NOT neutral THEN 'theme' END, CASE WHEN electoral AND cut <> 'ok' THEN 'truncation: ' || cut END,
    CASE WHEN len(offenders) > 0 THEN 'legacy_pseudonyms: ' || array_to_string(offenders, ', ') END, {missing}], lambda x: x IS NOT NULL) AS reasons
  FROM (SELECT *, score >= 0.55 AS electoral, score < 0.55 AND neg <= 1 AND pos = 0 AND NOT {DEFAULT_FIRED} AS neutral, {CUT} AS cut, {OFFENDERS} AS offenders, {MENTION} AS mention
    FROM ({SCORED.replace('FROM documents', 'FROM ' + source)}))"""


STAGE_SQL = "CASE WHEN reason LIKE 'theme%' THEN 'theme' WHEN reason LIKE 'trunc%' THEN 'truncation' WHEN reason LIKE 'legacy%' THEN 'pseudonym' ELSE 'candidate' END"
GATED = gated_sql(NAMED_TEXT)


@query("q_run_all_gates", f"SELECT doc_id, len(reasons) = 0 AS accepted, array_to_string(reasons, ';') AS reasons, electoral, neutral FROM ({GATED})")
def run_all(t):
    return gated(t).select("doc_id", "accepted", F.array_join("reasons", ";").alias("reasons"), F.col("is_electoral").alias("electoral"), F.col("is_neutral_volume").alias("neutral"))


@query(
    "q_theme_reject_log",
    f"""SELECT doc_id, reason, CASE WHEN reason LIKE 'theme%' THEN 'theme' WHEN reason LIKE 'trunc%' THEN 'truncation' WHEN reason LIKE 'legacy%' THEN 'pseudonym' ELSE 'candidate' END AS stage,
      substr(text, 1, 120) AS text_preview FROM (SELECT doc_id, text, unnest(reasons) AS reason FROM ({GATED}))""",
)
def reject_log(t):
    return G.reject_log(gated(t), "doc_id", "text").select("doc_id", "reason", "stage", "text_preview")


CODES_SQL = "regexp_extract_all(text, '\\bCandidate\\s+([A-Z]{1,3})\\b', 1)"


@query(
    "q_remap_codes",
    f"""SELECT doc_id, CASE WHEN len(list_distinct({CODES_SQL})) <= 3 THEN [{CODES_SQL}[1] || '>A'] END[1] AS remap FROM {NAMED_TEXT}""".replace("END[1]", "END").replace("[" + CODES_SQL + "[1] || '>A']", CODES_SQL + "[1] || '>A'"),
)
def remap(t):
    m = G.remap_codes(F.col("text"))
    joined = F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(">"), e["value"])), ",")
    return named_text(t).select("doc_id", joined.alias("remap"))


def _verdict_sql(high: float, low: float) -> str:
    return f"CASE WHEN {P_FAKE} >= {high}::DOUBLE THEN 'FAKE' WHEN {P_FAKE} <= {low}::DOUBLE THEN 'REAL' ELSE 'UNCERTAIN' END"


@query("q_verdicts", "SELECT doc_id, " + ", ".join(f"{_verdict_sql(*v)} AS {k}" for k, v in P.VERDICTS.items()) + f", ({P_FAKE} >= 0.5)::BIGINT AS binary_pred FROM documents")
def verdicts(t):
    return t("documents").select("doc_id", *[P.verdict(p_fake(), k).alias(k) for k in P.VERDICTS], P.binary(p_fake()).alias("binary_pred"))


@query(
    "q_difficulty",
    "SELECT doc_id, " + ", ".join(f"CASE WHEN abs({P_FAKE} - 0.5) >= {a}::DOUBLE THEN 'easy' WHEN abs({P_FAKE} - 0.5) >= {b}::DOUBLE THEN 'medium' ELSE 'hard' END AS {k}" for k, (a, b) in P.DIFFICULTIES.items()) + " FROM documents",
)
def difficulty(t):
    return t("documents").select("doc_id", *[P.difficulty(N.margin(p_fake()), k).alias(k) for k in P.DIFFICULTIES])


@query(
    "q_alignment_guard",
    f"""SELECT doc_id, CASE WHEN v = 'REAL' AND n >= 3 THEN 'UNCERTAIN' ELSE v END AS verdict, {micro("CASE WHEN v = 'REAL' AND n >= 3 THEN greatest(100 * p, 41) ELSE 100 * p END")} AS pct,
      v = 'FAKE' AND n = 0 AS fake_no_indicators, v = 'REAL' AND n >= 3 AS demoted FROM (SELECT doc_id, {P_FAKE} AS p, {_verdict_sql(0.6, 0.4)} AS v, doc_id % 5 AS n FROM documents)""",
)
def align(t):
    codes = F.slice(F.array(*map(F.lit, L.CODES)), F.lit(1), (F.col("doc_id") % 5).cast("int"))
    a = P.align(P.verdict(p_fake()), 100 * p_fake(), codes)
    return t("documents").withColumn("a", a).select("doc_id", "a.verdict", N.micro(F.col("a.fake_percent")).alias("pct"), "a.fake_no_indicators", F.col("a.demoted_real_to_uncertain").alias("demoted"))


def _bin(v: str, low: str, high: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN 'unk' WHEN {v} >= {high} THEN 'high' WHEN {v} >= {low} THEN 'mid' ELSE 'low' END"


@query(
    "q_percentile_bins",
    f"""WITH c AS (SELECT quantile_cont(l_extendedprice::DOUBLE, 0.33) AS lo, quantile_cont(l_extendedprice::DOUBLE, 0.67) AS hi FROM lineitem)
      SELECT {_bin('l_extendedprice::DOUBLE', 'lo', 'hi')} AS bin, count(*) AS n FROM lineitem, c GROUP BY 1""",
)
def percentile_bins(t):
    rows = t("lineitem")
    cuts = P.thresholds(rows, F.col("l_extendedprice"))
    binned = rows.crossJoin(F.broadcast(cuts)).select(P.bin3(F.col("l_extendedprice"), F.col("t_low"), F.col("t_high")).alias("bin"))  # one row
    return binned.groupBy("bin").agg(F.count("*").alias("n"))


@query(
    "q_tier_from_margin",
    f"""WITH m AS (SELECT doc_id, abs({P_FAKE} - 0.5) AS m FROM documents), c AS (SELECT quantile_cont(m, 0.33) AS a, quantile_cont(m, 0.67) AS b FROM m)
      SELECT doc_id, CASE WHEN m >= b THEN 'novice' WHEN m >= a THEN 'proficient' ELSE 'advanced' END AS tier FROM m, c""",
)
def tier_margin(t):
    rows = t("documents").select("doc_id", N.margin(p_fake()).alias("m"))
    cuts = P.thresholds(rows, F.col("m"), fallback=(0.10, 0.30))
    return rows.crossJoin(F.broadcast(cuts)).select("doc_id", P.tier_from_margin(F.col("m"), F.col("t_low"), F.col("t_high")).alias("tier"))  # one row


@query(
    "q_dominant_bin",
    """WITH x AS (SELECT unnest([{'axis': 'flag', 'value': l_returnflag}, {'axis': 'status', 'value': l_linestatus}]) AS e FROM lineitem),
      c AS (SELECT e.axis AS axis, e.value AS value, count(*) AS n FROM x GROUP BY 1, 2)
      SELECT axis, value, n, round(n / (SELECT sum(n) FROM c d WHERE d.axis = c.axis) * 1000000)::BIGINT AS share_micro FROM c QUALIFY row_number() OVER (PARTITION BY axis ORDER BY n DESC, value) = 1""",
)
def dominant(t):
    return R.dominant_bin(t("lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")), ["flag", "status"])


#: Every place that a set names, in capitals.
ALL_PLACES = tuple(p.upper() for ps in (*L.PLACE_SETS.values(), L.KNOWN_CITIES) for p in ps)


@query(
    "q_place_category",
    f"""SELECT place, CASE WHEN list_contains({sql_list(L.PLACE_SETS['region'])}, lower(place)) THEN 'region' WHEN list_contains({sql_list(L.PLACE_SETS['metropolitan_area'])}, lower(place)) THEN 'metropolitan_area'
      WHEN list_contains({sql_list(L.PLACE_SETS['landmark'])}, lower(place)) THEN 'landmark' WHEN list_contains({sql_list(L.PLACE_SETS['island_group'])}, lower(place)) THEN 'island_group'
      WHEN list_contains({sql_list(L.KNOWN_CITIES)}, lower(place)) OR lower(place) LIKE '% city' THEN 'city' ELSE 'province' END AS category
      FROM (SELECT n_name || [' City', '', ' Province'][n_nationkey % 3 + 1] AS place FROM nation UNION ALL SELECT r_name || ' city' FROM region UNION ALL SELECT unnest({sql_list(ALL_PLACES)}))""",
)
def places(t):
    own = t("nation").select(F.concat("n_name", F.element_at(F.array(F.lit(" City"), F.lit(""), F.lit(" Province")), F.col("n_nationkey").cast("int") % 3 + 1)).alias("place"))
    regions = t("region").select(F.concat("r_name", F.lit(" city")).alias("place"))
    known = own.sparkSession.createDataFrame([(p,) for p in ALL_PLACES], "place string")
    return own.unionByName(regions).unionByName(known).select("place", P.place_category(F.col("place")).alias("category"))


CUES = {"A": ("the", "ing"), "B": ("les", "eau", "que"), "C": ("ung", "der")}


@query(
    "q_archetype",
    "SELECT doc_id, CASE WHEN greatest(a, b, c) < 2 THEN NULL WHEN a = greatest(a, b, c) THEN 'A' WHEN b = greatest(a, b, c) THEN 'B' ELSE 'C' END AS archetype FROM (SELECT doc_id, "
    + ", ".join("(" + " + ".join(f"regexp_matches(coalesce(text, ''), '(?i){p}')::INT" for p in ps) + f") AS {a.lower()}" for a, ps in CUES.items())
    + " FROM documents)",
)
def archetype(t):
    return t("documents").select("doc_id", P.archetype(F.col("text"), CUES).alias("archetype"))


@query(
    "q_fallback_candidate",
    """SELECT doc_id, ['C-A', 'C-B', 'C-C'][(('0x' || substr(sha256(CASE WHEN doc_id % 2 = 0 THEN 'name' || doc_id % 7 ELSE substr(coalesce(text, ''), 1, 80) END), 1, 8))::BIGINT % 3 + 1)::INT] AS candidate FROM documents""",
)
def fallback(t):
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("name"), (F.col("doc_id") % 7).cast("string")))
    return t("documents").select("doc_id", P.fallback_candidate(name, F.col("text"), ("C-A", "C-B", "C-C")).alias("candidate"))


@query(
    "q_invalid_reasons",
    """SELECT CASE event_type_k WHEN 0 THEN 'extra_forbidden_field' WHEN 1 THEN 'missing_required_field' WHEN 2 THEN 'wrong_field_type' WHEN 3 THEN 'invalid_candidate_code' WHEN 4 THEN 'invalid_verdict' WHEN 5 THEN 'invalid_indicator' ELSE 'other' END AS reason,
      count(*) AS n FROM (SELECT event_id % 7 AS event_type_k FROM events) GROUP BY 1""",
)
def invalid_reasons(t):
    messages = ("Extra inputs are not permitted", "Field required", "Input should be a string", "bad Candidate", "unknown Verdict", "Indicator?", "?")
    message = F.element_at(F.array(*map(F.lit, messages)), (F.col("event_id") % 7 + 1).cast("int"))
    return t("events").select(P.schema_error_category(message).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
