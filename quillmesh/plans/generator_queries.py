"""Queries over generated cards and renamed ones."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quillmesh.operators import generator as GN
from quillmesh.operators import renaming as RN
from quillmesh.plans.registry import query, sql_list

VARIANTS = (
    "{prefix}: {candidate_full} sa {place} {date}, ayon sa {generic_official} at {generic_critic} .", "{candidate_short} ({candidate_first}): {amount} o {percentage} noong {decade} sa {platform}",
    "{audience} at {witness}, {generic_supporter} {generic_witness} {generic_journalist} {generic_expert} {generic_celebrity} {generic_ngo}!",
)


def index_sql(text: str, n: int) -> str:
    return f"(('0x' || substr(sha256({text}), 1, 8))::BIGINT % {n})::INT + 1"


def filled_sql() -> str:
    out = "variant"
    own = {"candidate_full": "full_", "candidate_short": "short_", "candidate_first": "string_split(full_, ' ')[2]"}
    for slot, value in (own | {s: f"{sql_list(vs)}[{index_sql(f'''1729 || '|' || row_ || '|{s}' ''', len(vs))}]" for s, vs in GN.SLOTS.items()}).items():
        out = f"replace({out}, '{{{slot}}}', {value})"
    return rf"regexp_replace(trim(regexp_replace({out}, '[\s\p{{Z}}]+', ' ', 'g')), ' +([.,;:!?])', '\1', 'g')"


CROSS = f"""SELECT t.r_regionkey || '' AS tid, n_name AS c, k, ['FAKE', 'REAL', 'UNCERTAIN'][(t.r_regionkey % 3 + 1)::INT] AS verdict, ['novice', 'proficient', 'advanced'][(t.r_regionkey % 3 + 1)::INT] AS tier,
    'Sen. ' || n_name || ' Cruz' AS full_, n_name AS short_, t.r_regionkey || '|' || n_name || '|' || k AS row_ FROM region t JOIN nation ON n_regionkey = t.r_regionkey, (SELECT unnest(range(0, 6)) AS k)"""
FILLED = f"SELECT *, {filled_sql()} AS text FROM (SELECT *, {sql_list(VARIANTS)}[{index_sql('row_', len(VARIANTS))}] AS variant FROM ({CROSS}))"


@query(
    "q_template_cards",
    f"""SELECT 'tpl_' || tid || '_' || c || '_' || lpad(k || '', 5, '0') AS id, text, c AS candidate, CASE WHEN verdict = 'FAKE' THEN 'fake' ELSE 'real' END AS target_label,
      CASE verdict WHEN 'FAKE' THEN 78.0 WHEN 'REAL' THEN 12.0 ELSE 50.0 END::DOUBLE AS fake, CASE verdict WHEN 'FAKE' THEN 0.74 WHEN 'REAL' THEN 0.15 ELSE 0.48 END::DOUBLE AS p_distil,
      CASE tier WHEN 'novice' THEN 'easy' WHEN 'proficient' THEN 'medium' ELSE 'hard' END AS difficulty, true AS named, verdict = 'REAL' AS credible FROM ({FILLED})""",
)
def template_cards(t):
    turn = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("r_regionkey") % 3 + 1).cast("int"))
    templates = t("region").select(
        F.col("r_regionkey").cast("string").alias("template_id"), turn("FAKE", "REAL", "UNCERTAIN").alias("verdict"), F.array(F.col("r_regionkey").cast("string")).alias("archetypes"),
        F.array(F.lit("REV")).alias("fired_indicators"), turn("novice", "proficient", "advanced").alias("tier"), F.array(*map(F.lit, VARIANTS)).alias("variants"),
    )
    people = t("nation").select(F.col("n_regionkey").cast("string").alias("archetype"), F.col("n_name").alias("candidate"), F.concat(F.lit("Sen. "), "n_name", F.lit(" Cruz")).alias("full"), F.col("n_name").alias("short"))
    cards = GN.generate_cards(templates, people, 6)
    phrases = F.col("explanation.indicator_phrases")
    return cards.select(
        "id", "text", "candidate", "target_label", F.col("fake_likelihood_percent").alias("fake"), F.col("detectors.p_distil_fake").alias("p_distil"), F.col("difficulty_bin").alias("difficulty"),
        F.array_contains("fired_indicators", F.lit("REV")).alias("named"), F.exists(phrases, lambda p: p["indicator"] == "CREDIBLE").alias("credible"),
    )


REGISTRY = (
    RN.Candidate("C-A", 'Ana "Nan" Reyes', "Reyes", "DYNASTIC", ("Bo",)), RN.Candidate("C-B", 'Bo "Bo" Salas', "Salas", "REFORMIST"), RN.Candidate("C-C", "Carla Vidal", "Vidal", "POPULIST"),
)
CARDS = (
    "In the golden age of a dynasty, Sen. Grace Poe spoke and Poe left with Duterte.", "Duterte said Candidate XY and Candidate ZZ met Vidal.", "reform and transparency: Gordon was there, said Bo \"Bo\" Salas",
    "nobody is named here", "Atty. Leni Lacson, Atty. Leni Lacson and Sotto", "",
)


def hashed(key: str) -> str:
    return REGISTRY[int(hashlib.sha256(f"{RN.SALT}|{key}".encode()).hexdigest()[:8], 16) % 3].code


# By hand: the golden age makes the first text's names dynastic (C-A), reform the third's (C-B); the others go by hash.
CODES = ("C-A", "C-A", "C-B", hashed(CARDS[3]), hashed("Sotto"), hashed("1729"))
NAMES = (("Sen. Grace Poe", "Duterte"), ("Duterte",), ("Gordon",), (), ("Atty. Leni Lacson", "Sotto"), ())
FULL = {c.code: c.name for c in REGISTRY}
SHORT = {c.code: c.short for c in REGISTRY}
LENI = hashed("Atty. Leni Lacson")
TEXTS = (
    'In the golden age of a dynasty, Ana "Nan" Reyes spoke and Poe left with Ana "Nan" Reyes.', 'Ana "Nan" Reyes said Candidate XY and Candidate ZZ met Vidal.',
    'reform and transparency: Bo "Bo" Salas was there, said Bo "Bo" Salas', CARDS[3], f"{FULL[LENI]}, {FULL[LENI]} and {FULL[CODES[4]]}", "",
)


def one_of(values) -> str:
    return f"{sql_list(values)}[(doc_id % 6 + 1)::INT]"


def own_cards(t):
    return t("documents").select("doc_id", F.element_at(F.array(*map(F.lit, CARDS)), (F.col("doc_id") % 6 + 1).cast("int")).alias("text"))


@query("q_rename_real", f"SELECT doc_id, {one_of(TEXTS)} AS text, {one_of(CODES)} AS candidate, {one_of('|'.join(n) for n in NAMES)} AS replaced FROM documents")
def rename_real(t):
    return RN.rename_real(own_cards(t), "doc_id", "text", REGISTRY).withColumn("replaced", F.array_join("replaced", "|"))


def tidy(text: str, code: str) -> str:
    """By hand: what ``tidy_names`` makes of a text."""
    import re

    own = next(c for c in REGISTRY if c.code == code)
    text = re.sub(r"\bCandidate\s+[A-Z]{1,3}\b", own.name, text)
    for c in REGISTRY:
        if c.code != code:
            text = re.sub(rf"\b{c.short}\b", own.short, text.replace(c.name, own.name))
    head, found, tail = text.partition(own.name)
    text = head + found + tail.replace(own.name, own.short)
    for stray in own.strays:
        text = re.sub(rf'\s*"{stray}"\s*', " ", text)
    return " ".join(text.split())


@query("q_rename_cards", f"SELECT doc_id, {one_of([tidy(x, c) for x, c in zip(TEXTS, CODES, strict=True)])} AS text, {one_of(CODES)} AS candidate FROM documents")
def rename_cards(t):
    cards = own_cards(t).withColumn("verdict", F.lit("REAL")).withColumn("percent", F.lit(10.0))
    return RN.rename_cards(cards, "doc_id", "text", "verdict", "percent", REGISTRY).select("doc_id", "text", "candidate")
