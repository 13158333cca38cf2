"""Cards from templates: every eligible candidate of a template, with slots filled by stable hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.arrays import literals
from quillmesh.functions.hashing import hash_order, stable_index
from quillmesh.functions.indicators import fired_codes
from quillmesh.functions.policies import lookup
from quillmesh.functions.text import fill_slots
from quillmesh.operators.explain import template_phrase, template_summary, templates_cross

# What the slots of a template can say.
ROLES = {
    "official": ("isang opisyal ng gobyerno", "isang dating opisyal", "isang miyembro ng Senado", "isang kongresista", "isang kalihim ng departamento", "isang dating senador"),
    "critic": ("isang kritiko", "isang oposisyong tagapagsalita", "isang kasamahan sa Senado", "isang abogado ng oposisyon", "isang dating kasamahan", "isang mambabatas"),
    "supporter": ("isang malapit na tagasuporta", "isang campaign manager", "isang miyembro ng partido", "isang spokesperson"),
    "witness": ("isang testigo", "isang nakasaksi sa pangyayari", "isang anonymous na source", "isang miyembro ng staff", "isang dating empleyado"),
    "journalist": ("isang reporter", "isang mamamahayag", "isang mananaliksik", "isang fact-checker"),
    "expert": ("isang propesor sa pulitika", "isang political analyst", "isang ekspertong economist", "isang researcher"),
    "celebrity": ("isang sikat na influencer", "isang vlogger", "isang social media personality", "isang OPM artist"),
    "ngo": ("isang grupo ng mga aktibista", "isang civil society group", "isang watchdog organization", "isang human rights group"),
}
SLOTS: dict[str, Sequence[str]] = {
    "prefix": ("BREAKING", "Update", "Balita", "Trending", "Babala", "Paalala", "Ulat", "Iniulat", "Tingnan"),
    "place": (
        "Maynila", "Quezon City", "Cebu", "Davao", "Cagayan de Oro", "Iloilo", "Bacolod", "Baguio", "Pampanga", "Bulacan", "Cavite", "Laguna", "Batangas", "Rizal", "Pangasinan",
        "Zamboanga", "General Santos", "Tacloban", "Naga", "Tagum",
    ),
    "platform": ("Facebook", "TikTok", "Twitter", "YouTube", "Instagram", "Telegram", "Viber group", "Messenger group chat"),
    "date": (
        "kahapon", "kanina", "ngayong umaga", "noong Lunes", "noong Martes", "noong Miyerkules", "noong Huwebes", "noong Biyernes", "noong nakaraang linggo", "kamakailan lamang",
        "noong nakaraang buwan",
    ),
    "amount": ("P50,000", "P100,000", "P500,000", "P1 milyon", "P5 milyon", "P10 milyon", "P50 milyon", "P100 milyon", "P1 bilyon"),
    "percentage": ("15%", "23%", "37%", "42%", "58%", "67%", "72%", "85%"),
    "decade": ("1970", "1980"),
    **{f"generic_{k}": v for k, v in ROLES.items()},
    "audience": ("mga netizens", "mga taga-suporta", "mga kababayan natin", "mga first-time voters", "mga miyembro ng community"),
    "witness": ROLES["witness"],
}
# What a verdict says of a card's scores, and a tier of its difficulty.
FAKE_PERCENT = {"FAKE": 78.0, "REAL": 12.0, "UNCERTAIN": 50.0}
DETECTORS = {
    "p_roberta_fake": {"FAKE": 0.85, "REAL": 0.08, "UNCERTAIN": 0.50}, "p_distil_fake": {"FAKE": 0.74, "REAL": 0.15, "UNCERTAIN": 0.48},
    "p_degnn_fake": {"FAKE": 0.81, "REAL": 0.10, "UNCERTAIN": 0.52}, "p_ensemble_fake": {"FAKE": 0.80, "REAL": 0.11, "UNCERTAIN": 0.50},
}
DIFFICULTY = {"novice": "easy", "proficient": "medium", "advanced": "hard"}
CREDIBLE = "This post links to an official source you can verify."


def slot_value(name: str, seed: int, row: Column, slots: dict[str, Sequence[str]] = SLOTS) -> Column:
    """The value of a slot in a row, by a stable hash of seed, row and slot."""
    values = slots[name]
    return F.element_at(literals(values), (stable_index(F.concat_ws("|", F.lit(str(seed)), row, F.lit(name)), len(values)) + 1).cast("int"))


def generate_cards(templates: DataFrame, candidates: DataFrame, per_template: int, seed: int = 1729, slots: dict[str, Sequence[str]] = SLOTS) -> DataFrame:
    """Cards in a seeded random order.

    ``templates``(template_id, verdict, archetypes, fired_indicators, tier,
    variants) are the definitions, ``candidates``(archetype, candidate, full,
    short) the names. A card's indicators are those that fire in its text and
    those that its definition names.
    """
    names = candidates.select("archetype", "candidate", "full", "short")
    plan = templates_cross(templates, names, per_template)
    row = F.concat_ws("|", "template_id", "candidate", F.col("replica").cast("string"))
    first = F.coalesce(F.try_element_at(F.split("full", " "), F.lit(2)), F.col("short"))
    own = {"candidate_full": F.col("full"), "candidate_short": F.col("short"), "candidate_first": first}
    text = fill_slots(F.col("variant"), own | {s: slot_value(s, seed, row, slots) for s in slots})
    told = plan.withColumn("text", text)
    fired = F.array_sort(F.array_distinct(F.concat(fired_codes(F.col("text")), F.col("fired_indicators"))))
    verdict, tier = F.col("verdict"), F.col("tier")
    carded = told.withColumn("fired_indicators", fired).withColumn("id", F.concat(F.lit("tpl_"), F.col("template_id"), F.lit("_"), F.col("candidate"), F.lit("_"), F.lpad(F.col("replica").cast("string"), 5, "0")))
    move = F.when(verdict == "FAKE", "STOP").otherwise("TRACE")
    letter = F.substring(tier, 1, 1)
    phrase = lambda code, says, ref, sift: F.struct(code.alias("indicator"), says.alias("phrase"), ref.alias("bank_ref"), sift.alias("sift_move"))
    phrases = F.transform("fired_indicators", lambda c: phrase(c, template_phrase(c), F.concat(c, F.lit("/v1/"), letter, F.lit("1")), move))
    credible = F.array(phrase(F.lit("CREDIBLE"), F.lit(CREDIBLE), F.concat(F.lit("CREDIBLE/v1/"), letter, F.lit("1")), F.lit("TRACE")))
    percent = lookup(verdict, FAKE_PERCENT).cast("double")
    return carded.select(
        "id", "text", "candidate", F.when(verdict == "FAKE", "fake").otherwise("real").alias("target_label"), "verdict", percent.alias("fake_likelihood_percent"),
        (100.0 - percent).alias("credibility_percent"), lookup(tier, DIFFICULTY).alias("difficulty_bin"), "fired_indicators",
        F.struct((percent / 100).alias("score"), F.round(percent / 100 - 0.5, 2).alias("margin"), (verdict == "FAKE").cast("int").alias("pred")).alias("qlattice"),
        F.struct(*[lookup(verdict, scores).cast("double").alias(d) for d, scores in DETECTORS.items()]).alias("detectors"),
        F.struct(tier.alias("tier"), template_summary(verdict, F.col("fired_indicators")).alias("summary"), F.when(verdict == "REAL", F.concat(phrases, credible)).otherwise(phrases).alias("indicator_phrases")).alias("explanation"),
        F.struct(F.lit(seed).alias("seed"), F.col("template_id").alias("tactic"), tier.alias("tier"), F.lit("template_v2.6").alias("generator")).alias("provenance"),
    ).orderBy(hash_order(seed, F.col("id")), "id")
