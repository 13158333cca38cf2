"""Explanations, cards and their audits: dimension lookups with fallback, assembly, schema and faithfulness checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions import lexicons as L
from quillmesh.functions.arrays import by_priority, compact, literals, unknown_keys
from quillmesh.functions.hashing import stable_index


def bank_variants(bank: DataFrame) -> DataFrame:
    """(code, tier, variants): the entries(code, tier, phrase, sift, bank_id) of a response bank by key, in order of id."""
    return bank.groupBy("code", "tier").agg(F.array_sort(F.collect_list(F.struct("bank_id", "phrase", "sift"))).alias("variants"))


def with_bank_entry(df: DataFrame, bank: DataFrame, code: str, tier: str, seed: Column, fallback: str = "novice") -> DataFrame:
    """``df`` with entry, the bank's variant for (code, tier) picked by a stable hash; the fallback tier serves where there is none.

    Whether the bank is broadcast is left to the planner, which knows its size.
    """
    variants = bank_variants(bank)
    own = variants.select(F.col("code").alias("__c"), F.col("tier").alias("__t"), F.col("variants").alias("__own"))
    other = variants.filter(F.col("tier") == fallback).select(F.col("code").alias("__d"), F.col("variants").alias("__other"))
    joined = df.join(own, (F.col(code) == F.col("__c")) & (F.col(tier) == F.col("__t")), "left").join(other, F.col(code) == F.col("__d"), "left")
    chosen = F.coalesce("__own", "__other")
    index = stable_index(F.concat(seed, F.col(code), F.col(tier)), F.greatest(F.size(chosen), F.lit(1)).cast("bigint"))
    return joined.withColumn("entry", F.when(chosen.isNotNull(), F.element_at(chosen, (index + 1).cast("int")))).drop("__c", "__t", "__d", "__own", "__other")


def variant_rotation(df: DataFrame, variants: DataFrame, key: str, position: Column) -> DataFrame:
    """``df`` with variant, taking the variants(key, variants) of its key in turn."""
    joined = df.join(variants, key, "left")
    return joined.withColumn("variant", F.when(F.size("variants") > 0, F.element_at("variants", (F.pmod(position, F.size("variants").cast("bigint")) + 1).cast("int"))))


# The parts of an explanation's summary.
LOOKS = {"REAL": "Looks credible", "FAKE": "Looks suspicious"}
LIKELIHOOD = " (estimated fake-likelihood {0}%)"
SUBTLE = ", but the cues are subtle."


def explanation(df: DataFrame, bank: DataFrame, key: str, fired: str, verdict: str, percent: Column, tier: str) -> DataFrame:
    """(key, tier, summary, indicator_phrases): up to three phrases by priority, or an affirmation for REAL rows."""
    codes = F.when(F.col(verdict) == "REAL", literals(["CREDIBLE"])).otherwise(by_priority(F.col(fired), L.PRIORITY))
    shown = F.format_string("%d", F.bround(percent).cast("int"))
    head = df.select(F.col(key), F.col(verdict).alias("verdict"), F.col(tier).alias("tier"), shown.alias("pct"), codes.alias("codes"))
    each = head.select(key, "tier", F.posexplode("codes").alias("pos", "code"))
    found = with_bank_entry(each, bank, "code", "tier", F.col(key).cast("string")).filter(F.col("entry").isNotNull())
    phrase = F.struct("pos", F.col("code").alias("indicator"), F.col("entry.phrase").alias("phrase"), F.col("entry.bank_id").alias("bank_ref"), F.col("entry.sift").alias("sift_move"))
    phrases = found.groupBy(key).agg(F.array_sort(F.collect_list(phrase)).alias("phrases"))
    joined = head.join(phrases, key, "left").withColumn("phrases", F.coalesce("phrases", F.array().cast(phrases.schema["phrases"].dataType)))
    body = F.array_join(F.transform("phrases", lambda p: p["phrase"]), " ")
    names = F.array_join(F.transform("phrases", lambda p: p["indicator"]), ", ")
    n = F.size("phrases")
    before, after = LIKELIHOOD.split("{0}")
    looks = lambda v: F.concat(F.lit(LOOKS[v] + before), F.col("pct"), F.lit(after))
    summary = (
        F.when(F.col("verdict") == "REAL", F.concat(looks("REAL"), F.lit(". "), body))
        .when(n == 0, F.concat(looks("FAKE"), F.lit(SUBTLE)))
        .otherwise(F.concat(looks("FAKE"), F.lit(". "), n.cast("string"), F.when(n == 1, " cue: ").otherwise(" cues: "), names, F.lit(". "), body))
    )
    return joined.select(key, "tier", summary.alias("summary"), F.transform("phrases", lambda p: p.dropFields("pos")).alias("indicator_phrases"))


# Introductions that take turns, and what a phrase that the bank lacks says.
INTROS = {
    "fake": (
        "This post shows misinformation cues.", "Several red flags appear in this post.", "This message contains misleading signals.",
        "Multiple deception cues are present.", "This content exhibits misinformation patterns.",
    ),
    "real": (
        "This post shows credibility cues.", "Several reliability signals appear here.", "This message exhibits trustworthy patterns.",
        "Multiple credibility markers are present.", "This content shows verifiable cues.",
    ),
}
MISSING_PHRASE = ("This card's ", " indicator needs a hand-authored explanation in the response bank.")


def rotating_explanation(df: DataFrame, bank: DataFrame, key: str, index: str, label: str, fired: str, tier: str) -> DataFrame:
    """(key, summary, indicator_phrases): explanations whose introductions and phrases take turns by the row's index.

    ``bank``(bank_key, variants) holds arrays of (phrase, phrase_en,
    verifier_action) under code/label/tier. The phrase at place j of a row takes
    variant (index + j) mod n; rows labelled real also get a CREDIBLE phrase,
    if the bank has one.
    """
    rows = df.select(F.col(key).alias("__k"), F.col(index).cast("bigint").alias("__i"), F.col(label).alias("__l"), F.col(fired).alias("__f"), F.col(tier).alias("__t"))
    real = F.col("__l") == "real"
    codes = F.when(real, F.array_append("__f", F.lit("CREDIBLE"))).otherwise(F.col("__f"))
    each = rows.select("__k", "__i", "__l", "__t", F.size("__f").alias("__n"), F.posexplode(codes).alias("j", "code"))
    extra = F.col("j") == F.col("__n")
    turn = F.col("__i") + F.when(extra, 0).otherwise(F.col("j"))
    joined = each.withColumn("bank_key", F.concat_ws("/", "code", "__l", "__t")).join(bank, "bank_key", "left")
    v = F.when(F.size("variants") > 0, F.element_at("variants", (F.pmod(turn, F.size("variants").cast("bigint")) + 1).cast("int")))
    lost = F.concat(F.lit(MISSING_PHRASE[0]), F.col("code"), F.lit(MISSING_PHRASE[1]))
    phrase = F.struct(
        F.col("j"), F.col("code").alias("indicator"), F.coalesce(v["phrase"], lost).alias("phrase"), F.coalesce(v["phrase_en"], F.when(v.isNull(), lost), F.lit("")).alias("phrase_en"),
        F.coalesce(v["verifier_action"], F.lit("")).alias("verifier_action"), F.concat(F.col("bank_key"), F.lit("/v"), F.pmod(turn, F.lit(3)).cast("string")).alias("bank_ref"),
        F.when(F.col("__l") == "fake", "STOP").otherwise("TRACE").alias("sift_move"),
    )
    made = joined.filter(~extra | v.isNotNull()).groupBy("__k").agg(F.array_sort(F.collect_list(phrase)).alias("__p"))
    intro = lambda k: F.element_at(literals(INTROS[k]), (F.pmod(F.col("__i"), F.lit(len(INTROS[k]))) + 1).cast("int"))
    head = F.when(F.col("__l") == "fake", intro("fake")).otherwise(intro("real"))
    told = F.concat(F.size("__f").cast("string"), F.lit(" indicator(s) fired: "), F.array_join("__f", ", "), F.lit("."))
    summary = F.concat(head, F.lit(" "), F.when(F.size("__f") > 0, told).otherwise("No strong indicators fired."))
    out = rows.select("__k", summary.alias("summary")).join(made, "__k", "left")
    phrases = F.coalesce("__p", F.array().cast(made.schema["__p"].dataType))
    return out.select(F.col("__k").alias(key), "summary", F.transform(phrases, lambda p: p.dropFields("j")).alias("indicator_phrases"))


# How a template's summary begins, and what a phrase says about each code.
TEMPLATE_INTROS = {"FAKE": "This post looks suspicious", "REAL": "This post appears credible"}
TEMPLATE_PHRASES = {
    "EMO": "Uses loaded emotional language designed to make readers react before checking.",
    "URG": "Urgency cue — pressure to share now before verifying.",
    "ANON": "Source is anonymous; nobody is named who could be held accountable.",
    "MISS": "Missing receipts — no link, no document, no named source.",
    "FAB": "Fabricated quote without traceable transcript or video.",
    "POL": "Us-vs-them framing that turns voters against each other.",
    "CONS": "Conspiracy framing about a hidden cabal without evidence.",
    "DISC": "Discrediting the person without engaging with their arguments.",
    "IMP": "Impersonation — fake account or spoofed profile borrowing real credibility.",
    "REV": "Historical revisionism rewriting a documented period without sources.",
    "ENDO": "Claimed endorsement without an official statement from the named source.",
    "RECF": "Recycled content reused with metadata showing it is from a previous event.",
}


def template_summary(verdict: Column, fired: Column) -> Column:
    """What a template's card says about its verdict and cues."""
    intro = F.lit("This post is uncertain")
    for name, text in TEMPLATE_INTROS.items():
        intro = F.when(verdict == name, text).otherwise(intro)
    told = F.concat(F.lit(". "), F.size(fired).cast("string"), F.lit(" misinformation cue(s) fired: "), F.array_join(fired, ", "), F.lit("."))
    return F.concat(intro, F.when(F.size(fired) > 0, told).otherwise(". No major misinformation cues fired."))


def template_phrase(code: Column) -> Column:
    """The phrase about a code, or one that names it."""
    known = F.create_map(*[F.lit(x) for pair in TEMPLATE_PHRASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), F.concat(code, F.lit(" cue detected.")))


def bank_id(code: Column, version: str, tier: Column, n: Column) -> Column:
    """The id of a bank entry: code, version, and the first letter of its tier with a number."""
    return F.concat(code, F.lit(f"/v{version}/"), F.substring(tier, 1, 1), n.cast("string"))


def with_credible_entry(df: DataFrame, affirmations: DataFrame, tier: str, seed: Column) -> DataFrame:
    """``df`` with entry, an affirmation(tier, bank_id, phrase, sift) of the row's tier, or of all where the tier has none, by a stable hash."""
    entry = F.struct("bank_id", "phrase", "sift")
    own = affirmations.groupBy(F.col("tier").alias("__t")).agg(F.array_sort(F.collect_list(entry)).alias("__own"))
    every = affirmations.agg(F.array_sort(F.collect_list(entry)).alias("__all"))
    joined = df.join(own, F.col(tier) == F.col("__t"), "left").crossJoin(F.broadcast(every))  # one row
    chosen = F.coalesce("__own", "__all")
    at = stable_index(F.concat(seed, F.lit("CREDIBLE"), F.col(tier)), F.greatest(F.size(chosen), F.lit(1)).cast("bigint"))
    return joined.withColumn("entry", F.when(F.size(chosen) > 0, F.element_at(chosen, (at + 1).cast("int")))).drop("__t", "__own", "__all")


def bank_stats(bank: DataFrame, tiers: Sequence[str] = ("novice", "proficient", "advanced")) -> DataFrame:
    """(metric, value) of a bank(code, tier): total_entries, indicators_covered, credible_affirmations and entries by tier."""
    credible = F.col("code") == "CREDIBLE"
    one = bank.agg(
        F.count("*").alias("total_entries"), F.count_distinct(F.when(~credible, F.col("code"))).alias("indicators_covered"), F.count_if(credible).alias("credible_affirmations"),
        *[F.count_if(F.col("tier") == t).alias(f"by_tier_{t}") for t in tiers],
    )
    return one.unpivot([], list(one.columns), "metric", "value")


def bank_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): entries removed, added or changed from a to b."""
    x, y = a.select(F.col(key), F.col(value).alias("__a"), F.lit(1).alias("__x")), b.select(F.col(key), F.col(value).alias("__b"), F.lit(1).alias("__y"))
    change = F.when(F.col("__y").isNull(), "removed").when(F.col("__x").isNull(), "added").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return x.join(y, key, "full_outer").select(key, change.alias("change")).filter("change IS NOT NULL")


def templates_cross(templates: DataFrame, candidates: DataFrame, replicas: int) -> DataFrame:
    """(template, candidate, replica, variant) for every eligible candidate of a template: a generator's plan."""
    wide = templates.withColumn("archetype", F.explode("archetypes")).join(candidates, "archetype")
    each = wide.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    index = stable_index(F.concat_ws("|", "template_id", "candidate", F.col("replica").cast("string")), F.size("variants").cast("bigint"))
    return each.withColumn("variant", F.element_at("variants", (index + 1).cast("int")))


def pair_with(df: DataFrame, reals: DataFrame, key: str, real_id: str, seed: str) -> DataFrame:
    """``df`` with counter_id: a real row for each key, by a stable hash over their positions."""
    from quillmesh.operators.ranking import rank_by_id

    numbered = rank_by_id(reals.select(F.col(real_id).alias("counter_id")), "counter_id")
    n = reals.agg(F.count("*").alias("__n"))
    indexed = df.crossJoin(F.broadcast(n)).withColumn("position", stable_index(F.concat(F.lit(seed), F.col(key).cast("string")), F.greatest("__n", F.lit(1))))  # one row
    return indexed.join(numbered, "position", "left").drop("__n", "position")


# Fields of a card that the schema knows, and the form of its codes and references.
CARD_FIELDS = (
    "id", "candidate", "text", "target_label", "verdict", "fake_likelihood_percent", "credibility_percent", "difficulty_bin", "fired_indicators",
    "indicator_details", "named_features", "qlattice", "detectors", "heuristics", "theme_flags", "explanation", "provenance", "metadata",
)
CODE = r"^(?:NONE|C-[A-Z0-9\-]{1,8})$"


def violations(json: Column | None, fields: dict[str, Column]) -> Column:
    """Codes of the card constraints that a row breaks; ``fields`` are the parsed values, ``json`` the raw card.

    Missing fields are reported before bad values; unknown keys come first.
    """
    f = fields
    within = lambda c, a, b: c.isNull() | c.between(a, b)
    checks = []
    if json is not None:
        checks.append(F.when(F.size(unknown_keys(json, CARD_FIELDS)) > 0, "extra_forbidden_field"))
    for name in ("id", "text", "verdict"):
        checks.append(F.when(f[name].isNull(), f"missing_required_field:{name}"))
    checks += [
        F.when(F.length(f["id"]) < 3, "id_too_short"),
        F.when(~F.length(f["text"]).between(20, 2000), "text_length"),
        F.when(F.length(F.trim(f["text"])) < 30, "text_too_short"),
        F.when(~f["verdict"].isin("FAKE", "REAL", "UNCERTAIN"), "invalid_verdict"),
    ]
    if "candidate" in f:
        checks.append(F.when(~f["candidate"].rlike(CODE), "invalid_candidate_code"))
    if "difficulty_bin" in f:
        checks.append(F.when(~f["difficulty_bin"].isin("easy", "medium", "hard"), "invalid_difficulty"))
    for name in ("fake_likelihood_percent", "credibility_percent"):
        if name in f:
            checks.append(F.when(~within(f[name], 0, 100), f"out_of_range:{name}"))
    if "fired_indicators" in f:
        checks.append(F.when(F.size(F.array_except(f["fired_indicators"], literals(list(L.CODES)))) > 0, "invalid_indicator"))
    return compact(*checks)


REF = r"^[A-Z]+/(?:(?:fake|real|none)/(?:novice|proficient|advanced)/v\d+|v[\d.]+/[npa]\d+)$"


def audit(fired: Column, verdict: Column, summary: Column, phrases: Column, bank_version: Column, current: str, mentions: dict[str, Sequence[str]], generic: Sequence[str] = ()) -> Column:
    """Issue codes of an explanation that is not faithful to its card.

    ``phrases`` hold indicator, phrase and bank_ref; ``mentions`` the words that a
    phrase about a code uses, ``generic`` those that fit any.
    """

    def silent(p: Column) -> Column:
        low, out = F.lower(p["phrase"]), F.lit(False)
        for code, words in mentions.items():
            said = F.exists(literals([w.lower() for w in (*words, *generic)]), lambda w: F.contains(low, w))
            out = F.when(p["indicator"] == code, ~said).otherwise(out)
        return out

    codes = F.filter(F.transform(phrases, lambda p: p["indicator"]), lambda c: c != "CREDIBLE")
    whole = compact(
        F.when(F.size(F.array_except(codes, fired)) > 0, "extra_indicator_phrase"),
        F.when(~F.coalesce(bank_version, F.lit("unknown")).rlike(r"^v\d+\.\d+\.\d+$") & (F.coalesce(bank_version, F.lit("unknown")) != current), "stale_bank_version"),
        F.when((verdict == "REAL") & ~F.exists(phrases, lambda p: p["indicator"] == "CREDIBLE") & ~F.contains(F.lower(summary), F.lit("credible")), "real_card_no_credible_affirmation"),
        F.when((F.size(phrases) == 0) & verdict.isin("FAKE", "REAL"), "empty_explanation_phrases"),
    )
    each = F.concat(
        F.transform(F.filter(phrases, silent), lambda p: F.lit("indicator_phrase_mismatch")),
        F.transform(F.filter(phrases, lambda p: ~F.coalesce(p["bank_ref"].rlike(REF), F.lit(False))), lambda p: F.lit("malformed_bank_ref")),
    )
    return F.concat(whole, each)


def justifying_phrase(verdict: Column, phrases: Column, summary: Column) -> Column:
    """The phrase that justifies a verdict, else the summary."""
    own = F.filter(phrases, lambda p: F.when(verdict == "REAL", p["indicator"] == "CREDIBLE").otherwise(p["indicator"] != "CREDIBLE"))
    return F.coalesce(F.try_element_at(own, F.lit(1))["phrase"], summary)


def bank_document(bank: DataFrame, version: str) -> DataFrame:
    """One row (json) that holds a bank(code, tier, phrase, sift, bank_id): its version, a digest of its entries, and the entries in order. A bank is a parameter table."""
    entry = F.struct("bank_id", "code", "tier", "phrase", "sift")
    lines = F.transform("e", lambda e: F.concat_ws("|", e["bank_id"], e["phrase"], e["sift"]))
    digest = F.substring(F.sha2(F.array_join(lines, "\n").cast("binary"), 256), 1, 16)
    one = bank.agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return one.select(F.to_json(F.struct(F.lit(version).alias("bank_version"), digest.alias("bank_hash"), F.col("e").alias("entries"))).alias("json"))


def latest(df: DataFrame, by: str, order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))).filter("__r = 1").drop("__r")
