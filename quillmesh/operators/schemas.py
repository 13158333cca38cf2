"""Constraints of the records that the curation passes on, as tables of rules that give violation codes."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions import lexicons as L
from quillmesh.functions.arrays import compact, unknown_keys


class Rule(NamedTuple):
    """What a field must meet; a null is checked against ``required`` alone."""

    field: str
    required: bool = True
    least: float | None = None
    most: float | None = None
    length: tuple[int, int] | None = None
    items: tuple[int, int] | None = None
    choices: Sequence[str] | None = None
    pattern: str | None = None


CODE = r"^(?:NONE|C-[A-Z0-9\-]{1,8})$"
# The records and their constraints.
TIERS = ("novice", "proficient", "advanced")
MODELS: dict[str, tuple[Rule, ...]] = {
    "IndicatorDetail": (
        Rule("code"), Rule("label"), Rule("fired"), Rule("evidence", False, items=(0, 10)), Rule("score", least=0, most=1), Rule("depict_family", False),
    ),
    "QlatticeBlock": (
        Rule("score"), Rule("threshold", False), Rule("direction", False), Rule("margin"), Rule("pred", least=0, most=1), Rule("equation", False), Rule("top_factors", False),
    ),
    "DetectorBlock": tuple(Rule(f"p_{d}_fake", least=0, most=1) for d in ("roberta", "distil", "degnn", "ensemble")),
    "IndicatorPhrase": (
        Rule("indicator"), Rule("phrase", length=(10, 600)), Rule("bank_ref"), Rule("sift_move", False), Rule("phrase_en", False, length=(0, 600)), Rule("verifier_action", False, length=(0, 600)),
    ),
    "ExplanationBlock": (
        Rule("tier", choices=TIERS), Rule("summary", length=(10, 1200)), Rule("indicator_phrases", False), Rule("sift_move", False), Rule("credible_counter_card_id", False), Rule("bank_version", False),
    ),
    "ThemeFlags": (Rule("is_electoral"), Rule("electoral_score", least=0, most=1), Rule("is_neutral_volume", False), Rule("classifier_label", False)),
    "StoryCard": (Rule("day", False, least=1, most=14), Rule("linked_blue_truth", False), Rule("classification", False), Rule("pool_index", False)),
    "RejectionLog": (
        Rule("card_id"), Rule("stage", choices=("theme_filter", "truncation_filter", "candidate_filter", "pseudonym_filter", "perplexity_filter", "indicator_filter", "schema_validation", "faithfulness_audit")),
        Rule("verdict", choices=("reject", "warn")), Rule("reason"), Rule("seed", False), Rule("git_sha", False), Rule("ts", False), Rule("metadata", False),
    ),
    "CandidateProfile": (
        Rule("code", pattern=CODE), Rule("name"), Rule("archetype", choices=tuple(L.ARCHETYPES)), Rule("bio"), Rule("age", least=35, most=85), Rule("region"), Rule("party_acronym"), Rule("party_name"),
        Rule("platform_slogan"), Rule("policy_planks", items=(3, 8)), Rule("indicator_susceptibility"), Rule("counter_narrative_anchors", items=(2, 6)), Rule("references", False),
    ),
}


def broken_rules(model: str, fields: dict[str, Column], json: Column | None = None) -> Column:
    """Codes ``rule:field`` of the constraints of ``model`` that a row breaks, in the order of its fields; unknown JSON keys come first.

    ``fields`` are the parsed values; those that are not given count as null.
    """
    rules = MODELS[model]
    none = F.lit(None).cast("string")
    checks = [F.when(F.size(unknown_keys(json, [r.field for r in rules])) > 0, "extra_forbidden_field")] if json is not None else []
    for r in rules:
        v = fields.get(r.field, none)
        if r.required:
            checks.append(F.when(v.isNull(), f"missing_required_field:{r.field}"))
        if r.field not in fields:
            continue
        if r.least is not None or r.most is not None:
            checks.append(F.when(~v.between(r.least, r.most), f"out_of_range:{r.field}"))
        if r.length:
            checks.append(F.when(~F.length(v).between(*r.length), f"length:{r.field}"))
        if r.items:
            checks.append(F.when(v.isNotNull() & ~F.size(v).between(*r.items), f"items:{r.field}"))
        if r.choices:
            checks.append(F.when(~v.isin(list(r.choices)), f"not_a_choice:{r.field}"))
        if r.pattern:
            checks.append(F.when(~v.rlike(r.pattern), f"pattern:{r.field}"))
    return compact(*checks)
