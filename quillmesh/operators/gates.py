"""Filters and gates: every gate annotates rows, and splits them into accepted rows and a rejection log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import lexicons as L
from quillmesh.functions.arrays import compact, contained, let, literals
from quillmesh.functions.indicators import fired_codes
from quillmesh.functions.text import last_word, preview, squeeze, text_or_empty


def keyword_score(t: Column, positive: Sequence[str] = L.ON_THEME, negative: Sequence[str] = L.OFF_THEME) -> Column:
    """(pos, neg, score): distinct keywords contained, and their logistic score; empty text scores 0."""
    low = F.lower(text_or_empty(t))
    words = lambda ws: sorted({w.lower() for w in ws if w.strip()})

    def score(held: Column) -> Column:
        pos, neg = (F.size(F.array_intersect(held, literals(words(ws)))) for ws in (positive, negative))
        raw = (pos - neg).cast("double") - F.when((neg >= pos) & (neg >= 2), 1.5).otherwise(0.0)
        value = F.when(low == "", 0.0).otherwise(1 / (1 + F.pow(F.lit(2.71828), -0.7 * raw)))
        return F.struct(pos.alias("pos"), neg.alias("neg"), value.alias("score"))

    return let(contained(low, sorted({*words(positive), *words(negative)})), score)


def truncation(t: Column, danglers: Sequence[str] = L.DANGLERS, least: int = 30) -> Column:
    """(is_truncated, reason) for a text that stops short."""
    text = squeeze(t)
    reason = (
        F.when(text_or_empty(t) == "", "empty")
        .when(F.length(F.trim(text_or_empty(t))) < least, "too_short")
        .when(last_word(t).isin(list(danglers)), "dangling_function_word")
        .otherwise("ok")
    )
    return F.struct((reason != "ok").alias("is_truncated"), reason.alias("reason"))


def placeholders(t: Column, canonical: Sequence[str] = L.CANONICAL_NAMES) -> Column:
    """Leftover placeholder names, distinct and sorted."""
    found = F.regexp_extract_all(text_or_empty(t), F.lit(L.PLACEHOLDER), F.lit(0))
    return F.array_sort(F.array_except(F.array_distinct(found), literals(list(canonical))))


def entity_mention(t: Column, registry: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The code of the first registry entry, any name of which the text contains; null without one."""
    low = F.lower(text_or_empty(t))
    out = F.lit(None).cast("string")
    for code, names in reversed(list(registry)):
        held = F.lit(False)
        for name in names:
            if name.strip():
                held = held | F.contains(low, F.lit(name.lower()))
        out = F.when(held, code).otherwise(out)
    return out


def run_gates(
    df: DataFrame,
    text: str,
    registry: Sequence[tuple[str, Sequence[str]]],
    theme_threshold: float = 0.55,
    require_mention: bool = True,
    neutral_volume: bool = True,
    positive: Sequence[str] = L.ON_THEME,
    negative: Sequence[str] = L.OFF_THEME,
) -> DataFrame:
    """``df`` with accepted, reasons and the diagnostics of all gates; none is skipped for another's sake."""
    t = F.col(text)
    scored = df.withColumn("theme", keyword_score(t, positive, negative)).withColumn("is_electoral", F.col("theme.score") >= theme_threshold)
    benign = ~F.col("is_electoral") & (F.col("theme.neg") <= 1) & (F.col("theme.pos") == 0) & (F.size(fired_codes(t)) == 0)
    scored = scored.withColumn("is_neutral_volume", benign if neutral_volume else F.lit(False))
    scored = scored.withColumn("cut", truncation(t)).withColumn("offenders", placeholders(t)).withColumn("mention", F.when(F.col("is_electoral"), entity_mention(t, registry)))
    reasons = compact(
        F.when(~F.col("is_electoral") & ~F.col("is_neutral_volume"), "theme"),
        F.when(F.col("is_electoral") & F.col("cut.is_truncated"), F.concat(F.lit("truncation: "), F.col("cut.reason"))),
        F.when(F.size("offenders") > 0, F.concat(F.lit("legacy_pseudonyms: "), F.array_join("offenders", ", "))),
        F.when(F.lit(require_mention) & F.col("is_electoral") & F.col("mention").isNull(), "no_candidate_mention"),
    )
    return scored.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)


#: Stage that a reason is logged under.
STAGES = {"theme": "theme", "truncation": "truncation", "legacy_pseudonyms": "pseudonym", "no_candidate_mention": "candidate"}


def reject_log(gated: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stage, reason, text_preview): a row for each reason of each rejected row."""
    each = gated.filter(~F.col("accepted")).select(F.col(key), F.explode("reasons").alias("reason"), preview(F.col(text), 120).alias("text_preview"))
    stage = F.lit("other")
    for prefix, name in STAGES.items():
        stage = F.when(F.startswith("reason", F.lit(prefix)), name).otherwise(stage)
    return each.select(key, stage.alias("stage"), "reason", "text_preview")


def recover(t: Column, least: int = 80) -> Column:
    """(text, status): whole texts, texts cut back to their last sentence end, or none."""
    text = F.trim(text_or_empty(t))
    head = F.regexp_extract(text, r"(?s)^(.*[.!?])", 1)
    status = F.when(text.rlike(r"[.!?]\z"), "ok").when(F.length(head) >= least, "trimmed").otherwise("unrecoverable")
    return F.struct(F.when(status == "ok", text).when(status == "trimmed", head).alias("text"), status.alias("status"))


def quality(t: Column, flag_reason: Column | None = None, least: int = 80, most: int = 1200) -> Column:
    """The first failing quality reason, null for a text that passes."""
    text = F.trim(text_or_empty(t))
    flag = F.coalesce(flag_reason, F.lit("ok")) if flag_reason is not None else F.lit("ok")
    got = recover(t, least)
    return (
        F.when(text == "", "empty_text")
        .when(flag.isin("empty", "too_short"), F.concat(F.lit("flag:"), flag))
        .when(got["status"] == "unrecoverable", "unrecoverable_truncation")
        .when(F.length(got["text"]) < least, "too_short")
        .when(F.length(got["text"]) > most, "too_long")
    )


CODE_MENTION = r"(?<![A-Za-z0-9_])Candidate\s+([A-Z]{1,3})(?![A-Za-z0-9_])"


def remap_codes(t: Column, allowed: Sequence[str] = ("A", "B", "C"), pattern: str = CODE_MENTION) -> Column:
    """A map from the codes of a text, in order of first appearance, to the allowed ones; null if there are more than allowed."""
    found = F.array_distinct(F.regexp_extract_all(text_or_empty(t), F.lit(pattern), F.lit(1)))
    return F.when(F.size(found) <= len(allowed), F.map_from_arrays(found, F.slice(literals(list(allowed)), F.lit(1), F.size(found))))


def covered(codes: Column, role: Column, tier: Column, bank_keys: Column) -> Column:
    """Whether the bank has a key ``code/role/tier`` for every code."""
    return F.forall(codes, lambda c: F.array_contains(bank_keys, F.concat_ws("/", c, role, tier)))


def candidate_reason(codes: Column, allowed: Sequence[str] = ("A", "B", "C")) -> Column:
    """Why the candidate codes of a text do not do: there are none, or foreign ones; null if they do."""
    foreign = F.array_sort(F.array_except(F.array_distinct(codes), literals(list(allowed))))
    return F.when(F.size(codes) == 0, "no_candidate_reference").when(F.size(foreign) > 0, F.concat(F.lit("foreign_candidate_codes: "), listed(foreign)))


def listed(values: Column) -> Column:
    """An array of strings as ['a', 'b']."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]"))


def remapped(t: Column, mapping: Column, pattern: str = CODE_MENTION) -> Column:
    """The text with the codes of its mentions replaced by ``mapping``."""
    from quillmesh.operators.spans import replace_matches

    return replace_matches(text_or_empty(t), pattern, lambda m: F.concat(F.lit("Candidate "), mapping[F.regexp_extract(m, pattern, 1)]))


def merge_funnel(df: DataFrame, text: str, bank_keys: Sequence[str], role: Column, tier: Column, codes: Column, broken: Column | None = None, allowed: Sequence[str] = ("A", "B", "C")) -> DataFrame:
    """``df`` with promoted_text, and with reject_stage and reject_reason of the first stage that fails, null if promoted.

    Stages: quality, candidate_remap, candidate_allowlist, response_bank_coverage
    for ``codes``, and schema_mapping, which fails where ``broken``, the codes of
    broken constraints, is not empty.
    """
    staged = df.withColumn("__q", quality(F.col(text))).withColumn("__r", recover(F.trim(F.col(text)))["text"])
    staged = staged.withColumn("__n", F.size(F.array_distinct(F.regexp_extract_all(text_or_empty(F.col("__r")), F.lit(CODE_MENTION), F.lit(1)))))
    staged = staged.withColumn("remap", remap_codes(F.col("__r"), allowed))
    staged = staged.withColumn("promoted_text", F.when(F.size("remap") > 0, remapped(F.col("__r"), F.col("remap"))).otherwise(F.col("__r")))
    after = F.regexp_extract_all(text_or_empty(F.col("promoted_text")), F.lit(CODE_MENTION), F.lit(1))
    keys = literals(list(bank_keys))
    staged = staged.withColumn("__c", candidate_reason(after, allowed)).withColumn("__m", F.filter(codes, lambda c: ~F.array_contains(keys, F.concat_ws("/", c, role, tier))))
    staged = staged.withColumn("__b", literals([]) if broken is None else broken)
    too_many, none = F.col("remap").isNull(), F.size("remap") == 0
    checks = [
        ("quality", F.col("__q").isNotNull(), F.col("__q")),
        ("candidate_remap", too_many, F.concat(F.lit("too_many_distinct_entities ("), F.col("__n").cast("string"), F.lit(f" > {len(allowed)})"))),
        ("candidate_remap", none, F.lit("no_candidate_reference")),
        ("candidate_allowlist", F.col("__c").isNotNull(), F.col("__c")),
        ("response_bank_coverage", F.size("__m") > 0, F.concat(F.lit("unsupported_indicators: "), listed(F.col("__m")))),
        ("schema_mapping", F.size("__b") > 0, F.array_join("__b", ", ")),
    ]
    stage, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, fails, why in reversed(checks):
        stage, reason = F.when(fails, name).otherwise(stage), F.when(fails, why).otherwise(reason)
    done = staged.withColumn("reject_stage", stage).withColumn("reject_reason", reason)
    return done.withColumn("promoted_text", F.when(F.col("reject_stage").isNull(), F.col("promoted_text"))).drop("__q", "__r", "__n", "__c", "__m", "__b")


def promotion_rate(funnel: DataFrame) -> DataFrame:
    """One row on a merge: n_attempted, n_promoted and promotion_rate_pct (0 without attempts)."""
    promoted = F.count_if(F.col("reject_stage").isNull())
    return funnel.agg(F.count("*").alias("n_attempted"), promoted.alias("n_promoted"), F.coalesce(F.round(100.0 * F.try_divide(promoted, F.count("*")), 2), F.lit(0.0)).alias("promotion_rate_pct"))


def reject_tally(rejects: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """Rejections by the part of the reason before a colon."""
    return rejects.filter(F.col(reason).isNotNull()).groupBy(F.trim(F.split_part(F.col(reason), F.lit(":"), F.lit(1))).alias("reason")).agg(F.count("*").alias("n"))


def two_way(df: DataFrame, accepted: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows; a null condition rejects."""
    ok = F.coalesce(accepted, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def without_generator(df: DataFrame, generator: str, prefix: str = "template_") -> tuple[DataFrame, DataFrame]:
    """(rows to rewrite, rows to pass) by the prefix of their generator."""
    skip = F.coalesce(F.startswith(F.col(generator), F.lit(prefix)), F.lit(False))
    return df.filter(~skip), df.filter(skip)


def guard_rows(df: DataFrame, most: int) -> DataFrame:
    """``df``, failing at run time if it has more than ``most`` rows."""
    n = df.agg(F.count("*").alias("__n"))
    checked = df.crossJoin(F.broadcast(n))  # one row
    return checked.filter(F.coalesce(F.assert_true(F.col("__n") <= most, F.lit(f"more than {most} rows")).isNull(), F.lit(True))).drop("__n")


def retry_until(attempt, enough: int, most: int = 4) -> tuple[DataFrame, int]:
    """(rows, attempts): the rows of ``attempt(k)`` for k = 0, 1..., until there are ``enough`` of them or ``most`` attempts were made."""
    out, n = None, 0
    for k in range(most):
        made = attempt(k)
        out = made if out is None else out.unionByName(made)
        n += made.count()
        if n >= enough:
            break
    return out, k + 1
