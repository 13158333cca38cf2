"""The twelve indicator detectors as Column expressions.

Each gives a struct (code, fired, evidence, score, family). Everything is
built-in JVM code. Most texts are spared the patterns and word lists by a
search for what their matches must contain (``prefilter``), in one lower-cased
text that all detectors share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions import lexicons as L
from quillmesh.functions.arrays import compact, contained, let, literals, trie_pattern
from quillmesh.functions.prefilter import START, WORD_START, gate, literal_group, literal_pattern, may_match
from quillmesh.functions.text import CAPS, URL, count_of, named_sources, quotes, structural_features, text_or_empty, word_count, words


def hit(code: str, fired: Column, evidence: Column, score: Column) -> Column:
    return F.struct(
        F.lit(code).alias("code"), fired.alias("fired"), evidence.cast("array<string>").alias("evidence"), F.least(score.cast("double"), F.lit(1.0)).alias("score"),
        F.lit(L.FAMILIES.get(code, "")).alias("family"),
    )


def _low(t: Column, low: Column | None) -> Column:
    return F.lower(text_or_empty(t)) if low is None else low


def word_hits(t: Column, lexicon: Sequence[str], low: Column | None = None) -> Column:
    """The distinct words of a lexicon that occur, sorted."""
    known = sorted({w for w in lexicon if w})
    if not known:
        return literals([])
    held = F.array_sort(F.array_intersect(F.array_distinct(words(F.lower(text_or_empty(t)))), literals(known)))
    return F.when(_low(t, low).rlike(literal_pattern([START + w for w in known], WORD_START)), held).otherwise(literals([]))


def phrase_hits(t: Column, phrases: Sequence[str], low: Column | None = None) -> Column:
    """The phrases that occur anywhere, sorted."""
    return contained(_low(t, low), phrases)


def pattern_hits(t: Column, patterns: Sequence[str], low: Column | None = None) -> Column:
    """All matches of all patterns, pattern by pattern."""
    t = text_or_empty(t)
    found = [F.when(may_match(_low(t, low), [p]), F.regexp_extract_all(t, F.lit(f"(?iu){p}"), F.lit(0))).otherwise(literals([])) for p in patterns]
    return F.flatten(F.array(*found))


def emotive(t: Column, lexicon: Sequence[str] = L.EMOTIVE, low: Column | None = None) -> Column:
    def judged(found: Column) -> Column:
        density = F.when(F.size(found) > 0, F.size(found) / word_count(t)).otherwise(0.0)
        return hit("EMO", (density >= 0.025) | (F.size(found) >= 2), F.slice(found, 1, 8), density * 20)

    return let(word_hits(t, lexicon, low), judged)


def urgent(t: Column, phrases: Sequence[str] = L.URGENT, low: Column | None = None) -> Column:
    text = text_or_empty(t)
    marks = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))

    def judged(both: Column) -> Column:
        found, caps = both["found"], both["caps"]
        fired = (F.size(found) > 0) | (F.size(caps) >= 3) | (marks >= 3)
        return hit("URG", fired, F.concat(F.slice(found, 1, 5), F.slice(caps, 1, 5)), 0.3 * F.size(found) + 0.1 * F.size(caps) + 0.1 * marks)

    return let(F.struct(phrase_hits(t, phrases, low).alias("found"), F.regexp_extract_all(text, F.lit(CAPS), F.lit(0)).alias("caps")), judged)


def urls(t: Column) -> Column:
    text = text_or_empty(t)
    return F.when(F.contains(text, F.lit("://")), count_of(text, URL)).otherwise(0)


def unsourced(t: Column) -> Column:
    links, named = urls(t), named_sources(text_or_empty(t))
    fired = (links == 0) & (named == 0)
    evidence = F.array(F.concat(F.lit("urls="), links.cast("string")), F.concat(F.lit("named_sources="), named.cast("string")))
    return hit("MISS", fired, evidence, fired.cast("double"))


def unanchored_quote(t: Column, least_words: int = 8) -> Column:
    long = F.filter(quotes(t), lambda q: F.size(F.regexp_extract_all(q, F.lit(r"[^\s\p{Z}]+"), F.lit(0))) >= least_words)

    def judged(found: Column) -> Column:
        fired = (F.size(found) > 0) & (urls(t) == 0)
        return hit("FAB", fired, F.slice(F.transform(found, lambda q: F.substring(q, 1, 120)), 1, 2), fired.cast("double"))

    return let(long, judged)


def by_patterns(code: str, t: Column, patterns: Sequence[str] | None = None, low: Column | None = None, may: Column | None = None) -> Column:
    own = L.PATTERNS[code] if patterns is None else patterns
    weight, kept = L.WEIGHTS[code]
    found = pattern_hits(t, own, low) if own else literals([])
    if may is not None:
        found = F.when(F.array_contains(may, code), found).otherwise(literals([]))

    def judged(found: Column) -> Column:
        fired = F.size(found) > 0
        return hit(code, fired, F.slice(found, 1, kept), fired.cast("double") if code == "IMP" else weight * F.size(found))

    return let(found, judged)


def detectors(
    t: Column,
    emotive_words: Sequence[str] = L.EMOTIVE,
    urgent_phrases: Sequence[str] = L.URGENT,
    patterns: dict[str, Sequence[str]] | None = None,
    low: Column | None = None,
    may: Column | None = None,
) -> dict[str, Column]:
    """All detectors by code, in detector order; ``low`` is the lower-cased text and ``may`` the codes of ``literal_gate``, where they are at hand."""
    own = patterns or {}
    made = {"EMO": emotive(t, emotive_words, low), "URG": urgent(t, urgent_phrases, low), "MISS": unsourced(t), "FAB": unanchored_quote(t)}
    made |= {code: by_patterns(code, t, own.get(code), low, may) for code in L.PATTERNS}
    return {code: made[code] for code in L.CODES}


def literal_gate(low: Column, emotive_words: Sequence[str] = L.EMOTIVE, urgent_phrases: Sequence[str] = L.URGENT, patterns: dict[str, Sequence[str]] | None = None) -> Column:
    """The codes whose words, phrases or patterns a text may hold, by one search for the literals of all."""
    own = {code: (patterns or {}).get(code, ps) for code, ps in L.PATTERNS.items()}
    groups = {code: literal_group(ps) if ps else () for code, ps in own.items()}
    return gate(low, groups | {"EMO": tuple(START + w for w in emotive_words if w), "URG": tuple(p for p in urgent_phrases if p)})


def indicator_map(t: Column, **options) -> Column:
    """code to hit; empty for empty text."""

    def build(low: Column) -> Column:
        made = lambda may: F.map_from_entries(F.array(*[F.struct(F.lit(code), h) for code, h in detectors(t, low=low, may=may, **options).items()]))
        return let(literal_gate(low, **options), made)

    full = let(F.lower(text_or_empty(t)), build)
    return F.when(text_or_empty(t) != "", full).otherwise(F.map_filter(full, lambda k, v: F.lit(False)))


def fires(code: str, t: Column, low: Column, emotive_words: Sequence[str], urgent_phrases: Sequence[str], patterns: Sequence[str]) -> Column:
    """Whether a detector fires, told by a search that ends at the first match where that will do."""
    if code == "EMO":
        return emotive(t, emotive_words, low)["fired"]
    if code == "URG":
        return low.rlike(trie_pattern(sorted({p for p in urgent_phrases if p}))) if urgent_phrases else F.lit(False)
    return may_match(low, patterns) & text_or_empty(t).rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def fired_codes(t: Column, emotive_words: Sequence[str] = L.EMOTIVE, urgent_phrases: Sequence[str] = L.URGENT, patterns: dict[str, Sequence[str]] | None = None) -> Column:
    """The codes that fire, in detector order."""
    text = text_or_empty(t)
    marks = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    loud = (marks >= 3) | text.rlike(rf"(?s)(?:{CAPS}.*?){{3}}")

    def build(low: Column) -> Column:
        def codes(may: Column) -> Column:
            own = {"MISS": unsourced(t)["fired"], "FAB": unanchored_quote(t)["fired"]}
            for code in ("EMO", "URG", *L.PATTERNS):
                exact = fires(code, t, low, emotive_words, urgent_phrases, (patterns or {}).get(code, L.PATTERNS.get(code, ())))
                own[code] = F.array_contains(may, code) & exact
            own["URG"] = own["URG"] | loud
            return compact(*[F.when(own[code], F.lit(code)) for code in L.CODES])

        return let(literal_gate(low, emotive_words, urgent_phrases, patterns), codes)

    return F.when(text != "", let(F.lower(text), build)).otherwise(literals([]))


def named_features(t: Column, **options) -> Column:
    """A flat map: ``ind_<code>_fired``, ``ind_<code>_score`` and the structural features."""

    def named(low: Column, may: Column) -> Column:
        pairs: list[Column] = []
        for code, h in detectors(t, low=low, may=may, **options).items():
            pairs += [F.lit(f"ind_{code.lower()}_fired"), h["fired"].cast("double"), F.lit(f"ind_{code.lower()}_score"), h["score"]]
        for name, value in structural_features(t).items():
            pairs += [F.lit(name), value.cast("double")]
        return F.create_map(*pairs)

    return let(F.lower(text_or_empty(t)), lambda low: let(literal_gate(low, **options), lambda may: named(low, may)))


def families(codes: Column) -> Column:
    """The sorted distinct technique families of codes."""
    lookup = F.create_map(*[F.lit(x) for pair in L.FAMILIES.items() for x in pair])
    return F.array_sort(F.array_distinct(F.transform(codes, lambda c: lookup[c])))
