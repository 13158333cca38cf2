"""Real names in cards: detection, one candidate for each name over all rows, and the chain that cleans a card."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import lexicons as L
from quillmesh.functions.arrays import let, literals, trie_pattern
from quillmesh.functions.hashing import stable_index
from quillmesh.functions.indicators import fired_codes
from quillmesh.functions.policies import archetype, lookup
from quillmesh.functions.text import preview, squeeze, text_or_empty

START, END, SPACE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])", r"[\s\p{Z}]"
#: Goes into the hash that chooses a candidate where no cue does.
SALT = "candidates"
# Titles with names, and surnames that are names on their own.
TITLED = (
    rf"{START}(?:Pres(?:ident)?\.?|Sen(?:ator)?\.?|Rep(?:resentative)?\.?|Mayor|Gov(?:ernor)?\.?|Sec(?:retary)?\.?|VP|Vice{SPACE}*Pres(?:ident)?|"
    rf"Vice[-\s\p{{Z}}]+Mayor|Cong\.?|Atty\.?){SPACE}+[A-Z][a-z]+(?:{SPACE}+[A-Z][a-z]+){{0,2}}{END}"
)
SURNAMES = (
    "Marcos", "Duterte", "Robredo", "Pacquiao", "Moreno", "Lacson", "Sotto", "Aquino", "Estrada", "Binay", "Roxas", "Trillanes", "Hontiveros", "Pangilinan", "Villar", "Cayetano", "Recto",
    "Gordon", "Drilon", "Enrile", "Honasan", "Poe", "Pimentel", "Escudero", "Legarda", "Zubiri", "Tolentino", "Diokno", "Gatchalian", "BBM", "Leni",
)


class Candidate(NamedTuple):
    """A fictional candidate: code, full and short name, archetype, and the quoted nicknames of others to drop beside it."""

    code: str
    name: str
    short: str
    archetype: str
    strays: Sequence[str] = ()


def detected_names(t: Column, surnames: Sequence[str] = SURNAMES) -> Column:
    """Titled names and known surnames of a text, those within a longer one left out, the longest first."""
    text = text_or_empty(t)
    known = rf"{START}(?:{trie_pattern(sorted(surnames))}){END}"
    found = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(TITLED), F.lit(0)), F.regexp_extract_all(text, F.lit(known), F.lit(0))))
    outer = let(found, lambda xs: F.filter(xs, lambda x: ~F.exists(xs, lambda y: (y != x) & F.contains(y, x))))
    return F.transform(F.array_sort(F.transform(outer, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])


def candidate_of(t: Column, name: Column, registry: Sequence[Candidate], cues: dict[str, Sequence[str]] = L.ARCHETYPES) -> Column:
    """The code for a text: by its archetype, else by a stable hash of the name or of the text's head."""
    key = F.coalesce(name, F.nullif(preview(t, 80), F.lit("")), F.lit("1729"))
    rotated = F.element_at(literals([c.code for c in registry]), (stable_index(F.concat(F.lit(f"{SALT}|"), key), len(registry)) + 1).cast("int"))
    return F.coalesce(lookup(archetype(t, cues), {c.archetype: c.code for c in reversed(registry)}), rotated)


def rename_real(df: DataFrame, key: str, text: str, registry: Sequence[Candidate], surnames: Sequence[str] = SURNAMES, cues: dict[str, Sequence[str]] = L.ARCHETYPES) -> DataFrame:
    """(key, text, candidate, replaced): real names replaced by candidates' names.

    A name goes to one candidate in all rows: that of the first row, by key,
    that holds it. A row takes the candidate of its last name, or its own where
    it has none.
    """
    rows = df.select(F.col(key), text_or_empty(F.col(text)).alias("__t")).withColumn("__n", detected_names(F.col("__t"), surnames))
    each = rows.filter(F.size("__n") > 0).select(key, "__t", F.posexplode("__n").alias("pos", "name"))
    first = each.groupBy("name").agg(F.min_by("__t", key).alias("first"))
    chosen = first.select("name", candidate_of(F.col("first"), F.col("name"), registry, cues).alias("code"))
    own = each.select(key, "pos", "name").join(chosen, "name").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "code"))).alias("__c"))
    names = {c.code: c.name for c in registry}
    joined = rows.join(own, key, "left")
    swapped = F.aggregate("__c", F.col("__t"), lambda acc, c: F.replace(acc, c["name"], lookup(c["code"], names)))
    code = F.coalesce(F.try_element_at("__c", F.lit(-1))["code"], candidate_of(F.col("__t"), F.lit(None).cast("string"), registry, cues))
    return joined.select(key, F.coalesce(swapped, F.col("__t")).alias(text), code.alias("candidate"), F.col("__n").alias("replaced"))


PLACEHOLDER = rf"{START}Candidate{SPACE}+[A-Z]{{1,3}}{END}"


def tidy_names(t: Column, code: Column, registry: Sequence[Candidate]) -> Column:
    """A text that speaks of one candidate: placeholders and other candidates become that one, named in full once, without strays."""
    out = t
    for own in registry:
        text = F.regexp_replace(t, PLACEHOLDER, own.name)
        for other in registry:
            if other.code != own.code:
                text = F.replace(text, F.lit(other.name), F.lit(own.name))
                if other.short != own.short:
                    text = F.regexp_replace(text, f"{START}{trie_pattern([other.short])}{END}", own.short)
        once = let(F.split(text, trie_pattern([own.name]), 2), lambda parts: F.when(F.size(parts) > 1, F.concat(parts[0], F.lit(own.name), F.replace(parts[1], F.lit(own.name), F.lit(own.short)))).otherwise(parts[0]))
        for stray in own.strays:
            once = F.regexp_replace(once, rf'{SPACE}*"{stray}"{SPACE}*', " ")
        out = F.when(code == own.code, squeeze(once)).otherwise(out)
    return out


def rename_cards(df: DataFrame, key: str, text: str, verdict: str, fake_percent: str, registry: Sequence[Candidate], cues: dict[str, Sequence[str]] = L.ARCHETYPES) -> DataFrame:
    """``df`` with the chain of a card's renaming: names, placeholders, other candidates, repetitions, strays, indicators, and the verdict's guard.

    A card that is REAL with three indicators or more becomes UNCERTAIN.
    """
    renamed = rename_real(df, key, text, registry, cues=cues)
    rest = df.drop(text, "candidate", "replaced")
    done = renamed.withColumn(text, tidy_names(F.col(text), F.col("candidate"), registry)).withColumn("fired_indicators", fired_codes(F.col(text)))
    joined = rest.drop("fired_indicators").join(done, key)
    demoted = (F.col(verdict) == "REAL") & (F.size("fired_indicators") >= 3)
    percent = F.when(demoted, F.greatest(F.col(fake_percent), F.lit(41.0))).otherwise(F.col(fake_percent))
    return joined.withColumn("alignment_flag", F.when(demoted, "demoted_real_to_uncertain")).withColumn(fake_percent, percent).withColumn(verdict, F.when(demoted, "UNCERTAIN").otherwise(F.col(verdict)))
