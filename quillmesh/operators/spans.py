"""Spans in text: find, select, replace, encode by first appearance, and gate by allow- and blocklists.

Everything is pure Catalyst. A text is split at the matches of a pattern, the
groups of the matches are extracted beside, and running sums of their lengths
give offsets; a replacement zips the parts together again with a value mapped
from each match. Patterns stand in three groups (before, name, after) and mark
word boundaries as ``@<`` and ``@>``; white space means any Unicode space.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import keep_lists as K
from quillmesh.functions import lexicons as L
from quillmesh.functions.arrays import let, literals, running, trie_pattern
from quillmesh.functions.hashing import stable_index
from quillmesh.functions.policies import place_category
from quillmesh.functions.text import index_code, text_or_empty
from quillmesh.operators.ranking import first_appearance

# Titles, particles, name shapes and the words that are never names.
TITLE = (
    r"(?:Mr|Mrs|Ms|Miss|Dr|Sen|Senator|Mayor|President|VP|Vice\s+President|Gov|Governor|Rep|Representative|Cong|Congressman|Congresswoman|"
    r"Councilor|Councillor|Atty|Hon|Honorable)"
)
CAPWORD = r"[A-Z][a-z][A-Za-zÀ-ÿ'’-]{1,}"
PARTICLE = r"(?:si|kay|kina|ni|ng|ang)"
NON_NAMES = (
    "Ang", "Ng", "Mga", "Ito", "Iyon", "Iyan", "Hindi", "Oo", "The", "This", "That", "These", "Those", "It", "He", "She", "They", "Breaking",
    "Update", "Report", "News", "Statement", "Balita", "Ulat", "Trending", "Viral", "Babala", "Paalala", "Election", "Campaign", "Survey",
    "Debate", "Result", "Results", "Official", "Department", "Office", "Council", "Senate", "Congress", "Committee", "Court", "Commission",
    "Bureau", "Agency", "Philippines", "Manila", "Cebu", "Davao", "Quezon", "Makati", "Pampanga", "Bulacan", "Rizal", "Tagum", "Bicol",
    "Mabilis", "Bukas", "Lunes", "Martes", "Miyerkules", "Huwebes", "Biyernes", "Sabado", "Linggo", "Enero", "Pebrero", "Marso", "Abril",
    "Mayo", "Hunyo", "Hulyo", "Agosto", "Setyembre", "Oktubre", "Nobyembre", "Disyembre", "January", "February", "March", "April", "May",
    "June", "July", "August", "September", "October", "November", "December", "Facebook", "Twitter", "YouTube", "TikTok", "Instagram",
    "WhatsApp", "Viber", "Telegram", "Messenger", "Filipino", "Pilipino", "Tagalog", "English", "American", "Christian", "Muslim", "Catholic",
)
#: What a redacted name becomes by default.
REDACTION = "[Iba pang tao]"
# Generic roles that stand in for names.
ROLES = (
    "isang opisyal ng gobyerno", "isang dating opisyal", "isang kongresista", "isang dating kongresista", "isang senador", "isang dating senador",
    "isang kalihim", "isang spokesperson", "isang miyembro ng oposisyon", "isang abogado", "isang abogado ng kampo", "isang miyembro ng partido",
    "isang influencer", "isang vlogger", "isang reporter", "isang testigo", "isang anonymous na source", "isang fact-checker", "isang researcher",
    "isang campaign manager", "isang dating empleyado", "isang nakakakilala sa kandidato",
)
NAME = rf"{CAPWORD}(?:\s+{CAPWORD}){{0,3}}"
MULTIWORD = rf"{CAPWORD}(?:\s+{CAPWORD}){{1,3}}"


class Pattern(NamedTuple):
    """A name with what stands before and after it, in the notation of this module."""

    name: str
    before: str
    own: str
    after: str = "@>"

    def groups(self, start: str, end: str, space: str) -> str:
        whole = f"({self.before})({self.own})({self.after})"
        return whole.replace("@<", start).replace("@>", end).replace(r"\s", space)

    @property
    def java(self) -> str:
        return self.groups(r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])", r"[\s\p{Z}]")


# Person patterns.
PERSON = (
    Pattern("title_name", rf"@<{TITLE}\.?\s+", NAME),
    Pattern("particle_title_name", rf"@<(?:si|kay|kina|ni)\s+(?:{TITLE}\.?\s+)?", NAME),
    Pattern("multiword_alone", "@<", MULTIWORD),
    Pattern("said_surname", "@<", CAPWORD, r"@>\s+(?:said|sabi|ayon|nagsalita|ipinahayag|ipinakita|pahayag)"),
    Pattern("according_to", rf"@<(?:According to|according to|Ayon kay|ayon kay|Sinabi ni|sinabi ni)\s+(?:{TITLE}\.?\s+)?", NAME),
    Pattern("comma_attribution", r",\s+", CAPWORD, r"\s*,"),
)
# Patterns of names that are counted for a blocklist.
COUNTED = (Pattern("title", rf"@<{TITLE}\.?\s+", MULTIWORD), Pattern("particle", rf"@<{PARTICLE}\s+", MULTIWORD), Pattern("alone", "@<", MULTIWORD))
SPAN = "struct<start:int,end:int,entity:string>"


def pattern_parts(t: Column, p: Pattern) -> Column:
    """The matches of a pattern in order, as structs (gap, before, own, after); gap is the text since the match before."""
    group = lambda k: F.regexp_extract_all(t, F.lit(p.java), F.lit(k))
    return let(group(2), lambda own: F.arrays_zip(F.slice(F.split(t, p.java, -1), F.lit(1), F.size(own)).alias("gap"), group(1).alias("before"), own.alias("own"), group(3).alias("after")))


def pattern_spans(t: Column, p: Pattern) -> Column:
    """The names that a pattern finds, with start and end in code points."""

    def place(rows: Column) -> Column:
        length = lambda r: F.length(r["gap"]) + F.length(r["before"]) + F.length(r["own"]) + F.length(r["after"])
        ends = running(F.transform(rows, length), lambda a, n: a + n, F.lit(0), "int")

        def span(r: Column) -> Column:
            end = r["stop"] - F.length(r["r"]["after"])
            return F.struct((end - F.length(r["r"]["own"])).alias("start"), end.alias("end"), r["r"]["own"].alias("entity"))

        return F.transform(F.arrays_zip(rows.alias("r"), ends.alias("stop")), span)

    # one search, which ends at the first match, spares most texts the rest
    return F.when(t.rlike(p.java), let(pattern_parts(t, p), place)).otherwise(F.array().cast(f"array<{SPAN}>"))


def alternation(terms: Sequence[str]) -> str:
    """A pattern of whole terms, the longest at a place, without regard to case."""
    return f"(?iu)(?<![A-Za-z0-9])(?:{trie_pattern(sorted(set(terms)))})(?![A-Za-z0-9])"


def replace_matches(t: Column, pattern: str, value: Callable[[Column], Column]) -> Column:
    """Every match replaced by ``value`` of it."""
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    parts = F.split(t, pattern, -1)
    joined = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda p, m: F.concat(p, value(m)))
    return F.when(F.size(found) > 0, F.concat(F.array_join(joined, ""), F.element_at(parts, -1))).otherwise(t)


def match_starts(t: Column, pattern: str) -> Column:
    """Matches with their start and end in code points."""

    def place(found: Column) -> Column:
        rows = F.zip_with(F.slice(F.split(t, pattern, -1), F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
        ends = running(rows, lambda a, n: a + n, F.lit(0), "int")
        return F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("entity")))

    return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), place)


def leftmost_longest(spans: Column) -> Column:
    """The greedy choice of spans that do not overlap: by start, the longer first."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("n"), s["end"].alias("end"), s["entity"].alias("entity")))

    def pick(ordered: Column) -> Column:
        # the end of the last span taken; a span is taken where it begins at or after the one before
        reach = running(ordered, lambda last, s: F.when(s["start"] < last, last).otherwise(s["end"]), F.lit(-1), "int")
        rows = F.arrays_zip(ordered.alias("s"), F.slice(F.concat(F.array(F.lit(-1)), reach), F.lit(1), F.size(ordered)).alias("last"))
        taken = F.filter(rows, lambda r: r["s"]["start"] >= r["last"])
        return F.transform(taken, lambda r: F.struct(r["s"]["start"].alias("start"), r["s"]["end"].alias("end"), r["s"]["entity"].alias("entity")))

    return let(F.array_sort(keyed), pick)


def replace_spans(t: Column, spans: Column, value: Callable[[Column], Column]) -> Column:
    """The text with spans, which are in order and do not overlap, replaced by ``value`` of each."""

    def join(chosen: Column) -> Column:
        rows = F.arrays_zip(chosen.alias("s"), F.slice(F.concat(F.array(F.lit(0)), F.transform(chosen, lambda s: s["end"])), F.lit(1), F.size(chosen)).alias("before"))
        pieces = F.transform(rows, lambda r: F.concat(F.substring(t, r["before"] + 1, r["s"]["start"] - r["before"]), value(r["s"])))
        tail = F.substring(t, F.element_at(chosen, -1)["end"] + 1, F.length(t))
        return F.when(F.size(chosen) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(t)

    return let(spans, join)


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: ~((span["end"] <= o["start"]) | (span["start"] >= o["end"])))


def place_codes(df: DataFrame, key: str, text: str, places: Sequence[str]) -> DataFrame:
    """(entity, category, index, pseudonym) of the places that occur, by first appearance within a category.

    ``places`` is a blocklist passed as a parameter; the result has a row for each at most.
    """
    found = df.select(F.col(key).alias("row"), F.posexplode(F.regexp_extract_all(text_or_empty(F.col(text)), F.lit(alternation(places)), F.lit(0))).alias("pos", "m"))
    items = found.select(F.lower("m").alias("entity"), place_category(F.col("m")).alias("category"), "row", "pos")
    codes = first_appearance(items, "entity", ["row", "pos"], "category")
    pooled, overflow = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, pool in L.PLACE_POOLS.items():
        base = pool[0].rstrip(" WXYZVUTSRQ")
        here = F.col("category") == kind
        pooled = F.when(here, F.try_element_at(literals(pool), (F.col("index") + 1).cast("int"))).otherwise(pooled)
        overflow = F.when(here, F.concat(F.lit(f"{base} "), (F.col("index") + 1).cast("string"))).otherwise(overflow)
    constant = F.lit(None).cast("string")
    for kind, name in L.PLACE_CONSTANTS.items():
        constant = F.when(F.col("category") == kind, name).otherwise(constant)
    return codes.select("entity", "category", "index", F.coalesce(constant, pooled, overflow).alias("pseudonym"))


def pseudonymise_places(df: DataFrame, key: str, text: str, places: Sequence[str]) -> DataFrame:
    """``df`` with places replaced and n_places, the number of replacements."""
    codes = place_codes(df, key, text, places)
    # one row of at most len(places) entries
    table = codes.agg(F.map_from_entries(F.collect_list(F.struct("entity", "pseudonym"))).alias("__map"))
    t, pattern = text_or_empty(F.col(text)), alternation(places)

    def rewrite(found: Column) -> Column:
        parts = F.split(t, pattern, -1)
        joined = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda p, m: F.concat(p, F.coalesce(F.col("__map")[F.lower(m)], m)))
        whole = let(parts, lambda ps: F.element_at(ps, -1))
        return F.struct(F.when(F.size(found) > 0, F.concat(F.array_join(joined, ""), whole)).otherwise(t).alias("text"), F.size(found).alias("n"))

    done = df.crossJoin(F.broadcast(table)).withColumn("__r", let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), rewrite))
    return done.withColumn("n_places", F.col("__r.n")).withColumn(text, F.col("__r.text")).drop("__map", "__r")


def counted_names(df: DataFrame, text: str, least: int = 1, patterns: Sequence[Pattern] = COUNTED) -> DataFrame:
    """(name, n): names by all patterns; a name counts once for each pattern that finds it."""
    t = text_or_empty(F.col(text))
    found = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p.java), F.lit(2)) for p in patterns]))
    names = df.select(F.explode(found).alias("name"))
    real = names.filter(~F.forall(F.split("name", r"[\s\p{Z}]+"), lambda w: w.isin(list(NON_NAMES))))
    return real.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def person_spans(t: Column, patterns: Sequence[Pattern] = PERSON, non_names: Sequence[str] = K.GATE_NON_NAMES) -> Column:
    """Person-like spans of a text, distinct by place, in order of start, longer first, with the first pattern that finds them."""
    text, stop = text_or_empty(t), list(non_names)

    def named(k: int, p: Pattern) -> Column:
        made = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("n"), F.lit(k).alias("k"), s["entity"].alias("entity"), F.lit(p.name).alias("pattern"))
        return F.transform(pattern_spans(text, p), made)

    real = lambda s: ~(s["entity"].isin(stop) | F.forall(F.split(s["entity"], r"[\s\p{Z}]+"), lambda w: w.isin(stop)))
    found = F.filter(F.concat(*[named(k, p) for k, p in enumerate(patterns)]), real)

    def distinct(ordered: Column) -> Column:
        same = lambda s, i: (i > 0) & (F.try_element_at(ordered, i)["start"] == s["start"]) & (F.try_element_at(ordered, i)["n"] == s["n"])
        first = F.filter(ordered, lambda s, i: ~F.coalesce(same(s, i), F.lit(False)))
        return F.transform(first, lambda s: F.struct(s["start"].alias("start"), (-s["n"]).alias("end"), s["entity"].alias("entity"), s["pattern"].alias("pattern")))

    return let(F.array_sort(found), distinct)


def classify(spans: Column, allowed: Sequence[str], blocked: Sequence[str], organisations: Sequence[str] = K.ORGANISATIONS) -> Column:
    """Each span with status: allowed, blocklist, unknown_name, or null for short single words.

    A span is allowed if any run of its words is on the allowlist or names an organisation, which both come first.
    """
    known = sorted({*allowed, *organisations})
    from quillmesh.functions.arrays import any_in, sub_ngrams
    from quillmesh.functions.text import norm_lower

    def status(s: Column) -> Column:
        words = F.split(norm_lower(s["entity"]), " ")
        return (
            F.when(any_in(sub_ngrams(words), known), "allowed")
            .when(any_in(F.array_append(words, norm_lower(s["entity"])), blocked), "blocklist")
            .when((F.size(words) >= 2) | (F.length(words[0]) >= 4), "unknown_name")
        )

    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity"].alias("entity"), s["pattern"].alias("pattern"), status(s).alias("status")))


def blocklist_hits(t: Column, blocked: Sequence[str]) -> Column:
    """Direct mentions of single blocked words of four letters or more."""
    single = [b for b in blocked if " " not in b and len(b) >= 4]
    return match_starts(text_or_empty(t), alternation(single)) if single else F.array().cast("array<struct<start:int,end:int,entity:string>>")


def redact(t: Column, spans: Column, mark: str = REDACTION) -> Column:
    """The text with the selected spans replaced; of overlapping spans the first and longest counts."""
    return replace_spans(t, leftmost_longest(spans), lambda s: F.lit(mark))


def strict_gate(
    df: DataFrame, text: str, allowed: Sequence[str], blocked: Sequence[str], mark: str = REDACTION, organisations: Sequence[str] = K.ORGANISATIONS
) -> DataFrame:
    """``df`` with foreign spans, accepted (none of them) and redacted, the text without them.

    A direct mention inside an allowed or foreign person span does not count again.
    """
    t = text_or_empty(F.col(text))
    allow, orgs = sorted({a.lower() for a in allowed}), sorted({o.lower() for o in organisations})
    direct_words = [b for b in blocked if b not in allow and b not in orgs]
    marked = df.withColumn("__s", classify(person_spans(F.col(text)), allow, blocked, orgs)).withColumn("__b", blocklist_hits(F.col(text), direct_words))
    held = F.filter("__s", lambda s: s["status"].isNotNull())
    inside = lambda b: F.exists(held, lambda s: (b["start"] >= s["start"]) & (b["end"] <= s["end"]))
    made = lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["entity"].alias("entity"), F.lit("blocklist_direct").alias("pattern"), F.lit("blocklist").alias("status"))
    direct = F.transform(F.filter("__b", lambda b: ~inside(b)), made)
    foreign = F.concat(F.filter(held, lambda s: s["status"] != "allowed"), direct)
    return marked.withColumn("foreign", foreign).withColumn("accepted", F.size("foreign") == 0).withColumn("redacted", redact(t, F.col("foreign"), mark)).drop("__s", "__b")


def gate_summary(gated: DataFrame) -> DataFrame:
    """One row on a gate's run: n_input, n_kept, n_rejected, redactions and pass_rate_pct."""
    kept = F.count_if("accepted")
    return gated.agg(
        F.count("*").alias("n_input"), kept.alias("n_kept"), F.count_if(~F.col("accepted")).alias("n_rejected"), F.coalesce(F.sum(F.size("foreign")), F.lit(0)).alias("redactions"),
        F.round(100.0 * kept / F.greatest(F.count("*"), F.lit(1)), 2).alias("pass_rate_pct"),
    )


def foreign_names(gated: DataFrame, most: int = 50) -> DataFrame:
    """(name, reason, n): the names that a gate found foreign most often."""
    from quillmesh.functions.text import norm_lower

    each = gated.select(F.explode("foreign").alias("f")).select(norm_lower(F.col("f.entity")).alias("name"), F.col("f.status").alias("reason"))
    return each.groupBy("name", "reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name", "reason").limit(most)


def foreign_examples(gated: DataFrame, key: str, text: str, most: int = 50, around: int = 30) -> DataFrame:
    """(key, name, pattern, reason, context): the first foreign spans by key and place, with the text around them."""
    from quillmesh.functions.text import snippet

    each = gated.select(F.col(key), F.col(text), F.explode("foreign").alias("f"))
    shown = each.select(key, F.col("f.start").alias("start"), F.col("f.entity").alias("name"), F.col("f.pattern").alias("pattern"), F.col("f.status").alias("reason"), snippet(F.col(text), F.col("f.start"), F.col("f.end"), around).alias("context"))
    return shown.orderBy(key, "start", "name", "pattern").limit(most).drop("start")


def pseudonymise_people(df: DataFrame, key: str, text: str, prefix: str = "Entity", keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with person names replaced, mapping): names coded by first appearance over all rows.

    Names are joined back by row, so the mapping may be of any size.
    """
    t = text_or_empty(F.col(text))
    protected = match_starts(t, alternation(keep)) if keep else F.array().cast("array<struct<start:int,end:int,entity:string>>")
    found = df.select(key, t.alias("__t"), leftmost_longest(F.filter(person_spans(F.col(text)), lambda s: ~overlaps(s, protected))).alias("__s"))
    each = found.select(F.col(key).alias("row"), F.posexplode("__s").alias("pos", "s")).select("row", "pos", F.col("s.entity").alias("entity"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    mapping = first_appearance(each, "entity", ["row", "pos"]).select("entity", F.concat(F.lit(f"{prefix} "), index_code(F.col("index"))).alias("code"))
    coded = each.join(mapping, "entity").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "code"))).alias("__c"))
    joined = found.join(coded, found[key] == coded["row"], "left")
    spans = F.coalesce("__c", F.array().cast("array<struct<start:int,end:int,code:string>>"))
    return joined.select(key, replace_spans(F.col("__t"), spans, lambda s: s["code"]).alias("pseudonymised")), mapping


# Passes of the universal rewrite.
REWRITE_TITLE = (
    r"(?:Pres(?:ident)?\.?|Sen(?:ator)?\.?|Rep(?:resentative)?\.?|Mayor|Gov(?:ernor)?\.?|Sec(?:retary)?\.?|VP|Vice\s*Pres(?:ident)?|Vice[-\s]+Mayor|"
    r"Cong(?:ressman)?\.?|Atty\.?|Dr\.?|Mr\.?|Mrs\.?|Ms\.?)"
)
PASSES = (
    Pattern("title", rf"@<{REWRITE_TITLE}\s+", r'[A-Z][a-z]+(?:\s+"[A-Z][a-z]+")?(?:\s+[A-Z][a-z]+){0,3}'),
    Pattern("particle", r"@<(?:si|kay|kina|ni|nina)\s+", r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}"),
    Pattern("two_word", "@<", r"[A-Z][a-z]{2,}\s+[A-Z][a-z]{2,}"),
    Pattern("context", r"@<(?:ayon kay|ayon sa|sabi ni|sinabi ni|paliwanag ni|pahayag ni|dagdag ni|sambit ni|wika ni|banat ni)\s+", r"[A-Z][a-z]{2,}"),
    Pattern("bare_single", r"\s", r"[A-Z][a-z]{3,}"),
)
#: What a bare name stands behind, before one white space.
BEFORE_BARE = r'[a-z,"”(]\z'
PARTICLES = r"^(?:si|kay|kina|ni|nina)"


def collapse_repeats(t: Column, full: str, short: str) -> Column:
    """Every mention of a full name after the first becomes its short form."""
    parts = F.split(t, alternation([full]), 2)
    rest = F.regexp_replace(F.element_at(parts, -1), alternation([full]), short)
    return F.when(F.size(parts) > 1, F.concat(parts[0], F.lit(full), rest)).otherwise(t)


#: Goes into the hash that chooses a role; another seed gives other roles.
SEED = "roles"


def role_for(name: Column, roles: Sequence[str] = ROLES, seed: str = SEED) -> Column:
    """The role that stands in for a name, whatever its case, under a seed."""
    return F.element_at(literals(roles), (stable_index(F.concat(F.lit(f"{seed}:"), F.lower(name)), len(roles)) + 1).cast("int"))


class Keep(NamedTuple):
    """Names that a rewrite leaves alone: canonical tokens anywhere in a name, places and institutions at its head, and whole names of any list."""

    canonical: Sequence[str] = K.CANONICAL_TOKENS
    places: Sequence[str] = K.PLACES
    institutions: Sequence[str] = K.INSTITUTIONS
    words: Sequence[str] = (*K.SENTENCE_STARTS, *K.FUNCTION_WORDS, *K.COMMON_WORDS)

    def every(self) -> list[str]:
        return sorted({*self.canonical, *self.places, *self.institutions, *self.words})

    def anchors(self) -> list[str]:
        return sorted({*self.places, *self.institutions})

    def spares(self, name: Column) -> Column:
        parts = F.split(name, r"[\s\p{Z}]+")
        return F.exists(parts, lambda w: w.isin(list(self.canonical))) | name.isin(self.every()) | F.element_at(parts, 1).isin(self.anchors())


def _pass(t: Column, p: Pattern, keep: Keep, roles: Sequence[str], seed: str) -> Column:
    """(text, n): one pass of the rewrite."""

    def around(rows: Column, i: Column) -> tuple[Column, Column]:
        """The text before a match back to the match before it, and after it to the next match, both included."""
        whole = lambda r: F.concat(r["before"], r["own"], r["after"])
        last, next_ = F.try_element_at(rows, i), F.try_element_at(rows, i + 2)
        here = F.element_at(rows, i + 1)
        tail = F.element_at(F.split(t, p.java, -1), -1)
        return F.concat(F.when(i > 0, F.coalesce(whole(last), F.lit(""))).otherwise(""), here["gap"]), F.coalesce(F.concat(next_["gap"], whole(next_)), tail)

    def stays(rows: Column, r: Column, i: Column) -> Column:
        name = r["own"]
        out = keep.spares(name)
        if p.name == "two_word":
            before, after = around(rows, i)
            # the capitalised word before, and the one after, in the fifty characters that follow
            previous = F.regexp_extract(before, r"(?<![\p{L}\p{N}_])([A-Z][a-z]+|[A-Z]{2,})[\s\p{Z}]*\z", 1)
            following = F.regexp_extract(F.substring(after, 1, 50), r"^[\s\p{Z}]+([A-Z][a-z]+)", 1)
            out = out | F.exists(F.split(name, r"[\s\p{Z}]+"), lambda w: w.isin(keep.every())) | previous.isin(keep.anchors()) | following.isin(sorted(keep.institutions))
        if p.name == "bare_single":
            before, _ = around(rows, i)
            out = out | ~before.rlike(BEFORE_BARE)
        return out

    def swap(r: Column) -> Column:
        role = role_for(r["own"], roles, seed)
        if p.name == "particle":
            return F.concat(F.regexp_extract(r["before"], PARTICLES, 0), F.lit(" "), role, r["after"])
        return F.concat(role, r["after"]) if p.name in ("title", "two_word") else F.concat(r["before"], role, r["after"])

    def rewrite(rows: Column) -> Column:
        marked = F.transform(rows, lambda r, i: F.struct(r.alias("r"), stays(rows, r, i).alias("stays")))

        def join(ms: Column) -> Column:
            pieces = F.transform(ms, lambda m: F.concat(m["r"]["gap"], F.when(m["stays"], F.concat(m["r"]["before"], m["r"]["own"], m["r"]["after"])).otherwise(swap(m["r"]))))
            text = F.concat(F.array_join(pieces, ""), F.element_at(F.split(t, p.java, -1), -1))
            return F.struct(text.alias("text"), F.size(F.filter(ms, lambda m: ~m["stays"])).alias("n"))

        return let(marked, join)

    return F.when(t.rlike(p.java), let(pattern_parts(t, p), rewrite)).otherwise(F.struct(t.alias("text"), F.lit(0).alias("n")))


def universal_rewrite(t: Column, keep: Keep = Keep(), roles: Sequence[str] = ROLES, seed: str = SEED) -> Column:  # noqa: B008
    """(text, n): names replaced by generic roles, pass after pass, and white space tidied; names that ``keep`` spares stay."""

    def chain(state: Column, rest: Sequence[Pattern]) -> Column:
        if not rest:
            return F.struct(F.regexp_replace(F.btrim(F.regexp_replace(state["text"], r"[\s\p{Z}]+", " ")), r"[\s\p{Z}]+([.,;:!?])", "$1").alias("text"), state["n"].alias("n"))
        done = lambda s: let(_pass(s["text"], rest[0], keep, roles, seed), lambda d: F.struct(d["text"].alias("text"), (s["n"] + d["n"]).alias("n")))
        return let(done(state), lambda s: chain(s, rest[1:]))

    start = F.struct(text_or_empty(t).alias("text"), F.lit(0).alias("n"))
    return let(start, lambda s: chain(s, PASSES))
