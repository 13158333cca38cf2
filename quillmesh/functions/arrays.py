"""Array, map and JSON expressions of the curation operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literals(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def compact(*items: Column) -> Column:
    """An array of the items that are not null, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def by_priority(codes: Column, priority: Sequence[str], most: int = 3) -> Column:
    """Codes in the order of a priority list (others last, in their own order), ``most`` of them."""
    order = literals(list(priority))
    ranked = F.transform(
        codes,
        lambda c, i: F.struct(F.coalesce(F.nullif(F.array_position(order, c).cast("int"), F.lit(0)), F.lit(99)).alias("p"), i.alias("i"), c.alias("c")),
    )
    return F.slice(F.transform(F.array_sort(ranked), lambda x: x["c"]), 1, most)


def fired_from_map(features: Column, prefix: str = "ind_", suffix: str = "_fired", default: str = "MISS") -> Column:
    """Codes whose ``<prefix><code><suffix>`` entry is 1 or more, sorted; the default where none is."""
    keys = F.map_keys(F.map_filter(features, lambda k, v: F.startswith(k, F.lit(prefix)) & F.endswith(k, F.lit(suffix)) & (v >= 1)))
    codes = F.array_sort(F.transform(keys, lambda k: F.upper(F.substring(k, len(prefix) + 1, F.length(k) - len(prefix) - len(suffix)))))
    return F.when(F.size(codes) > 0, codes).otherwise(literals([default]))


def top_by_size(values: Column, most: int = 5) -> Column:
    """Map entries of largest absolute value, ties by key."""
    keyed = F.transform(F.map_entries(values), lambda e: F.struct((-F.abs(e["value"])).alias("a"), e["key"].alias("key"), e["value"].alias("value")))
    return F.slice(F.transform(F.array_sort(keyed), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))), 1, most)


def sub_ngrams(tokens: Column) -> Column:
    """All contiguous runs of the tokens, joined by single spaces."""
    runs = F.transform(
        F.sequence(F.lit(1), F.size(tokens)),
        lambda i: F.transform(F.sequence(i, F.size(tokens)), lambda j: F.array_join(F.slice(tokens, i, j - i + 1), " ")),
    )
    return F.when(F.size(tokens) > 0, F.flatten(runs)).otherwise(F.array().cast("array<string>"))


def any_in(values: Column, allowed: Sequence[str]) -> Column:
    return F.arrays_overlap(values, literals(list(allowed)))


def details(labels: Sequence[str], features: Column) -> Column:
    """A map of code to (label, fired, score) from a flat feature map, 0 where it has no entry."""
    get = lambda k: F.coalesce(F.try_element_at(features, F.lit(k)), F.lit(0.0))
    entries = [F.struct(F.lit(c), F.struct((get(f"ind_{c.lower()}_fired") >= 1).alias("fired"), get(f"ind_{c.lower()}_score").alias("score"))) for c in labels]
    return F.map_from_entries(F.array(*entries))


def unknown_keys(json: Column, known: Sequence[str]) -> Column:
    """Top-level keys of a JSON object that the schema does not know, sorted; null for other text."""
    return F.array_sort(F.array_except(F.json_object_keys(json), literals(list(known))))


def metrics_record(record: Column) -> Column:
    """A map of metrics with ``eval_`` stripped from keys and values as doubles; others are skipped."""
    cast = F.transform_values(F.transform_keys(record, lambda k, v: F.regexp_replace(k, "^eval_", "")), lambda k, v: v.try_cast("double"))
    return F.map_filter(cast, lambda k, v: v.isNotNull())


#: Names under which a run's metrics are kept, and those that stand for them.
SPLITS = {"test": ("test", "test_metrics"), "val": ("val", "eval_metrics")}


def split_metrics(record: Column) -> Column:
    """(test, val): the metrics of a record of maps under any of their names; the query fails on a record without test metrics."""
    test, val = (F.coalesce(*[F.try_element_at(record, F.lit(n)) for n in names]) for names in SPLITS.values())
    checked = F.when(test.isNull(), F.raise_error(F.lit("a record has no test metrics")).cast("map<string,string>")).otherwise(test)
    return F.struct(metrics_record(checked).alias("test"), metrics_record(val).alias("val"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where a lambda inside it uses it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trie_pattern(words: Sequence[str]) -> str:
    """A pattern that matches the longest of the words at a position, branching on one letter at a time."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def build(node: dict) -> str:
        branches = [_quoted(c) + build(node[c]) for c in sorted(k for k in node if k)]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return body + "?" if "" in node else body

    return build(root)


def _quoted(c: str) -> str:
    return c if c.isalnum() or c in " '_" else "\\" + c


def contained(low: Column, words: Sequence[str]) -> Column:
    """The words that a lower-cased text contains, sorted, overlaps included: one pass over the text.

    A look-ahead gives the longest word at every position; a word is contained
    if it begins one of those. Texts that contain none are told by a plain search.
    """
    known = sorted({w for w in words if w})
    if not known:
        return literals([])
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?=({trie_pattern(known)}))"), F.lit(1)))
    held = let(found, lambda ms: F.filter(literals(known), lambda w: F.exists(ms, lambda m: F.startswith(m, w))))
    return F.when(low.rlike(trie_pattern(known)), held).otherwise(literals([]))


#: Elements of an array that are worked on at a time where results are gathered one by one.
BLOCK = 256


def running(values: Column, step: Callable[[Column, Column], Column], start: Column, kind: str) -> Column:
    """The states after each element: step(step(start, v1), v2)... as an array of ``kind``; block by block, so that long arrays stay cheap."""
    none, no_blocks = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, BLOCK))
    within = lambda state, xs: F.aggregate(xs, none, lambda acc, v: F.concat(acc, F.array(step(F.coalesce(F.try_element_at(acc, F.lit(-1)), state), v))))

    def block(acc: Column, xs: Column) -> Column:
        return let(within(acc["state"], xs), lambda made: F.struct(F.element_at(made, -1).alias("state"), F.concat(acc["out"], F.array(made)).alias("out")))

    done = F.aggregate(blocks, F.struct(start.cast(kind).alias("state"), no_blocks.alias("out")), block)
    return F.when(F.size(values) > 0, F.flatten(done["out"])).otherwise(none)
