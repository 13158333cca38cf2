"""Literals that any match of a pattern must contain, found when a plan is made.

A cheap search for them spares most texts the full pattern. The pattern's
syntax tree is walked: pieces that can only be one of few strings are joined,
and the piece whose strings are longest stands for the pattern. A literal that
a pattern can only have at the start of a word is marked and looked for there.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from re import _constants as c
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.arrays import trie_pattern

#: Strings that a piece may stand for, at most.
MOST = 64
#: Shorter literals occur in too many texts to tell anything.
LEAST = 3


#: Marks the start of a word in front of a literal.
START = "\0"


def plain(literal: str) -> str:
    return literal.replace(START, "")


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The set whose shortest string is longer, then one that stands at the start of words, then the smaller set."""
    worth = lambda s: (min(len(plain(x)) for x in s), all(x.startswith(START) for x in s), -len(s)) if s else (-1, False, 0)
    return a if worth(a) >= worth(b) else b


def _some(strings: frozenset[str]) -> frozenset[str] | None:
    """The set, if none of its strings is empty."""
    return strings if all(map(plain, strings)) else None


def _parts_words(op, arg) -> bool:
    """Whether a piece is at least one white space, hyphen or the like, so that a word begins after it."""
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        return arg[0] > 0 and len(arg[2]) == 1 and _parts_words(*arg[2][0])
    if op is c.IN:
        return all((kind is c.CATEGORY and x is c.CATEGORY_SPACE) or (kind is c.LITERAL and not chr(x).isalnum() and x != ord("_")) for kind, x in arg)
    return False


def _walk(items) -> tuple[frozenset[str] | None, frozenset[str] | None]:
    """(exact, required): all strings that a sequence can be, if they are few, and strings one of which it must contain."""
    exact: frozenset[str] | None = frozenset([""])
    run: frozenset[str] = frozenset([""])
    best: frozenset[str] | None = None
    for op, arg in items:
        now, need = _piece(op, arg)
        joined = frozenset(a + b for a in run for b in now) if now is not None and len(run) * len(now) <= MOST else None
        best = _better(best, need)
        if joined is not None:
            run = joined
        else:
            best = _better(best, _some(run))
            run = now if now is not None else frozenset([START if _parts_words(op, arg) else ""])
            exact = None
    best = _better(best, _some(run))
    return (run if exact is not None else None), best


def _piece(op, arg) -> tuple[frozenset[str] | None, frozenset[str] | None]:
    if op is c.LITERAL:
        own = frozenset([chr(arg).lower()])
        return own, own
    if op is c.AT:
        return frozenset([START if arg is c.AT_BOUNDARY else ""]), None
    if op in (c.ASSERT, c.ASSERT_NOT):
        return frozenset([""]), None
    if op is c.SUBPATTERN:
        return _walk(arg[-1])
    if op is c.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        exact = frozenset().union(*(e for e, _ in parts)) if all(e is not None for e, _ in parts) else None
        needs = [n if n is not None else e for e, n in parts]
        need = frozenset().union(*needs) if all(n and _some(n) for n in needs) else None
        return (exact if exact is not None and len(exact) <= MOST else None), need
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        low, high, inner = arg
        exact, need = _walk(inner)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, None
        return (exact if (low, high) == (1, 1) else None), (need if low else None)
    if op is c.IN and all(kind is c.LITERAL for kind, _ in arg) and len(arg) <= 4:
        return frozenset(chr(x).lower() for _, x in arg), None
    return None, None


def required(patterns: Sequence[str]) -> tuple[str, ...] | None:
    """Lower-case strings, one of which every match of any of the patterns contains; null if a pattern has none.

    A string that begins with START stands at the start of a word.
    """
    found: set[str] = set()
    for p in patterns:
        _, need = _walk(_parser.parse(p, re.IGNORECASE))
        if need is None or min(len(plain(x)) for x in need) < LEAST:
            return None
        found |= {(START if x.startswith(START) and plain(x)[0].isalnum() else "") + plain(x) for x in need}
    # a string is no news where one that stands for it is asked for anyway
    stands_for = lambda o, s: plain(s).startswith(plain(o)) if o.startswith(START) and s.startswith(START) else not o.startswith(START) and o in plain(s)
    return tuple(sorted(s for s in found if not any(o != s and stands_for(o, s) for o in found)))


def literal_pattern(literals: Sequence[str], boundary: str = r"\b") -> str:
    """A pattern of the literals, those marked with START only where a word begins."""
    at_start, anywhere = sorted({plain(x) for x in literals if x.startswith(START)}), sorted({x for x in literals if not x.startswith(START)})
    return "|".join(p for p in (f"{boundary}(?:{trie_pattern(at_start)})" if at_start else "", f"(?:{trie_pattern(anywhere)})" if anywhere else "") if p)


#: Two letters match i and s without regard to case, though they have no other lower case.
UNFOLDED = ("ı", "ſ")


def may_match(low: Column, patterns: Sequence[str]) -> Column:
    """Whether a lower-cased text can match any of the patterns without regard to case; true where that cannot be told cheaply."""
    needs = required(patterns)
    return F.lit(True) if needs is None else low.rlike(literal_pattern((*needs, *UNFOLDED)))


def _hides(found: str, literal: str) -> bool:
    """Whether a match of ``found`` can cover the start of ``literal``: it holds it, or ends in its beginning; inside a word no word starts."""
    own = plain(literal)
    for k in range(len(found)):
        if literal.startswith(START) and k and (found[k - 1].isalnum() or found[k - 1] == "_"):
            continue
        if found[k:].startswith(own) or own.startswith(found[k:]):
            return True
    return False


#: True wherever a word starts, whether by ``\\b`` or by the letters, digits and underscores of ``text.WORD``.
WORD_START = r"(?<![\p{L}\p{Nd}_])"


def gate(low: Column, groups: dict[str, Sequence[str] | None]) -> Column:
    """The names of the groups, one of whose literals a lower-cased text may hold: one pass over the text for all groups.

    A group without literals is always named. Matches do not overlap, so a
    literal also names the groups whose literals it can hide.
    """
    known = sorted({w for ws in groups.values() for w in ws or ()})
    always = sorted(k for k, ws in groups.items() if ws is None)
    names = {f: sorted(k for k, ws in groups.items() if ws and any(_hides(f, w) for w in ws)) for f in map(plain, known)}
    every = F.array(*map(F.lit, always)) if always else F.array().cast("array<string>")
    if not known:
        return every
    table = F.create_map(*[x for f, ks in names.items() for x in (F.lit(f), F.array(*map(F.lit, ks)))])
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(literal_pattern(known, WORD_START)), F.lit(0)))
    return F.array_union(every, F.flatten(F.transform(found, lambda f: table[f])))


def literal_group(patterns: Sequence[str]) -> tuple[str, ...] | None:
    """The literals by which ``gate`` names a group of patterns that are matched without regard to case."""
    needs = required(patterns)
    return None if needs is None else (*needs, *UNFOLDED)
