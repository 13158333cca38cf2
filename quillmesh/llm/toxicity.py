"""Toxicity by a weighted lexicon, matched with one Aho-Corasick pass over folded text.

Folding lower-cases, maps look-alike and decorated letters to Latin ones,
removes joiners and combining marks, and undoes digit and symbol substitutions
inside words. The lexicon (whole words and word stems) and its weights are
learned from labelled rows as log odds of document frequencies, and so are
exception phrases: a harsh word with the word beside it, where the two together
stand in clean rows and in no toxic one. A word counts once, with its heaviest
term, unless it lies inside an exception phrase. The sum is normalised by
length and mapped to the observed share of toxic rows, so 0.3 means three in
ten.

Edge cases: null and empty texts have no evidence and get the calibrated base
score; repeated rows are scored alike, and an id that repeats with several
texts trains with one of them (the least); a null id is not held out and never
trains; without labels every score is 0; other input columns are ignored; time
is linear in the length of a text, however long its words are.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import Batches, id_remainder, materialise, table

#: Rows of the labelled sample that the lexicon is learned from (least hash of the id first).
TRAIN_ROWS = 50_000
#: Toxic rows that must hold a term, and clean rows that must hold an exception phrase.
MIN_SUPPORT = 4
MIN_WEIGHT = 3.0
STEMS = range(4, 9)
LENGTH_WORDS = 400
BINS = 400
BIN_WIDTH = 0.25
#: Terms that a task counts before it hands them on.
COUNTED = 200_000
THRESHOLD = 0.3

# Letters that look like Latin ones, and substitutions inside words.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "к": "k", "т": "t", "м": "m",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "ı": "i", "ɑ": "a", "ɡ": "g",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
# Harmless phrases that hold a word which is harsh elsewhere.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "circus clown", "rodeo clown", "clown fish", "pond scum")



def _decorated() -> dict[str, str]:
    """Accented, full-width and mathematical letters and digits by the ASCII character that they decompose to."""
    out = {}
    for lo, hi in ((0xC0, 0x250), (0x1E00, 0x1F00), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)):
        for c in map(chr, range(lo, hi)):
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
            if len(plain) == 1 and plain != c:
                out[c] = HOMOGLYPHS.get(plain, plain)
    return out


#: Zero-width characters, soft hyphens, variation selectors and combining marks, which only hide a word.
HIDDEN = dict.fromkeys([0xAD, 0x34F, 0x61C, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0x300, 0x370)], "")
LOOKALIKE = str.maketrans(_decorated() | HOMOGLYPHS) | HIDDEN
UNDO = str.maketrans(SUBSTITUTES)
WORD = re.compile(r"[^\W_]+(?:[@$!|]+[^\W_]+)*")
# anchored at the start of a word and possessive, so that a word is read once
CODED = re.compile(r"(?<= )[^ 0-9@$!|]*+[0-9@$!|][^ ]*")
LETTER = re.compile(r"[^\W\d_]")


def _undo(m: re.Match) -> str:
    word = m[0]
    return word.translate(UNDO) if LETTER.search(word) else word


def fold(text: str | None) -> tuple[str, int]:
    """The folded words between single spaces, a space at either end, and their number."""
    low = (text or "").lower()
    if not low.isascii():
        low = low.translate(LOOKALIKE)
    words = WORD.findall(low)
    return CODED.sub(_undo, " " + " ".join(words) + " "), len(words)


@dataclass
class Lexicon:
    """Terms (" stem" or " word ") with weights, exception phrases, and score by evidence bin."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    scores: list[float] = field(default_factory=list)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for phrase in self.exceptions:
            folded = fold(phrase)[0]
            a.add_word(folded, (len(folded), None))
        for term, w in self.weights.items():
            if term not in a:
                a.add_word(term, (len(term), w))
        if len(a):
            a.make_automaton()
        return a


def evidence(folded: str, words: int, automaton) -> float:
    """The weights of distinct matched words, each once, normalised by length."""
    heaviest: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    if len(automaton):
        for end, (n, w) in automaton.iter(folded):
            start = end - n + 1
            if w is None:
                excused.append((start, end))
            elif w > heaviest.get(start, 0.0):
                heaviest[start] = w
    if not heaviest:
        return 0.0
    # phrases by start, with the farthest end so far
    excused.sort()
    heads, reach = [a for a, _ in excused], []
    for _, b in excused:
        reach.append(max(b, reach[-1]) if reach else b)
    by_word: dict[str, float] = {}
    for start, w in heaviest.items():
        k = bisect_right(heads, start) - 1
        if k < 0 or start >= reach[k]:
            word = folded[start + 1 : folded.index(" ", start + 1)]
            by_word[word] = max(w, by_word.get(word, 0.0))
    return sum(by_word.values()) / (1 + 0.25 * math.log1p(words / LENGTH_WORDS))


def bin_of(x: float) -> int:
    return min(BINS - 1, math.ceil(x / BIN_WIDTH))


def terms_of(folded: str) -> set[str]:
    """The whole words and stems of a text, as they stand in the lexicon."""
    found = set()
    for w in set(folded.split()):
        found.add(f" {w} ")
        found.update(f" {w[:k]}" for k in STEMS if k <= len(w))
    return found


def phrases_of(folded: str, automaton) -> set[str]:
    """Each word that holds a term, with the word before it and with the word after it."""
    found = set()
    for start in {end - n + 1 for end, (n, w) in automaton.iter(folded) if w is not None} if len(automaton) else ():
        stop = folded.index(" ", start + 1)
        if start > 0:
            found.add(folded[folded.rindex(" ", 0, start) : stop + 1])
        if stop + 1 < len(folded):
            found.add(folded[start : folded.index(" ", stop + 1) + 1])
    return found


def _counts(rows: DataFrame, of) -> DataFrame:
    """(term, pos, neg): toxic and clean rows(folded, toxic) that hold each term of ``of()(folded)``."""
    schema = pa.schema([("term", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = of()
        counts = (Counter(), Counter())

        def hand_on() -> Iterator[pa.RecordBatch]:
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in counts[::-1])], schema=schema)
            for c in counts:
                c.clear()

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[toxic].update(terms(text))
                if len(counts[0]) + len(counts[1]) >= COUNTED:
                    yield from hand_on()
        yield from hand_on()

    return rows.select("folded", "toxic").mapInArrow(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _isotonic(pos: list[int], total: list[int]) -> list[float]:
    """Non-decreasing shares by bin (pool adjacent violators); an empty bin takes its neighbour's."""
    blocks: list[list[float]] = []
    for i, (p, n) in enumerate(zip(pos, total, strict=True)):
        if n or not blocks:
            blocks.append([float(p), float(n), i])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                p2, n2, _ = blocks.pop()
                blocks[-1][0] += p2
                blocks[-1][1] += n2
    out, k = [], 0
    for i in range(len(pos)):
        while k + 1 < len(blocks) and blocks[k + 1][2] <= i:
            k += 1
        p, n, _ = blocks[k]
        out.append(p / n if n else 0.0)
    return out


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, train_rows: int = TRAIN_ROWS) -> Lexicon:
    """A lexicon from the labelled rows that are not held out, ``train_rows`` of them at most."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (id_remainder(F.col("doc_id"), 4) != 2))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    schema = pa.schema([("folded", pa.string()), ("words", pa.int64()), ("toxic", pa.int64())])

    def folding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(schema)
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                folded, words = fold(text.as_py())
                out.add((folded, words, int(toxic > 0)), len(folded))
                if out.full():
                    yield from out.take()
        yield from out.take()

    # train_rows bounds this side (16 bytes a row), whatever the size of labels
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # ids may repeat: one text each, so that train_rows bounds the rows as well
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    rows = materialise(rows.mapInArrow(folding, "folded string, words long, toxic long"), "labelled")
    by = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p, n = by.get(1, 0), by.get(0, 0)
    if not p or not n:
        return Lexicon(exceptions=exceptions)
    # the weight that a term has at most in any of the lexicons below
    most = F.log((F.col("pos") + 0.5) / (p + 1)) - F.log((F.greatest(F.lit(0), F.col("neg") - 1) + 0.5) / n)
    heavy = _counts(rows, lambda: terms_of).filter((F.col("pos") >= MIN_SUPPORT) & (most >= MIN_WEIGHT - 0.1))
    counts = {r.term: (r.pos, r.neg) for r in heavy.collect()}
    weights = _weights(counts, p, n)

    def phrases():
        automaton = Lexicon(weights, ()).automaton()
        return lambda folded: phrases_of(folded, automaton)

    clean = _counts(rows, phrases).filter((F.col("pos") == 0) & (F.col("neg") >= MIN_SUPPORT))
    exceptions = (*exceptions, *sorted(r.term.strip() for r in clean.select("term").collect()))
    lexicon = Lexicon(weights, exceptions)
    # a training row is judged by what the others say: its own share of the counts is left out
    others = (Lexicon(_weights(counts, p, n, clean=1), exceptions), Lexicon(_weights(counts, p, n, toxic=1), exceptions))
    pos, total = [0] * BINS, [0] * BINS
    for r in score_bins(rows, others).groupBy("bin").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).collect():
        pos[r.bin], total[r.bin] = r.pos, r.n
    lexicon.scores = _isotonic(pos, total)
    return lexicon


def _weights(counts: dict[str, tuple[int, int]], p: int, n: int, toxic: int = 0, clean: int = 0) -> dict[str, float]:
    """Log odds of the terms with enough support, as they are without so many toxic or clean rows that hold them."""
    out = {}
    for term in sorted(counts):
        a, b = counts[term][0] - toxic, max(0, counts[term][1] - clean)
        if a >= MIN_SUPPORT:
            w = math.log((a + 0.5) / (p - toxic + 1)) - math.log((b + 0.5) / (n - clean + 1))
            if w >= MIN_WEIGHT:
                out[term] = w
    return out


def score_bins(rows: DataFrame, by_label: tuple[Lexicon, Lexicon]) -> DataFrame:
    """rows(folded, words, toxic) as (bin, toxic), each row judged by the lexicon of its label."""
    schema = pa.schema([("bin", pa.int64()), ("toxic", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [x.automaton() for x in by_label]
        for b in batches:
            bins = [bin_of(evidence(t, n, automata[y])) for t, n, y in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), b.column(2)], schema=schema)

    return rows.select("folded", "words", "toxic").mapInArrow(run, "bin long, toxic long")


def score(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of each row with its evidence and score."""
    fields = [docs.schema[c] for c in keep]
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", evidence double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        last = len(keep)
        for b in batches:
            found = [evidence(*fold(t.as_py()), automaton) for t in b.column(last)]
            scores = [lexicon.scores[bin_of(x)] if lexicon.scores else 0.0 for x in found]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:last], pa.array(found, pa.float64()), pa.array(scores, pa.float64())], names=[*keep, "evidence", "score"]
            )

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, out_schema)


def toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learns from ``labels`` and scores every row of ``docs``."""
    return score(docs, learn(docs, labels), keep)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows with crc32(id) mod 4 = 2 never train."""
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
