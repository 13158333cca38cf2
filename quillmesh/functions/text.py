"""Text normalisation and lexical measures as Column functions.

Word, white-space and case rules are spelled as explicit character classes, so
that they mean the same in Java, RE2 and Python (``\\b`` and ``\\w`` do not).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the lexical and structural measures.
SPACE = r"[\s\p{Z}]+"
WORD = r"[\p{L}\p{N}_]+"
URL = r"(?i)https?://[^\s)\]]+"
QUOTE = '["“”]([^"“”]{8,400})["“”]'
# A boundary is looked for behind the first letter, so that it is tried at capitals alone.
CAPS = r"[A-Z](?<![A-Za-z0-9_].)[A-Z]{2,}(?![A-Za-z0-9_])"
REPORTED = ("said", "told", "stated", "announced", "confirmed", "sabi", "sinabi", r"ayon\s+kay", "nagsabi")
NAMED_SOURCE = rf"([A-Z](?<![A-Za-z0-9_].)[a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){{0,3}})\s+(?:{'|'.join(REPORTED)})(?![A-Za-z0-9_])"


def text_or_empty(t: Column) -> Column:
    return F.coalesce(t.cast("string"), F.lit(""))


def squeeze(t: Column) -> Column:
    """White space collapsed to single spaces and trimmed; null is empty."""
    return F.trim(F.regexp_replace(text_or_empty(t), SPACE, " "))


clean_text = squeeze


def tidy_punctuation(t: Column) -> Column:
    """``squeeze`` without the space that a rewrite can leave before punctuation."""
    return F.regexp_replace(squeeze(t), r" +([.,;:!?])", "$1")


def norm_key(t: Column) -> Column:
    """Squeezed text without punctuation at either end."""
    return F.btrim(squeeze(t), F.lit("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ "))


def norm_lower(t: Column) -> Column:
    return F.lower(squeeze(t))


def words(t: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(t), F.lit(WORD), F.lit(0))


def word_count(t: Column) -> Column:
    """The number of words, one at least."""
    return F.greatest(F.size(words(t)), F.lit(1))


def count_of(t: Column, pattern: str) -> Column:
    return F.regexp_count(text_or_empty(t), F.lit(pattern))


def lexical_features(t: Column) -> dict[str, Column]:
    """char_len, word_len (blank-separated), exclam, question and digit_ratio (0 for empty text)."""
    text = text_or_empty(t)
    trimmed = squeeze(t)
    chars = F.length(text)
    return {
        "char_len": chars,
        "word_len": F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " "))),
        "exclam": count_of(text, "!"),
        "question": count_of(text, r"\?"),
        "digit_ratio": F.when(chars == 0, 0.0).otherwise(count_of(text, r"\p{Nd}") / F.greatest(chars, F.lit(1))),
    }


def quotes(t: Column) -> Column:
    """Quoted passages of 8 to 400 characters, without the marks."""
    return F.regexp_extract_all(text_or_empty(t), F.lit(QUOTE), F.lit(1))


def named_sources(t: Column) -> Column:
    """How often a name is followed by a word of reporting."""
    plain = "|".join(w.split(r"\s")[0] for w in REPORTED)
    return F.when(t.rlike(plain), count_of(t, NAMED_SOURCE)).otherwise(0)


def structural_features(t: Column) -> dict[str, Column]:
    text = text_or_empty(t)
    n = word_count(t)
    return {
        "len_words": n,
        "len_chars": F.length(text),
        "num_urls": count_of(text, URL),
        "num_quotes": F.size(quotes(t)),
        "num_named_sources": named_sources(text),
        "caps_ratio": count_of(text, CAPS) / n,
        "excl_count": count_of(text, "!"),
        "question_count": count_of(text, r"\?"),
    }


def last_word(t: Column) -> Column:
    """The last blank-separated word, lower-cased, without closing punctuation."""
    return F.rtrim(F.lower(F.element_at(F.split(squeeze(t), " "), -1)), F.lit('.,;:!?"”'))


def snippet(t: Column, start: Column, end: Column, around: int = 30) -> Column:
    """The span [start, end) with so many code points on either side."""
    first = F.greatest(start - around, F.lit(0))
    return F.substring(text_or_empty(t), first + 1, end + around - first)


def preview(t: Column, n: int) -> Column:
    return F.substring(text_or_empty(t), 1, n)


def escape_html(t: Column) -> Column:
    out = text_or_empty(t)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def fill_slots(template: Column, slots: dict[str, Column]) -> Column:
    """``{name}`` replaced for every slot, then tidied."""
    out = template
    for name, value in slots.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return tidy_punctuation(out)


def control_token(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<|{name}="), value, F.lit("|>"))


def control_value(token: Column) -> Column:
    """The value of a control token (``<|name=value|>``), null for other text."""
    found = F.regexp_extract(token, r"^<\|[^=|]*=(.*?)\|?>?$", 1)
    return F.when(F.contains(token, F.lit("=")), found)


def conditioned_line(tokens: list[Column], t: Column) -> Column:
    """Control tokens and the text on one line."""
    return F.concat_ws(" ", *tokens, F.trim(F.regexp_replace(text_or_empty(t), r"[\r\n]+", " ")))


def index_code(i: Column) -> Column:
    """0 to A, 25 to Z, 26 to AA, and so on, with as many letters as it takes."""
    letter = lambda k: F.char(F.lit(65) + k.cast("int"))
    # 14 letters hold any long; each step takes the last digit of what is left, in base 26 without a zero
    step = lambda acc, _: F.when(acc["left"] < 0, acc).otherwise(
        F.struct((F.floor(acc["left"] / F.lit(26).cast("decimal(2,0)")).cast("bigint") - 1).alias("left"), F.concat(letter(F.pmod(acc["left"], F.lit(26).cast("bigint"))), acc["code"]).alias("code"))
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(i.cast("bigint").alias("left"), F.lit("").alias("code")), step)["code"]


def column_name(name: str) -> str:
    """A name as the equation language writes it: letters and digits only, ``f`` before a leading digit."""
    kept = "".join(c for c in name if c.isalnum())
    return f"f{kept}" if kept[:1].isdigit() else kept
