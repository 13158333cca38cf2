"""Sinks: tables, lines with a rejection log, pool documents, reports, fan-out and rendered packs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import escape_html


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_with_rejects(accepted: DataFrame, rejected: DataFrame, path: str) -> None:
    """Accepted rows and the rejection log, side by side."""
    write_jsonl(accepted, f"{path}/accepted")
    write_jsonl(rejected, f"{path}/rejected")


def write_pool(cards: DataFrame, metadata: dict, path: str, order: Sequence[str] = ("id",)) -> None:
    """One JSON document ``{_metadata, cards}`` of a pool, whose size is a parameter of its curation."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct(*cards.columns)).alias("__json"))))
    body = cards.agg(F.array_join(F.transform(rows, lambda r: r["__json"]), ",\n").alias("c"))
    head = json.dumps(metadata, ensure_ascii=False)
    body.select(F.concat(F.lit('{"_metadata": ' + head + ', "cards": [\n'), F.col("c"), F.lit("\n]}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_corpus(lines: DataFrame, line: str, tokens: Sequence[str], path: str) -> None:
    """Text lines and the manifest of their special tokens."""
    lines.select(F.col(line).alias("value")).write.mode("overwrite").text(f"{path}/corpus")
    manifest = json.dumps({"special_tokens": sorted(set(tokens))}, ensure_ascii=False)
    lines.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/tokens")


def write_arrays(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as one JSON object."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_terms(terms: DataFrame, term: str, header: Sequence[str], path: str) -> None:
    """A term list in order, below comment lines."""
    comments = terms.sparkSession.createDataFrame([(i, f"# {h}") for i, h in enumerate(header)], "pos long, value string")
    rows = terms.select(F.lit(len(header)).cast("long").alias("pos"), F.col(term).alias("value"))
    comments.unionByName(rows).orderBy("pos", "value").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_fan_out(df: DataFrame, key: str, path: str) -> None:
    """A folder for each key, e.g. a deck for each user."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def html_cards(df: DataFrame, key: str, title: Column, body: Column, fields: dict[str, Column]) -> DataFrame:
    """(key, html): a section for each row; all text is escaped."""
    items = [F.concat(F.lit(f"<dt>{name}</dt><dd>"), escape_html(value), F.lit("</dd>")) for name, value in fields.items()]
    return df.select(key, F.concat(F.lit("<section><h2>"), escape_html(title), F.lit("</h2><p>"), escape_html(body), F.lit("</p><dl>"), *items, F.lit("</dl></section>")).alias("html"))


def markdown_rows(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, line): a Markdown table row for each row."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return df.select(key, F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))


# The questions of a rater's form.
QUESTIONS = (
    ("**Q1. Is this post FAKE / REAL / UNCERTAIN?**", ("FAKE", "REAL", "UNCERTAIN")),
    ("**Q2. Why? (1-2 sentences, open response)**", None),
    ("**Q3. Which manipulation tactic does it use? (single choice)**", ()),
    ("**Q4. How confident are you? (1 = not at all, 5 = very confident)**", ("1", "2", "3", "4", "5")),
    ("**Q5. Would you share this post?**", ("Yes", "No", "Maybe")),
)
ANSWER = "> _(rater's free-text answer here)_"
NO_TACTIC = "credible / not manipulation"


def questionnaire(cards: DataFrame, position: str, key: str, text: str, tactics: Sequence[str]) -> DataFrame:
    """(position, block): a rater's form for each card in Markdown; ``position`` counts from 1."""
    parts = []
    for question, options in QUESTIONS:
        if options is None:
            parts += [question, "", ANSWER, ""]
        else:
            parts += [question, *(f"- [ ] {o}" for o in options or (NO_TACTIC, *sorted(tactics))), ""]
    head = F.concat(F.lit("## Card "), F.col(position).cast("string"), F.lit(" - `"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("`\n\n> "))
    quoted = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\n"), F.lit("\n> "))
    return cards.select(position, F.concat(head, quoted, F.lit("\n\n" + "\n".join([*parts, "---", ""]))).alias("block"))


def answer_key(cards: DataFrame, position: str, key: str, verdict: Column, tactic: Column, tier: Column, candidate: Column, fired: Column, phrase: Column) -> DataFrame:
    """(position, block): a scoring sheet for each card in Markdown."""
    shown = F.when(F.size(fired) > 0, F.array_join(fired, ", ")).otherwise("(none)")
    lines = [
        F.concat(F.lit("## Card "), F.col(position).cast("string"), F.lit(" - `"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("`")), F.lit(""),
        F.concat(F.lit("- **Gold verdict:** "), verdict), F.concat(F.lit("- **Tactic:** `"), tactic, F.lit("`")), F.concat(F.lit("- **Tier:** "), tier), F.concat(F.lit("- **Candidate:** "), candidate),
        F.concat(F.lit("- **Fired DEPICT indicators:** "), shown), F.concat(F.lit("- **Justifying phrase:** "), phrase), F.lit(""), F.lit("---"), F.lit(""),
    ]
    return cards.select(position, F.concat_ws("\n", *lines).alias("block"))


def json_schema(df: DataFrame) -> str:
    """The schema of a table as JSON."""
    return df.schema.json()
