from __future__ import annotations

import pytest
from pyspark.sql import Row

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ", score double, rank int, fp bigint, id string, copy int, sequence_id string, media binary, part int, shard string, pii_row string, toxic string, length string, term string, raw string, tag string"


def base_rows() -> list[tuple]:
    words = "the onent ingly hath erder stion of reat ondle".split()
    rows = []
    for i in range(40):
        text = " ".join(words[(i * 7 + k * k) % len(words)] + ("" if k % 5 else str(i % 3)) for k in range(12 + i))
        if i % 6 == 0:
            text += " idiot moron"
        rows.append((i, text, ("en", "fr")[i % 2], f"s{i % 3}", len(text)))
    return rows


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, repeated rows, ties, odd characters."""
    rows = base_rows()
    rows += [(100, None, "en", "s0", None), (101, "", "fr", "s1", 0), (102, "  \t\n ", None, None, 3), (None, "a text without an id of its own here", "en", "s0", 5)]
    rows += [(103, "la " * 30_000 + "end", "fr", "s2", 90_003), (104, "x" * 20_000, "en", "s2", 20_000), (105, "1 " * 8_000, "en", "s2", 16_000)]
    rows += [rows[3], rows[3], (106, rows[5][1], "fr", "s1", 1), (106, rows[6][1], "fr", "s1", 1)]
    rows += [(107, "\u0000 nul \U0001f600 emoji é日本語 <|endoftext|> end", "en", None, 9), (108, "mail a.b@c.de ip 1.2.3.4 +1 (377) 555-0271 4111 1111 1111 1111", "en", "s1", 9)]
    return rows


def save(spark, path, docs: list[tuple], clash: bool = False) -> str:
    frame = spark.createDataFrame(docs, DOCS)
    if clash:
        for column in CLASH.strip(", ").split(", "):
            name, kind = column.split()
            frame = frame.selectExpr("*", f"cast(null as {kind}) as {name}")
    frame.coalesce(2).write.parquet(f"{path}/documents.parquet")
    labels = [(i, (i or 0) % 2, int("idiot" in (t or ""))) for i, t, *_ in docs] + [(None, 1, 1), (5000, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = [(i, [float((i * k) % 7 - 3) for k in range(1, 9)], i % 3) for i in range(60)] if docs else []
    if docs:
        vectors += [(100, vectors[4][1], 0), (120, vectors[4][1], 0), (121, None, 0), (122, [0.0] * 8, 0), (140, [float("nan")] + [1.0] * 7, 0)]
        vectors += [(123, [None] * 8, 0), (None, [1.0] * 8, 0), (160, [float("inf")] * 8, 0), (180, [], 1), vectors[20], (200, [1.0, 2.0], 1)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    return save(spark, tmp_path_factory.mktemp("odd"), odd_rows(), clash=True)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return save(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in odd_rows()]


def as_set(rows: list[Row]) -> set:
    return {tuple(r) for r in rows}
