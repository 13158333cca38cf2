"""Operators and the whole pipeline against the plain versions of brute.py."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_shingles import kept

import corpus_pipeline
from quillmesh.llm import hnsw, langid, pii, registry, toxicity
from quillmesh.llm.common import table
from quillmesh.llm.tokens import Encoder

SMALL = "/root/testdata/sf0.001"


def corpus(seed: int, n: int = 150) -> list[tuple[int, str | None]]:
    """Short texts of few words, some with personal data that words stand beside."""
    rng = random.Random(seed)
    people = [(f"name{chr(97 + k)}x", f"p{k}@corp.com" if k % 2 else f"+49 30 123{k}56{k}8") for k in range(8)]
    rows = []
    for i in range(n):
        words = rng.choices(["alpha", "beta", "gamma", "delta", "omega", "of", "the"], k=rng.randint(2, 12))
        for name, value in rng.sample(people, rng.choice([0, 0, 0, 1, 1, 2])):
            words += [name] * (rng.random() < 0.9) + [value]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, rows[3][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_disclosing_terms(spark, seed):
    rows = corpus(seed)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.s for r in pii.pii_spans(frame, ("doc_id",)).select("doc_id", pii._listed(pii._all_spans()).alias("s")).collect()}
    spans = brute.pii_spans([t for _, t in rows])
    assert got == {i: brute.listed(s) for (i, _), s in zip(rows, spans, strict=True)}
    assert any(o == 4 for s in spans for _, o, _ in s)
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert clean == {i: brute.sanitised(t, s) for (i, t), s in zip(rows, spans, strict=True)}


def test_terms_are_found_in_the_documents(spark):
    for sf in ("sf0.01",):
        assert registry.queries()["op4_pii"](spark, f"/root/testdata/{sf}").agg(F.sum("n_term")).first()[0] > 0


def test_toxicity_is_learned_and_scored_as_by_hand(spark):
    folder = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    labels = pd.read_parquet(f"{folder}/labels.parquet")
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))
    lex = toxicity.learn(table(spark, folder, "documents"), table(spark, folder, "labels"))
    weights, phrases = brute.lexicon(rows, list(zip(labels.doc_id.tolist(), labels.toxic.tolist(), strict=True)))
    assert lex.weights.keys() == weights.keys() and lex.weights == pytest.approx(weights)
    assert set(lex.exceptions) == set(toxicity.EXCEPTIONS) | phrases
    got = {r.doc_id: r.evidence for r in registry.queries()["op2_toxicity"](spark, folder).collect()}
    for i, t in rows[:300]:
        assert got[i] == pytest.approx(brute.evidence(t, lex)), i


def test_exception_phrases_are_learned(spark):
    rows = [(i, f"you are a clown and a fool {i}" if i % 2 else f"the rodeo clown came by {i}" if i % 4 else f"plain words in a row {i}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i, _ in rows], "doc_id bigint, toxic int")
    more = spark.createDataFrame([(i, "a word of the same kind") for i in range(800, 9000)], "doc_id bigint, text string")
    clean = spark.createDataFrame([(i, 0) for i in range(800, 9000)], "doc_id bigint, toxic int")
    lex = toxicity.learn(docs.unionByName(more), labels.unionByName(clean), exceptions=())
    assert any("rodeo" in p and "clown" in p for p in lex.exceptions) or " clown " not in lex.weights


def test_languages_as_by_hand(spark):
    docs = table(spark, SMALL, "documents")
    held = langid.learn(docs)
    got = {r.doc_id: r.lang_pred for r in registry.queries()["op5_language_id"](spark, SMALL).collect()}
    assert got == {r.doc_id: brute.language(r.text, held) for r in docs.collect()}


def test_hnsw_recall_over_eight_shards(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1600, 24))
    x[100:180] = x[5]  # copies
    x[200:240] = np.round(x[200:240])  # equal scores
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for size in (200, None):
        got = hnsw.nearest(frame, F.col("vec_id") % 20 == 0, shard_rows=size).toPandas()
        hits = total = 0
        for q, g in got.groupby("query_id"):
            g = g.sort_values("rank")
            scores = (x * x[q]).sum(1)
            truth = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:20]
            assert g["rank"].tolist() == list(range(1, 21))
            assert list(zip((-g.score).tolist(), g.vec_id.tolist(), strict=True)) == sorted(zip((-scores[g.vec_id]).tolist(), g.vec_id.tolist(), strict=True))
            hits += len({i for _, i in truth} & set(g.vec_id))
            total += 20
        assert total == 80 * 20 and hits / total >= 0.9


def test_pipeline_rows(spark, odd):
    docs = [tuple(r) for r in table(spark, odd, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    scored = toxicity.toxicity(table(spark, odd, "documents"), table(spark, odd, "labels"), keep=("doc_id", "text")).collect()
    low = {(r.doc_id, r.text) for r in scored if r.score < toxicity.THRESHOLD}
    docs = [r for r in docs if (r[0], r[1]) in low]
    ids = kept(docs)
    # an id that repeats with other texts stands for a component once: take what the stage took of those
    stage = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"), odd).collect()
    assert {r.doc_id for r in stage} == ids
    docs = [tuple(r) for r in stage]
    texts = [t for _, t, *_ in docs]
    docs = [(i, brute.sanitised(t, s), *rest) for (i, t, *rest), s in zip(docs, brute.pii_spans(texts), strict=True)]
    wanted: Counter = Counter()
    encode = Encoder()
    for (i, t), n in brute.copies([(i, t, source) for i, t, _, source, _ in docs]).items():
        tokens = np.append(encode(t or ""), 0).astype("<u4")
        for a in range(0, len(tokens), 1024):
            part = tokens[a : a + 1024]
            wanted[(i, a, len(part), zlib.crc32(part.tobytes()), len(tokens))] += n
    got = corpus_pipeline.run(spark, odd).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == +wanted
    assert max(Counter(), *[Counter()]) == Counter() and all(r.offset + r.length <= 1024 for r in got)
