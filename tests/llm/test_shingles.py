"""Near-duplicates of the pipeline against exact Jaccard similarities of all pairs."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from quillmesh.llm import shingles, simhash


def words_of(text: str | None) -> set:
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near(a: set, b: set) -> bool:
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept(rows: list[tuple]) -> set:
    """The least id of each component, all pairs compared."""
    sets, parent = [words_of(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if near(sets[a], sets[b]):
                parent[root(a)] = root(b)
    least: dict = {}
    for k, r in enumerate(rows):
        if r[0] is not None or root(k) not in least:
            was = least.get(root(k))
            least[root(k)] = r[0] if was is None else min(was, r[0])
    return set(least.values())


def near_rows() -> list[tuple]:
    """Texts of 60 to 200 words with copies in which one to nine words differ, chains of them, and short texts."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        text = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 200)))]
        for _ in range(4):
            rows.append((len(rows), " ".join(text), "en", "s0", 0))
            text = list(text)
            for at in rng.integers(0, len(text), int(rng.integers(1, 4))):
                text[at] = f"x{rng.integers(0, 10**6)}"
    short = ["one", "one two", "One  TWO", "a b c d e f g h i", "a b c d e f g h j", "a b c d e f g h i j"]
    return rows + [(10_000 + k, t, "en", "s0", 0) for k, t in enumerate(short)]


def test_stage_keeps_one_of_each_group(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == kept(rows)


def test_stage_on_odd_rows(spark, odd, empty, texts):
    read = lambda path: corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert {r.doc_id for r in read(odd).collect()} == kept(texts)
    assert read(empty).count() == 0


def test_components_are_exact():
    rows = near_rows()
    order = np.random.default_rng(1).permutation(len(rows)).tolist()
    found = [shingles.shingle_set(rows[i][1].encode()) for i in order]
    comp = shingles.components(found)
    sets = [words_of(rows[i][1]) for i in order]
    assert all(comp[a] == comp[b] for a in range(len(sets)) for b in range(a) if near(sets[a], sets[b]))
    assert len(set(comp.tolist())) == len(kept(rows))


def test_stage_takes_what_the_trie_self_join_links(spark, monkeypatch):
    """Without any bands, near copies within the budget of op9 are still found, and exact similarity decides."""
    rows = near_rows()
    prints = [simhash.fingerprint(r[1].encode()) for r in rows]
    sets = [words_of(r[1]) for r in rows]
    linked = {b for b in range(len(rows)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= simhash.BUDGET and near(sets[a], sets[b]) and sets[a] != sets[b]}
    plain = shingles.with_class
    monkeypatch.setattr(shingles, "with_class", lambda *a: plain(*a).withColumn("bands", F.array().cast("array<long>")))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert linked and got & {rows[b][0] for b in linked} == set() and got >= kept(rows)
