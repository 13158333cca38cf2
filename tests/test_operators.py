from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import cards as C
from quillmesh.operators import explain as EX
from quillmesh.operators import gates as G
from quillmesh.operators import graph as GR
from quillmesh.operators import ml
from quillmesh.operators import ranking as K
from quillmesh.operators import reports as R
from quillmesh.operators import spans as S
from quillmesh.sources import readers, writers
from quillmesh.streaming import gates as ST


def pool(spark, n=50):
    rows = [(f"c{i:02d}", "FAKE" if i < 37 else "REAL" if i < 45 else "UNCERTAIN", "ABC"[i % 3], ("novice", "proficient", "advanced")[i % 3], f"t{i % 5}") for i in range(n)]
    return spark.createDataFrame(rows, "id string, verdict string, candidate string, tier string, tactic string")


def test_pilot_sample(spark):
    got = K.stratified_sample(pool(spark), 30).toPandas()
    assert got.verdict.value_counts().to_dict() == {"FAKE": 22, "REAL": 5, "UNCERTAIN": 3}
    assert got.id.is_unique and got.candidate.nunique() == 3 and got.tactic.nunique() >= 3
    again = K.stratified_sample(pool(spark).repartition(5), 30).toPandas()
    assert again.sort_values("pick").id.tolist() == got.sort_values("pick").id.tolist()


def test_apportion_sums(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1)], "k string, n bigint")
    assert {r.k: r.slots for r in K.apportion(counts, "k", "n", 4).collect()} == {"a": 2, "b": 2, "c": 0}


def test_decks(spark):
    users = spark.createDataFrame([("u1", "1"), ("u2", "2")], "user_id string, seed string")
    got = K.draw_decks(pool(spark), users, days=3, per_day=6, real_per_day=2).toPandas()
    for _, g in got.groupby("user_id"):
        assert len(g) == 18 and g.id.is_unique
        assert g.groupby("day").size().tolist() == [6, 6, 6]
        assert (g[g.verdict == "REAL"].groupby("day").size() >= 2).all()
        seen = None
        for r in g.sort_values(["day", "slot"]).itertuples():
            seen = r.id if r.verdict == "REAL" else seen
            assert r.verdict != "FAKE" or r.counter_id == seen or (r.counter_id is None and seen is None)
    assert set(got[got.user_id == "u1"].id) != set(got[got.user_id == "u2"].id)


def test_curate_and_balance(spark):
    got = K.curate(pool(spark), "id", 20).toPandas()
    assert len(got) == 20 and sorted(got.pool_index) == list(range(20)) and (got.verdict == "REAL").sum() >= 7
    got = K.balance(pool(spark), "id", 30).toPandas()
    assert len(got) == 30 and got.id.is_unique


def test_chunks_drop_the_tail(spark):
    df = spark.createDataFrame([("a", 1, ["1", "2", "3"]), ("a", 2, ["4", "5"]), ("b", 1, ["9"])], "g string, o int, w array<string>")
    assert [(r.chunk, r.tokens) for r in K.chunk(df, "w", 2, ["g"], ["o"]).orderBy("chunk").collect()] == [(0, ["1", "2"]), (1, ["3", "4"])]


def test_metrics(spark):
    pairs = [(1, 1)] * 4 + [(1, 0), (0, 1)] + [(0, 0)] * 4
    ask = lambda rows: R.binary_metrics(spark.createDataFrame(rows, "t int, p int"), F.col("t"), F.col("p")).first()
    got = ask(pairs)
    assert (got.accuracy, got.precision, got.recall, got.f1) == pytest.approx((0.8, 0.8, 0.8, 0.8))
    assert tuple(ask([])) == (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    got = ask([(1, 0), (1, 0), (0, 0)])
    assert got.accuracy == pytest.approx(1 / 3) and (got.precision, got.recall, got.f1) == (0, 0, 0)


def test_t_test():
    assert R.t_p_value(2.776445, 4) == pytest.approx(0.05, abs=1e-5)
    assert R.t_p_value(0.0, 10) == pytest.approx(1.0) and R.t_p_value(1.812461, 10) == pytest.approx(0.1, abs=1e-5)


def test_graph(spark):
    rows = [(i, [float((i * 7 + k * 3) % 11 - 5) for k in range(5)]) for i in range(10)]
    nodes = spark.createDataFrame(rows, "id bigint, v array<double>")
    edges = GR.knn_edges(nodes, "id", "v", 3)
    assert edges.count() == 30 and edges.filter("src = dst").count() == 0
    both = GR.symmetric(edges)
    assert both.count() == 60 and both.exceptAll(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).count() == 0
    lone = spark.createDataFrame([(0, 1), (2, 1)], "src bigint, dst bigint")
    mean = {r.id: r["mean"] for r in GR.neighbour_mean(nodes, lone, "id", "v").collect()}
    assert mean[5] == [0.0] * 5 and mean[1] == pytest.approx([(a + b) / 2 for a, b in zip(rows[0][1], rows[2][1], strict=True)])
    out = GR.layer(nodes, lone, "id", "v", [[1, 0, 0, 0, 0]], [[0, 0, 0, 0, 0]], [0.5])
    assert {r.id: r.v[0] for r in out.collect()}[0] == max(0.0, rows[0][1][0] + 0.5)
    with pytest.raises(ValueError):
        GR.knn_edges(nodes, "id", "v", 0)


def test_strict_gate(spark):
    texts = {1: "We saw Senator Dalmor speak today.", 2: "dalmor was there", 3: "nothing to see in the valley", 4: "Candidate A spoke.", 5: "The Harbor Council met."}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {r.id: r for r in S.strict_gate(df, "text", ["candidate a", "harbor council"], ["dalmor"]).collect()}
    assert [got[i].accepted for i in sorted(got)] == [False, False, True, True, True]
    assert "almor" not in got[1].redacted and got[2].redacted == "[Iba pang tao] was there" and got[4].redacted == texts[4]


def test_places(spark):
    df = spark.createDataFrame([(1, "From Baguio to Quezon City and baguio."), (2, "In Luzon, near Cityville and Malacanang"), (3, None)], "id int, text string")
    places = ["baguio", "quezon city", "quezon", "luzon", "city", "malacanang"]
    got = {r.id: r for r in S.pseudonymise_places(df, "id", "text", places).collect()}
    assert got[1].text == "From City W to City X and City W." and got[1].n_places == 3
    assert got[2].text == "In Island Group 1, near Cityville and [Landmark]" and got[3].text == ""
    many = spark.createDataFrame([(1, " ".join(f"town{i} city," for i in range(12)))], "id int, text string")
    last = S.place_codes(many, "id", "text", [f"town{i} city" for i in range(12)]).filter("index = 10").first()
    assert last.pseudonym == "City 11"


def test_people(spark):
    df = spark.createDataFrame([(1, "Today Juan Stone met Mary Field. Juan Stone left."), (2, "then Mary Field and Candidate Zed spoke"), (3, "nobody")], "id int, text string")
    rows, mapping = S.pseudonymise_people(df, "id", "text", keep=["Candidate Zed"])
    got = {r.id: r.pseudonymised for r in rows.collect()}
    codes = {r.entity: r.code for r in mapping.collect()}
    assert got[3] == "nobody" and "Candidate Zed" in got[2]
    assert codes["Mary Field"] in got[1] and codes["Mary Field"] in got[2] and "Mary" not in got[1] + got[2]


def test_universal_rewrite(spark):
    df = spark.createDataFrame([("we hear Bikoy Marlow spoke, says the note",), ("no names",)], "t string")
    a, b = (r[0] for r in df.select(S.universal_rewrite(F.col("t"))).collect())
    assert a.n == 1 and "Marlow" not in a.text and any(role in a.text for role in S.ROLES) and (b.text, b.n) == ("no names", 0)


def test_spans(spark):
    df = spark.createDataFrame([("é ab ab",)], "t string")
    got = df.select(S.match_starts(F.col("t"), "ab").alias("s")).first().s
    assert [(x.start, x.end) for x in got] == [(2, 4), (5, 7)]
    spans = F.from_json(F.lit('[{"start":0,"end":3,"entity":"a"},{"start":0,"end":5,"entity":"b"},{"start":4,"end":6,"entity":"c"},{"start":5,"end":6,"entity":"d"}]'), "array<struct<start:int,end:int,entity:string>>")
    assert [x.entity for x in df.select(S.leftmost_longest(spans).alias("s")).first().s] == ["b", "d"]


def test_explanations_and_audit(spark):
    bank = spark.createDataFrame([("EMO", "novice", "emo words", "stop", "EMO/v1.0/n0"), ("CREDIBLE", "novice", "a credible note", "trust", "CREDIBLE/v1.0/n0")], "code string, tier string, phrase string, sift string, bank_id string")
    rows = [(1, ["URG", "EMO"], "FAKE", "novice"), (2, [], "REAL", "novice"), (3, [], "FAKE", "advanced"), (4, ["EMO"], "FAKE", "advanced")]
    df = spark.createDataFrame(rows, "id int, fired array<string>, verdict string, tier string")
    made = EX.explanation(df, bank, "id", "fired", "verdict", F.lit(72.5), "tier")
    got = {r.id: r for r in made.collect()}
    assert got[1].summary == "Looks suspicious (estimated fake-likelihood 72%). 1 cue: EMO. emo words" and got[4].indicator_phrases[0].bank_ref == "EMO/v1.0/n0"
    assert got[2].summary.endswith("a credible note") and got[3].indicator_phrases == []
    joined = df.join(made.drop("tier"), "id").select("id", EX.audit(F.col("fired"), F.col("verdict"), F.col("summary"), F.col("indicator_phrases"), F.lit("1.0"), "1.1", {"EMO": ["zzz"]}).alias("i"))
    issues = {r.id: sorted(r.i) for r in joined.collect()}
    assert issues == {1: ["indicator_phrase_mismatch", "stale_bank_version"], 2: ["stale_bank_version"], 3: ["empty_explanation_phrases", "stale_bank_version"], 4: ["indicator_phrase_mismatch", "stale_bank_version"]}


def test_violations(spark):
    df = spark.createDataFrame([('{"id":"abc","zz":1}', "abc", "x" * 40, "FAKE"), ('{"id":"a"}', "a", " " * 25, "NO")], "raw string, id string, text string, verdict string")
    got = [r[0] for r in df.select(EX.violations(F.col("raw"), {"id": F.col("id"), "text": F.col("text"), "verdict": F.col("verdict")})).collect()]
    assert got == [["extra_forbidden_field"], ["id_too_short", "text_too_short", "invalid_verdict"]]


def test_funnel_and_guards(spark):
    long = "A sentence that is long enough to pass the filter because it holds more than eighty characters. "
    df = spark.createDataFrame([(1, long), (2, "short."), (3, long + "Candidate A Candidate B Candidate C Candidate D spoke.")], "id int, text string")
    got = {r.id: (r.reject_stage, r.reject_reason) for r in G.merge_funnel(df, "text", ["EMO/fake/novice"], F.lit("fake"), F.lit("novice"), F.array(F.lit("EMO"))).collect()}
    assert got == {1: ("candidate_remap", "no_candidate_reference"), 2: ("quality", "too_short"), 3: ("candidate_remap", "too_many_distinct_entities (4 > 3)")}
    assert G.guard_rows(df, 3).count() == 3
    with pytest.raises(Exception, match="more than 2 rows"):
        G.guard_rows(df, 2).collect()


def test_registry_checks(spark):
    rows = spark.createDataFrame([("C-A", "X", "a"), ("C-B", "Y", "b"), ("bad code", "Z", " ")], "code string, archetype string, display_name string")
    assert {r.check: r.ok for r in C.assert_registry(rows).collect()} == {"unique_codes": True, "archetypes": True, "names": False, "code_format": False}


def test_linear_equation_agrees_with_model(spark):
    rows = [(i / 50, (i * 7 % 50) / 50, float(i / 50 + (i * 7 % 50) / 25 > 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "p_a double, p_b double, y double")
    from quillmesh.functions.equation import compile_equation

    text = ml.linear_equation(df, ["p_a", "p_b"], "y")
    scored = df.select("y", compile_equation(text, df.columns).alias("p"))
    assert scored.filter((F.col("p") >= 0.5) == (F.col("y") == 1)).count() > 190


def test_sources(spark, tmp_path):
    import gzip
    import io
    import zipfile

    text = 'Label, Article \nfake,"one, two"\nreal," x "\n,\n'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("data/Full.csv", text)
    (tmp_path / "packed").mkdir()
    (tmp_path / "packed/a.bin").write_bytes(buffer.getvalue())
    (tmp_path / "packed/b.bin").write_bytes(gzip.compress(text.encode()))
    got = readers.read_packed_csv(spark, str(tmp_path / "packed"), "fakenews/full.csv", ["label", "article"]).collect()
    assert sorted((r.label, r.article) for r in got) == [("fake", "one, two")] * 2 + [("real", "x")] * 2
    corpus = readers.canonical_corpus(spark.createDataFrame([("a text of some length", "Fake"), ("short", "real"), ("another text of length", "?")], "article string, labels string"), "d", "en")
    assert [(r.text, r.label) for r in corpus.collect()] == [("a text of some length", 1)]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2, "b": 3}\n')
    good, bad = readers.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.reason for r in bad.collect()] == ["malformed_json"]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int", "fail")[0].collect()
    (tmp_path / "t.txt").write_text("# head\nBaguio\n quezon city # x\nbaguio\n\n")
    assert readers.read_terms(spark, str(tmp_path / "t.txt")) == ["quezon city", "baguio"]
    for name, doc in (("p1", [{"id": "a"}]), ("p2", {"_metadata": {"v": 1}, "cards": [{"id": "b"}, {"id": "c"}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
        assert [r.id for r in readers.read_pool(spark, str(tmp_path / f"{name}.json"), "struct<id:string>").collect()] == (["a"] if name == "p1" else ["b", "c"])
    (tmp_path / "s.json").write_text(json.dumps({"log_history": [{"step": 1, "loss": 0.5}, {"step": 2, "eval_f1": 0.9}, {"x": 1}]}))
    assert readers.read_history(spark, str(tmp_path / "s.json")).count() == 2
    (tmp_path / "h.csv").write_text("id,text,true_label,notes\n1,a,Fake,x\n2,b,real,\n3,c,maybe,\n")
    assert [r.label for r in readers.read_holdout(spark, str(tmp_path / "h.csv")).orderBy("id").collect()] == [1, 0, None]
    assert readers.existing(spark, [str(tmp_path / "no"), str(tmp_path / "t.txt")]).endswith("t.txt")
    assert readers.config({"n": 3, "seeds": (1, 2), "on": True, "x": 0.5}, {"QM_N": "7", "QM_SEEDS": "4,5", "QM_ON": "no", "QM_X": "bad"}) == {"n": 7, "seeds": (4, 5), "on": False, "x": 0.5}
    assert readers.expand_users("a, b,a") == ["a", "b"] and len(readers.expand_users("demo")) == 25
    profiles = spark.createDataFrame([("Ana  One", ["A1", "Ana"])], "display_name string, aliases array<string>")
    assert {r.term for r in readers.allowed_terms(profiles).collect()} == {"ana one", "a1", "ana", "candidate a", "candidate b", "candidate c"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "x|y"), ("a", None)], "id string, text string")
    writers.write_with_rejects(df.filter("id = 'a'"), df.filter("id = 'b'"), str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w/accepted")).count() == 1
    writers.write_fan_out(df, "id", str(tmp_path / "f"))
    assert sorted(p.name for p in (tmp_path / "f").glob("id=*")) == ["id=a", "id=b"]
    writers.write_terms(df, "id", ["made today"], str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["# made today", "a", "b"]
    writers.write_corpus(df.select(F.coalesce("text", F.lit("-")).alias("line")), "line", ["<|a|>"], str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c/corpus")).count() == 2
    writers.write_report(df.agg(F.count("*").alias("n")), str(tmp_path / "r"))
    writers.write_arrays(df, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "r")).first().n == 2 and json.loads(writers.json_schema(df))["type"] == "struct"


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    registry = [("C-A", ["Candidate A"])]
    stream = ST.read_stream(spark, "/root/testdata/sf0.001/documents.parquet", docs.schema)
    ST.gate_stream(stream, "doc_id", "text", registry, str(tmp_path / "o"), str(tmp_path / "k"), positive=["the"], negative=["que"], require_mention=False).awaitTermination()
    batch = G.run_gates(docs, "text", registry, positive=["the"], negative=["que"], require_mention=False)
    want = {r.doc_id for r in batch.filter("accepted").select("doc_id").collect()}
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "o/accepted")).collect()} == want and want
    assert spark.read.parquet(str(tmp_path / "o/rejected")).select("doc_id").distinct().count() == docs.count() - len(want)


def test_stamp_collapse_and_batched_model(spark):
    import numpy as np

    df = spark.createDataFrame([("Ana One met Ana One and Ana One.", (["a"],)), ("nobody", (None,))], "t string, p struct<script_chain:array<string>>")
    assert [r[0] for r in df.select(S.collapse_repeats(F.col("t"), "Ana One", "Ana")).collect()] == ["Ana One met Ana and Ana.", "nobody"]
    assert [r.p.script_chain for r in C.stamp(df, "p", "b").collect()] == [["a", "b"], ["b"]]
    nums = spark.range(5).select(F.col("id").cast("double").alias("x"))
    got = ml.predict_batches(nums, lambda: lambda x: np.asarray(x) * 2, ["x"], "y").collect()
    assert sorted(r.y for r in got) == [0.0, 2.0, 4.0, 6.0, 8.0]
