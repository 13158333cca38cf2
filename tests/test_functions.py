from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import arrays as A
from quillmesh.functions import equation as EQ
from quillmesh.functions import indicators as I
from quillmesh.functions import numeric as N
from quillmesh.functions import policies as P
from quillmesh.functions import text as X
from quillmesh.operators import gates as G


@pytest.fixture(scope="module")
def one(spark):
    def ask(**columns):
        return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict(recursive=True)

    return ask


def ask_text(one, fn, text):
    return one(v=fn(F.lit(text)))["v"]


@pytest.mark.parametrize(
    "code, text, fired",
    [
        ("EMO", "This is a betrayed and outraged scandal!", True),
        ("EMO", "A calm and long note about the weather in the valley and about nothing else that would matter to anybody at all, or to " + "one " * 40 + "scandal.", False),
        ("URG", "URGENT! SHARE NOW BEFORE IT'S DELETED!", True),
        ("URG", "Please read this at your leisure.", False),
        ("ANON", "Sources say the mill is in trouble.", True),
        ("MISS", "Read the full statement at https://example.org/123.", False),
        ("MISS", "Maria Stone said the bill passed today.", False),
        ("MISS", "the bill passed today.", True),
        ("FAB", 'He wrote "one two three four five six seven eight nine ten" in a letter.', True),
        ("FAB", 'He wrote "one two" at https://example.org/x.', False),
        ("CONS", "They don't want you to know about the hidden agenda.", True),
        ("REV", "Back to the golden age.", True),
        ("POL", "It is us versus them.", True),
        ("ENDO", "An unanimous endorsement from everybody.", True),
        ("RECF", "A nobel prize winner.", True),
        ("IMP", "see bbc.co now", True),
        ("DISC", "a puppet of china", True),
    ],
)
def test_detectors(one, code, text, fired):
    assert one(v=I.detectors(F.lit(text))[code])["v"]["fired"] is fired


def test_no_codes_for_sourced_text(one):
    text = "Maria Stone said the bill passed today, see https://example.org/1 for the vote."
    assert ask_text(one, I.fired_codes, text) == []
    assert ask_text(one, I.fired_codes, "") == []
    assert ask_text(one, lambda t: F.size(I.indicator_map(t)), "") == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("A long enough sentence that is citing the need for", (True, "dangling_function_word")),
        ("A long enough sentence that is citing the constitution", (False, "ok")),
        ("Short.", (True, "too_short")),
        ("", (True, "empty")),
        (None, (True, "empty")),
    ],
)
def test_truncation(one, text, want):
    got = one(v=G.truncation(F.lit(text).cast("string")))["v"]
    assert (got["is_truncated"], got["reason"]) == want


def test_placeholders(one):
    assert ask_text(one, G.placeholders, "Candidate DTQ met Candidate A and Person B.") == ["Candidate DTQ", "Person B"]


@pytest.mark.parametrize(
    "text, status",
    [("It ends well. " * 8, "ok"), ("A whole sentence of words that are long enough to count here as one, surely it is. And then a", "trimmed"), ("no end at all " * 9, "unrecoverable"), ("Hm. " + "no more end " * 9, "unrecoverable")],
)
def test_recovery(one, text, status):
    assert one(v=G.recover(F.lit(text)))["v"]["status"] == status


def test_remap(one):
    assert ask_text(one, G.remap_codes, "Candidate X and Candidate Q, then Candidate X") == {"X": "A", "Q": "B"}
    assert ask_text(one, G.remap_codes, "nobody") == {}
    assert ask_text(one, G.remap_codes, "Candidate A Candidate B Candidate C Candidate D") is None


@pytest.mark.parametrize("p, want", [(0.8, "high"), (0.6, "mid"), (0.1, "low"), (None, "unk"), (math.nan, "unk")])
def test_bins(one, p, want):
    assert one(v=P.bin3(F.lit(p).cast("double"), 0.6, 0.8))["v"] == want


def test_percentile_fallback_and_spread(spark):
    few = spark.createDataFrame([(0.5,), (0.6,), (0.7,)], "v double")
    assert tuple(P.thresholds(few, F.col("v")).first()) == (0.6, 0.8)
    same = spark.createDataFrame([(0.7,)] * 100 + [(math.nan,), (None,)], "v double")
    low, high = P.thresholds(same, F.col("v")).first()
    assert low == pytest.approx(0.7) and high == pytest.approx(0.7 + 1e-6)


def test_verdicts_and_guard(one):
    got = one(a=P.verdict(F.lit(0.62), "explain"), b=P.verdict(F.lit(0.62), "merge"), c=P.align(F.lit("REAL"), F.lit(20.0), A.literals(["A", "B", "C"])), d=P.binary(F.lit(math.nan)))
    assert (got["a"], got["b"], got["d"]) == ("FAKE", "UNCERTAIN", 0)
    assert got["c"] == {"verdict": "UNCERTAIN", "fake_percent": 41.0, "fake_no_indicators": False, "demoted_real_to_uncertain": True}


@pytest.mark.parametrize("i, code", [(0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA"), (18277, "ZZZ")])
def test_codes(one, i, code):
    assert one(v=X.index_code(F.lit(i)))["v"] == code


def test_text_helpers(one):
    got = one(
        clean=X.clean_text(F.lit(" a  b\n\tc ")), norm=X.norm_key(F.lit(' "Hi there!" ')), words=X.word_count(F.lit("Él dijo ñandú naïve 42 x_y")), none=X.word_count(F.lit("")),
        token=X.control_value(F.lit("<|tier=novice|>")), tidy=X.tidy_punctuation(F.lit("so , it is .")), html=X.escape_html(F.lit("<a href='x'>")),
    )
    assert got == {"clean": "a b c", "norm": "Hi there", "words": 6, "none": 1, "token": "novice", "tidy": "so, it is.", "html": "&lt;a href=&#x27;x&#x27;&gt;"}
    assert X.column_name("p_roberta_fake") == "probertafake" and X.column_name("2nd") == "f2nd"


def test_numbers(one):
    got = one(m=N.mean_known(F.lit(None).cast("double"), F.lit(math.nan), default=0.5), s=N.sigmoid(F.lit(1e9)), z=N.l2_normalise(F.array(F.lit(3.0), F.lit(4.0))), o=N.l2_normalise(F.array(F.lit(0.0), F.lit(0.0))), r=N.ratio(F.lit(1), F.lit(0)), b=N.percent(F.lit(1), F.lit(8), 0))
    assert got["m"] == 0.5 and got["s"] == 1.0 and got["z"] == [0.6, 0.8] and got["o"] == [0.0, 0.0] and got["r"] == 0.0 and got["b"] == 12.0
    assert [one(v=N.label_of(F.lit(x)))["v"] for x in ("Fake", " real ", "1", "0", "?", None)] == [1, 0, 1, 0, None, None]


def test_arrays(one):
    features = F.create_map(F.lit("ind_urg_fired"), F.lit(1.0), F.lit("ind_emo_fired"), F.lit(0.0))
    got = one(p=A.by_priority(A.literals(["IMP", "X", "EMO"]), ("EMO", "IMP")), f=A.fired_from_map(features), n=A.sub_ngrams(A.literals(["a", "b", "c"])), u=A.unknown_keys(F.lit('{"a":1,"zz":2}'), ["a"]), d=A.details(["URG", "EMO"], features), m=A.metrics_record(F.create_map(F.lit("eval_f1"), F.lit("0.5"), F.lit("note"), F.lit("x"))))
    assert got["p"] == ["EMO", "IMP", "X"] and got["f"] == ["URG"] and got["n"] == ["a", "a b", "a b c", "b", "b c", "c"] and got["u"] == ["zz"]
    assert got["d"]["URG"]["fired"] and not got["d"]["EMO"]["fired"] and got["m"] == {"f1": 0.5}


def test_equation(spark):
    df = spark.createDataFrame([(0.9, 0.8, "x"), (0.1, 0.2, "y"), (None, 0.5, "z")], "p_a double, p_b double, name string")
    ask = lambda e: [r[0] for r in df.select(EQ.compile_equation(e, df.columns)).collect()]
    high, low, none = ask("logreg(p_a + p_b - 1.0)")
    assert 0 < low < 0.5 < high < 1 and none is None
    assert ask("pa^2 + where(p_b > 0.3, 1, 0)")[0] == pytest.approx(1.81)
    assert ask("missing + 1") == [None] * 3 and ask("") == [None] * 3
    assert ask("log(p_a - 0.5)")[1] is None and ask("p_a / 0") == [None] * 3
    assert EQ.variables("logreg(b + a*b - pi)") == ["b", "a"]


@pytest.mark.parametrize("text", ["__import__('os')", "open('x')", "eval('1')", "(lambda: 1)()", "p_a.real", "[p_a]", "exp(p_a, x=1)", "p_a if 1 else 2", "1 +", "'a'", "True", "exp(1, 2)"])
def test_equation_is_closed(spark, text):
    with pytest.raises(EQ.EquationError):
        EQ.compile_equation(text, ["p_a"])


def test_keyword_score(one):
    got = one(v=G.keyword_score(F.lit("The Election and the ballot"), ["election", "ballot", ""], ["grab"]))["v"]
    assert (got["pos"], got["neg"]) == (2, 0) and got["score"] == pytest.approx(1 / (1 + 2.71828 ** (-1.4)))
    assert one(v=G.keyword_score(F.lit("")))["v"]["score"] == 0


def test_schema_errors(one):
    ask = lambda m: one(v=P.schema_error_category(F.lit(m)))["v"]
    assert [ask(m) for m in ("extra_forbidden", "Field required", "Input should be", "the candidate", "verdict", "indicator", "x")] == [
        "extra_forbidden_field", "missing_required_field", "wrong_field_type", "invalid_candidate_code", "invalid_verdict", "invalid_indicator", "other",
    ]


def test_running_totals_cross_blocks(one):
    n = A.BLOCK * 2 + 7
    got = one(s=A.running(F.sequence(F.lit(1), F.lit(n)), lambda a, b: a + b, F.lit(0), "int"), none=A.running(F.array().cast("array<int>"), lambda a, b: a + b, F.lit(0), "int"))
    assert got["s"] == [k * (k + 1) // 2 for k in range(1, n + 1)] and got["none"] == []


def test_index_codes_of_any_length(one):
    def code(i):
        out, i = "", i + 1
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(65 + r) + out
        return out

    numbers = [0, 25, 26, 701, 702, 18_277, 18_278, 18_279, 475_253, 475_254, 10**12, 2**62]
    got = one(v=F.transform(F.array(*[F.lit(i).cast("long") for i in numbers]), X.index_code))["v"]
    assert got == [code(i) for i in numbers]


def test_literals_of_patterns():
    from quillmesh.functions import lexicons as L
    from quillmesh.functions.prefilter import required

    assert required([r"\bcover[- ]?up\b"]) == ("\0cover up", "\0cover-up", "\0coverup")
    assert required([r"\bsources?\s+say(s)?\b"]) == ("\0source",) and required(["harvard|mit"]) == ("harvard", "mit")
    assert required([r"\bsources?\s+say(s)?\b", "x"]) is None
    texts = ["anonymous tip", "ranong", "a certain expert says", "puppet of china", "golden age", "nobel peace prize winner", "mit graduate", "45 % of voters support"]
    import re

    for patterns in L.PATTERNS.values():
        for p in patterns:
            need = required([p])
            for t in texts:
                assert not re.search(p, t, re.IGNORECASE) or need is None or any(re.search(("\\b" if n[0] == "\0" else "") + re.escape(n.strip("\0")), t) for n in need)


def test_exact_percentiles(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    for values in (rng.normal(size=5000), rng.integers(0, 4, 3000).astype(float), np.array([1.0]), np.array([2.0, 3.0]), np.repeat(7.0, 50)):
        frame = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
        got = P.percentiles(frame, (0.33, 0.67, 0.0, 1.0)).first()
        assert got.n == len(values) and got.p == pytest.approx(np.quantile(values, [0.33, 0.67, 0.0, 1.0]).tolist())


def test_gate_names_every_group_that_occurs(spark):
    import itertools

    from quillmesh.functions.prefilter import gate

    groups = {"a": ("abc", "cd"), "b": ("bcd", "x"), "c": ("ab",), "d": None, "e": ()}
    texts = ["".join(x) for n in range(6) for x in itertools.product("abcdx"[:4], repeat=n)] + ["x", "axb"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", gate(F.col("t"), groups).alias("g")).collect()
    for r in got:
        need = {k for k, ws in groups.items() if ws is None or any(w in r.t for w in ws)}
        assert need <= set(r.g) and "e" not in r.g, r
