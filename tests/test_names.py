"""The name operators against their plain versions."""

from __future__ import annotations

import random

import names_brute as brute
from pyspark.sql import functions as F

from quillmesh.functions import keep_lists as K
from quillmesh.operators import spans as S


def texts() -> list[tuple[int, str]]:
    rng = random.Random(4)
    words = ["Ana", "Cruz", "Quezon", "Office", "Marlow", "Today", "the", "si", "kay", "said", "Sen.", "Dr", "ayon kay", ",", "(", '"', "Pulse", "Lopez,", "é", "Thaléa", "PNP", ".", "\n", "Bayan"]
    made = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(300)]
    return list(enumerate([*brute.FIXTURES, *made]))


def test_person_spans(spark):
    rows = texts()
    got = spark.createDataFrame(rows, "id int, t string").select("id", S.person_spans(F.col("t")).alias("s")).collect()
    for r in got:
        assert [tuple(x) for x in r.s] == brute.person_spans(rows[r.id][1]), rows[r.id][1]


def test_rewrite(spark):
    rows = texts()
    got = spark.createDataFrame(rows, "id int, t string").select("id", S.universal_rewrite(F.col("t")).alias("r")).collect()
    for r in got:
        assert (r.r.text, r.r.n) == brute.rewrite(rows[r.id][1]), rows[r.id][1]


def test_gate_and_its_reports(spark):
    rows = [(1, "Pero Today Kahapon came."), (2, "Pacquiao Moreno spoke in Quezon City."), (3, "duterte was named"), (4, "Candidate A and Rappler agreed"), (5, "Juan Stone left")]
    df = spark.createDataFrame(rows, "id int, text string")
    gated = S.strict_gate(df, "text", ["candidate a"], ["duterte", "pacquiao"])
    got = {r.id: r for r in gated.collect()}
    assert [got[i].accepted for i in range(1, 6)] == [True, False, False, True, False]
    assert got[3].redacted == "[Iba pang tao] was named" and got[5].redacted == "[Iba pang tao] left"
    assert [(f.status, f.pattern) for f in got[3].foreign] == [("blocklist", "blocklist_direct")]
    report = S.gate_summary(gated).first()
    assert (report.n_input, report.n_kept, report.n_rejected, report.pass_rate_pct) == (5, 2, 3, 40.0)
    assert S.foreign_names(gated, 1).first().n == 1
    assert S.foreign_examples(gated, "id", "text", 1).first().id == 2


def test_lists_are_distinct():
    assert "Pero" in K.GATE_NON_NAMES and "Pero" not in S.NON_NAMES
