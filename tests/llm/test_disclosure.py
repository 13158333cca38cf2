"""Terms that disclose entities of few documents."""

from __future__ import annotations

from quillmesh.llm import pii


def cleaned(spark, special: dict[int, str], n: int = 400) -> dict[int, str]:
    rows = [(i, special.get(i, f"some plain words were written today in town number {i % 7}")) for i in range(n)]
    return {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}


def test_entity_of_one_document(spark):
    clean = cleaned(spark, {3: "some plain words Zebediah wrote zeb@corp.com today in town"} | {i: "some plain words she wrote today in town" for i in range(4, 90)})
    assert clean[3] == "some plain words  wrote <email> today in town"
    assert clean[4] == "some plain words she wrote today in town"


def test_entity_of_two_documents(spark):
    text = "some plain words Zebediah written zeb@corp.com today in town"
    clean = cleaned(spark, {3: text, 9: text})
    assert clean[3] == clean[9] == "some plain words  written <email> today in town"


def test_term_far_from_the_entity(spark):
    filler = " ".join(["some plain words were written today in town"] * 5)
    clean = cleaned(spark, {3: f"Zebediah {filler} zeb@corp.com {filler} zebediah", 5: f"{filler} corp"})
    assert clean[3] == f" {filler} <email> {filler} "
    assert clean[5] == f"{filler} corp"


def test_term_counts_are_of_whole_documents(spark):
    far = " ".join(["some plain words were written today in town"] * 5)
    clean = cleaned(spark, {i: (f"Zebediah wrote zeb@corp.com {far}" if i % 2 else f"Zebediah wrote {far} zeb@corp.com") for i in range(8)})
    assert {clean[i].split()[0] for i in range(8)} == {"some", "<email>"}


def test_many_entities_of_one_document(spark):
    mails = " ".join(f"a{k}@corp.com" for k in range(300))
    clean = cleaned(spark, {3: f"Zebediah has {mails}", 4: "none has any"})
    assert clean[3] == " has " + " ".join(["<email>"] * 300)
