"""Disclosing terms go wherever they stand."""

import pytest

from tallywright.llm import pii


@pytest.mark.parametrize("held", [200_000, 0])  # held by every task, and joined
def test_every_occurrence_of_a_disclosing_term(spark, monkeypatch, held):
    monkeypatch.setattr(pii, "HELD", held, raising=False)
    words = "alder birch cedar hazel larch maple rowan willow".split()
    docs = [(i, f"the cat {w} sat {i} correspondence u{i}@mail.example the dog") for i, w in enumerate(words)]
    docs += [(100 + i, "the cat and the dog sat on the mat " * 20) for i in range(20)]
    far = "the cat and the dog sat on the mat " * 6
    docs += [(200, f"a Correspondence of old {far}z@mail.example, {far}correspondence@mail.example"), (201, "CORRESPONDENCE only"),
             (201, "CORRESPONDENCE only"), (None, "no key, correspondence"), (202, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = pii.find(frame)
    assert found.count() == len(docs)
    texts = sorted((r.doc_id or 0, r.text) for r in pii.redact(frame, found).where("doc_id is null or doc_id = 3 or doc_id >= 200").collect())
    assert texts == [
        (0, "no key, "), (3, "the cat hazel sat 3  [EMAIL] the dog"), (200, f"a  of old {far}[EMAIL], {far}[EMAIL]"),
        (201, " only"), (201, " only"), (202, None)]


def test_free_terms_overlap_no_span():
    text = "alpha beta gamma delta"
    spans = [(0, 6, 8), (1, 7, 10), (0, 17, 17 + 5)]
    assert list(pii.free_terms(text, spans)) == [("alpha", 0, 5), ("gamma", 11, 16)]
    assert len(list(pii.free_terms(text, []))) == 4


def test_terms_that_grow_in_lower_case(spark):
    """A lower-cased capital I with a dot is two code points; the term is still counted as one word."""
    docs = [(i, f"the cat {w} sat {i} \u0130stanbul u{i}@mail.example the dog") for i, w in enumerate(
        "alder birch cedar hazel larch maple rowan willow".split())]
    docs += [(100 + i, "the cat and the dog sat on the mat " * 20) for i in range(20)] + [(200, "\u0130STANBUL only")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(frame).collect()}
    assert rows[200] == [(pii.REMOVED, 0, 8)] and (pii.REMOVED, 20, 28) in rows[0]
