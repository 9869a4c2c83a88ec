"""Line dedup against brute force over all pairs of lines."""

import random

import brute
import pytest

from tallywright.llm import line_dedup


def deduped(spark, docs, **options):
    frame = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(docs)], "doc_id long, text string, n int")
    return {(r.doc_id, r.n): (r.text, r.removed_lines) for r in line_dedup.dedupe(frame, **options).collect()}


def surroundings():
    """Passages of 1 to 6 lines at other places, between other lines; overlapping repeats; null keys."""
    runs = {n: [f"line {i} of a run of {n}" for i in range(n)] for n in (1, 2, 3, 4, 5, 6)}
    docs = []
    for n, run in runs.items():
        for copy in range(3):
            docs.append((10 * n + copy, "\n".join(
                [f"before {n} {copy} {i}" for i in range(copy)] + run + [f"after {n} {copy} {i}" for i in range(3 - copy)])))
    docs += [(100, "\n".join(["a"] * 7 + ["b", "a", "a", "b", "a"])), (101, "\n".join(["", "x", "", "x", "", "x", "y", "b", "a"]))]
    docs += [(102, dict(docs)[42]), (103, "\n".join(runs[3] + runs[5][1:3] + runs[6])), (None, "\n".join(runs[2])), (104, None), (105, "")]
    return docs


@pytest.mark.parametrize("held", [10**6, 0])
def test_runs_in_other_surroundings(spark, held):
    """With the repeated hashes broadcast, and joined by a shuffle."""
    docs = surroundings()
    got = deduped(spark, docs, held=held)
    assert got == brute.without_chunks(docs)
    by_key = {k: v for (k, _), v in got.items()}
    assert by_key[52][0] == "before 5 2 0\nbefore 5 2 1\nafter 5 2 0" and by_key[11][1] == 0 and by_key[103][0] == ""


def test_random_texts(spark):
    r = random.Random(12)
    docs = [(r.choice([None, i, i % 20]), "\n".join(r.choice("aabbcdefgh ") * r.choice([1, 1, 2]) for _ in range(r.randint(0, 9)))) for i in range(150)]
    assert deduped(spark, docs) == brute.without_chunks(docs)


def test_a_removed_chunk_stands_somewhere_in_what_stays(spark):
    """A,B is first seen where B goes as a part of B,X: so the last A,B stays."""
    got = deduped(spark, [(1, "B\nX"), (2, "A\nB\nX"), (3, "A\nB")])
    assert [t for _, (t, _) in sorted(got.items())] == ["B\nX", "A", "A\nB"]
    # a passage in a document that has copies of its own goes from all but the first
    passage = [f"p{i}" for i in range(4)]
    docs = [(1, "\n".join(["x", *passage, "y"]))] + [(k, "\n".join(["h0", "h1", *passage, "t0", "t1"])) for k in (2, 3, 4)]
    assert [t for _, (t, _) in sorted(deduped(spark, docs).items())] == ["x\np0\np1\np2\np3\ny", "h0\nh1\nt0\nt1", "", ""]
    rows = line_dedup.chunks(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((c.doc.key, c.begin, c.end, c.first.key, c["at"]) for c in rows if c.doc.key == 3) == [
        (3, 0, 1, 2, 0), (3, 2, 5, 1, 1), (3, 6, 7, 2, 6)]


def test_blank_lines_are_no_chunk(spark):
    got = deduped(spark, [(1, "q1\n\n\nq2"), (2, "z1\n\n\nz2"), (3, "a\n \nb\nc\n\nd"), (4, "e\na\n\t\n\nb\nc\n\nf"), (5, "\n\n"), (6, "\n\n")])
    assert [t for _, (t, _) in sorted(got.items())] == ["q1\n\n\nq2", "z1\n\n\nz2", "a\n \nb\nc\n\nd", "e\n\nf", "\n\n", "\n\n"]


def test_null_keys_are_documents_of_their_own(spark):
    docs = [(None, f"own {i}\ns1\ns2\ns3") for i in range(3)] + [(None, "u\nv")] * 2
    got = sorted(t for t, _ in deduped(spark, docs).values())
    assert sum(t in ("own 0", "own 1", "own 2") for t in got) == 2
    assert sum("s1\ns2\ns3" in t for t in got) == 1 and got.count("u\nv") == 2


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    """All rolling hashes equal: the bytes decide."""
    plain = line_dedup.rolling

    def colliding(text, size, with_lines=False):
        from pyspark.sql import functions as F

        return F.transform(plain(text, size, with_lines), lambda w: w.withField("hash", F.lit(1).cast("long")))

    monkeypatch.setattr(line_dedup, "rolling", colliding)
    docs = surroundings()
    assert deduped(spark, docs) == brute.without_chunks(docs)


def test_line_dedup_of_awkward_rows(awkward, nothing):
    out = line_dedup.dedupe(awkward)
    assert out.columns == [*awkward.columns, "removed_lines"] and out.count() == awkward.count()
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    want = {(k, t): v for (k, n), v in brute.without_chunks(docs).items() for t in [docs[n][1]]}
    rows = {r.doc_id: r for r in out.collect()}
    assert all((rows[k].text, rows[k].removed_lines) == v for (k, _), v in want.items())
    assert rows[7].removed_lines > 0 and rows[6].removed_lines == 0
    assert line_dedup.dedupe(nothing).count() == 0


def test_op6(spark, folder, documents):
    rows = line_dedup.op6_line_dedup(spark, folder).collect()
    assert {r.doc_id: (r.text, r.removed_lines) for r in rows} == {
        k: v for (k, _), v in brute.without_chunks([(r.doc_id, r.text) for r in documents.collect()]).items()}
    assert all(r.n_chars == len(r.text) for r in rows)
    assert "Python" not in line_dedup.op6_line_dedup(spark, folder)._jdf.queryExecution().toString()
