"""Operators over documents: awkward rows, and whole tables against plain loops."""

import hashlib
import random
import re

import brute
import pytest
from pyspark.sql import functions as F

from tallywright.llm import bpe, langid, mixing, pii, simhash


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference(ranks):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})


# -- byte-level BPE ---------------------------------------------------------------


def test_slices_and_merges_equal_the_pattern(ranks, reference):
    random.seed(4)
    alphabet = "'''  \n\t  strevlmdaZ9\u0663!\u00e9.\u4e2d'\u2003\u3000'\u1c89\U00010d41"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(4000)]
    texts += ["", "'", "''s", "'s's", " 's", "\n's", "x" * 500, "ab" * 3000, " " * 300, "'" * 300, "=-" * 400, "'r", "'re"]
    encoder = bpe.Encoder(bpe.read_ranks(ranks), bpe.class_table())
    ids, starts, ends = encoder(texts)
    assert [i.tolist() for i in ids] == [reference.encode_ordinary(t) for t in texts]
    for text, i, s, e in zip(texts, ids, starts, ends):
        cuts = [*s.tolist(), len(text)]
        parts = [i[a:b].tolist() for a, b in zip([0, *e.tolist()], e.tolist())]
        assert [reference.decode(p) for p in parts] == [text[a:b] for a, b in zip(cuts, cuts[1:])]


def test_long_merges_equal_short_ones(ranks):
    table = bpe.read_ranks(ranks)
    random.seed(5)
    for n in (3, 20, 90):
        piece = bytes(random.choice(b"theandoing") for _ in range(n))
        if piece not in table:
            assert bpe._merge_long(piece, table) == bpe.merge(piece, table)


def test_long_texts_are_encoded_by_stretches(spark, ranks, reference):
    random.seed(9)
    words = ["don't", "we'll", "it's", "caf\u00e9", "a", "1234", "\n\n", "  ", "x!", "'s", "o'", "\u4e2d", " the", "end."]
    text = " ".join(random.choice(words) for _ in range(3000))
    for size in (1, 7, 50, 10**6):
        cut = bpe.stretches(text, size)
        assert "".join(cut) == text and (len(cut) > 1) == (size < len(text))
    assert bpe.stretches("x" * 5000, 10) == ["x" * 5000] and bpe.stretches("", 10) == [""]
    frame = spark.createDataFrame([(1, text), (2, "short one"), (3, None), (4, text[::-1])], "doc_id long, text string")
    want = {r.doc_id: r for r in bpe.encode(frame, ranks).collect()}
    for r in bpe.encode(frame, ranks, batch_bytes=100, stretch=40).collect():
        assert r == want[r.doc_id] and list(r.ids) == reference.encode_ordinary({1: text, 2: "short one", 4: text[::-1]}.get(r.doc_id, ""))


def test_batches_by_size():
    import pyarrow as pa

    from tallywright.llm.common import by_size

    texts = ["a" * 5, None, "", "b" * 12, "c", "d" * 4, "e" * 4, "f" * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["k", "t"])
    for slice_of in (batch, batch.slice(1, 6)):
        parts = [p.column(1).to_pylist() for p in by_size([slice_of], 1, 10, 3)]
        assert sum(parts, []) == slice_of.column(1).to_pylist()
        assert all(len(p) <= 3 and (len(p) == 1 or sum(len(t or "") for t in p) <= 10) for p in parts)


def test_encode_and_decode(awkward, nothing, ranks, reference):
    coded = bpe.decode(bpe.encode(awkward, ranks), ranks)
    assert coded.columns == ["doc_id", "ids", "starts", "ends", "decoded"]
    got = sorted(((r.doc_id or 0, bytes(r.decoded), list(r.ids)) for r in coded.collect()))
    want = sorted((r.doc_id or 0, (r.text or "").encode(), reference.encode_ordinary(r.text or "")) for r in awkward.collect())
    assert got == want
    spans = bpe.decode_slices(coded.where("doc_id = 12").select("doc_id", "ids", "starts", "ends"), ranks).collect()
    text = awkward.where("doc_id = 12").first().text
    assert b"".join(bytes(r.piece) for r in sorted(spans, key=lambda r: r.start)) == text.encode()
    assert bpe.decode(bpe.encode(nothing, ranks), ranks).count() == 0


def test_op4(spark, folder, documents, reference):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op4_byte_bpe(spark, folder).collect()}
    for r in documents.collect():
        ids = reference.encode_ordinary(r.text or "")
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id] == (len(ids), sha, hashlib.sha256((r.text or "").encode()).hexdigest())


# -- SimHash ----------------------------------------------------------------------


def test_simhash_of_awkward_rows(awkward, nothing):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    prints = {r.doc_id: r.fp & (1 << 64) - 1 for r in rows}
    texts = {r.doc_id: r.text for r in awkward.collect()}
    assert prints == {k: brute.fingerprint(t) for k, t in texts.items()}
    assert {r.doc_id: r.component_id for r in rows}[3] == 2  # texts without words are one group
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    root = brute.near_components({k: v for k, v in prints.items() if k is not None})
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [k for k in sorted(root) if root[k] == k]
    alone = all((prints[None] ^ prints[k]).bit_count() > 3 for k in root)
    assert kept.where("doc_id = 11").count() == 1 and kept.where("doc_id is null").count() == alone
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.keep_one(nothing).columns == nothing.columns


def test_rows_without_key_are_told_apart(spark):
    """Of each component one row stays, though all share the null key."""
    texts = [" ".join(f"{w}{i}" for w in "alpha beta gamma delta eps zeta eta theta".split()) for i in range(4)]
    rows = [(None, t, n) for n, t in enumerate([*texts, texts[0], texts[0], texts[1].upper()])] + [(5, texts[2], 9), (5, texts[3], 8), (5, texts[3], 7)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert len(kept) == 4 and {r.text.lower() for r in kept} == set(texts)
    assert [r.n for r in kept if r.text == texts[3]] == [7]  # of equal rows the smallest, and a key before none


def test_links_within_hot_groups(spark):
    """Groups around a centre, chains of links, and far ones; against all pairs."""
    random.seed(6)
    prints = {}
    for group in range(6):
        centre = random.getrandbits(64)
        for _ in range(40):
            near = centre
            for b in random.sample(range(64), random.choice([0, 1, 2, 3, 4, 5])):
                near ^= 1 << b
            prints[len(prints)] = near
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in set(prints.values())], "fp long")
    root = {r.fp: r.root for r in simhash.links(frame).collect()}
    signed = {k: v - (1 << 64) if v >> 63 else v for k, v in prints.items()}
    want = brute.near_components(prints)
    groups = {}
    for k, v in signed.items():
        groups.setdefault(want[k], set()).add(root.get(v, v))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_op10(spark, folder, documents):
    rows = simhash.op10_simhash(spark, folder).collect()
    prints = {r.doc_id: brute.fingerprint(r.text) for r in documents.collect()}
    assert {r.doc_id: r.fingerprint for r in rows} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute.near_components(prints)


# -- language ID ------------------------------------------------------------------


def test_language_of_awkward_rows(awkward, nothing):
    model = langid.learn(awkward)
    rows = langid.identify(awkward, model, carry=["row", "key"]).collect()
    assert len(rows) == awkward.count()
    by_id = {r.doc_id: r for r in rows}
    assert {by_id[k].lang_pred for k in (2, 3, 4, 10)} == {"und"} and by_id[2].score == 0
    assert by_id[13].lang_pred == by_id[5].lang_pred == "de" and by_id[1].row.key == "k"
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(nothing, langid.learn(nothing)).count() == 0
    assert {r.lang_pred for r in langid.identify(awkward, langid.learn(nothing)).collect()} == {"und"}


def test_mixtures_are_found(spark, documents):
    model = langid.learn(langid.training(documents))
    whole = {r.lang: r.text for r in documents.where("length(text) > 3000").orderBy("doc_id").collect()}
    mixed = spark.createDataFrame([(1, whole["en"][:1500] + "\n" + whole["de"][:1500])], "doc_id long, text string")
    found = langid.identify(mixed, model).first()
    assert {"en", "de"} <= set(found.langs) and abs(found.score - 0.5) < 0.15


def test_texts_in_no_learned_language_are_not_plausible(spark, documents):
    model = langid.learn(langid.training(documents))
    usual = langid.expected(langid.identify(documents.where("lang is not null").where(langid.fold() == 2), model))
    odd = ["\u65e5\u672c\u8a9e\u306e\u30c6\u30ad\u30b9\u30c8\u306f\u3053\u3053", "xqzv kjwq", "\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440, \u044d\u0442\u043e \u0442\u0435\u043a\u0441\u0442", "hdfjkg sdfkjg hsdkfjg " * 50, "123", None]
    frame = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert langid.identify(frame, model).where(langid.plausible(usual)).count() == 0
    known = langid.identify(documents, model)
    assert known.where(langid.plausible(usual)).count() >= 0.99 * known.where("grams > 0").count()
    assert langid.expected(known.limit(0)) is None
    row = known.where("grams > 50").first()  # the mixture's likelihood, trigram by trigram
    text = documents.where(f"doc_id = {row.doc_id}").first().text
    logs = model[1][langid.trigrams(text)][:, [model[0].index(x) for x in row.langs]].astype(float)
    import numpy as np

    each = np.log(np.exp(logs) @ np.array(row.shares))
    assert row.grams == len(each) and row.fit == pytest.approx(each.mean(), abs=1e-3) and row.spread == pytest.approx(each.std(), abs=1e-3)


def test_op9_on_held_out_rows(spark, folder, documents):
    rows = langid.op9_language_id(spark, folder).join(documents, "doc_id").where("held_out and length(text) > 60").collect()
    assert len(rows) > 20
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


# -- personal data ----------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda t: [int(c) for c in t if c in "0123456789"]

    def luhn(ds):
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(ds))) % 10 == 0

    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    random.seed(8)
    for alphabet in ("a.@-1 +%b", "1.2 ", "12 -", "+1 (2).-a"):
        for _ in range(3000):
            text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 60)))
            assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("4111 1111-1111 1111 x@y.zz") == plain_spans("4111 1111-1111 1111 x@y.zz")
    for long in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "a@" * 50_000):
        pii.base_spans(long)  # in linear time


def test_contexts_of_many_spans_in_linear_time():
    import time

    text = " ".join(f"word{'abcdefgh'[i % 8]} u{i}@mail.example" for i in range(20_000))
    began = time.time()
    spans = pii.base_spans(text)
    near = pii.contexts(text, spans)
    assert len(spans) == 20_000 and time.time() - began < 30
    few = pii.base_spans(text[:2000])
    assert pii.contexts(text[:2000], few)[:20] == near[:20]
    assert all(not any(x["start"] < e and s < x["end"] for _, s, e in few) for x in pii.contexts(text[:2000], few))


def test_revealing_terms(spark):
    """A word that only stands beside emails discloses them; common ones do not."""
    words = "alder birch cedar hazel larch maple rowan willow".split()
    docs = [(i, f"the cat {w} sat {i} correspondence u{i}@mail.example the dog") for i, w in enumerate(words)]
    docs += [(100 + i, "the cat and the dog sat on the mat " * 20) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = pii.find(frame)
    text = pii.redact(frame, found).where("doc_id = 3").first().text
    assert text == "the cat hazel sat 3  [EMAIL] the dog"


def test_pii_of_awkward_rows(spark, awkward, nothing):
    found = pii.find(awkward)
    assert found.count() == awkward.count() and found.where("size(spans) > 0").count() == 0
    clean = pii.redact(awkward, found)
    assert clean.columns == awkward.columns and clean.exceptAll(awkward).count() == 0
    assert pii.find(nothing).count() == 0


def test_op2(spark, folder, documents):
    rows = {r.doc_id: r for r in pii.op2_personal_data(spark, folder).collect()}
    for r in documents.collect():
        spans = plain_spans(r.text or "")
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        got = rows[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(s[0] == k for s in spans) for k in range(4)]
        assert got.spans.startswith(joined)


# -- mixing -----------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 50, None: 7}, {"a": 5}, {"b": 0, "a": 0}, {"z": 1, "y": 0, "x": 100, "w": 100, "v": 3},
])
def test_targets_equal_resharing_by_rounds(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(brute.targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))


def test_mixing_of_awkward_rows(awkward, nothing):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(0 <= r.copies <= 3 for r in rows)
    assert {r["size"] for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert mixing.mixed(awkward).columns == awkward.columns
    assert mixing.mix(nothing).count() == mixing.mixed(nothing).count() == 0


def test_rounding_keeps_counts_and_repeats(spark):
    """A source of many blocks: the number of further copies misses by less than one."""
    units = spark.range(5000).select(
        F.col("id").alias("key"), F.lit(0).cast("long").alias("rid"), F.lit(0).cast("long").alias("salt"), F.lit("a").alias("source"), (F.col("id") % 50 + 1).alias("size"), F.lit(1.37).alias("rate"))
    out = mixing.rounded(units, block=16)
    assert out.count() == 5000 and {r[0] for r in out.select("copies").distinct().collect()} == {1, 2}
    assert abs(out.agg(F.sum("copies")).first()[0] - 1.37 * 5000) < 1 + 1e-6
    words = out.agg(F.sum(F.col("copies") * F.col("size"))).first()[0]
    assert words == pytest.approx(1.37 * units.agg(F.sum("size")).first()[0], rel=0.01)
    assert out.exceptAll(mixing.rounded(units, block=16)).count() == 0


def test_many_rows_without_key(spark):
    """Equal rows meet in many blocks; other texts under the null key are other documents."""
    import time

    rows = spark.range(40_000).selectExpr(
        "cast(null AS long) AS doc_id", "if(id < 30000, 'same text', concat('text no ', id)) AS text", "if(id % 2 = 0, 'a', 'b') AS source")
    began = time.time()
    out = mixing.mix(rows).collect()
    assert time.time() - began < 100 and len(out) == 40_000
    sizes, taken = {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
    want = brute.targets(sizes)
    assert all(abs(taken[s] - want[s]) < 0.01 * want[s] for s in sizes)
    few = spark.createDataFrame([(None, f"text {i}", "a") for i in range(6)] + [(None, "text 0", "a"), (1, "x", "a"), (1, "y", "a")],
                                "doc_id long, text string, source string")
    assert sorted(r.text for r in mixing.mixed(few).collect()) == sorted([f"text {i}" for i in range(6)] + ["text 0", "x", "y"])


def test_op8(spark, folder, documents):
    rows = mixing.op8_mixing(spark, folder).join(documents.select("doc_id", "source", "text"), "doc_id").collect()
    sizes = {}
    for r in rows:
        assert r["size"] == len(brute.WORD.findall(r.text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        assert r.taken <= 3 * r["size"]
    want, taken, largest = brute.targets(sizes), {}, {}
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    for s in sizes:  # the rounding of a few large documents remains
        assert abs(taken[s] - want[s]) <= 1.5 * largest[s]
