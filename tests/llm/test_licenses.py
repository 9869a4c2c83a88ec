"""License scans against regular expressions over the words, and against SQL."""

import random
import re

import compare
import pytest

from tallywright.llm import licenses as L
from tallywright.llm.queries import LLM_QUERIES, LLM_SQL

SCHEMA = "doc_id long, text string, n_words int, phrases int, matches int, key int, label int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 1, 2, 3, 4, 5) for k, t in rows], SCHEMA)


def full_text(label, holder="Some One and Others"):
    """A license's text with its regions filled in and its optional ones left out."""
    markup = next(m for name, m in L.TEMPLATES if name == label)
    markup = re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", markup, flags=re.S)
    return re.sub(r"<<var;name=\"bullet\"[^>]*>>", "*", re.sub(r"<<var;name=\"holder\"[^>]*>>", holder, markup))


@pytest.mark.parametrize("markup", [
    "a b c", "a <<beginOptional>>b<<endOptional>> c", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>> a<<endOptional>> b",
    'a <<var;name="x";match=".{0,2}">> b', 'a <<var;name="x";match=".{1,3}">> <<var;name="y";match=".{0,1}">> a',
    '<<var;name="v";match="a b|c|b a">> c <<beginOptional>>a<<endOptional>>', '<<var;match=".+">> a', 'a <<var;match=".*">> b b',
    'b <<beginOptional>><<var;match="a|c a">><<endOptional>> <<beginOptional>>a<<endOptional>> b',
])
def test_automata_equal_regular_expressions(markup):
    random.seed(7)
    automaton, expression = L.Automaton(markup), re.compile(L.pattern(markup))
    for _ in range(1500):
        text = " ".join(random.choice("abc") for _ in range(random.randint(0, 12)))
        words = L.words_of(text)
        joined = "".join(w.decode() + " " for w in words)
        ends = {}  # by begin, the longest of all that match there
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                if expression.fullmatch("".join(w.decode() + " " for w in words[i:j])):
                    ends[i] = j
        want, after = [], 0
        for i in sorted(ends):
            if i >= after:
                want.append((i, ends[i]))
                after = ends[i]
        assert automaton.places(words) == want, (markup, text)
        assert bool(want) == any(expression.match(joined, m.start()) for m in re.finditer(r"(?<![^ ])(?=\S)", joined))


@pytest.mark.parametrize("markup", ["", "<<beginOptional>>a<<endOptional>>", 'a <<var;name="x">> b', "a <<beginOptional>> b", "a <<endOptional>> b", '<<var;match=".*">>'])
def test_templates_that_say_nothing_are_refused(markup):
    with pytest.raises(ValueError):
        L.Automaton(markup)


@pytest.mark.parametrize("label", ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense"])
def test_license_texts(label):
    text = full_text(label)
    automata = [(name, L.Automaton(markup)) for name, markup in L.TEMPLATES]
    found = lambda t: {name for name, a in automata if a.places(L.words_of(t))}
    layout = re.sub(r"\s+", lambda m: random.choice([" ", "\n * ", "  \t"]), text).swapcase()
    assert found(text) == found(f"before {layout} behind") == {label}
    words = text.split()
    at = len(words) // 3
    assert label not in found(" ".join(words[:at] + ["otherwise"] + words[at:]))  # a word more
    assert label not in found(" ".join(words[:at] + words[at + 1:]))  # a word less
    if "holder" in dict(L.TEMPLATES)[label]:
        assert found(full_text(label, "x " * 60)) == {label} and found(full_text(label, "x " * 61)) == set()


@pytest.mark.parametrize("text, labels", [
    ("Released under the MIT License.", "MIT,mit"), ("released UNDER the terms of the mit-license", "MIT,mit"),
    ("the MIT License", "mit"), ("released under the MITLicense", ""), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0,apache"),
    ("licensed under the Apache License Version 2", "apache"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0,gpl"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "GPL-2.0,gpl"),
    ("General Public License general public license", "gpl"), ("mité license İmit license", ""), ("permission is hereby granted", ""),
    ("mit mit license license apache\nlicense", "apache,mit"), (None, ""), ("", ""),
])
def test_notices(spark, text, labels):
    row = L.scan(frame(spark, [(1, text)])).first()
    assert ",".join(sorted({m.label for m in row.phrases + row.matches})) == labels
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    assert row.n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered))
    for m in row.matches + row.phrases:
        assert 0 <= m.begin < m.end <= row.n_words


def test_awkward_rows(spark, awkward, nothing):
    out = L.scan(awkward)
    assert out.columns == ["doc_id", "n_words", "phrases", "matches"] and out.count() == awkward.count()
    assert out.where("size(phrases) + size(matches) > 0").count() == 0
    assert L.scan(nothing).count() == 0
    long = " ".join(["released under the MIT License. mit"] * 30_000)
    rows = L.scan(frame(spark, [(1, long), (1, long), (None, "mit license"), (2, "x" * 3_000_000)])).collect()
    assert [len(r.matches) for r in rows] == [30_000, 30_000, 0, 0] and [len(r.phrases) for r in rows] == [30_000, 30_000, 1, 0]
    assert rows[0].matches[7].begin == 42 and rows[0].matches[7].end == 47


def test_op13_equals_its_sql(spark, folder):
    assert compare.differences(LLM_QUERIES["op13_license_scan"](spark, folder), compare.connect(folder), LLM_SQL["op13_license_scan"]) == ""


def test_op13_sql_over_license_texts(spark, tmp_path):
    rows = [(i, full_text(label) if label != "GPL-2.0" else "x") for i, (label, _) in enumerate(L.TEMPLATES)]
    rows += [(100 + i, t) for i, t in enumerate([None, "", "mit license MIT license", "a 中 mit　license", "released under the mit license"])]
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare.differences(L.op13_license_scan(spark, str(tmp_path)), con, L.OP13_SQL) == ""
