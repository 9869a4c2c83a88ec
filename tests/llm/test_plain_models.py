"""What models and statistics add, by plain loops."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF

from tallywright.llm import langid, pii, urls

# -- language ID ------------------------------------------------------------------


def plain_trigrams(text):
    """The three letters around each letter of a word, as a bucket."""
    out, kept = [], "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    for word in kept.split(" "):
        for a, b, c in zip(f" {word}", word, f"{word} "[1:]):
            x = (ord(a) * 0x9E3779B1 ^ ord(b) * 0x85EBCA77 ^ ord(c) * 0xC2B2AE3D) % 2 ** 32
            x = (x ^ x >> 15) * 0x2C1B3C6D % 2 ** 32
            out.append((x ^ x >> 16) % langid.BUCKETS)
    return out


def plain_mixture(counts, likely, langs, start):
    share = dict(start)
    for _ in range(langid.ROUNDS):
        new = dict.fromkeys(langs, 0.0)
        for b, n in counts.items():
            under = sum(share[x] * likely[b][x] for x in langs)
            for x in langs:
                new[x] += n * share[x] * likely[b][x] / under
        new = {x: v / sum(counts.values()) for x, v in new.items()}
        done = max(abs(new[x] - share[x]) for x in langs) < 1e-4
        share = new
        if done:
            break
    value = sum(n * math.log(sum(share[x] * likely[b][x] for x in langs)) for b, n in counts.items())
    return share, value - 0.5 * (len(langs) - 1) * math.log(sum(counts.values()))


def plain_set(text, langs, logs):
    """The set that languages join by their shares while the penalised likelihood rises, its
    proportions and that likelihood; the best likelihood of any set of languages."""
    counts = Counter(plain_trigrams(text))
    likely = {b: {x: math.exp(logs[b][k]) for k, x in enumerate(langs)} for b in counts}
    every, _ = plain_mixture(counts, likely, langs, dict.fromkeys(langs, 1 / len(langs)))
    order = sorted(langs, key=lambda x: (-every[x], langs.index(x)))
    best = None
    for size in range(1, len(langs) + 1):
        part = order[:size]
        total = sum(every[x] for x in part)
        found = plain_mixture(counts, likely, part, {x: every[x] / total for x in part})
        if best and found[1] <= best[1]:
            break
        best = found
    sets = [s for size in range(1, len(langs) + 1) for s in itertools.combinations(langs, size)]
    return *best, max(plain_mixture(counts, likely, s, dict.fromkeys(s, 1 / len(s)))[1] for s in sets)


def test_model_is_the_smoothed_counts(spark, documents):
    learned = langid.training(documents).where("lang is not null")
    langs, logs = langid.learn(learned)
    counts = {x: Counter() for x in langs}
    for r in learned.collect():
        counts[r.lang].update(plain_trigrams(r.text))
    total = {x: sum(c.values()) for x, c in counts.items()}
    assert langs == sorted(langs) and sum(total.values()) > 0
    for b in range(0, langid.BUCKETS, 7):
        every = (sum(c[b] for c in counts.values()) + 0.5) / (sum(total.values()) + 0.5 * langid.BUCKETS)
        for k, x in enumerate(langs):
            assert logs[b, k] == pytest.approx(math.log((counts[x][b] + 200 * every) / (total[x] + 200)), abs=1e-4)


def test_sets_of_languages_by_plain_loops(spark, documents):
    langs, logs = langid.learn(langid.training(documents))
    texts = [r.text for r in documents.where("length(text) between 1 and 900").orderBy("doc_id").limit(60).collect()]
    texts += [f"{a[:300]}\n{b[:300]}" for a, b in zip(texts, reversed(texts[:20]))]
    texts += ["a", "Été à la mer", "Straße, İstanbul!", "x" * 40]
    texts = [t for t in texts if plain_trigrams(t)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in langid.identify(frame, (langs, logs)).collect()}
    best_of_all = 0
    for i, text in enumerate(texts):
        share, value, most = plain_set(text, langs, logs.astype(float))
        got = rows[i]
        assert got.grams == len(plain_trigrams(text)) and sorted(got.langs) == sorted(share)
        assert dict(zip(got.langs, got.shares)) == pytest.approx(share, abs=1e-6)
        assert got.score == pytest.approx(max(share.values()), abs=1e-6) and got.shares == sorted(got.shares, reverse=True)
        best_of_all += value >= most - 0.5
    assert best_of_all >= 0.95 * len(texts)


# -- URL filter -------------------------------------------------------------------


def plain_grams(host, path):
    chars = f"^{host}{path}$"
    return {chars[i:i + n] for n in urls.GRAMS for i in range(len(chars) - n + 1)}


def plain_regression(features, labels, penalty=0.01):
    """Intercept and weights of the least mean logistic loss plus half the penalty times the squared
    weights, in units of each feature's standard deviation, by Newton's method."""
    deviation = features.std(axis=0, ddof=1)
    used = deviation > 0
    x = np.column_stack([np.ones(len(features)), features[:, used] / deviation[used]])
    ridge = np.diag([0.0] + [penalty] * int(used.sum()))
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge + 1e-12 * np.eye(len(ridge)),
                               x.T @ (p - labels) / len(x) + ridge @ beta)
        beta -= step
        if np.abs(step).max() < 1e-10:
            break
    weights = np.zeros(features.shape[1])
    weights[used] = beta[1:] / deviation[used]
    return beta[0], weights


def test_regression_by_newtons_method(spark):
    rng = random.Random(4)
    words = "shop cart deal news wiki paper blog forum".split()
    seen = [("block" if i % 2 else "allow", f"{rng.choice(words[:5] if i % 2 else words[3:])}{rng.randint(0, 9)}.test", f"/{rng.choice(words)}")
            for i in range(90)]
    seen = sorted({(h, p): (v, h, p) for v, h, p in seen}.values())
    asked = [(i, f"http://{rng.choice(words)}.{rng.choice(words)}/{rng.choice(words)}{i}") for i in range(40)] + [(99, None)]
    labelled = spark.createDataFrame([(h, p, v) for v, h, p in seen], "host string, path string, verdict string")
    out = urls.judge(spark.createDataFrame(asked, "page_id long, url string"), labelled=labelled).collect()
    hashing = HashingTF(numFeatures=urls.FEATURES, binary=True, inputCol="grams", outputCol="features")
    places = {}

    def vector(host, path):
        row = np.zeros(urls.FEATURES)
        for g in plain_grams(host, path):
            row[places.setdefault(g, None) or places.update({g: hashing.indexOf(g)}) or places[g]] = 1
        return row

    base, weights = plain_regression(
        np.array([vector(h, p) for _, h, p in seen]), np.array([float(v == "block") for v, _, _ in seen]))
    scores = {r.page_id: 1 / (1 + math.exp(-base - vector(r.host, r.path) @ weights)) for r in out}
    assert len(out) == len(asked) and len({round(s, 3) for s in scores.values()}) > 20
    assert {r.page_id: r.block_score for r in out} == pytest.approx(scores, abs=0.005)
    assert all(r.verdict == ("block" if r.block_score >= 0.5 else "allow") for r in out)


# -- personal data ----------------------------------------------------------------


def plain_disclosure(texts):
    """``{(term, kind): disclosure}`` by every word against every span of its text."""
    counts, near, windows = Counter(), Counter(), {}
    for text in texts:
        words = [(m[0].lower(), *m.span()) for m in pii.TERM.finditer(text)]
        counts.update(w for w, _, _ in words)
        spans, places = pii.base_spans(text), set()
        for kind, start, end in spans:
            left = [w for w in words if w[2] <= start and (w[1] > start - pii.REACH or start <= pii.REACH)]
            right = [w for w in words if w[1] >= end and (w[2] < end + pii.REACH or len(text) <= end + pii.REACH)]
            around = left[-pii.WINDOW:] + right[:pii.WINDOW]
            for w, a, b in around:
                if not any(a < e and s < b for _, s, e in spans) and (a, kind) not in places:
                    places.add((a, kind))
                    near[w, kind] += 1
                    windows.setdefault((w, kind), set()).add(tuple(text[c:d] for _, c, d in around))
    out = {}
    for (w, kind), n in near.items():
        share = sum(v for (_, k), v in near.items() if k == kind) / sum(counts.values())
        if len(windows[w, kind]) >= pii.SUPPORT:
            out[w, kind] = math.log2(n / counts[w] / share) / -math.log2(share)
    return out


def random_texts(seed):
    """Common words everywhere, some that mostly stand beside a kind of span, and copies."""
    rng = random.Random(seed)
    common = "the cat and dog sat mat house tree road sky over under near".split()
    beside = {0: "mailbox correspondence", 1: "gateway subnet", 3: "dial switchboard"}
    spans = {0: lambda i: f"u{i}@mail.example", 1: lambda i: f"10.0.{i % 250}.7", 3: lambda i: f"+49 30 {1000000 + i}"}
    texts = []
    for i in range(150):
        words = [rng.choice(common) for _ in range(rng.randint(5, 160))]
        for kind, names in beside.items():
            name, apart = names.split()
            if rng.random() < 0.35:
                at = rng.randrange(len(words))
                words[at:at] = rng.sample(common, 2) + [name.upper() if rng.random() < 0.3 else name, spans[kind](i)]
            if rng.random() < 0.1:
                words.insert(0, apart), words.append(spans[kind](i + 500))
        if rng.random() < 0.05:
            words.insert(rng.randrange(len(words)), "mailbox")
        texts.append(" ".join(words))
    return texts + texts[:20]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_disclosure_by_plain_loops(spark, seed):
    texts = random_texts(seed)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    plain = plain_disclosure(texts)
    got = {(r.term, r.kind): r.disclosure for r in pii.disclosure(pii.scan(frame, "doc_id", "text")).collect()}
    assert got == pytest.approx(plain, abs=1e-9)
    level = {}
    for (w, _), d in plain.items():
        level[w] = max(level.get(w, -9.0), d)
    assert sum(d >= pii.GENERALISE for d in level.values()) >= 2 and sum(d < pii.GENERALISE for d in level.values()) >= 5
    kind = {w: pii.REMOVED if d >= pii.REMOVE else pii.GENERALISED for w, d in level.items() if d >= pii.GENERALISE}
    for r in pii.find(frame).collect():
        text = texts[r.doc_id]
        spans = pii.base_spans(text)
        added = [(kind[m[0].lower()], *m.span()) for m in pii.TERM.finditer(text) if m[0].lower() in kind
                 and not any(m.start() < e and s < m.end() for _, s, e in spans)]
        assert sorted((s.kind, s.start, s.end) for s in r.spans) == sorted(spans + added)
