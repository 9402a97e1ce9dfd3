import re
from collections import Counter
from math import comb

import numpy as np

from tests.llm import edge
from tidewater.llm import quality_knn as Q
from tidewater.llm import quality_rules as R

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def base(text):
    text = text or ""
    ws = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    hit = {j for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def corpus(spark, n=900):
    rows, marks = [], []
    for i in range(n):
        bad = i % 6 == 0
        ws = edge.words(i, 60).split()
        text = " ".join(w + "#*$" for w in ws) if bad else " ".join(ws) + "\nx\n\n x\nx"
        rows.append((1000 + i, text, "en" if i % 3 else None, "a", 0))
        marks.append((1000 + i, int(not bad), 0))
    rep = " ".join(["a b c d e f g h"] * 5)
    rows += [(1, "a b\r\na b\n\x0ba b\n\n", "en", "a", 0), (2, rep, "en", "a", 0), (3, "x\u00a0y\x1cz \x85", "en", "a", 0)]
    return edge.with_clashes(edge.docs(spark, rows)), edge.labels(spark, marks)


def test_measures_match_brute_force(spark):
    docs, _ = corpus(spark, 60)
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in R.measures(docs.select("doc_id", "text")).collect()), key=str)
    assert got == sorted(((r["doc_id"], *base(r["text"])) for r in docs.collect()), key=str)


def test_judge_controls_false_rejections(spark):
    docs, labels = corpus(spark)
    got = edge.collected(R.judge(docs, labels))
    assert len(got) == docs.count()
    mine = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] >= 1000}
    en = [i for i in range(900) if i % 3]
    assert all(mine[1000 + i]["kept"] == (i % 6 != 0) for i in en)
    assert all(not r["kept"] for r in got if r["base_failed"]) and all(r["base_failed"] for r in got if r["n_words"] < 20)


def test_binomial_tail_is_exact():
    for n, p in ((7, 0.3), (40, 0.01), (200, 0.05)):
        for k in range(n + 1):
            true = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
            assert abs(R.binomial_tail(np.array([k]), np.array([n]), p)[0] - true) < 1e-9


def test_no_cutoff_from_few_good_documents(spark):
    docs, labels = corpus(spark, 60)
    assert {r["failed_rules"] for r in R.judge(docs, labels).collect()} == {""}


def test_neighbours_separate_the_classes(spark):
    docs, labels = corpus(spark, 300)
    got = {}
    for r in Q.score(docs, labels, Q.label_fold(3) != 1).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert sum(map(len, got.values())) == docs.count()
    assert all((got[1000 + i][0] >= 0.5) == (i % 6 != 0) for i in range(300))
    assert all(0 <= x <= 1 for v in got.values() for x in v)


def test_votes_match_brute_force():
    rng = np.random.default_rng(2)
    mine = Q.unit_rows(rng.standard_normal((50, 6)).astype(np.float32))
    z = Q.unit_rows(rng.standard_normal((9, 6)).astype(np.float32))
    label, vote = rng.integers(0, 2, 50), rng.random(50) + 0.5
    got = Q.votes(z, {"mine": mine, "label": label, "vote": vote}, 7, 0.5)
    for i in range(9):
        near = sorted(range(50), key=lambda j: -float(z[i] @ mine[j]))[:7]
        w = [max(float(z[i] @ mine[j]), 0) ** 4 * vote[j] for j in near]
        assert abs(got[i] - sum(x for x, j in zip(w, near) if label[j]) / sum(w)) < 1e-4


def test_latent_axes_span_the_leading_directions():
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((60, 5)) @ rng.standard_normal((5, 200)) + 0.01 * rng.standard_normal((60, 200))).astype(np.float32)
    axes = Q.latent_axes(x, rank=5)
    assert np.abs(x - (x @ axes) @ axes.T).max() < 0.1


def test_empty_tables(spark):
    docs, labels = corpus(spark, 30)
    assert R.judge(docs.limit(0), labels).count() == 0 and R.judge(docs, labels.limit(0)).count() == docs.count()
    assert Q.score(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in Q.score(docs, labels.limit(0)).collect()} == {0.5}
