from collections import Counter

import numpy as np
import pytest

from tests.llm import edge
from tidewater.llm import near_dedup as N
from tidewater.llm import textkit as X


@pytest.mark.parametrize("n,keep", [(5, 0.7), (60, 0.8), (60, 0.4), (800, 0.9)])
def test_signatures_agree_as_weighted_jaccard(n, keep):
    rng = np.random.default_rng(n)
    seen, true = [], []
    for _ in range(40):
        e = rng.integers(0, 2**63, 2 * n).astype(X.U)
        a = rng.integers(0, 3, 2 * n) * rng.choice([1.0, 0.5, 1.3], 2 * n) + 1e-3
        b = np.where(rng.random(2 * n) < keep, a, rng.integers(0, 3, 2 * n) + 1e-3)
        s = [N.signatures(e, np.zeros(len(e), np.int64), w, 1)[0] for w in (a, b)]
        seen.append((s[0] == s[1]).mean())
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(seen) - np.mean(true)) < 0.03


def bag(text):
    ws = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()
    return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else Counter([tuple(ws)] if ws else [])


def brute(rows):
    """fp text -> class, by all pairs."""
    texts = sorted({t or "" for _, t in rows})
    bags, root = {t: bag(t) for t in texts}, {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            low, high = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if high and low >= 0.8 * high:
                root[find(a)] = find(b)
    ids = {}
    for d, t in rows:
        ids.setdefault(find(t or ""), []).append(d)
    least = {c: min((x for x in v if x is not None), default=None) for c, v in ids.items()}
    return sorted(((d, least[find(t or "")]) for d, t in rows), key=str)


def edited(text, seed, n):
    ws = text.split()
    for k in range(n):
        ws[(seed * 31 + k * 97) % len(ws)] = f"w{seed}x{k}"
    return " ".join(ws)


def family(first, n, edits):
    base = edge.words(5, 120)
    return [(first + i, edited(base, i + 1, edits), "en", "a", 0) for i in range(n)]


def test_classes_match_brute_force_with_chains_and_edge_rows(spark):
    rows = [*family(100, 30, 1), *family(200, 12, 4), (300, "Ab, cd!", "en", "a", 0), (301, "ab cd", "en", "a", 0)]
    df = edge.with_clashes(edge.docs(spark, rows))
    got = sorted(((r["doc_id"], r["class_id"]) for r in N.classes(df).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_rest_of_a_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)  # many pairs of blocks, in several shards
    monkeypatch.setattr(N, "SHARD_BYTES", 4_000_000)
    rows = family(100, 40, 5)
    df = spark.createDataFrame(rows, edge.DOCS)
    got = sorted(((r["doc_id"], r["class_id"]) for r in N.classes(df).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in rows])


def test_dedup_keeps_one_row_a_class(spark):
    df = edge.with_clashes(edge.docs(spark, family(100, 10, 1)))
    out = N.dedup(df)
    assert out.columns == df.columns
    kept = [r["doc_id"] for r in out.collect()]
    classes = [r["class_id"] for r in N.text_classes(df).select("class", "class_id").distinct().collect()]
    assert sorted(kept, key=str) == sorted(classes, key=str)


def test_empty_table(spark):
    assert N.classes(edge.docs(spark).limit(0)).count() == 0
    assert N.dedup(edge.docs(spark).limit(0)).count() == 0


def test_components(spark):
    pairs = [(b"%02d" % i, b"%02d" % (i + 1)) for i in range(0, 20)] + [(b"50", b"40"), (b"40", b"60"), (b"70", b"70")]
    got = {(bytes(r["node"]), bytes(r["root"])) for r in N.components(spark.createDataFrame(pairs, "a binary, b binary")).collect()}
    assert got == {(b"%02d" % i, b"00") for i in range(21)} | {(b"40", b"40"), (b"50", b"40"), (b"60", b"40")}
