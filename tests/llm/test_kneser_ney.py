import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm import edge
from tidewater.llm import kneser_ney as K


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), 0]  # 0: the end


class Brute:
    """The model by dictionaries of tuples; 1 is the start of a text."""

    def __init__(self, texts, order):
        self.order = order
        self.plain = Counter(t for x in texts for t in tokens(x))
        self.level = {n: Counter() for n in range(1, order + 1)}
        for x in texts:
            seq = [1, *tokens(x)]
            for end in range(1, len(seq)):
                n = min(order, end + 1) if order > 1 else 1
                self.level[n][tuple(seq[end - n + 1 : end + 1])] += 1
        for n in range(order, 1, -1):
            for gram in self.level[n]:
                if gram[1:][0] != 1:
                    self.level[n - 1][gram[1:]] += 1
        self.d = {n: self.discounts(self.level[n]) for n in self.level}
        self.total, self.spared = Counter(), defaultdict(float)
        for n, level in self.level.items():
            for gram, c in level.items():
                self.total[gram[:-1]] += c
                self.spared[gram[:-1]] += self.d[n][min(c, 3)]

    @staticmethod
    def discounts(level):
        n = [sum(c == i for c in level.values()) for i in range(5)]
        if min(n[1:]) > 0:
            y = n[1] / (n[1] + 2 * n[2])
            d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
            if all(0 <= d[i] <= i for i in (1, 2, 3)):
                return d
        return [0, 0.5, 1, 1.5]

    def p(self, word, history):
        n = len(history) + 1
        lower = 1 / (len(self.plain) + 1) if n == 1 else self.p(word, history[1:])
        context = tuple(history)
        if context not in self.total:
            return lower
        c = self.level[n][(*history, word)]
        return (c - self.d[n][min(c, 3)] + self.spared[context] * lower) / self.total[context]

    def score(self, text):
        seq = [1, *tokens(text)]
        return sum(math.log10(self.p(seq[i], seq[max(0, i - self.order + 1) : i])) for i in range(1, len(seq)))


def prose(seed, n):
    few = edge.words(5, 40).split()
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (1103515245 * x + 12345) % 2**31
        out.append(few[min(x >> 8 & 63, x >> 14 & 63) % 40])
    return " ".join(out)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(K, "FLUSH", 500)
    texts = [prose(i, 60) for i in range(25)] + ["É É é UPPER upper", "a a a a a a", "", None, "one", "<s> </s>", prose(3, 60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    model = K.train(docs, order)
    brute = Brute(texts, order)
    more = [*texts, "never seen words", prose(99, 50) + " zzz " + prose(98, 20)]
    rows = K.score(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string"), model).collect()
    assert len(rows) == len(more)
    for r in rows:
        assert abs(r["score"] - brute.score(more[r["doc_id"]])) < 1e-8, more[r["doc_id"]]
    vocabulary = [*brute.plain, "unknown word"]
    for history in ([1], [prose(2, 1)], prose(2, 3).split()):
        assert abs(sum(brute.p(w, history[-order + 1 :] if order > 1 else []) for w in vocabulary) - 1) < 1e-9


def test_query_columns_over_awkward_rows(spark):
    docs = edge.with_clashes(edge.docs(spark, [(i, prose(i, 30), "en", "a", 0) for i in range(100, 160)])).withColumnRenamed("key", "held_out")
    got = edge.collected(K.perplexities(docs))
    rows = docs.select("doc_id", "text").collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [r["text"] for r in rows if not held(r["doc_id"])]
    counts = Counter(t for x in train for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    brute = Brute(train, K.ORDER)
    want = Counter()
    for r in rows:
        t = tokens(r["text"])
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        want[r["doc_id"], held(r["doc_id"]), len(t), sum(counts[x] > 0 for x in t), n, round(base, 3), round(brute.score(r["text"]), 3)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3), round(r["score"], 3)) for r in got) == want


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(200)], "doc_id long, text string")
    only = docs.filter("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 1")
    for r in K.perplexities(only).collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"], r["perplexity"]) == (3, 0, 0, 0.0, 0.0, 1.0)
    assert K.perplexities(docs.limit(0)).count() == 0


def test_arrays_hold_every_level_sorted(spark):
    docs = spark.createDataFrame([(i, prose(i, 50)) for i in range(20)], "doc_id long, text string")
    model = K.train(docs, 3)
    brute = Brute([r["text"] for r in docs.collect()], 3)
    for n, store in model.grams.items():
        shards = [store.column(s, "key") for s in range(2**store.bits)]
        assert sum(len(s) for s in shards if s is not None) == len(brute.level[n])
        assert all((s[1:] > s[:-1]).all() for s in shards if s is not None)


def test_held_out_texts_of_the_fixture_gain_by_the_model(spark):
    rows = K.perplexities(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).filter("held_out AND n_tokens > 20").collect()
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.8 * len(rows)
