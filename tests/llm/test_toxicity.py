import random
import re

import pyarrow as pa

from tests.llm import edge
from tidewater.llm import toxicity as T


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_automaton_accepts_what_brute_force_accepts():
    random.seed(3)
    terms = sorted({"".join(random.choice("abcé") for _ in range(random.randint(3, 7))) for _ in range(25)} | {"abca*", "ééa*"})
    words = ["".join(random.choice("abcéx") for _ in range(random.randint(1, 9))) for _ in range(8000)] + [t.rstrip("*") for t in terms] + ["abca" + "x" * 50]
    own, term, count, _ = T.Matcher(T.automaton_of(terms)).run(pa.array(words))
    got = {int(o): (terms[int(t)], int(e)) for o, t, e in zip(own, term, count)}
    for i, w in enumerate(words):
        exact = [t for t in terms if t == w]
        stems = sorted((t for t in terms if t.endswith("*") and w.startswith(t[:-1])), key=len)
        near = [t for t in terms if not t.endswith("*") and len(t) >= T.EDIT_FROM and edits(t, w) == 1]
        if exact or stems:
            assert got[i] == ((exact or stems[-1:])[0], 0)
        elif near:
            assert got[i][0] in near and got[i][1] == 1
        else:
            assert i not in got


def test_words_across_marks_match_brute_force():
    random.seed(8)
    terms = sorted({"".join(random.choice("abcé") for _ in range(random.randint(3, 7))) for _ in range(30)})
    word = lambda: "".join(random.choice("abcé" + T.MARKS * (i > 0)) for i in range(random.randint(1, 9)))
    words = [word() for _ in range(6000)] + [t[:2] + m + t[3:] for t in terms for m in T.MARKS] + ["", "*", "a*", "**"]
    own, term, count, _ = T.Matcher(T.automaton_of(terms)).run(pa.array(words))
    got = {}
    for o, t, e in zip(own, term, count):
        got.setdefault(int(o), []).append((terms[int(t)], int(e)))
    near = lambda w: [t for t in terms if t == w] or [t for t in terms if len(t) >= T.EDIT_FROM and edits(t, w) == 1]
    crossed = 0
    for i, w in enumerate(words):
        for run in re.findall(f"[a-zé]+(?:[{T.MARKS}][a-zé]+)*", w):
            parts = re.split(f"[{T.MARKS}]", run)
            alone = [p for p in parts if near(p)]
            whole = near(run) if len(parts) > 1 and not alone else []
            for p in alone or [run] * bool(whole):
                t, e = got[i].pop(0)
                assert t in near(p) and e == (t != p)
            crossed += bool(whole)
        assert not got.get(i)
    assert crossed > 100


def test_a_mark_in_a_word_hides_no_term(spark):
    docs, labels = corpus(spark)
    more = [(7000, edge.words(5, 20) + " you zgr*bl " + edge.words(6, 20) + " wuff#pack", "en", "a", 0), (7001, edge.words(7, 20) + " ask zg@hosts or 5*zgr " + edge.words(8, 20), "en", "a", 0)]
    got = {r["doc_id"]: r["score"] for r in T.score(docs.unionByName(edge.with_clashes(edge.docs(spark, more))), labels).collect()}
    assert got[7000] >= T.THRESHOLD and got[7001] == 0


def test_several_automata_accept_what_one_accepts():
    random.seed(4)
    word = lambda least, most: "".join(random.choice("abcé") for _ in range(random.randint(least, most)))
    terms = sorted({word(3, 7) for _ in range(60)} | {word(4, 6) + "*" for _ in range(12)})
    texts = pa.array([" ".join(word(1, 9) + random.choice(["", "", "*" + word(1, 5)]) for _ in range(20)) for _ in range(300)])
    one = T.Matcher(T.automaton_of(terms)).run(texts)
    for size in (1, 7, 30, 400):
        assert all((a == b).all() for a, b in zip(one, T.Matcher(*T.automata_of(terms, size)).run(texts)))


def test_every_term_that_passes_is_learned_and_scores(spark):
    random.seed(6)
    bad = sorted({"".join(random.choice("bdfgklmnprstvz") + random.choice("aeiou") for _ in range(5)) for _ in range(700)})
    rows, marks = [], []
    for i in range(400):
        toxic = i < 100
        text = edge.words(30_000 + i, 20) + " " + " ".join(bad[(i * len(bad) // 100 + j * 11) % len(bad)] if toxic else "" for j in range(100))
        rows.append((1000 + i, text, "en", "a", 0))
        marks.append((1000 + i, 1, int(toxic)))
    rows += [(5000 + i, edge.words(90_000 + i, 20) + f" you {w} " + edge.words(95_000 + i, 20), "en", "a", 0) for i, w in enumerate(bad)]
    docs, labels = edge.docs(spark, rows), edge.labels(spark, marks)
    found = T.lexicon(T.training(docs, labels, None))
    assert len(found) > T.TERMS and set(bad) <= set(found)
    got = {r["doc_id"]: r["score"] for r in T.score(docs, labels).collect()}
    assert all(got[5000 + i] >= T.THRESHOLD for i in range(len(bad)))


def test_context_tells_quotation_from_abuse():
    m = T.Matcher(T.automaton_of(["zgrobl"]))
    for text, kind in (('he said "zgrobl" once', 2), ("«zgrobl» is a word", 2), ("you zgrobl", 1), ("a zgrobl here", 0), ('ends" then zgrobl', 0), ('“x”\nzgrobl said', 0)):
        assert m.run(pa.array([text]))[3].tolist() == [kind], text


def corpus(spark):
    rows, marks = [], []
    for i in range(300):
        toxic = i % 5 == 0
        text = edge.words(10_000 + i, 40) + (" zgrobl wuffpack, " if toxic else " ") + edge.words(20_000 + i, 20) + (" zgrobl" if toxic else "")
        rows.append((1000 + i, text, "en", "a", 0))
        marks.append((1000 + i, 1, int(toxic)))
    more = [(5000, edge.words(1, 20) + " zgrobbl wuffpak " + edge.words(2, 9) + " wufpack", "en", "a", 0), (5001, edge.words(1, 20) + ' the word "zgrobl" ' + edge.words(2, 9), "en", "a", 0)]
    return edge.with_clashes(edge.docs(spark, rows + more)), edge.labels(spark, marks)


def test_score_learns_from_its_fold_only(spark):
    docs, labels = corpus(spark)
    fold = T.label_fold(4)
    got = {}
    for r in T.score(docs, labels, fold != 2).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert sum(map(len, got.values())) == docs.count()
    assert all((got[1000 + i][0] >= T.THRESHOLD) == (i % 5 == 0) for i in range(300))
    assert got[5000][0] >= T.THRESHOLD and 0 < got[5001][0] < T.THRESHOLD
    assert got[1] == got[2] == [0.0] and all(0 <= x <= 1 for v in got.values() for x in v)
    # labels of the other fold change nothing
    import pyspark.sql.functions as F

    flipped = labels.withColumn("toxic", F.when(fold == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in T.score(docs, flipped, fold != 2).collect()}
    assert all(again[k] in v for k, v in got.items())


def test_clean_keeps_columns_and_clean_rows(spark):
    docs, labels = corpus(spark)
    out = T.clean(docs, labels)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert all((1000 + i in kept) == (i % 5 != 0) for i in range(300)) and {None, 1, 2, 3, 4, 5, 6} <= kept and 5000 not in kept


def test_without_labels_or_rows(spark):
    docs, labels = corpus(spark)
    assert {r["score"] for r in T.score(docs, labels.limit(0)).collect()} == {0.0}
    assert T.score(docs.limit(0), labels).count() == 0 and T.clean(docs.limit(0), labels).count() == 0


def test_long_terms_are_kept_and_match_as_they_stand(spark):
    long = "zz" + "qxv" * 30
    bad = [(i, f"{edge.words(i, 20)} {long} {edge.words(900 + i, 20)}", "en", "a", 0) for i in range(40)]
    good = [(100 + i, edge.words(2000 + i, 40), "en", "a", 0) for i in range(120)]
    docs = spark.createDataFrame(bad + good, edge.DOCS)
    labels = spark.createDataFrame([(r[0], 1, int(r[0] < 100)) for r in bad + good], edge.LABELS)
    terms = T.lexicon(T.training(docs, labels, None))
    assert long in terms
    m = T.Matcher(T.automaton_of([long]))
    own, _, edits, _ = m.run(pa.array([f"a {long} b", f"a {long[:-1]} b", f"a {long}x b"]))
    assert own.tolist() == [0] and edits.tolist() == [0]
