import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers

from tests.llm import edge
from tidewater.llm import cross_tokens as C

ODD = ["<|endoftext|> and <s> </s> <unk>", "tab\tand\nline  two  spaces ", "   ", "a▁b", "nul\x00byte", "émoji \U0001f600 日本語 \u0085 x", "don't WON'T 12345 !!", "x" * 3000, "﻿bom", "é combining", "\x1c\x1d sep"]


@pytest.fixture(scope="module")
def plain():
    a = tokenizers.Tokenizer.from_file(C.VOCABULARY_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=C.VOCABULARY_B)


def brute(plain, texts):
    """Groups and links of each text by walking byte ends with dicts."""
    a_model, b_model = plain
    letters = C.byte_letters()
    out = []
    for text in texts:
        row = {"a": [], "b": [], "groups": [], "links": []}
        out.append(row)
        if not text:
            continue
        want = b" " + text.encode()
        a = a_model.encode(" " + text, add_special_tokens=False).ids
        b = b_model.encode(text)
        bytes_a = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            continue
        row["a"], row["b"] = a, b
        ends = [dict(zip(np.cumsum([len(x) for x in xs]).tolist(), range(len(xs)))) for xs in (bytes_a, bytes_b)]
        pa = pb = 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            qa, qb = ends[0][end] + 1, ends[1][end] + 1
            row["groups"].append(",".join(map(str, a[pa:qa])) + "|" + ",".join(map(str, b[pb:qb])))
            row["links"].append((a[qa - 1], b[qb - 1]))
            pa, pb = qa, qb
    return out


def expected(plain, rows):
    found = brute(plain, [r[1] for r in rows])
    pairs = Counter(p for f in found for p in f["links"])
    top = {}
    for (_, b), n in pairs.items():
        top[b] = max(top.get(b, 0), n)
    return Counter(
        (r[0], len(f["a"]), len(f["b"]), len(f["groups"]), len(f["links"]), sum(pairs[p] == top[p[1]] for p in f["links"]), sum(pairs[p] for p in f["links"]), hashlib.sha256(";".join(f["groups"]).encode()).hexdigest() if f["a"] else "")
        for r, f in zip(rows, found)
    )


def test_lockstep_equals_common_ends():
    rng = np.random.default_rng(1)
    for limit in (1, 3, 1000):
        sizes = rng.integers(1, 400, 30)
        ends, counts = [], []
        for size, base in zip(sizes, np.cumsum(sizes) - sizes):
            cuts = [np.union1d(rng.choice(np.arange(1, size + 1), rng.integers(1, size + 1)), [size]) + base for _ in "ab"]
            ends.append(cuts)
            counts.append(len(cuts[0]))
        a, b = (np.concatenate([e[i] for e in ends]) for i in (0, 1))
        la, lb = C.lockstep(a, b, *C.lanes(np.array(counts), limit))
        both = np.intersect1d(a, b)
        assert (a[la] == both).all() and (b[lb] == both).all()


def test_against_brute_force(spark, plain, monkeypatch):
    monkeypatch.setattr(C, "LANE", 7)
    monkeypatch.setattr(C, "FLUSH", 300)
    docs = edge.docs(spark, [(100 + i, t, "en", "a", 0) for i, t in enumerate(ODD * 2)])
    docs = edge.with_clashes(docs).withColumnRenamed("n", "links")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = Counter(tuple(r) for r in C.alignment(docs.repartition(4)).collect())
    assert got == expected(plain, rows)


def test_fixture_documents(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in C.alignment(docs).collect()) == expected(plain, rows)


def test_both_encoders_of_a_agree(plain):
    e = C.encoders().ready()
    texts = [edge.words(i, 200) + t for i, t in enumerate(ODD)] + ["".join(chr(c) for c in range(1, 0x180)), "''s 't're've'm'll'd''S", "1a2b 3.4,5—“q”"]
    assert e.fast is not None
    for t in texts:
        assert e.encode_a(t) == plain[0].encode(" " + t, add_special_tokens=False).ids
        if not C.UNUSUAL.search(t):
            assert e.fast.encode_ordinary(" " + t) == e.encode_a(t)


def test_links_are_real_tokens(spark, plain):
    docs = spark.createDataFrame([(1, "the  cats sat"), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in C.links(docs).collect()}
    want = brute(plain, ["the  cats sat"])[0]["links"]
    assert list(zip(rows[1]["a_ids"], rows[1]["b_ids"])) == want and rows[1]["ends"][-1] == 14 and rows[2]["ends"] == rows[3]["ends"] == []


def test_empty(spark):
    assert C.alignment(edge.docs(spark).limit(0)).count() == 0
    assert [r["groups_sha256"] for r in C.alignment(edge.docs(spark).filter("text IS NULL")).collect()] == ["", ""]


def test_files_are_bounded(monkeypatch):
    monkeypatch.setattr(C, "MAX_FILE", 10)
    with pytest.raises(ValueError, match="executors"):
        C.encoders()
