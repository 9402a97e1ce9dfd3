import re
from math import comb

from tests.llm import edge
from tidewater.llm import decontaminate as D


def sets(text):
    ws = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def tables(spark):
    items = [(1, edge.words(31, 12)), (2, edge.words(32, 60)), (3, edge.words(33, 300)), (4, "too few words"), (5, None), (6, ""), (None, edge.words(34, 20)), (7, edge.words(31, 12)), (3, edge.words(33, 300))]
    plain = edge.words(40, 50)
    sixty = edge.words(32, 60).split()
    rows = [
        (100, f"{plain} {edge.words(31, 12).upper()}! {plain}"),
        (101, plain + " " + " ".join(sixty[:52])),  # 48 of 56 shingles
        (102, plain + " " + " ".join(sixty[:48])),  # 44 of 56
        (103, edge.LONG + " " + edge.words(33, 300)),
        (104, " ".join([*sixty[:30], "x", *sixty[30:]])),
        (105, edge.words(34, 20)), (105, plain), (None, edge.words(31, 12)), (106, plain),
    ]
    docs = edge.docs(spark, [(i, t, "en", "a", 0) for i, t in rows])
    return edge.with_clashes(docs), spark.createDataFrame(items, "item_id long, text string")


def brute(docs, items):
    found = {}
    for d in docs:
        for i in items:
            q, x = sets(i["text"]), sets(d["text"])
            if q and len(q & x) >= 0.8 * len(q):
                key = (d["doc_id"], i["item_id"])
                found[key] = max(found.get(key, (0, 0)), (len(q & x), len(q)))
    return {(d, i, n, m) for (d, i), (m, n) in found.items()}


def test_contained_matches_brute_force(spark):
    docs, items = tables(spark)
    got = {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in D.contained(docs, items).collect()}
    expected = brute(docs.collect(), items.collect())
    assert got == expected and {100, 101, 103, 104, 105, None} <= {d for d, *_ in got} and 102 not in {d for d, *_ in got}


def test_clean_drops_only_contaminated(spark):
    docs, items = tables(spark)
    bad = {d for d, *_ in brute(docs.collect(), items.collect())}
    out = D.clean(docs, items)
    assert out.columns == docs.columns
    expected = sorted(str(r["doc_id"]) for r in docs.collect() if r["doc_id"] not in bad)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == expected


def test_shuffle_joins_give_the_same(spark, monkeypatch):
    docs, items = tables(spark)
    first = sorted(map(str, D.contained(docs, items).collect()))
    monkeypatch.setattr(D, "pick_ids", lambda ids: ids)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, D.contained(docs, items).collect())) == first
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_tables(spark):
    docs, items = tables(spark)
    assert D.contained(docs.limit(0), items).count() == 0 and D.contained(docs, items.limit(0)).count() == 0
    assert D.clean(docs, items.limit(0)).count() == docs.count()


def miss(n, m, k=D.SKETCH, c=D.THRESHOLD):
    """Chance that fewer than m of k shingles drawn from n are among the share c found."""
    here = -(-n * 4 // 5)
    return sum(comb(here, x) * comb(n - here, k - x) for x in range(m) if k - x <= n - here) / comb(n, k)


def test_bound_of_a_partition_holds_for_all_its_sizes():
    for part in range(5, 10):
        m = D.partition_bound(part)
        sizes = range(max(2**part, D.SKETCH + 1), 2 ** (part + 1))
        assert all(miss(n, m) < D.MISS for n in sizes) and any(miss(n, m + 1) >= D.MISS for n in sizes)
    last = D.partition_bound(D.EVEN)
    assert D.partition_bound(40) == last and all(miss(n, last) < D.MISS for n in (5000, 10**5, 10**6))
    binomial = sum(comb(D.SKETCH, x) * 0.8**x * 0.2 ** (D.SKETCH - x) for x in range(last))
    assert binomial < D.MISS  # the limit of ever larger items
    assert D.partition_bound(5) > D.partition_bound(6) > last
    assert D.least_hits(10) == 8  # the sketch is the item


def test_documents_reach_only_partitions_they_can_contain(spark):
    docs, items = tables(spark)
    sketch = D.sketches(items)
    parts = {(r["n"], r["part"], r["need"]) for r in sketch.select("n", "part", "need").collect()}
    assert all(2**p <= n < 2 ** (p + 1) for n, p, _ in parts) and len({p for _, p, _ in parts}) >= 3
    assert all(need == (-(-n * 4 // 5) if n <= D.SKETCH else D.partition_bound(p)) for n, p, need in parts)
    found = D.candidates(docs, sketch)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan and "reach" in plan and "Python" not in plan and "Arrow" not in plan
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert {(d, i) for d, i, *_ in brute(docs.collect(), items.collect())} <= got
    long_item = spark.createDataFrame([(9, edge.words(50, 400))], "item_id long, text string")
    short = edge.docs(spark, [(1, " ".join(edge.words(50, 400).split()[:200]), "en", "a", 0)])
    assert D.candidates(short, D.sketches(long_item)).isEmpty()  # half of it is there, but it is too short


def test_plan_stays_in_the_jvm(spark):
    docs, items = tables(spark)
    plan = D.contained(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow|NestedLoop|Cartesian", plan)
