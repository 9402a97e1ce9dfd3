import numpy as np
import pandas as pd

from tests.llm import edge
from tidewater.llm import mixing as M


def brute_targets(size):
    """Cap, share the excess again, until no target is above its cap."""
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(size.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        t = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3.0 * size[s] for s in free if t[s] > 3 * size[s]}
        if not over:
            return t | fixed
        fixed |= over


def test_targets(spark):
    for size in ({"a": 10, "b": 1000, "c": 5, "d": 0, None: 300}, {"x": 7}, {"z": 1, "é": 1, "A": 500, "b": 2}):
        rows = [(s, n, 1) for s, n in size.items()]
        got = {r["source"]: r["target"] for r in M.targets(spark.createDataFrame(rows, "source string, source_size long, n_docs long")).collect()}
        expected = brute_targets(size)
        assert got.keys() == expected.keys() and all(abs(got[s] - expected[s]) < 1e-6 for s in size)


def test_pivot_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    size, p0 = rng.integers(1, 50, 40).astype(float), rng.random(40)
    mean = np.zeros(40)
    for _ in range(4000):
        p = p0.copy()
        live = M.pivot(p, size, rng)
        assert abs((p * size).sum() - (p0 * size).sum()) < 1e-6
        assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i != live)
        mean += p / 4000
    assert np.abs(mean - p0).max() < 0.05


def rows(n):
    return [(100 + i, edge.words(i, 5 + i % 30), "en", "abc"[i % 10 // 4], 0) for i in range(n)]


def test_mix_reaches_targets_and_reruns_agree(spark):
    df = edge.with_clashes(edge.docs(spark, rows(400)))
    first = M.mix(df, block=16)  # three levels of the tree
    again = M.mix(df.repartition(7), block=16)
    key = lambda d: sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["taken"]) for r in d.collect())
    assert key(first) == key(again)
    got = edge.collected(first)
    assert len(got) == df.count()
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine)
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)


def brute_settled(spares, gap, most=3):
    """Each spare in turn, longest first, one copy more or fewer where the gap gets smaller."""
    out = []
    for size, copies in spares:
        options = [(abs(gap - d * size), abs(d), d) for d in (-1, 0, 1) if 0 <= copies + d <= most]
        d = min(options)[2]
        out.append(d)
        gap -= d * size
    return out, gap


def test_spares_settle_the_gap():
    rng = np.random.default_rng(3)
    for _ in range(50):
        size = -np.sort(-rng.integers(1, 4000, 40))
        copies = rng.integers(0, 4, 40)
        gap = float(rng.normal() * 2000)
        pdf = pd.DataFrame({"size": size, "copies": copies, "draw": range(40), "key": "", "nth": 1, "gap": gap})
        out = M.settled(pdf.sample(frac=1, random_state=1), 3.0)
        expected, rest = brute_settled(list(zip(size, copies)), gap)
        assert list(out["change"]) == expected and abs(rest) <= abs(gap)


def test_long_documents_do_not_leave_a_source_off_target(spark):
    long = [(i, edge.words(i, 3000), "en", "a", 0) for i in range(5)]
    short = [(10 + i, edge.words(i, 8 + i % 40), "en", "a", 0) for i in range(200)]
    other = [(500 + i, edge.words(i, 50), "en", "b", 0) for i in range(60)]
    df = edge.docs(spark, long + short + other)
    got = M.mix(df, block=64).collect()
    for s in ("a", "b"):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= (8 if s == "a" else 25)
    assert all(0 <= r["copies"] <= 3 for r in got) and len(got) == df.count()


def test_mixed_repeats_rows_as_taken(spark):
    df = edge.with_clashes(edge.docs(spark, rows(60)))
    out = M.mixed(df)
    assert out.columns == [*df.columns, "copy"]
    taken = M.mix(df).groupBy().sum("copies").collect()[0][0]
    assert out.count() == taken and out.filter("copy < 1 OR copy > 3").isEmpty()


def test_empty_table(spark):
    assert M.mix(edge.docs(spark).limit(0)).count() == 0 and M.mixed(edge.docs(spark).limit(0)).count() == 0
