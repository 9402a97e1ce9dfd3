"""Co-purchase picks in blocks, against every owner and material one by one."""

import datetime as dt
import random

from tidewater.operators import rankers as rk


def test_copurchase_picks_equal_all_pairs_and_make_no_row_a_pair(spark, monkeypatch):
    from tidewater.operators import blocks
    for name, n in (("USER_ROWS", 4), ("ITEM_ROWS", 3), ("TILE_USERS", 5), ("TILE_ITEMS", 4), ("TASKS_A_CORE", 0)):
        monkeypatch.setattr(blocks, name, n)
    rng, k = random.Random(3), 4
    mats = {i: (f"m{i}", "ABC"[i % 3]) for i in range(11)}
    lines = [(u, rng.randrange(11), 1, dt.datetime(2024, 1, 1 + rng.randrange(20)), n, 1, 1) for n, u in enumerate(rng.choices([*range(9), None], k=70))]
    owners = [(u, "IJ"[u % 2]) for u in range(12)] + [(3, "J"), (4, "J"), (5, None)]  # one twice, one in two industries
    rules = [("I", "A"), ("J", "B"), ("J", "C")]
    sims = [(i, j, round(1 / (1 + abs(i - j)), 3)) for i in range(11) for j in range(11) if (i * j) % 4]
    frames = (spark.createDataFrame(lines, "owner_id long, material_id long, quantity int, date timestamp_ntz, l_orderkey long, l_linenumber int, l_partkey long"),
              spark.createDataFrame([(i, n, c, 2.0, "d") for i, (n, c) in mats.items()], "material_id long, material_name string, category string, price double, description string"),
              spark.createDataFrame(owners, "owner_id long, industry string"), spark.createDataFrame(rules, "industry string, category string"),
              spark.createDataFrame(sims, "item_i long, item_j long, sim double"))
    got = rk.recommend_materials_copurchase(*frames, k)
    want = []
    for u in {r[0] for r in lines}:
        mine = [r for r in lines if r[0] == u]
        held, cand = {r[1] for r in mine}, []
        for i, (_, category) in mats.items():
            times = sum((ind, category) in rules for o, ind in owners if u is not None and o == u)
            near = [s for r in mine for a, b, s in sims if (a, b) == (r[1], i)]
            if u is None:
                cand += [(-round(sum(near), 9), i, False)] * bool(near)
            elif i in held:
                cand += [(-0.25, i, True)] * times
            else:
                cand += [(-round(sum(near) + 0.25 * (times > 0), 9), i, False)] * max(1, times)
        first = None if u is None else mats[min(mine, key=lambda r: (r[3], r[4]))[1]][0]
        want += [(u, n, i, round(-s, 6), "Based on production trends" if b else first and f"Similar to {first}") for n, (s, i, b) in enumerate(sorted(cand)[:k], 1)]
    count = {i: sum(r[1] == i for r in lines) for i in mats}
    most = sorted((i for i in mats if count[i]), key=lambda i: (-count[i], i))[:k]
    want += [(u, n, i, 1.0, "Popular material") for u in {o for o, _ in owners} - {r[0] for r in lines} for n, i in enumerate(most, 1)]
    rows = [(r.user_id, r["rank"], r.material_id, r.score, r.reason) for r in got.collect()]
    fixed = lambda rows: sorted(((u, n, i, abs(s), t) for u, n, i, s, t in rows), key=str)
    assert fixed(rows) == fixed(want)


def test_copurchase_scores_owners_in_blocks(spark, monkeypatch):
    seen, joined = [], rk.industry_category_scores
    monkeypatch.setattr(rk, "industry_category_scores", lambda owners, *rest: seen.append(owners.count()) or joined(owners, *rest))
    lines = [(u, u % 3, 1, dt.datetime(2024, 1, 1), u, 1, 1) for u in range(60)]
    frames = (spark.createDataFrame(lines, "owner_id long, material_id long, quantity int, date timestamp_ntz, l_orderkey long, l_linenumber int, l_partkey long"),
              spark.createDataFrame([(i, f"m{i}", "A", 2.0, "d") for i in range(5)], "material_id long, material_name string, category string, price double, description string"),
              spark.createDataFrame([(u, "I") for u in range(60)], "owner_id long, industry string"), spark.createDataFrame([("I", "A")], "industry string, category string"),
              spark.createDataFrame([(i, j, 0.5) for i in range(3) for j in range(5)], "item_i long, item_j long, sim double"))
    assert rk.recommend_materials_copurchase(*frames, 2).count() == 120
    assert seen and max(seen) <= 2  # industries, not owners
