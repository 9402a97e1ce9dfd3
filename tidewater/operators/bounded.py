"""Nearest items by cosine of sparse vectors, by bounds in place of all pairs.

Items are grouped by their two heaviest terms, so that a group's vectors are alike. A query meets its own
group first; the k-th best it finds there is its floor. A group's greatest weights by term bound what any
of its items can score, so a query goes on only to groups whose bound reaches its floor, and inside a
group only through blocks whose own bound reaches the floor so far. Bounds leave out no item that belongs
to the k best, ties included: the result is that of all pairs. Rows shuffled are a query's groups, not
items times items; a large group is dealt out in tiles of its items by tiles of the queries that come to it.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import blocks
from tidewater.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Groups of items, and slots that terms are hashed to: the table of a group's greatest weights has at most
#: GROUPS x SLOTS entries whatever the catalog (4 MB).
GROUPS, SLOTS = 256, 2048
BLOCK = 1024  # items of a block, and queries that are scored against it at once
TILE_ITEMS, TILE_QUERIES = 65_536, 16_384  # of one task
PLACES = 9  # scores are compared at so many decimal places
SLACK = 1e-3  # of the last place, for the rounding of sums

SCORES = "item_id long, other long, score double"


def key_of(score: np.ndarray, slack: float = 1e-7) -> np.ndarray:
    """Score in units of the last place, rounded half up."""
    return np.floor(score * 10**PLACES + 0.5 + slack).astype(np.int64)


def grouped(weights: DataFrame) -> DataFrame:
    """item_id, terms, w, slots, lead, home of every item of ``weights`` (doc_id, term, weight)."""
    rows = weights.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("item_id")).agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("v"))
    heavy = F.array_sort(F.transform("v", lambda s: F.struct((-F.abs(s["weight"])).alias("a"), s["term"].alias("t"))))
    lead = F.concat_ws(" ", F.array_sort(F.transform(F.slice(heavy, 1, 2), lambda s: s["t"])))
    return rows.select("item_id", F.col("v.term").alias("terms"), F.col("v.weight").alias("w"), F.transform("v.term", lambda t: hashed(t, SLOTS)).alias("slots"), lead.alias("lead")).withColumn("home", hashed(F.col("lead"), GROUPS))


def hashed(c: Column, n: Column | int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def greatest_weights(items: DataFrame) -> np.ndarray:
    """(GROUPS x SLOTS) greatest absolute weight of a slot's terms in a group; at most GROUPS rows are collected."""
    rows = items.select("home", F.explode(F.arrays_zip("slots", "w")).alias("s")).groupBy("home", "s.slots").agg(F.max(F.abs("s.w")).alias("m"))
    out = np.zeros((GROUPS, SLOTS))
    for r in rows.groupBy("home").agg(F.collect_list("slots").alias("s"), F.collect_list("m").alias("m")).collect():
        out[r["home"], r["s"]] = r["m"]
    return out


def reach(queries: DataFrame, most: np.ndarray) -> DataFrame:
    """``queries`` (item_id, terms, w, slots, home, floor) with ``group``, a row for each group but their own whose bound reaches the floor."""
    table = queries.sparkSession.sparkContext.broadcast(most)
    schema = queries.drop("slots", "home").schema.add("group", "integer")

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                some = pdf.iloc[at : at + BLOCK]
                slot, row = blocks.flat(some["slots"], np.int64)
                mine = np.zeros((len(some), SLOTS))
                np.add.at(mine, (row, slot), np.abs(blocks.flat(some["w"], float)[0]))
                bound = mine @ table.value.T
                go = (bound > 0) & (key_of(bound, SLACK) >= some["floor"].to_numpy()[:, None])
                go[np.arange(len(some)), some["home"].to_numpy()] = False
                r, group = np.nonzero(go)
                yield some.iloc[r].drop(columns=["slots", "home"]).assign(group=group.astype(np.int32))

    return queries.mapInPandas(run, schema)


class Best:
    """The k best others of each query so far: by score at ``PLACES`` places, then by id."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor.copy(), k
        self.key, self.ids, self.score = np.full((len(floor), k), -1), np.zeros((len(floor), k), np.int64), np.zeros((len(floor), k))

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """``score`` of ``rows`` with the items ``ids``, in order of id; scores of 0 and less count for nothing."""
        key = np.where(score > 0, key_of(score), -1)
        take = min(self.k, len(ids))
        top = np.argpartition(np.arange(len(ids)) - key * len(ids), take - 1, axis=1)[:, :take]
        both = [np.concatenate([old[rows], new], axis=1) for old, new in ((self.key, np.take_along_axis(key, top, 1)), (self.ids, ids[top]), (self.score, np.take_along_axis(score, top, 1)))]
        order = np.lexsort((both[1], -both[0]), axis=1)[:, : self.k]
        self.key[rows], self.ids[rows], self.score[rows] = (np.take_along_axis(x, order, 1) for x in both)
        self.floor[rows] = np.maximum(self.floor[rows], self.key[rows, -1])


def scan(queries: pd.DataFrame, items: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of ``items`` (item_id, terms, w, lead) for each of ``queries`` (item_id, terms, w, floor), itself left out; none below its floor is needed."""
    items = items.sort_values(["lead", "item_id"])
    parts = [items.iloc[at : at + BLOCK].sort_values("item_id") for at in range(0, len(items), BLOCK)]
    tops = [pd.DataFrame({"t": np.concatenate([np.asarray(t) for t in p["terms"]]), "w": np.abs(np.concatenate([np.asarray(w) for w in p["w"]]))}).groupby("t")["w"].max() for p in parts]
    tops = pd.DataFrame({"terms": [t.index.to_numpy() for t in tops], "w": [t.to_numpy() for t in tops]})
    out = []
    for at in range(0, len(queries), BLOCK):
        some = queries.iloc[at : at + BLOCK].rename(columns={"w": "p"})
        own, best = some["item_id"].to_numpy(np.int64), Best(some["floor"].to_numpy(np.int64), k)
        bound = blocks.scores_of(some.assign(p=[np.abs(p) for p in some["p"]]), tops)
        for b in np.argsort(-bound.sum(axis=0), kind="stable"):
            rows = np.flatnonzero((bound[:, b] > 0) & (key_of(bound[:, b], SLACK) >= best.floor))
            if len(rows):
                ids = parts[b]["item_id"].to_numpy(np.int64)
                score = blocks.scores_of(some.iloc[rows], parts[b])
                score[own[rows][:, None] == ids[None, :]] = 0
                best.add(rows, score, ids)
        r, c = np.nonzero(best.key >= 0)
        out.append(pd.DataFrame({"item_id": own[r], "other": best.ids[r, c], "score": best.score[r, c]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"item_id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "score": np.zeros(0)})


def dealt(queries: DataFrame, items: DataFrame, sizes: dict[int, int], asked: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """``queries`` (with group) and the ``items`` of their groups by (group, tile, part): tiles of a group's items by parts
    of the queries that come to it (``asked``), so an item is copied once for so many queries of its own group, not of all."""
    cut = lambda rows, most: F.element_at(F.array(*[F.lit(-(-rows.get(g, 0) // most)) for g in range(GROUPS)]), F.col("group") + 1)
    fresh = lambda df: df.toDF(*df.columns)  # noqa: E731  items and queries come from one frame
    tiles, parts = F.greatest(cut(sizes, TILE_ITEMS), F.lit(1)), cut(asked, TILE_QUERIES)
    left = queries.withColumn("part", hashed(F.col("item_id"), parts)).withColumn("tile", F.explode(F.sequence(F.lit(0), tiles - 1)))
    right = items.select("item_id", "terms", "w", "lead", F.col("home").alias("group")).where(parts > 0)  # items go only where queries are
    right = right.withColumn("tile", hashed(F.col("item_id"), tiles)).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left, fresh(right)


def met(queries: DataFrame, items: DataFrame, sizes: dict[int, int], asked: dict[int, int], k: int) -> DataFrame:
    """``scan`` of ``queries`` (with group, ``asked`` of each) and the ``items`` of their groups, tile by tile."""
    left, right = dealt(queries, items, sizes, asked)

    def run(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        return scan(q, i, k) if len(i) else scan(q.iloc[:0], i, k)

    at = ["group", "tile", "part"]
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(run, SCORES)


def nearest(weights: DataFrame, k: int) -> DataFrame:
    """item_id, other, score: the k best others of every item of ``weights`` (doc_id, term, weight; a term once an item).

    Score: the sum over shared terms of both weights, above 0. Ties at ``PLACES`` places: the least id.
    """
    items = cut_lineage(grouped(weights))
    counts = lambda df, c: {r[c]: r["count"] for r in df.groupBy(c).count().collect()}  # noqa: E731  at most GROUPS rows
    sizes = counts(items, "home")
    queries = items.select("item_id", "terms", "w", "slots", "home")
    near = cut_lineage(met(queries.select("item_id", "terms", "w", F.col("home").alias("group"), F.lit(-1).cast("long").alias("floor")), items, sizes, sizes, k))
    best = Window.partitionBy("item_id").orderBy(F.col("key").desc())
    key = F.floor(F.col("score") * 10**PLACES + F.lit(0.5 + 1e-7)).cast("long")
    floor = near.select("item_id", key.alias("key")).withColumn("at", F.row_number().over(best)).where(F.col("at") == k).select("item_id", F.col("key").alias("floor"))
    queries = queries.join(floor, "item_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-1).cast("long")))
    far = cut_lineage(reach(queries, greatest_weights(items)))
    return near.unionByName(met(far, items, sizes, counts(far, "group"), k))
