"""Benchmark decontamination: MinHash containment search for short items in long documents (operator 1).

An item is found in a document if 80 % or more of its distinct five-word shingles occur there. Plain
MinHash compares sets of like size; an item inside a long document has next to no Jaccard similarity.
So only the small side is sketched: the ``SKETCH`` shingles of an item with the least hash values are a
MinHash sample of it, and a document that contains a share c of the item contains each of them with
probability c, whatever the document's size.

Items are partitioned by size, partition p holding those of 2^p to 2^(p+1) - 1 shingles, and each
partition has its own bound on sketch hits (``least_hits``): up to ``SKETCH`` shingles the sketch is the
item and the bound exact; above, the sketch is a draw without replacement, and the bound is the largest
at which no size of the partition lets an item contained to 80 % be missed with probability above 1e-6.
A document is looked up only in the partitions whose items it is long enough to contain to 80 %.
Candidates are then verified by exact containment over all shingles of item and document.

DataFrame functions only. Documents are scanned twice and not shuffled: the sketches are broadcast
while the planner finds them small, and so are verified candidates' ids (checked; else both are
joined by a shuffle of shingles or texts).

Rows: null and empty texts match nothing; items of fewer than five words have no shingle and match
nothing; repeated items match each on its own; rows that share a doc_id count together, by the row that
contains most; null doc_ids and item_ids are ordinary values; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewater.llm.common import checkpointed, pick_ids, text_key

SHINGLE = 5
THRESHOLD = 0.8
SKETCH = 32
MISS = 1e-6


def least_hits(n: int, k: int = SKETCH, c: float = THRESHOLD, miss: float = MISS) -> int:
    """Most hits m such that fewer than m of k shingles, drawn from n of which a share c occurs in a
    document, are hit with probability below ``miss``."""
    k, here = min(k, n), math.ceil(n * c - 1e-9)
    total, m = 0.0, max(0, k - (n - here))  # fewer than that cannot be hit
    while m < k:
        total += math.comb(here, m) * math.comb(n - here, k - m) / math.comb(n, k)
        if total >= miss:
            break
        m += 1
    return max(m, 1)


EVEN = 12  # partitions from here on share the bound of this one: a draw of 32 from 4096 or more is as good as independent


def partition_bound(part: int) -> int:
    """The bound on hits for all sizes of a partition above the sketch: the least of its sizes' bounds."""
    part = min(part, EVEN)
    return min(least_hits(n) for n in range(max(2**part, SKETCH + 1), 2 ** (part + 1)))


def size_partition(n: Column) -> Column:
    """floor(log2(n)) of a positive count, from its binary digits."""
    return F.length(F.bin(n)) - 1


def shingles(text: Column) -> Column:
    """Hashes of the five-word windows of a text (array<long>, in order, with repeats; may be empty).

    Words are runs of letters and digits in lower case.
    """
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - SHINGLE)
        return F.when(F.size(h) >= SHINGLE, F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + d) for d in range(SHINGLE)])))

    # one-element array: the word hashes are bound once, not evaluated for every window
    return F.coalesce(F.get(F.transform(F.array(hashes), windows), F.lit(0)), F.array().cast("array<long>"))


def with_shingles(rows: DataFrame, name: str = "shingles") -> DataFrame:
    """Rows with their shingles instead of the text."""
    return rows.withColumn(name, shingles(F.col("text"))).drop("text")


def sketches(items: DataFrame) -> DataFrame:
    """item_id, fp, n, part, need, shingle: the sketch of every item with a shingle."""
    sets = with_shingles(items.select("item_id", text_key("text").alias("fp"), "text").distinct())
    rows = sets.select("item_id", "fp", F.explode(F.array_distinct("shingles")).alias("shingle"))
    item = W.partitionBy("item_id", "fp")
    rows = rows.withColumn("at", F.row_number().over(item.orderBy(F.xxhash64(F.lit(7), "shingle"), "shingle"))).withColumn("n", F.count(F.lit(1)).over(item))
    rows = rows.filter(F.col("at") <= SKETCH)
    part = size_partition(F.col("n"))
    first = size_partition(F.lit(SKETCH + 1))
    bounds = F.array(*[F.lit(partition_bound(p)) for p in range((SKETCH + 1).bit_length() - 1, EVEN + 1)])
    need = F.when(F.col("n") <= SKETCH, F.ceil(F.col("n") * THRESHOLD - 1e-9)).otherwise(F.get(bounds, F.least(part, F.lit(EVEN)) - first))
    return rows.select("item_id", "fp", "n", part.alias("part"), need.cast("int").alias("need"), "shingle")


def candidates(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """doc_id, doc_fp, item_id, fp of pairs with enough sketch hits for the item's partition."""
    d = with_shingles(docs.select("doc_id", text_key("text").alias("doc_fp"), "text"))
    reach = size_partition(F.floor(F.size("shingles") / THRESHOLD + 1e-9))  # of the largest item it can contain
    hits = d.select("doc_id", "doc_fp", reach.alias("reach"), F.explode("shingles").alias("_shingle"))
    index = pick_ids(sketch)
    hits = hits.join(index, (F.col("_shingle") == F.col("shingle")) & (F.col("part") <= F.col("reach")))
    found = hits.groupBy("doc_id", "doc_fp", "item_id", "fp", "need").agg(F.count_distinct("shingle").alias("hits"))
    return found.filter("hits >= need").select("doc_id", "doc_fp", "item_id", "fp")


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of every item found in a document.

    ``docs``: doc_id, text; ``items``: item_id, text.
    """
    sketch = checkpointed(sketches(items))
    pairs = checkpointed(candidates(docs, sketch))
    ids = pick_ids(pairs.select(F.col("doc_id").alias("_id"), "doc_fp").distinct())
    d = docs.select("doc_id", text_key("text").alias("doc_fp"), "text")
    at = F.col("doc_id").eqNullSafe(F.col("_id")) & (d["doc_fp"] == ids["doc_fp"])
    d = with_shingles(d.join(ids, at, "left_semi")).withColumn("shingles", F.array_distinct("shingles"))
    i = with_shingles(items.select(F.col("item_id").alias("_item"), text_key("text").alias("_fp"), "text").distinct(), "item_shingles")
    i = i.withColumn("item_shingles", F.array_distinct("item_shingles"))
    p = pick_ids(pairs.select(F.col("doc_id").alias("_id"), F.col("doc_fp").alias("_doc_fp"), "item_id", "fp"))
    both = d.join(p, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc_fp") == F.col("_doc_fp")))
    both = both.join(i, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("fp") == F.col("_fp")))
    n, shared = F.size("item_shingles"), F.size(F.array_intersect("item_shingles", "shingles"))
    both = both.select("doc_id", "item_id", n.cast("long").alias("n_item"), shared.cast("long").alias("n_shared"))
    both = both.filter(F.col("n_shared") >= THRESHOLD * F.col("n_item") - 1e-9)
    best = both.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("x"))
    return best.select("doc_id", "item_id", "x.n_item", "x.n_shared", "x.containment")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those in whose doc_id an item was found."""
    found = checkpointed(contained(docs.select("doc_id", "text"), items).select(F.col("doc_id").alias("__id")).distinct())
    return docs.join(pick_ids(found), F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti").select(*docs.columns)


#: DuckDB: exact containment of every item in every document.
ORACLE = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS ws FROM documents
  UNION ALL
  SELECT 'i', item_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] FROM benchmark
), s AS (
  SELECT DISTINCT kind, id, array_to_string(ws[i:i + 4], ' ') AS shingle
  FROM (SELECT kind, id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), n AS (SELECT id, count(*) AS n_item FROM s WHERE kind = 'i' GROUP BY id),
h AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM s d JOIN s i ON d.shingle = i.shingle AND d.kind = 'd' AND i.kind = 'i' GROUP BY d.id, i.id
)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM h JOIN n ON n.id = h.item_id WHERE n_shared >= 0.8 * n_item - 1e-9
"""
