"""Mixing sources to target weights by pivotal dependent rounding (operator 8).

Every document of a source starts with the same expected number of copies, target / source size. The
whole part is certain; the fractional parts are rounded by pairing: two documents exchange expected
words until one of them is a whole number of copies, with odds that keep both expectations. Each
exchange keeps the source's expected words, so at most one document a block stays fractional; these
residuals are combined, block by block, in a reduction tree until one a source is left, which a fair
draw settles. What that last draw leaves, less than one document, is settled by shorter ones: of every
size class (powers of two) of a source the ``SPARE`` first documents by a hash are spares, and one more or
one fewer copy of some of them, the longest that fit first, brings the source to its target. So the
difference that stays is of the order of the source's shortest documents, not of its longest.

Blocks hold about ``BLOCK`` documents by a hash of the document, whatever the partitions are, and
draws come from a generator seeded by (seed, source, level, block): reruns and retried tasks agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidewater.llm.common import checkpointed, pick_ids, words_count

BLOCK = 4096
MOST_COPIES = 3.0
WEIGHTS = (1, 2, 3)
SEED = 20
SPARE = 8  # spares of a size class and source that may settle the rest: a design number, not a limit of rows taken


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, n_docs -> the same with ``target``.

    Sources by code point, null last, weigh ``weights`` in turn. A target is weight x level, capped at
    ``most`` x source size; the level is the one at which all targets add up to all sizes. It is found
    from running sums in the order in which the caps are reached. One row a source goes through here.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    s = sizes.withColumn("at", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("at"), F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("reached", F.col("cap") / F.col("weight"))
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    filled = W.orderBy("reached", "at")
    below = F.coalesce(F.sum("cap").over(filled.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(filled.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", (total - below) / rest)  # the level if this and all later ones are not capped
    # from the first source that is not capped on, levels only fall: the first is the largest
    level = F.max(F.when(F.col("level") <= F.col("reached"), F.col("level"))).over(W.partitionBy())
    return s.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))).select("source", "source_size", "n_docs", "target")


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> int:
    """Round ``p`` in place by exchanging expected words; the index of the one left fractional, or -1."""
    live, draws = -1, rng.random(len(p))
    for i in range(len(p)):
        if p[i] <= 0 or p[i] >= 1:
            continue
        if live < 0:
            live = i
            continue
        a, b = live, i
        up = min((1 - p[a]) * size[a], p[b] * size[b])  # words that can go from b to a
        down = min(p[a] * size[a], (1 - p[b]) * size[b])  # and from a to b
        move = up if draws[i] * (up + down) < down else -down
        to_a, to_b = p[a] + move / size[a], p[b] - move / size[b]
        if move > 0:
            a_whole = (1 - p[a]) * size[a] <= p[b] * size[b]
            b_whole = (1 - p[a]) * size[a] >= p[b] * size[b]
            p[a], p[b] = (1.0 if a_whole else to_a), (0.0 if b_whole else to_b)
        else:
            a_whole = p[a] * size[a] <= (1 - p[b]) * size[b]
            b_whole = p[a] * size[a] >= (1 - p[b]) * size[b]
            p[a], p[b] = (0.0 if a_whole else to_a), (1.0 if b_whole else to_b)
        if 0 < p[a] < 1:
            live = a
        elif 0 < p[b] < 1:
            live = b
        else:
            live = -1
    return live


def rounded_block(pdf: pd.DataFrame, level: int, last: bool, seed: int) -> pd.DataFrame:
    """One block of one source: ``p`` becomes 0 or 1 but for one residual (none if ``last``)."""
    pdf = pdf.sort_values(["key", "size", "p", "nth"], kind="stable")
    name = pdf["source"].iloc[0]
    key = f"{seed}|{level}|{pdf['block'].iloc[0]}|{'-' if name is None else '+' + str(name)}"
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(key.encode("utf-8", "surrogatepass")).digest()[:8], "big"))
    p = pdf["p"].to_numpy(dtype=float, copy=True)
    live = pivot(p, pdf["size"].to_numpy(dtype=float), rng)
    if live >= 0 and last:
        p[live] = float(rng.random() < p[live])
    return pdf.assign(p=p)


def rounder(level: int, last: bool, seed: int):
    """The grouped function of one level of the tree."""
    return lambda pdf: rounded_block(pdf, level, last, seed)


def settled(pdf: pd.DataFrame, most: float) -> pd.DataFrame:
    """``change`` (-1, 0 or 1 copies) of the spares of one source, so that ``gap`` (words wanted) shrinks.

    Longest spares first, each once: a copy goes or comes where that brings the gap nearer to 0.
    """
    pdf = pdf.sort_values(["size", "draw", "key", "nth"], ascending=[False, True, True, True], kind="stable")
    gap, change = float(pdf["gap"].iloc[0]), np.zeros(len(pdf), dtype=np.int64)
    for i, (size, copies) in enumerate(zip(pdf["size"].to_numpy(), pdf["copies"].to_numpy())):
        step = 1 if gap > 0 else -1
        if abs(gap - step * size) < abs(gap) and 0 <= copies + step <= most:
            change[i], gap = step, gap - step * size
    return pdf.assign(change=change)


def settle(done: DataFrame, seed: int, most: float) -> DataFrame:
    """``copies`` of ``done`` with the spares' changes. A few hundred spares a source at most take part."""
    one = F.col("size") > 0
    gaps = done.groupBy(F.col("source").alias("of")).agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    draw = F.xxhash64(F.lit(seed + 1), "key", "size", "nth")
    kind = W.partitionBy("source", F.length(F.bin("size")), F.col("copies") > 0).orderBy("draw", "key", "size", "nth")
    spare = done.filter(one).select("source", "key", "doc_id", "size", "nth", "copies", draw.alias("draw"))
    spare = spare.withColumn("at", F.row_number().over(kind)).filter(F.col("at") <= SPARE)
    spare = spare.join(gaps, F.col("source").eqNullSafe(F.col("of"))).drop("of", "at")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in spare.schema.fields] + [T.StructField("change", T.LongType())])
    change = spare.groupBy("source").applyInPandas(lambda pdf: settled(pdf, most), schema).filter("change <> 0")
    change = checkpointed(change.select(*[F.col(c).alias(f"_{c}") for c in ("source", "doc_id", "size", "nth")], "change"))
    at = F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("size") == F.col("_size")) & (F.col("nth") == F.col("_nth"))
    out = done.join(pick_ids(change), at, "left")
    return out.withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0).cast("long")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (long) and taken = copies x size of every row.

    Null texts have size 0; rows of size 0 take 0 copies; null ids and null sources are ordinary values;
    repeated rows are mixed as separate documents; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "source", words_count("text").alias("size"))
    # equal (doc_id, source, size) rows are interchangeable: numbered, so that each is rounded on its own
    rows = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    rows = checkpointed(rows.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = checkpointed(targets(sizes, weights, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    s = plan.select(F.col("source").alias("of"), "source_size", "target", "n_docs", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("p"))
    rows = rows.join(s, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    id_type = docs.schema["doc_id"].dataType
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would turn a nullable long into a float
    live = rows.withColumn("key", F.coalesce("doc_id", F.lit(""))).withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(F.lit(0.0)))
    # blocks of about `block` documents of a source
    n_blocks = F.ceil(F.col("n_docs") / F.lit(block))
    live = live.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "key", "size", "nth"), n_blocks))
    most_docs = plan.agg(F.max("n_docs")).collect()[0][0] or 0
    blocks = -(-most_docs // block)
    fields = live.schema.fields
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    decided, level = [], 0
    while True:
        last = blocks <= 1
        out = checkpointed(live.groupBy("source", "block").applyInPandas(rounder(level, last, seed), schema))
        whole = (F.col("p") <= 0) | (F.col("p") >= 1)
        decided.append(out.filter(whole))
        if last:
            break
        # at most one residual a block; `block` of them form a block of the next level
        live = out.filter(~whole).withColumn("block", F.floor(F.col("block") / F.lit(block)))
        blocks, level = -(-blocks // block), level + 1
    done = decided[0]
    for d in decided[1:]:
        done = done.unionByName(d)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("p").cast("long")).otherwise(F.lit(0)).cast("long")
    done = settle(done.withColumn("copies", copies), seed, most)
    return done.select(F.col("doc_id").cast(id_type).alias("doc_id"), "source", "size", "source_size", "target", "nth", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, with ``copy`` (1, 2, ...) added.

    Documents that take no copy are left out. Rows that share doc_id, source and size are numbered in
    the order of their texts, and each takes the copies of its number.
    """
    taken = mix(docs, **options)
    key = [F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size")]
    taken = taken.select(*key, F.col("nth").alias("__nth"), F.col("copies").alias("__copies"))
    marked = docs.withColumn("__words", words_count("text"))
    at = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size"))
    out = [*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("copy")]
    chosen = taken.filter("__copies > 0")
    repeated = taken.filter("__nth = 2").select("__id", "__source", "__size").distinct()
    if repeated.isEmpty():
        return marked.join(chosen, at).select(*out)
    again = marked.join(repeated, at, "left_semi")
    again = again.withColumn("__row", F.row_number().over(W.partitionBy("doc_id", "source", "__words").orderBy("text")))
    left = marked.join(repeated, at, "left_anti").withColumn("__row", F.lit(1)).unionByName(again)
    return left.join(chosen, at & (F.col("__row") == F.col("__nth"))).select(*out)
