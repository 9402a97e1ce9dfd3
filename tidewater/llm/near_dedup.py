"""Near-duplicate classes by DartMinHash (operator 6).

A text is the weighted set of its five-word shingles (weight: number of occurrences; a text of one to
four words is one shingle). Similarity is weighted Jaccard, sum of minima over sum of maxima; links
join texts of similarity 0.8 or more, classes are the connected components of the links.

Signatures: every shingle owns a strip of the plane (weight x rank). A hash throws darts at it, about
one a unit of area, each with a weight position, a rank and one of ``K`` coordinates. A text catches
the darts below its weights; per coordinate the earliest caught dart is its value. Two texts agree on a
coordinate with probability equal to their similarity. The search stops at a rank at which all
coordinates are expected to be hit, so the work is linear in the text, not text x K; a text with an
empty coordinate searches twice as far.

Search: coordinates form ``BANDS`` bands of ``ROWS``; texts that agree on a band share a bucket.
1. Every member of a bucket is compared with one of its texts, the head: one row a member, no pairs.
   The first head is the text that shares most buckets with others; links found give components.
2. In buckets that still hold several components, the members outside the largest one, in blocks, meet
   all members, in blocks. Pairs of different components whose signatures allow the threshold are
   compared; a pair that shares several buckets is compared in the first one. Pairs of blocks are
   packed into shards of bounded bytes, and a shard returns only links that join components.
No bucket is capped; every pair that shares a bucket is compared or already in one component. At
similarity 0.8 a pair shares no bucket with probability (1 - 0.8^4)^24 = 3e-6.

Rows: null text counts as empty; texts without a word are equal only to the same text; copies (equal
texts, also on repeated rows) share a class; class ids are the least doc_id, null if all are null;
an empty table gives an empty result; other columns are ignored (``classes``) or kept (``dedup``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import textkit as X
from tidewater.llm.common import bounded_batches, checkpointed, pick_ids, text_key, written

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 4, 24
K = ROWS * BANDS
#: Darts expected below the first search rank, so that no coordinate is likely to stay empty.
DARTS = int(K * math.log(K) + 2 * K)
#: Two texts at the threshold agree on fewer coordinates than this with probability below 1e-5.
MIN_AGREE = int(THRESHOLD * K - 4.5 * math.sqrt(THRESHOLD * (1 - THRESHOLD) * K))
BLOCK = 256  # texts, and
BLOCK_BYTES = 8 << 20  # bytes of text in one block
SHARD_BYTES = 8 << 20  # bytes of text in the pairs of blocks of one shard, about

#: Rank intervals below 1: [0, 2^-10), then growing fourfold; from 1 on all have length 1.
CELLS = [(0.0, 2.0**-10), *[(4.0**i, 4.0 ** (i + 1)) for i in range(-5, 0)]]


def poisson_steps(area: float) -> list[float]:
    """Cumulative probabilities of 0, 1, 2, ... darts in a cell of this area, up to 1 - 1e-12."""
    p, total, out = math.exp(-area), 0.0, []
    for n in range(1, 60):
        total += p
        out.append(total)
        if 1 - total < 1e-12:
            break
        p *= area / n
    return out


def unit(h: np.ndarray) -> np.ndarray:
    """uint64 -> [0, 1)."""
    return (h >> X.U(11)).astype(np.float64) * 2.0**-53


def caught(elem: np.ndarray, own: np.ndarray, weight: np.ndarray, limit: np.ndarray):
    """Darts (owner, coordinate, rank, id) below ``weight`` and below the rank limit of each owner.

    Strips are cut in cells of one unit of weight by one interval of rank; a cell's darts depend only on
    the element and the cell, so equal elements of two texts meet the same darts.
    """
    strips = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(elem)), strips)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(strips) - strips, strips)
    seed = X.mix(elem[at] + (nth.astype(X.U) + X.U(1)) * X.BASE)
    room = np.minimum(weight[at] - nth, 1.0)
    owner, far = own[at], limit[own[at]]
    found = []

    def throw(seed, room, owner, far, cell, low, length):
        """Darts of one cell of each strip; ``cell`` and ``low`` are numbers or arrays."""
        here = X.mix(seed ^ (np.atleast_1d(cell).astype(X.U) + X.U(1)) * X.U(0xD1B54A32D192ED03))
        u = unit(here)
        more = np.arange(len(u))
        for n, step in enumerate(poisson_steps(length)):
            more = more[u[more] >= step]  # cells with at least n + 1 darts
            if not len(more):
                break
            dart = X.mix(here[more] + X.U((0x8CB92BA72F3D8DD7 * (n + 1)) % 2**64))
            rank = (low if np.isscalar(low) else low[more]) + length * unit(X.mix(dart ^ X.U(0xA24BAED4963EE407)))
            hit = (unit(X.mix(dart ^ X.U(0x9FB21C651E98DF25))) < room[more]) & (rank < far[more])
            dart = dart[hit]
            found.append((owner[more][hit], ((dart >> X.U(20)) % X.U(K)).astype(np.int64), rank[hit], dart))

    for cell, (low, high) in enumerate(CELLS):
        if cell:
            live = far > low
            seed, room, owner, far = seed[live], room[live], owner[live], far[live]
        throw(seed, room, owner, far, cell, low, high - low)
    # only short texts search beyond rank 1; their strips x intervals are about DARTS a text
    units = np.maximum(np.ceil(far) - 1, 0).astype(np.int64)
    at = np.repeat(np.arange(len(far)), units)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
    throw(seed[at], room[at], owner[at], far[at], len(CELLS) + nth, 1.0 + nth, 1.0)
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=t) for i, t in enumerate((np.int64, np.int64, float, X.U)))


def signatures(elem: np.ndarray, own: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """(texts x K) uint64 signatures; rows of texts without elements are 0."""
    mass = np.bincount(own, weights=weight, minlength=texts)
    out = np.zeros((texts, K), dtype=X.U)
    todo, reach = mass > 0, 1.0
    while todo.any():
        limit = np.where(todo, reach * DARTS / np.maximum(mass, 1e-9), 0.0)
        use = todo[own]
        o, c, r, d = caught(elem[use], own[use], weight[use], limit)
        order = np.lexsort((d, r, o * K + c))
        slot = (o * K + c)[order]
        first = np.ones(len(slot), dtype=bool)
        first[1:] = slot[1:] != slot[:-1]
        sig = np.zeros(texts * K, dtype=X.U)
        full = np.zeros(texts * K, dtype=bool)
        sig[slot[first]], full[slot[first]] = d[order][first], True
        done = todo & full.reshape(texts, K).all(axis=1)
        out[done] = sig.reshape(texts, K)[done]
        todo &= ~done
        reach *= 2
    return out


def shingled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(shingle, owner, count) of the distinct shingles of each text, and the number of texts."""
    words = X.Words(texts)
    h, own, _ = words.grams(SHINGLE, short=True)
    return *X.distinct_counts(h, own), words.texts


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(texts x BANDS) int64 bucket keys."""
    s = sig.reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=X.U) * X.BASE, s.shape[:2]).copy()
    for i in range(ROWS):
        h = X.mix(h ^ s[:, :, i]) + X.BASE
    return X.mix(h).view(np.int64)


def signed_texts(docs: DataFrame) -> DataFrame:
    """fp, doc_id, size, n (shingles with repeats), bands, sig (32 bits a coordinate) of every row."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"fp binary, doc_id {id_type}, size long, n long, bands array<long>, sig binary"

    def run(batches):
        for batch in batches:
            n_all, bands, sigs = [], [], []
            for _, part in X.chunks(batch.column(3)):
                elem, own, count, texts = shingled(part)
                sig = signatures(elem, own, count.astype(float), texts)
                n = np.bincount(own, weights=count, minlength=texts).astype(np.int64)
                keys = band_keys(sig)
                n_all.append(n)
                bands += [k if m else None for k, m in zip(keys, n)]
                sigs += [s.astype(np.uint32).tobytes() if m else None for s, m in zip(sig, n)]
            n = pa.array(np.concatenate(n_all) if n_all else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), n, pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["fp", "doc_id", "size", "n", "bands", "sig"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select(text_key("text").alias("fp"), "doc_id", size.alias("size"), "text").mapInArrow(run, schema)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted shingles, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - low
    return float(low) / float(total) if total else 0.0


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for _, part in X.chunks(texts):
        h, own, count, n = shingled(part)
        cut = np.searchsorted(own, np.arange(n + 1))
        out += [(h[a:b], count[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    return out


def compared(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, text_a, text_b) -> (a, b) of similarity ``THRESHOLD`` or more."""

    def run(batches):
        last_key, last_bag = None, None
        for batch in batches:
            left = bags(batch.column(2))
            keep = []
            keys = batch.column(1).to_pylist()
            for i, key in enumerate(keys):
                if key != last_key:
                    last_key, last_bag = key, bags(batch.column(3).slice(i, 1))[0]
                keep.append(weighted_jaccard(left[i], last_bag) >= THRESHOLD)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def shard_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that join different components, between the two blocks of each pair of blocks of a shard."""
    group = pdf[["key", "i", "j"]].to_numpy(dtype=np.int64)
    order = np.lexsort(group.T)
    cut = np.flatnonzero(np.any(group[order][1:] != group[order][:-1], axis=1)) + 1
    sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint32).reshape(len(pdf), K)
    rest, n, band = pdf["rest"].to_numpy(dtype=bool), pdf["n"].to_numpy(), pdf["band"].to_numpy()
    text = pdf["fp"].factorize()[0]  # equal numbers for the same text in several buckets
    names, comp = pdf["comp"].factorize()
    first = np.unique(text, return_index=True)[1]
    root = np.arange(len(comp))

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    found = []
    for rows in np.split(order, cut):
        mine, others = rows[rest[rows]], rows[~rest[rows]]
        if not len(mine) or not len(others):
            continue
        ok = (names[mine][:, None] != names[others]) & (np.minimum(n[mine][:, None], n[others]) >= THRESHOLD * np.maximum(n[mine][:, None], n[others]))
        x, y = np.nonzero(ok)
        for part in range(0, len(x), 1 << 15):
            a, b = mine[x[part : part + (1 << 15)]], others[y[part : part + (1 << 15)]]
            agree = sig[a] == sig[b]
            total = agree.sum(axis=1)
            ok = total >= MIN_AGREE
            if nth := int(band[rows[0]]):  # without pairs that met in an earlier band
                ok &= ~agree.reshape(len(a), BANDS, ROWS).all(axis=2)[:, :nth].any(axis=1)
            found.append(np.stack([total[ok], a[ok], b[ok]], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    pairs = pairs[np.argsort(-pairs[:, 0], kind="stable")]  # likeliest first: a link spares the rest of its component
    used = np.unique(text[pairs[:, 1:]])
    bag = dict(zip(used.tolist(), bags(pa.array(pdf["text"].to_numpy()[first[used]], pa.large_string())) if len(used) else []))
    links, fp = [], pdf["fp"].to_numpy()
    for _, i, j in pairs.tolist():
        a, b = find(names[i]), find(names[j])
        if a != b and weighted_jaccard(bag[text[i]], bag[text[j]]) >= THRESHOLD:
            root[max(a, b)] = min(a, b)
            links.append((fp[i], fp[j]))
    return pd.DataFrame(links, columns=["a", "b"], dtype=object)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the connected components of links (a, b); one root a component.

    Every node moves to its least neighbour if that is less, twice over; links are redrawn between the
    new places and distinct ones kept, until none is left. Each round is written.
    """
    edge = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    edge, place = written(edge), None
    while not edge.isEmpty():
        step = edge.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        step = written(step)
        again = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = written(step.join(again, "to").select("node", F.col("next").alias("to")))
        move = step.select(F.col("node").alias("root"), "to")
        if place is None:
            place = step.select("node", F.col("to").alias("root"))
        else:
            place = place.join(move, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        place = written(place)
        a, b = step.select(F.col("node").alias("a"), F.col("to").alias("a2")), step.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        edge = written(edge.join(a, "a").join(b, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).filter("a <> b").distinct())
    return place if place is not None else edge.select(F.col("a").alias("node"), F.col("b").alias("root"))


def text_classes(docs: DataFrame) -> DataFrame:
    """fp -> rep_id (least doc_id of the text), n_rows, class fp and class_id of every distinct text."""
    rows = signed_texts(docs)
    texts = rows.groupBy("fp").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n_rows"), F.first("size").alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    texts = checkpointed(texts)
    buckets = texts.filter("n > 0").select("fp", "n", F.posexplode("bands").alias("band", "key"))  # keys differ by band
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    # rows of (text, bucket) for buckets of two texts or more
    members = checkpointed(buckets.join(shared, "key"))
    if members.isEmpty():
        return texts.select("fp", "rep_id", "n_rows", F.col("fp").alias("class"), F.col("rep_id").alias("class_id"))

    # texts of all members, found by their least doc_id and then by fp
    wanted = checkpointed(members.select("fp").distinct().join(texts.select("fp", "rep_id"), "fp"))
    ids = pick_ids(wanted.select(F.col("rep_id").alias("_id")).distinct())
    source = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    source = source.select(text_key("text").alias("fp"), F.coalesce("text", F.lit("")).alias("text"))
    source = source.join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])
    source = checkpointed(source)

    def star_links(rows: DataFrame) -> DataFrame:
        """Links between members (fp, n) and the heads (head, head_n) of their buckets."""
        pairs = rows.filter(F.least("n", "head_n") >= THRESHOLD * F.greatest("n", "head_n")).select(F.col("fp").alias("a"), F.col("head").alias("b")).distinct()
        pairs = pairs.join(source.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a")
        pairs = pairs.join(source.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b")
        return checkpointed(compared(pairs))

    # the first heads: texts that share their buckets with most others
    degree = members.groupBy("fp").agg(F.sum("members").alias("degree"))
    heads = members.join(degree, "fp").groupBy("key").agg(F.max(F.struct("degree", "fp", "n")).alias("h")).select("key", F.col("h.fp").alias("head"), F.col("h.n").alias("head_n"))
    links = star_links(members.join(heads, "key").filter("fp <> head"))
    place = components(links)

    # buckets that still hold several components
    left = members.select("fp", "band", "key", "n").join(place.withColumnRenamed("node", "fp"), "fp", "left")
    left = checkpointed(left.select("fp", "band", "key", "n", F.coalesce("root", "fp").alias("comp")))
    several = left.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    left = checkpointed(left.join(several.select("key"), "key"))
    left = left.join(texts.select("fp", "size", "sig"), "fp")
    inside = left.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"))
    most = inside.groupBy("key").agg(F.max(F.struct("rows", "comp")).alias("m")).select("key", F.col("m.comp").alias("main"))
    left = left.join(most, "key").withColumn("rest", F.col("comp") != F.col("main")).drop("main")
    parts = left.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.count_if("rest").alias("rest_rows"), F.sum(F.when(F.col("rest"), F.col("size")).otherwise(0)).alias("rest_bytes"))
    blocks = lambda rows, size: F.greatest(F.ceil(F.col(rows) / F.lit(BLOCK)), F.ceil(F.col(size) / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")
    parts = parts.select("key", blocks("rows", "bytes").alias("n_blocks"), blocks("rest_rows", "rest_bytes").alias("n_rest"))
    left = checkpointed(left.join(parts, "key").select("fp", "band", "key", "n", "size", "comp", "sig", "rest", "n_blocks", "n_rest"))
    total = left.agg(F.sum((F.col("size") + 1000) * (F.col("n_rest") + F.when(F.col("rest"), F.col("n_blocks")).otherwise(0)))).collect()[0][0]
    shards = -(-(total or 0) // SHARD_BYTES) or 1
    # every member goes once to each block of rest members, a rest member also once to each block of members
    block = lambda count: F.pmod(F.xxhash64("fp"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    common = ["fp", "band", "key", "n", "comp", "sig"]
    as_member = left.select(*common, F.lit(False).alias("rest"), block("n_blocks").alias("j"), every("n_rest").alias("i"))
    as_rest = left.filter("rest").select(*common, F.lit(True).alias("rest"), every("n_blocks").alias("j"), block("n_rest").alias("i"))
    met = as_member.unionByName(as_rest).withColumn("shard", F.pmod(F.xxhash64("key", "i", "j"), F.lit(shards))).join(source, "fp")
    more = met.groupBy("shard").applyInPandas(shard_links, "a binary, b binary")
    place = components(links.union(checkpointed(more)))

    known = texts.select("fp", "rep_id", "n_rows").join(place.withColumnRenamed("node", "fp"), "fp", "left")
    known = checkpointed(known.select("fp", "rep_id", "n_rows", F.coalesce("root", "fp").alias("class")))
    ids = known.groupBy("class").agg(F.min("rep_id").alias("class_id"))
    return known.join(ids, "class").select("fp", "rep_id", "n_rows", "class", "class_id")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id of every row of ``docs`` (doc_id, text)."""
    found = text_classes(docs).select("fp", "class_id")
    return docs.select("doc_id", text_key("text").alias("fp")).join(found, "fp").select("doc_id", "class_id")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand first in their class, one a class: the one with the least doc_id.

    A class whose ids are all null keeps one of its rows with the least text key. Of several rows with
    the same doc_id and text one stays.
    """
    found = checkpointed(text_classes(docs))
    first = F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "fp")).alias("x")
    kept = checkpointed(found.groupBy("class").agg(first).select(F.col("x.fp").alias("__fp"), F.col("x.rep_id").alias("__id")))
    out = docs.withColumn("__key", text_key("text"))
    out = out.join(pick_ids(kept), (F.col("__key") == F.col("__fp")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    # only rows that share doc_id and text are left to be told apart; their texts alone are shuffled
    same = docs.select(F.col("doc_id").alias("__rid"), text_key("text").alias("__rfp")).groupBy("__rid", "__rfp").agg(F.count(F.lit(1)).alias("__n"))
    same = checkpointed(same.filter("__n > 1").select("__rid", "__rfp"))
    if same.isEmpty():
        return out.select(*docs.columns)
    same, at = pick_ids(same), (F.col("__key") == F.col("__rfp")) & F.col("doc_id").eqNullSafe(F.col("__rid"))
    again = out.join(same, at, "left_semi").dropDuplicates(["__key", "doc_id"])
    return out.join(same, at, "left_anti").unionByName(again).select(*docs.columns)


#: DuckDB: exact weighted Jaccard of all pairs of distinct texts that share a shingle, then components.
ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS id FROM documents GROUP BY 1
), w AS (
  SELECT id, [x FOR x IN regexp_split_to_array(lower(text), '[\x00-/:-@\[-`{-\x7F]+') IF x <> ''] AS ws FROM t
), g AS (
  SELECT id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4
), c AS (SELECT id, s, count(*) AS n FROM g GROUP BY id, s),
m AS (SELECT id, sum(n) AS n FROM c GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS low FROM c a JOIN c b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE low >= 0.8 * (x.n + y.n - low) - 1e-9),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT id, id AS class_id FROM t UNION SELECT l.b, r.class_id FROM r JOIN l ON l.a = r.id WHERE r.class_id < l.b),
f AS (SELECT id, min(class_id) AS class_id FROM r GROUP BY id)
SELECT d.doc_id, f.class_id FROM documents d JOIN t ON coalesce(d.text, '') = t.text JOIN f ON f.id = t.id
"""
