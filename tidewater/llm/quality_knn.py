"""Quality by nearest neighbours in a latent-semantic space (operator 2).

Documents are TF-IDF vectors of hashed words and word shapes (case, trailing marks, length, repeats):
``DIMS`` dimensions, document frequencies counted over all documents. A truncated singular value
decomposition of a bounded, class-balanced sample of labelled training documents (``SAMPLE`` rows,
taken by a hash of the id) gives ``RANK`` latent axes. The sample's latent vectors are broadcast
(SAMPLE x RANK numbers, a fixed bound). Every document is projected, blocks of documents are
multiplied with all labelled vectors, and the ``NEIGHBOURS`` nearest vote, weighted by similarity and
by how much the balanced sample under-represents their class.

Rows: null and empty texts, and texts without a known axis, have no direction and get the training
share of label 1; a repeated row is scored on its own; a document with several label rows counts as 1
if all are 1; rows without label, or with a null one, teach nothing; without any label all score 0.5;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import textkit as X
from tidewater.llm.common import bounded_batches, checkpointed
from tidewater.llm.toxicity import label_fold  # noqa: F401  (the fold of the query)

DIMS = 1 << 14  # hashed words; shapes have SHAPES more
SHAPES = 1 << 9
SAMPLE = 2048  # labelled documents kept as neighbours: the bound of the fit
RANK = 48
NEIGHBOURS = 25
SHAPE_SHARE = 0.8  # share of a vector's squared length that shapes get


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(dimension, owner, count) of the distinct terms of each text, and the number of texts."""
    w = X.Words(texts, X.NONSPACE, lower=False)
    n, raw = w.texts, w.raw
    low = X.Words(texts)
    dims, own = [(low.hash % X.U(DIMS)).astype(np.int64)], [low.owner]
    if len(w.hash):
        size = np.minimum(w.ends - w.starts, 24)
        total = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        upper, alpha = total((raw >= 65) & (raw <= 90)), total(((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128))
        digit = total((raw >= 48) & (raw <= 57))
        up, al, di = (t[w.ends] - t[w.starts] for t in (upper, alpha, digit))
        case = np.select([up == 0, (up > 1) & (2 * up > al)], [0, 2], 1)
        last = raw[w.ends - 1]
        mark = np.where(X.ALNUM[last], 0, last).astype(np.int64)
        two = (w.ends - w.starts > 1) & (mark > 0) & (raw[np.maximum(w.ends - 2, 0)] == last)
        again = np.zeros(len(w.hash), dtype=np.int64)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.owner[1:] == w.owner[:-1])
        rest = (w.ends - w.starts) - al - di
        kinds = [case * 8 + again * 4 + (di > 0) * 2 + (rest > 1), 32 + size // 2, 48 + mark % 128 + two * 128, 304 + np.minimum(al, 15)]
        for k in kinds:
            dims.append(DIMS + k.astype(np.int64))
            own.append(w.owner)
        # windows of eight words seen before in the text, and length of the text
        h, o, _ = w.grams(8)
        if len(h):
            order = np.lexsort((h, o))
            dup = (h[order][1:] == h[order][:-1]) & (o[order][1:] == o[order][:-1])
            dims.append(np.full(int(dup.sum()), DIMS + 330))
            own.append(o[order][1:][dup])
    count = w.counts
    full = np.flatnonzero(count)
    dims.append(DIMS + 340 + np.minimum(np.log2(count[full]).astype(np.int64), 20))
    own.append(full)
    d, o = np.concatenate(dims), np.concatenate(own)
    key, number = np.unique(o.astype(np.int64) * (DIMS + SHAPES) + d, return_counts=True)
    return key % (DIMS + SHAPES), key // (DIMS + SHAPES), number, n


def vectors(texts: pa.Array, idf: np.ndarray):
    """(dimension, owner, value) of unit TF-IDF vectors, and the number of texts.

    Words weigh 1 + log(count); shapes weigh the square root of their share of the text's words.
    """
    d, o, c, n = terms(texts)
    shape = d >= DIMS
    words = np.maximum(np.bincount(o[~shape], weights=c[~shape], minlength=n), 1)
    v = np.where(shape, np.sqrt(np.minimum(c / words[o], 1.0)), 1 + np.log(c)) * idf[d]
    for part, share in ((shape, SHAPE_SHARE), (~shape, 1 - SHAPE_SHARE)):
        length = np.sqrt(np.bincount(o[part], weights=v[part] ** 2, minlength=n))
        v[part] *= np.sqrt(share) / np.maximum(length[o[part]], 1e-12)
    return d, o, v, n


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each dimension, over all rows, and the number of rows."""

    def run(batches):
        total = np.zeros(DIMS + SHAPES + 1, dtype=np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for _, part in X.chunks(batch.column(0)):
                total[:-1] += np.bincount(terms(part)[0], minlength=DIMS + SHAPES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["dim", "n"])

    rows = docs.select("text").mapInArrow(run, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()  # at most DIMS + SHAPES + 1 rows
    out = np.zeros(DIMS + SHAPES + 1)
    for r in rows:
        out[r["dim"]] = r["n"]
    return out[:-1], int(out[-1])


def neighbours(docs: DataFrame, labels: DataFrame, fold: Column | None, sample: int = SAMPLE) -> tuple[DataFrame, float]:
    """text, label of a class-balanced sample of labelled rows, and the share of label 1 of all of them."""
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    marks = marks if fold is None else marks.filter(fold)
    marks = marks.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("label"))
    share = marks.agg(F.avg("label")).collect()[0][0]
    some = None
    for label in (0, 1):
        part = marks.filter(F.col("label") == label).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(sample // 2)
        some = part if some is None else some.unionByName(part)
    some = checkpointed(some)
    # of rows that share an id the one with the least text counts; the sample bounds what is shuffled
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return texts.filter("text IS NOT NULL").select("text", "label"), share


def score(docs: DataFrame, labels: DataFrame, fold: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score of every row of ``docs``; ``fold``: condition on the labels to learn from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    train, share = neighbours(docs, labels, fold, sample)
    if share is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    df, total = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + df)) + 0.1

    def sparse(batches):
        for batch in batches:
            label = batch.column(1).to_pylist()
            for base, part in X.chunks(batch.column(0)):
                d, o, v, n = vectors(part, idf)
                cut = np.searchsorted(o, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([pa.array(label[base : base + n], pa.int32()), pa.array([d[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([v[a:b].astype(np.float32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["label", "d", "v"])

    rows = train.mapInArrow(sparse, "label int, d binary, v binary").orderBy("label", "d", "v").collect()  # at most `sample` rows
    x = np.zeros((len(rows), DIMS + SHAPES), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["d"], np.int32)] = np.frombuffer(r["v"], np.float32)
    label = np.array([r["label"] for r in rows])
    if not len(rows):
        return docs.select("doc_id", F.lit(float(share)).alias("score"))
    axes = latent_axes(x)
    mine = unit_rows(x @ axes)
    del x
    held = np.bincount(label, minlength=2) / len(label)
    vote = np.where(label == 1, share / max(held[1], 1e-9), (1 - share) / max(held[0], 1e-9))
    model = spark.sparkContext.broadcast({"idf": idf, "axes": axes, "mine": mine, "label": label, "vote": vote})

    def run(batches):
        m = model.value
        k = min(NEIGHBOURS, len(m["label"]))
        for batch in batches:
            out = []
            for _, part in X.chunks(batch.column(1)):
                d, o, v, n = vectors(part, m["idf"])
                z = np.zeros((n, m["axes"].shape[1]), dtype=np.float32)
                full = np.flatnonzero(np.bincount(o, minlength=n))
                if len(full):
                    z[full] = np.add.reduceat(m["axes"][d] * v[:, None].astype(np.float32), np.searchsorted(o, full), axis=0)
                for a in range(0, n, 512):
                    out.append(votes(unit_rows(z[a : a + 512]), m, k, share))
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))


def latent_axes(x: np.ndarray, rank: int = RANK, rounds: int = 4) -> np.ndarray:
    """Right singular vectors of ``x`` (dimensions x rank) by subspace iteration from a fixed start."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(5).standard_normal((x.shape[1], min(rank + 10, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :rank], dtype=np.float32)


def unit_rows(z: np.ndarray) -> np.ndarray:
    length = np.sqrt((z * z).sum(axis=1, keepdims=True))
    return (z / np.where(length > 1e-9, length, 1)).astype(np.float32)


def votes(z: np.ndarray, m: dict, k: int, share: float) -> np.ndarray:
    """Share of label 1 among the weighted votes of the k nearest labelled vectors of each row."""
    cos = z @ m["mine"].T
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(cos, near, axis=1), 0) ** 4 * m["vote"][near]
    total = w.sum(axis=1)
    good = (w * (m["label"][near] == 1)).sum(axis=1)
    return np.where(total > 1e-12, good / np.where(total > 1e-12, total, 1), share).astype(np.float64)
