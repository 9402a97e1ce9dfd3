"""Interpolated modified Kneser-Ney n-gram model and perplexity (operator 12).

Counting: words are 64-bit hashes (textkit). Tasks count them, and the sums become the vocabulary:
sorted hash arrays, a word's place is its id. A second scan counts n-grams of ids: each task groups a
bounded number of them at a time and sends one packed row a shard; shards are cut by a hash of the
whole n-gram, so a frequent word, context or passage is one pre-added row a task and flush and no shard
gathers more than its share. The task that gathers a shard of level n writes its sorted hash arrays and
sends level n - 1 what its n-grams say there: one distinct left neighbour of the suffix, and counts of
followers of the context. One job runs through all levels; only counts of counts reach the driver.

Model: level ``order`` has raw counts, lower levels the number of distinct left neighbours, or raw
counts for n-grams at the start of a text. p_n(w|h) = max(c(hw) - D(c(hw)), 0) / c(h.) + g(h) p_(n-1),
with discounts D1, D2, D3+ of each level from its counts of counts (0.5, 1, 1.5 where these do not
give discounts between 0 and the count), g(h) = (D1 N1 + D2 N2 + D3 N3+) / c(h.), and below level 1 the
same share for every training token and one unknown one. Contexts never seen leave p_(n-1) as it is.

Scoring maps the arrays (``arrays.Store``): n-gram hashes of a batch are sorted and walked through the
shards. A context followed once by one n-gram, as most are, is told by its own n-gram and not stored.

Rows: null text counts as empty and consists of the end token; a null doc_id is in no fold (held_out is
false), so it is learned from; repeated rows are learned and scored one by one; without training rows all tokens
are unknown and have probability 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import arrays, textkit as X
from tidewater.llm.common import bounded_batches

#: Length of the n-grams. Each further level holds up to an entry a word of the corpus, about 10 bytes.
ORDER = 2
FLUSH = 1 << 21  # words or n-grams that a task holds before it sends their sums

U = np.uint64


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z lower-cased, and the number of words of each text."""
    w = X.Words(pc.ascii_lower(texts), X.NONSPACE, lower=False)
    return w.hash, w.counts


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and how often they stand."""
    keys = np.sort(keys)
    at = arrays.runs(keys)
    return keys[at], np.diff(np.append(at, len(keys))).astype(U)


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams, one array a place; that of a longer one follows from its beginning (``extended``)."""
    out = X.mix(columns[0].astype(U) + U(1))
    for c in columns[1:]:
        out = extended(out, c)
    return out


def extended(beginning: np.ndarray, last: np.ndarray) -> np.ndarray:
    return X.mix(beginning * X.BASE + last.astype(U) + U(1))


def grouped(columns: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, first places of equal n-grams in it), in the order of their ids, which are below ``base``."""
    key = columns[0].astype(U)
    for c in columns[1:]:
        if len(key) and int(key.max()) >= 2**64 // base - 1:
            order = np.argsort(key)
            rank = np.zeros(len(key), dtype=U)
            first = np.zeros(len(key), dtype=np.int64)
            first[arrays.runs(key[order])] = 1
            rank[order] = (np.cumsum(first) - 1).astype(U)
            key = rank
        key = key * U(base) + c.astype(U)
    order = np.argsort(key)
    return order, arrays.runs(key[order])


class Vocabulary:
    """Words of the training texts; the ids behind them are the end, the start and unknown words."""

    def __init__(self, folder: str, bits: int, sizes: dict[int, int], total: int, texts: int):
        self.store = arrays.Store(folder, "word", bits)
        self.offset = np.zeros(2**bits + 1, dtype=np.int64)
        for shard, n in sizes.items():
            self.offset[shard + 1] = n
        self.offset = np.cumsum(self.offset)
        self.end = int(self.offset[-1])
        self.start, self.unknown = self.end + 1, self.end + 2
        self.texts, self.tokens, self.types = texts, total + texts, self.end + (texts > 0)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of words."""
        order = np.argsort(hashes)
        ids, count = np.full(len(hashes), self.unknown, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        for rows, shard, at in self.store.find(hashes[order]):
            ids[order[rows]] = self.offset[shard] + at
            count[order[rows]] = self.store.column(shard, "count")[at]
        return ids, count

    def sequences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, each with a start and an end; counts; place in the text; tokens a text, ends included."""
        hashes, lengths = words(texts)
        ids, count = self.find(hashes)
        first = np.cumsum(lengths + 2) - (lengths + 2)
        last = first + lengths + 1
        inner = np.ones(int((lengths + 2).sum()), dtype=bool)
        inner[first], inner[last] = False, False
        out, found = np.empty(len(inner), dtype=np.int64), np.zeros(len(inner), dtype=np.int64)
        out[inner], found[inner] = ids, count
        out[first], out[last], found[last] = self.start, self.end, self.texts
        return out, found, np.arange(len(inner)) - np.repeat(first, lengths + 2), lengths + 1


def vocabulary(texts: DataFrame, folder: str, bits: int) -> Vocabulary:
    """Count the words of all rows of ``texts`` (text) into sorted hash arrays."""

    def tally(batches):
        held, size, rows = [], 0, 0

        def flush():
            keys, count = counted(np.concatenate(held))
            out = [(s, arrays.pack(keys[i], count[i], rising=True)) for s, i in arrays.by_shard(keys, bits)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], names=["part", "body"])

        for batch in batches:
            rows += batch.num_rows
            for _, part in X.chunks(batch.column(0)):
                held.append(words(part)[0])
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([arrays.pack(np.array([rows], dtype=U))], pa.binary())], names=["part", "body"])

    def merged(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        parts = [arrays.unpack(body) for body in group.column("body").to_pylist()]
        if part < 0:
            return pa.table({"part": pa.array([part], pa.int32()), "n": [0], "total": [int(sum(p[0][0] for p in parts))]})
        keys, count = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(keys)
        at = arrays.runs(keys[order])
        keys, count = keys[order][at], np.add.reduceat(count[order], at)
        arrays.write_shard(folder, "word", part, key=keys, count=arrays.narrow(count))
        return pa.table({"part": pa.array([part], pa.int32()), "n": [len(keys)], "total": [int(count.sum())]})

    rows = texts.mapInArrow(tally, "part int, body binary").groupBy("part").applyInArrow(merged, "part int, n long, total long").collect()  # a row a shard
    shards = [r for r in rows if r["part"] >= 0]
    return Vocabulary(folder, bits, {r["part"]: r["n"] for r in shards}, sum(r["total"] for r in shards), sum(r["total"] for r in rows if r["part"] < 0))


ROWS = "level int, part int, kind string, body binary"


def table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["level", "part", "kind", "body"])


class Counter:
    """Counts of counts, and the jobs that lead to them."""

    def __init__(self, vocab: Vocabulary, order: int, folder: str, bits: int):
        self.vocab, self.order, self.folder, self.bits = vocab, order, folder, bits

    def dealt(self, level: int, kind: str, columns: list[np.ndarray], numbers: list[np.ndarray]):
        """Packed rows, one a shard, of n-grams in the order of their ids."""
        for shard, at in arrays.by_shard(gram_hash(columns), self.bits):
            yield level, shard, kind, arrays.pack(*[c[at].astype(U) for c in columns], *[x[at].astype(U) for x in numbers], rising=True)

    def sums(self, level: int, kind: str, columns: list[np.ndarray], numbers: list[np.ndarray]):
        """The same of n-grams in any order, numbers of equal ones added."""
        if not len(columns[0]):
            return
        order, first = grouped(columns, self.vocab.unknown + 1)
        yield from self.dealt(level, kind, [c[order[first]] for c in columns], [np.add.reduceat(x[order], first) for x in numbers])

    def scan(self, batches):
        """n-grams of texts: all of length ``order``, and shorter ones at the start of a text."""
        held, size = {n: [] for n in range(1, self.order + 1)}, 0

        def flush():
            rows = []
            for n, found in held.items():
                if found:
                    columns = [np.concatenate([f[i] for f in found]) for i in range(n)]
                    rows += self.sums(n, "count", columns, [np.ones(len(columns[0]), dtype=U)])
                found.clear()
            return table(rows)

        for batch in batches:
            for _, part in X.chunks(batch.column(0)):
                ids, _, place, _ = self.vocab.sequences(part)
                ids = ids.astype(np.uint32 if self.vocab.unknown < 2**32 else U)
                for n in range(1 if self.order == 1 else 2, self.order + 1):
                    ends = np.flatnonzero(place >= max(n - 1, 1)) if n == self.order else np.flatnonzero(place == n - 1)
                    if len(ends):
                        held[n].append([ids[ends - n + 1 + i] for i in range(n)])
                        size += len(ends)
                if size >= FLUSH:
                    yield from flush().to_batches()
                    size = 0
        if size:
            yield from flush().to_batches()

    def gather(self, level: int):
        """The function that completes the shards of one level and feeds the one below."""

        def run(group: pa.Table) -> pa.Table:
            rows = list(zip(*[group.column(c).to_pylist() for c in ("level", "part", "kind", "body")]))
            out = [r for r in rows if r[0] != level or r[2] == "stats"]
            counts = [arrays.unpack(r[3]) for r in rows if r[0] == level and r[2] == "count"]
            followers = [arrays.unpack(r[3]) for r in rows if r[0] == level and r[2] == "context"]
            del rows
            part = group.column("part")[0].as_py()
            if counts:
                columns = [np.concatenate([c[i] for c in counts]) for i in range(level + 1)]
                keys, columns, (count,) = self.combined(columns[:level], columns[level:])
                arrays.write_shard(self.folder, f"gram{level}", part, key=keys, count=arrays.narrow(count))
                of = [np.count_nonzero(count == i) for i in (1, 2, 3, 4)]
                stats = np.array([*of, len(count), int(count.sum())], dtype=U)
                out.append((level, part, "stats", arrays.pack(stats)))
                if level > 1:
                    out += self.sums(level - 1, "count", columns[1:], [np.ones(len(count), dtype=U)])
                    out += self.sums(level - 1, "context", columns[:-1], [count, *[(count == i).astype(U) for i in (1, 2)], (count > 2).astype(U)])
            if followers:
                columns = [np.concatenate([c[i] for c in followers]) for i in range(level + 4)]
                keys, columns, numbers = self.combined(columns[:level], columns[level:])
                keep = np.flatnonzero((numbers[0] != 1) | (columns[0] == U(self.vocab.start)))
                fields = {f: arrays.narrow(x[keep]) for f, x in zip(("total", "once", "twice", "more"), numbers)}
                arrays.write_shard(self.folder, f"context{level}", part, key=keys[keep], **fields)
            return table(out)

        return run

    @staticmethod
    def combined(columns, numbers):
        """n-grams by rising hash, their hashes, and numbers of equal ones added."""
        keys = gram_hash(columns)
        order = np.argsort(keys)
        at = arrays.runs(keys[order])
        first = order[at]
        return keys[first], [c[first] for c in columns], [np.add.reduceat(x[order], at) for x in numbers]

    def run(self, texts: DataFrame) -> dict[int, np.ndarray]:
        rows = texts.mapInArrow(self.scan, ROWS)
        for level in range(self.order, 0, -1):
            rows = rows.groupBy("part").applyInArrow(self.gather(level), ROWS)

        def added(group: pa.Table) -> pa.Table:
            total = sum(arrays.unpack(body)[0] for body in group.column("body").to_pylist())
            return pa.table({"level": pa.array([group.column("level")[0].as_py()], pa.int32()), "stats": pa.array([total.astype(np.int64).tolist()])})

        found = rows.filter("kind = 'stats'").groupBy("level").applyInArrow(added, "level int, stats array<long>").collect()  # a row a level
        return {r["level"]: np.array(r["stats"], dtype=float) for r in found}


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2, 3 and more from the numbers of n-grams counted 1, 2, 3, 4 times."""
    plain = np.array([0, 0.5, 1, 1.5])
    if not (n[:4] > 0).all():
        return plain
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([0, *[i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]])
    return d if (d >= 0).all() and (d <= np.arange(4)).all() else plain


class Model:
    """A trained model: a few numbers, and the places of its arrays."""

    def __init__(self, vocab: Vocabulary, order: int, folder: str, bits: int, stats: dict[int, np.ndarray]):
        self.vocab, self.order = vocab, order
        self.grams = {n: arrays.Store(folder, f"gram{n}", bits) for n in range(1, order + 1)}
        self.contexts = {n: arrays.Store(folder, f"context{n}", bits) for n in range(1, order)}
        self.discount = {n: discounts(s) for n, s in stats.items()}
        self.total = self.rest = 0.0
        if 1 in stats:
            ones, twos, _, _, types, self.total = stats[1]
            d = self.discount[1]
            self.rest = (d[1] * ones + d[2] * twos + d[3] * (types - ones - twos)) / self.total

    def lookup(self, n: int, keys: np.ndarray, last: np.ndarray):
        """Counts of n-grams, and where they are contexts the numbers of their followers (total, once, twice, more)."""
        order = np.argsort(keys)
        k = keys[order]
        count = np.zeros(len(keys))
        for rows, shard, at in self.grams[n].find(k):
            count[order[rows]] = self.grams[n].column(shard, "count")[at]
        if n == self.order:
            return count, None
        follow = np.zeros((4, len(keys)))
        follow[:2, (count > 0) & (last != self.vocab.end)] = 1
        for rows, shard, at in self.contexts[n].find(k):
            for i, field in enumerate(("total", "once", "twice", "more")):
                follow[i, order[rows]] = self.contexts[n].column(shard, field)[at]
        return count, follow

    def log10(self, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 probability of every token of ``sequences`` given those before it; 0 at starts."""
        if not self.total:
            return np.zeros(len(ids))
        keys = X.mix(ids.astype(U) + U(1))
        count, follow = self.lookup(1, keys, ids)
        d = self.discount[1]
        p = (count - d[np.minimum(count, 3).astype(np.int64)]) / self.total + self.rest / (self.vocab.types + 1)
        at = np.arange(len(ids))
        for n in range(2, self.order + 1):
            # ``at``: tokens with n - 1 tokens before them, the start included; keys and followers stand by the token that ends them
            use = at[place[at] >= n - 1]
            before = np.searchsorted(at, use - 1)
            keys, context = extended(keys[before], ids[use]), follow[:, before]
            count, follow = self.lookup(n, keys, ids[use])
            at = use
            seen = context[0] > 0
            d = self.discount[n]
            c, f = count[seen], context[:, seen]
            p[use[seen]] = ((c - d[np.minimum(c, 3).astype(np.int64)]) + (d[1] * f[1] + d[2] * f[2] + d[3] * f[3]) * p[use[seen]]) / f[0]
        out = np.log10(p)
        out[place == 0] = 0.0
        return out


def train(texts: DataFrame, order: int = ORDER, folder: str | None = None) -> Model:
    """A model of all rows of ``texts`` (text). ``folder``: one that the driver and all workers mount,
    where ``spark.checkpoint.dir`` is not such."""
    spark = texts.sparkSession
    bounded_batches(spark)
    texts = texts.select("text")
    place, bits = arrays.shared_folder(spark, "ngrams", folder), arrays.shard_bits(spark)
    vocab = vocabulary(texts, place, bits)
    return Model(vocab, order, place, bits, Counter(vocab, order, place, bits).run(texts) if vocab.texts else {})


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id), n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = keep or ["doc_id"]
    rows = docs.select(*keep, "text")
    schema = T.StructType(rows.schema.fields[:-1])
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"), ("perplexity", "double")):
        schema = schema.add(name, kind)
    shared = spark.sparkContext.broadcast(model)  # numbers and paths, and one offset a shard

    def run(batches):
        m = shared.value
        v = m.vocab
        floor = v.tokens + 0.5 * (v.types + 1)
        for batch in batches:
            for base, part in X.chunks(batch.column(len(keep)), 4 * X.CHUNK_BYTES):
                ids, count, place, lengths = v.sequences(part)
                starts = np.cumsum(lengths + 1) - (lengths + 1)
                known = np.add.reduceat((count > 0).astype(np.int64), starts)
                plain = np.log10((count + 0.5) / floor)
                plain[starts] = 0.0
                base_score, own = np.add.reduceat(plain, starts), np.add.reduceat(m.log10(ids, place), starts)
                kept = [batch.column(i).slice(base, len(part)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, (lengths, known, np.full(len(part), v.tokens), base_score, own, 10 ** (-own / lengths)))], names=schema.names)

    return rows.mapInArrow(run, schema)


def perplexities(docs: DataFrame, order: int = ORDER, folder: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row, by a
    model of the rows whose crc32(doc_id as text) mod 5 is not 1."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    docs = docs.select("doc_id", held.alias("held_out"), "text")
    model = train(docs.filter(~F.col("held_out")), order, folder)
    return score(docs, model, ["doc_id", "held_out"])
