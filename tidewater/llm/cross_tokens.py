"""Alignment of two tokenizers by lockstep merging (operator 13).

Every text, with a space before it, is encoded by a byte-level BPE (A) and a SentencePiece model (B).
Tokens are byte ranges; where ranges of A and B end together the text is cut into groups, and the two
tokens that end there are linked.

``lockstep``: one state vector holds an A and a B pointer a lane; a lane is a document, or a piece of
``LANE`` A tokens of a longer one, so that no lane outlasts the others. A step compares the two ends of
all lanes at once, emits links and cuts where they agree, moves the pointer that lies behind (both at a
cut), and lanes that are through are compacted away.

The aligned documents are written once to the shared folder, links as packed numbers. Pair counts are
summed in tasks, dealt to shards by a hash of the pair and kept as sorted arrays that tasks map
(``arrays``); of each B id only the highest count goes through the driver (at most B's vocabulary).

A is encoded from its JSON file by ``tiktoken`` where its ids are the order of its merges and a text
has only characters on which both libraries split alike; other texts go through ``tokenizers``.

Rows: texts that are null or empty, or whose tokens' bytes differ from the text, have no tokens, zeros
and an empty string; a repeated row counts as often as it stands; a token of no bytes has no end of its
own and is refused when a vocabulary is loaded; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import arrays, textkit as X
from tidewater.llm.common import bounded_batches, written

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Larger vocabulary files are refused: they are sent to every executor.
MAX_FILE = 64 << 20

LANE = 128  # A tokens of a lane at most
FLUSH = 1 << 21  # links counted before a task sends their sums

#: The split pattern published with the vocabulary of A.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters outside these ranges (ASCII but the four separators, Latin, dashes and quotation marks)
#: may be classed by another Unicode version in one of the two libraries.
UNUSUAL = re.compile("[^\x00-\x1b\x20-\x7f¡-ſ‐-‧]")


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: visible ones stand for themselves,
    the others, in their order, for 256 and up."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bytes:
    """Bytes of the tokens of a vocabulary, by id."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(entries), dtype=np.uint8)
        self.text = np.array([str(i).encode() for i in range(len(entries))])  # decimal ids

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        shift = self.start[ids] - (np.cumsum(size) - size)
        return self.pool[np.repeat(shift, size) + np.arange(int(size.sum()))]


class Encoders:
    """Both tokenizers, made from their files' bytes in the worker that uses them."""

    def __init__(self, a: bytes, b: bytes):
        self.files, self.made = (a, b), None

    def __getstate__(self):
        return {"files": self.files, "made": None}

    def ready(self) -> "Encoders":
        if self.made is None:
            raw_a, raw_b = self.files
            spec = json.loads(raw_a)
            vocab, letters = spec["model"]["vocab"], byte_letters()
            size = max([*vocab.values(), *[t["id"] for t in spec.get("added_tokens", [])]]) + 1
            entries = [b""] * size
            for token, ident in vocab.items():
                entries[ident] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
            for t in spec.get("added_tokens", []):
                entries[t["id"]] = t["content"].encode()
            self.a = Bytes(entries)
            self.slow = tokenizers.Tokenizer.from_str(raw_a.decode())
            self.slow.encode_special_tokens = True
            self.fast = None
            special = {t["id"] for t in spec.get("added_tokens", [])}
            merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
            if {len(e) for e in entries[:256]} == {1} and all(vocab.get(x + y) == 256 + i for i, (x, y) in enumerate(merges)):
                ranks = {e: i for i, e in enumerate(entries) if i not in special}
                self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.b_model = sentencepiece.SentencePieceProcessor(model_proto=raw_b)
            m = self.b_model
            self.b = Bytes([bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())])
            if self.a.size.min() == 0 or self.b.size.min() == 0:
                raise ValueError("a vocabulary has a token of no bytes")
            self.made = True
        return self

    def encode_a(self, text: str) -> list[int]:
        if self.fast is not None and not UNUSUAL.search(text):
            return self.fast.encode_ordinary(" " + text)
        return self.slow.encode(" " + text, add_special_tokens=False).ids

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.b_model.encode(texts, num_threads=1)


def encoders(vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> Encoders:
    files = []
    for path in (vocabulary_a, vocabulary_b):
        with open(path, "rb") as f:
            files.append(f.read())
        if len(files[-1]) > MAX_FILE:
            raise ValueError(f"{path}: {len(files[-1])} bytes; at most {MAX_FILE} are sent to executors")
    return Encoders(*files)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked (A, B) token numbers in text order.

    ``ends_a``, ``ends_b``: rising byte ends of all tokens of a batch, over its joined texts; lane i is
    the A tokens ``first[i]`` to ``stop[i]`` (exclusive) and the B tokens that end in their bytes.
    """
    begin = np.where(first > 0, ends_a[np.maximum(first - 1, 0)], 0)
    a, a_stop = first.copy(), stop.copy()
    b = np.searchsorted(ends_b, begin, side="right")
    b_stop = np.searchsorted(ends_b, ends_a[a_stop - 1], side="right")
    out_a, out_b = [], []
    while True:
        live = (a < a_stop) & (b < b_stop)
        if not live.all():
            a, b, a_stop, b_stop = a[live], b[live], a_stop[live], b_stop[live]
        if not len(a):
            break
        gap = ends_a[a] - ends_b[b]
        met = gap == 0
        out_a.append(a[met])
        out_b.append(b[met])
        a = a + (gap <= 0)
        b = b + (gap >= 0)
    if not out_a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    order = np.argsort(a)
    return a[order], b[order]


def lanes(counts: np.ndarray, limit: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """(first, stop) A tokens of the lanes of documents with ``counts`` tokens."""
    pieces = -(-counts // limit)
    base = np.repeat(np.cumsum(counts) - counts, pieces)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = base + nth * limit
    return first, np.minimum(first + limit, np.repeat(np.cumsum(counts), pieces))


def group_codes(e: Encoders, ids_a: np.ndarray, ids_b: np.ndarray, link_a: np.ndarray, link_b: np.ndarray):
    """The groups of a batch as fixed-width bytes: per token its decimal id and the mark that follows it
    (``,`` within, ``|`` after the last A, ``;`` after the last B token of a group), NUL-padded, in
    reading order; the order is group by group, A before B."""
    width = max(e.a.text.itemsize, e.b.text.itemsize) + 1
    last_a, last_b = np.zeros(len(ids_a), dtype=bool), np.zeros(len(ids_b), dtype=bool)
    last_a[link_a], last_b[link_b] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    upto_a = np.append(link_a + 1, len(ids_a))  # A tokens up to the end of each group
    before_b = np.concatenate([[0], link_b + 1])  # B tokens before each group
    out = np.zeros(len(ids_a) + len(ids_b), dtype=f"S{width}")
    out[np.arange(len(ids_a)) + before_b[group_a]] = marked(e.a.text, b",|", width)[ids_a * 2 + last_a]
    out[np.arange(len(ids_b)) + upto_a[group_b]] = marked(e.b.text, b",;", width)[ids_b * 2 + last_b]
    return out


def marked(text: np.ndarray, marks: bytes, width: int) -> np.ndarray:
    """Each decimal id with the one and with the other mark after it."""
    return np.stack([np.char.add(text, marks[i : i + 1]) for i in (0, 1)], axis=1).ravel().astype(f"S{width}")


class Aligned:
    """Tokens, links and digests of a batch of texts."""

    def __init__(self, e: Encoders, texts: list[str | None]):
        at = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in at]
        lists_a, lists_b = [e.encode_a(t) for t in some], e.encode_b(some) if some else []
        raw = [b" " + t.encode() for t in some]
        same = self.matching(e.a, lists_a, raw) & self.matching(e.b, lists_b, raw)
        use = np.flatnonzero(same)
        lists_a, lists_b = [lists_a[i] for i in use], [lists_b[i] for i in use]
        self.rows = np.array(at, dtype=np.int64)[use]  # texts that have tokens
        self.n_a, self.n_b = (np.array([len(x) for x in lists], dtype=np.int64) for lists in (lists_a, lists_b))
        self.ids_a, self.ids_b = flat(lists_a), flat(lists_b)
        self.ends_a, self.ends_b = np.cumsum(e.a.size[self.ids_a]), np.cumsum(e.b.size[self.ids_b])
        self.link_a, self.link_b = lockstep(self.ends_a, self.ends_b, *lanes(self.n_a))
        stops = np.cumsum(self.n_a)
        self.first_link = np.searchsorted(self.link_a, stops - self.n_a)
        self.n_links = np.searchsorted(self.link_a, stops) - self.first_link
        self.codes = group_codes(e, self.ids_a, self.ids_b, self.link_a, self.link_b)
        self.first_code = np.cumsum(self.n_a + self.n_b) - (self.n_a + self.n_b)

    @staticmethod
    def matching(v: Bytes, lists: list[list[int]], raw: list[bytes]) -> np.ndarray:
        """Texts whose tokens' bytes are the text's."""
        ids, want = flat(lists), np.frombuffer(b"".join(raw), dtype=np.uint8)
        size = np.array([len(r) for r in raw], dtype=np.int64)
        count = np.array([len(x) for x in lists], dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(v.size[ids])])
        stop = np.cumsum(count)
        got = total[stop] - total[stop - count]
        if (got == size).all():
            differ = np.concatenate([[0], np.cumsum(v.joined(ids) != want)])
            stop = np.cumsum(size)
            return differ[stop] == differ[stop - size]
        return np.array([v.joined(np.array(x, dtype=np.int64)).tobytes() == r for x, r in zip(lists, raw)], dtype=bool)

    def groups(self, i: int) -> bytes:
        """``a1,a2|b1;a3|b2,b3`` of the i-th text that has tokens."""
        a = self.first_code[i]
        return self.codes[a : a + self.n_a[i] + self.n_b[i]].tobytes().translate(None, b"\0")[:-1]

    def links(self, i: int) -> slice:
        return slice(self.first_link[i], self.first_link[i] + self.n_links[i])


def flat(lists: list[list[int]]) -> np.ndarray:
    total = sum(map(len, lists))
    return np.fromiter((x for ids in lists for x in ids), dtype=np.int64, count=total) if total < 1000 else np.concatenate([np.array(ids, dtype=np.int64) for ids in lists])


def batches_of(e: Encoders, column: pa.Array):
    for base, part in X.chunks(column):
        yield base, len(part), Aligned(e, part.to_pylist())


def aligned(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links (packed ids of A and B) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(encoders(vocabulary_a, vocabulary_b))
    numbers = ("n_a", "n_b", "n_groups", "n_links")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in numbers], T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.BinaryType())])

    def run(batches):
        for batch in batches:
            e = shared.value.ready()
            for base, n, found in batches_of(e, batch.column(1)):
                digest, links = [""] * n, [None] * n
                counts = np.zeros((n, 3), dtype=np.int64)
                counts[found.rows] = np.stack([found.n_a, found.n_b, found.n_links], axis=1)
                pair_a, pair_b = found.ids_a[found.link_a], found.ids_b[found.link_b]
                for i, row in enumerate(found.rows):
                    digest[row] = hashlib.sha256(found.groups(i)).hexdigest()
                    at = found.links(i)
                    links[row] = arrays.pack(pair_a[at].astype(np.uint64), pair_b[at].astype(np.uint64))
                # all bytes of a text lie in groups that end in a link, so there are as many groups as links
                columns = [counts[:, 0], counts[:, 1], counts[:, 2], counts[:, 2]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(base, n), *[pa.array(c) for c in columns], pa.array(digest, pa.string()), pa.array(links, pa.binary())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def links(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """doc_id and arrays a_ids, b_ids, ends: the linked tokens of every row and the byte, in space and text, at which they end."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(encoders(vocabulary_a, vocabulary_b))
    schema = docs.select("doc_id").schema
    for name in ("a_ids", "b_ids", "ends"):
        schema = schema.add(name, T.ArrayType(T.IntegerType()))

    def run(batches):
        for batch in batches:
            e = shared.value.ready()
            for base, n, found in batches_of(e, batch.column(1)):
                out = [[[] for _ in range(n)] for _ in range(3)]
                start = np.concatenate([[0], found.ends_a[np.cumsum(found.n_a) - 1]]) if len(found.rows) else []
                for i, row in enumerate(found.rows):
                    at = found.links(i)
                    out[0][row], out[1][row] = found.ids_a[found.link_a[at]].tolist(), found.ids_b[found.link_b[at]].tolist()
                    out[2][row] = (found.ends_a[found.link_a[at]] - start[i]).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(base, n), *[pa.array(x, pa.list_(pa.int32())) for x in out]], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keyed(pairs: np.ndarray) -> np.ndarray:
    """One-to-one hash of pair numbers."""
    return X.mix(pairs + X.U(1))


def pair_counts(table: DataFrame, folder: str, bits: int) -> dict[int, int]:
    """Counts of linked id pairs over ``table``, as arrays below ``folder``; the highest count of each B id."""

    def tally(batches):
        held, size = [], 0

        def flush():
            pairs = np.sort(np.concatenate(held))
            at = arrays.runs(pairs)
            count = np.diff(np.append(at, len(pairs))).astype(np.uint64)
            pairs = pairs[at]
            rows = [(s, arrays.pack(pairs[i], count[i], rising=True)) for s, i in arrays.by_shard(keyed(pairs), bits)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "body"])

        for batch in batches:
            for body in batch.column(0).to_pylist():
                if body is not None:
                    a, b = arrays.unpack(body)
                    held.append(a << X.U(32) | b)
                    size += len(a)
                    if size >= FLUSH:
                        yield flush()
                        held, size = [], 0
        if size:
            yield flush()

    def merged(group: pa.Table) -> pa.Table:
        parts = [arrays.unpack(body) for body in group.column("body").to_pylist()]
        pairs, count = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(pairs)
        at = arrays.runs(pairs[order])
        pairs, count = pairs[order][at], np.add.reduceat(count[order], at)
        keys = keyed(pairs)
        order = np.argsort(keys)
        arrays.write_shard(folder, "pair", group.column("part")[0].as_py(), key=keys[order], count=arrays.narrow(count[order]))
        b = (pairs & X.U(0xFFFFFFFF)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        at = arrays.runs(b[order])
        return pa.table({"b": b[order][at], "most": np.maximum.reduceat(count[order], at).astype(np.int64)})

    sums = table.select("links").mapInArrow(tally, "part int, body binary").groupBy("part").applyInArrow(merged, "b long, most long")
    return {r["b"]: r["most"] for r in sums.groupBy("b").agg(F.max("most").alias("most")).collect()}  # at most B's vocabulary


def judged(table: DataFrame, folder: str, bits: int, most: dict[int, int]) -> DataFrame:
    """``table`` without its links, with n_best and count_sum."""
    top = np.zeros(max(most, default=0) + 1, dtype=np.int64)
    for b, n in most.items():
        top[b] = n
    store = arrays.Store(folder, "pair", bits)
    kept = [c for c in table.columns if c != "links"]
    schema = table.select(*kept).schema.add("n_best", "long").add("count_sum", "long")
    nth = table.columns.index("links")

    def run(batches):
        for batch in batches:
            n_best, total = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            found = [(i, *arrays.unpack(body)) for i, body in enumerate(batch.column(nth).to_pylist()) if body is not None]
            if found:
                own = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                a, b = (np.concatenate([f[k] for f in found]) for k in (1, 2))
                keys = keyed(a << X.U(32) | b)
                order = np.argsort(keys)
                count = np.zeros(len(keys), dtype=np.int64)
                for rows, shard, at in store.find(keys[order]):
                    count[order[rows]] = store.column(shard, "count")[at]
                np.add.at(total, own, count)
                np.add.at(n_best, own, count == top[b.astype(np.int64)])
            columns = [c for i, c in enumerate(batch.columns) if i != nth]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_best), pa.array(total)], names=schema.names)

    return table.mapInArrow(run, schema)


def alignment(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, folder: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    ``folder``: one that the driver and all workers mount, where ``spark.checkpoint.dir`` is not such.
    """
    spark: SparkSession = docs.sparkSession
    place, bits = arrays.shared_folder(spark, "pairs", folder), arrays.shard_bits(spark)
    table = written(aligned(docs, vocabulary_a, vocabulary_b))
    most = pair_counts(table, place, bits)
    return judged(table, place, bits, most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
