"""Secret scan: pattern matches plus strings that a public token vocabulary encodes badly (operator 10).

Natural words, also rare ones, reach two to five characters a token under a byte-pair vocabulary;
random keys stay near one and a half. A run of key characters counts as random when its ratio is
below ``MAX_CHARS_PER_TOKEN`` and it is no digest of a usual length, UUID, number or piece of the alphabet.
Names (letters of one or of title case, with marks between) count by their best of three ratios: as
they stand, in lower case, and their words alone; so headings and paths of short words are no keys.

Rows: null and empty texts have no span; a repeated row is scanned on its own; an empty table gives
an empty result; other columns are ignored (``scan``) or kept as they are (``redact``).
"""

from __future__ import annotations

import base64
import hashlib
import re
import string

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import bounded_batches

#: Vocabulary file of ranks (one "base64 rank" line a token), read on the driver.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern published with that vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A vocabulary of more ranks is refused: it is sent to every executor.
MAX_RANKS = 400_000

MIN_RUN = 16
MAX_CHARS_PER_TOKEN = 1.9

KINDS = ("assign", "access", "hex", "random")

# The base patterns and their least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 20
HEX = r"[0-9a-f]+"
HEX_LEAST = 24
#: Lengths of hexadecimal MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Ranks of a vocabulary file; refused above ``MAX_RANKS`` entries."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"{path}: {len(ranks)} ranks; at most {MAX_RANKS} are sent to executors")
    return ranks


class Scanner:
    """Finds spans in one text: (start, kind index, end) in code points, ends exclusive."""

    def __init__(self, ranks: dict[bytes, int]):
        self.encode = tiktoken.Encoding("scan", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        # a maximal run that is too short can hold no accepted match, so the least length may stand in the pattern
        self.access = re.compile(ACCESS.replace("+", "{%d,}" % (ACCESS_LEAST - 4)))
        self.hex = re.compile(HEX.replace("+", "{%d,}" % HEX_LEAST))
        self.run = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_RUN)
        self.uuid = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
        self.name = re.compile(r"[A-Za-z]+([_/+-]+[A-Za-z]+)*[_/+=-]*|[_/+=-]*")  # words joined by punctuation
        self.number = re.compile(r"[0-9_/+=-]+")

    def known(self, run: str) -> bool:
        """Digests of usual lengths, UUIDs, numbers and letters in the order of the alphabet."""
        if self.uuid.fullmatch(run) or self.number.fullmatch(run):
            return True
        if len(run) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
            return True
        return run.lower() in string.ascii_lowercase

    def ratio(self, run: str) -> float:
        """Characters a token; of a name the best of the run, its lower case and its words alone."""
        own = len(run) / len(self.encode(run))
        words = re.findall("[A-Za-z]+", run)
        if own >= MAX_CHARS_PER_TOKEN or not self.name.fullmatch(run) or not all(w.islower() or w.istitle() or w.isupper() for w in words):
            return own
        low = [w.lower() for w in words]
        return max(own, len(run) / len(self.encode(run.lower())), sum(map(len, low)) / sum(len(self.encode(w)) for w in low))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        found = []
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            found += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        for m in self.run.finditer(text):
            run = m.group()
            if not self.known(run) and self.ratio(run) < MAX_CHARS_PER_TOKEN:
                found.append((m.start(), 3, m.end()))
        return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with each maximal union of overlapping spans replaced by ``mark``."""
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            at = end
        out += [text[at:a], mark]
        end = b
    return "".join([*out, text[max(end, 0):]])


def scan(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches):
        scanner = Scanner(ranks.value)
        for batch in batches:
            rows = [scanner.spans(t or "") for t in batch.column(1).to_pylist()]
            counts = [[sum(k == i for _, k, _ in r) for r in rows] for i in range(3)]
            base = [hashlib.sha256(joined([x for x in r if x[1] < 3]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string()), pa.array([joined(r) for r in rows], pa.string())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; ``n_chars``, if present, follows the new text.

    Null texts stay null; texts without a span and all other columns stay as they are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    at = docs.columns.index("text")

    def run(batches):
        scanner = Scanner(ranks.value)
        for batch in batches:
            texts = [t if t is None else masked(t, scanner.spans(t), mark) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
