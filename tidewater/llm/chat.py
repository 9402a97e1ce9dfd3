"""Chat formatting of reply trees (operator 4).

Messages form a forest: each names its parent, roots name none. Iterative self-joins list the path from
every leaf to its root: round k joins the rows found so far with each node's 2^k-th ancestor, so a path
of n messages takes log2(n) rounds, whatever the number of trees. Branches are ranked within their
conversation by mean score, then by leaf, and the first ``branches`` of them are formatted, each as one
conversation under a template that marks turns.

Control strings of this and of common other templates inside texts are escaped by one backslash after
their first character (one more where there are some already), which ``unescaped`` takes back exactly.
The loss mask is a list of code point ranges of the formatted string: the assistants' texts.

Rows: null texts are empty, null roles are the empty role; a message whose parent is missing is a root;
messages that repeat a node id of their conversation, or have a null one, are refused with a ValueError,
as their place in the tree is not known (``chained`` gives each row its own); null conversation ids form one conversation; an empty table gives an empty
result; other columns are ignored. Messages on a cycle have no leaf and are not listed.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewater.llm.common import bounded_batches, written

# The template and the control strings that are escaped.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

LOSS_ROLE = "assistant"

PLAIN = re.compile("|".join(rf"({re.escape(c[0])})(\\*)({re.escape(c[1:])})" for c in sorted(CONTROL, key=len, reverse=True)))
MARKED = re.compile("|".join(rf"({re.escape(c[0])})\\(\\*)({re.escape(c[1:])})" for c in sorted(CONTROL, key=len, reverse=True)))


def escaped(text: str) -> str:
    return PLAIN.sub(lambda m: "{}\\{}{}".format(*(g for g in m.groups() if g is not None)), text)


def unescaped(text: str) -> str:
    return MARKED.sub(lambda m: "{}{}{}".format(*(g for g in m.groups() if g is not None)), text)


#: Characters that a role may not show, as the turn's first line must stay one line without control strings.
ROLE_MARKS = {"\\": "\\\\", "\n": "\\n", "<": "\\l", "[": "\\b"}


def escaped_role(role: str) -> str:
    return re.sub(r"[\\\n<\[]", lambda m: ROLE_MARKS[m.group()], role)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\([\\nlb])", lambda m: next(k for k, v in ROLE_MARKS.items() if v == m.group()), role)


def chained(rows: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each replies to the one before.

    Rows of a conversation are ordered by turn; of equal turns, by role and text.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    m = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return m.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def paths(messages: DataFrame) -> DataFrame:
    """conv_id, leaf, node, back (steps from the leaf) of every message on a path from a leaf to its root."""
    m = written(messages.select("conv_id", "node", "parent"))
    here = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.at") == F.col(f"{b}.node"))
    nodes = m.select("conv_id", "node")
    up = m.filter("parent IS NOT NULL").select("conv_id", "node", F.col("parent").alias("at"))
    up = written(up.alias("u").join(nodes.alias("n"), here("u", "n"), "left_semi"))
    replied = up.select("conv_id", F.col("at").alias("node"))
    at = F.col("n.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("n.node") == F.col("r.node"))
    found = nodes.alias("n").join(replied.alias("r"), at, "left_anti")
    # grouped, so that the optimizer does not take leaf and at for two names of one column
    found = found.groupBy("conv_id", F.col("node").alias("leaf")).agg(F.first("node").alias("at"))
    parts, step = [written(found.withColumn("back", F.lit(0).cast("long")))], 1
    while not up.isEmpty():
        more = [p.alias("f").join(up.alias("u"), here("f", "u")).select("f.conv_id", "f.leaf", F.col("u.at").alias("at"), (F.col("f.back") + step).alias("back")) for p in parts]
        more = written(reduce(DataFrame.unionByName, more))
        if more.isEmpty():  # what is left of ``up`` lies on cycles
            break
        parts.append(more)
        up = written(up.alias("u").join(up.alias("v"), here("u", "v")).select("u.conv_id", "u.node", F.col("v.at").alias("at")))
        step *= 2
    return reduce(DataFrame.unionByName, parts).select("conv_id", "leaf", F.col("at").alias("node"), "back")


def ranked(messages: DataFrame, found: DataFrame, branches: int) -> DataFrame:
    """conv_id, leaf, rank of the ``branches`` best paths of each conversation."""
    at = F.col("p.conv_id").eqNullSafe(F.col("m.conv_id")) & (F.col("p.node") == F.col("m.node"))
    scored = found.alias("p").join(messages.select("conv_id", "node", "score").alias("m"), at).groupBy("p.conv_id", "p.leaf").agg(F.avg("m.score").alias("score"))
    order = W.partitionBy("conv_id").orderBy(F.col("score").desc_nulls_last(), "leaf")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= branches).select("conv_id", "leaf", "rank")


def formatted(messages: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, rank, text, loss (start and end of each masked range) of the chosen branches.

    ``messages``: conv_id, node, parent, role, text, score.
    """
    bounded_batches(messages.sparkSession)
    twice = messages.groupBy("conv_id", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR node IS NULL").select("conv_id", "node").head(3)
    if twice:
        raise ValueError(f"messages that repeat a node id, or have none: {[tuple(r) for r in twice]}")
    found = paths(messages)
    best = ranked(messages, found, branches)
    on = F.col("p.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("p.leaf") == F.col("b.leaf"))
    rows = found.alias("p").join(best.alias("b"), on).select("p.conv_id", "b.rank", "p.node", "p.back")
    at = F.col("r.conv_id").eqNullSafe(F.col("m.conv_id")) & (F.col("r.node") == F.col("m.node"))
    turn = F.struct((-F.col("r.back")).alias("nth"), F.coalesce("m.role", F.lit("")).alias("role"), F.coalesce("m.text", F.lit("")).alias("text"))
    rows = rows.alias("r").join(messages.alias("m"), at).groupBy("r.conv_id", "r.rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    rows = rows.select("conv_id", "rank", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches):
        for batch in batches:
            out, spans = [], []
            for roles, texts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                parts, loss, at = [], [], 0
                for role, text in zip(roles, texts):
                    head, body, tail = f"{START}{escaped_role(role)}\n", escaped(text), f"{END}\n"
                    if role == LOSS_ROLE:
                        loss += [at + len(head), at + len(head) + len(body)]
                    parts += [head, body, tail]
                    at += len(head) + len(body) + len(tail)
                out.append("".join(parts))
                spans.append(loss)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(spans, pa.list_(pa.int64()))], names=["conv_id", "rank", "text", "loss"])

    kind = messages.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, rank int, text string, loss array<long>")


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out = []
    for turn in text.split(f"{END}\n")[:-1]:
        role, _, body = turn.removeprefix(START).partition("\n")
        out.append((unescaped_role(role), unescaped(body)))
    return out


def read_back(conversations: DataFrame) -> DataFrame:
    """conv_id, rank and digests of the turns and of the masked text, from the formatted strings alone."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                turns = turns_of(text)
                masked = "".join(unescaped(text[a:b]) for a, b in zip(loss[::2], loss[1::2]))
                digest = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
                rows.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(masked), digest(masked), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=["conv_id", "rank", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return conversations.mapInArrow(run, f"conv_id {kind}, rank int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sql_pattern() -> str:
    """The escaped control strings as one pattern for SQL."""
    return "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]).replace("/", "\\/") for c in sorted(CONTROL, key=len, reverse=True))


#: DuckDB: digests of the conversations as they are; each escape adds one character.
ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = '{LOSS_ROLE}' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = '{LOSS_ROLE}' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum({len(START) + len(END) + 2} + length(role) + length(text) + len(regexp_extract_all(text, '{_sql_pattern()}')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
