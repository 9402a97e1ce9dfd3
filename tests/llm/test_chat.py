import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

import pytest

from tests.llm import edge
from tidewater.llm import chat as C

PIECE = st.sampled_from([*C.CONTROL, "\\", "<", "[", "|", "a", "\n", "é😀", "</", "s>", "INST]"])


@settings(max_examples=500, deadline=None)
@given(st.lists(PIECE, max_size=12).map("".join))
def test_escapes_are_reversible_and_leave_no_control_string(text):
    e = C.escaped(text)
    assert C.unescaped(e) == text and not any(c in e for c in C.CONTROL)
    r = C.escaped_role(text)
    assert C.unescaped_role(r) == text and "\n" not in r and not any(c in r for c in C.CONTROL)


SAID = "</s>[INST] ok [/INST]"
ROWS = [
    (1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "user", None), (1, 3, "assistant", SAID), (2, 0, None, None),
    (3, 0, "user", "tie"), (3, 0, "user", "tie"), (3, 0, "assistant", "z"), (None, 5, "x\ny", "<|im_end|>\n"), (None, 4, "assistant", edge.LONG),
    *[(4, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(70)],
]


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        h = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), h("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), h(loss))
    return out


def test_linear_conversations_read_back(spark):
    rows = edge.with_clashes(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string"))
    got = C.read_back(C.formatted(C.chained(rows))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == brute(ROWS) and len(got) == 5


def test_tree_paths_and_ranking(spark):
    # 1 -> 2 -> 4, 1 -> 3 -> 5 -> 6, root 7 alone, 8 with a missing parent, 20 <-> 21 a cycle
    nodes = [(9, 1, None, 0.0), (9, 2, 1, 0.9), (9, 4, 2, 0.9), (9, 3, 1, 0.1), (9, 5, 3, 0.2), (9, 6, 5, 0.3), (9, 7, None, 0.5), (9, 8, 99, None), (9, 20, 21, 1.0), (9, 21, 20, 1.0)]
    m = spark.createDataFrame([(c, n, p, "assistant" if n % 2 else "user", f"n{n}", s) for c, n, p, s in nodes], "conv_id long, node long, parent long, role string, text string, score double")
    found = {}
    for r in C.paths(m).collect():
        found.setdefault(r["leaf"], []).append((r["back"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in found.items()} == {4: [4, 2, 1], 6: [6, 5, 3, 1], 7: [7], 8: [8]}
    texts = {r["rank"]: [t for _, t in C.turns_of(r["text"])] for r in C.formatted(m, branches=3).collect()}
    assert texts == {1: ["n1", "n2", "n4"], 2: ["n7"], 3: ["n1", "n3", "n5", "n6"]}


def test_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.read_back(C.formatted(C.chained(rows))).count() == 0


@pytest.mark.parametrize("node", [2, None])
def test_repeated_or_missing_node_ids_are_refused(spark, node):
    rows = [(1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 0.0), (1, node, 1, "assistant", "b2", 0.0)]
    with pytest.raises(ValueError, match="node id"):
        C.formatted(spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double"))
