"""Toxicity: Levenshtein automata over a lexicon trie, weighted by context (operator 3).

1. Lexicon: words and stems (first letters of words, written "stem*") that labelled toxic documents hold
   more often than chance explains. The binomial odds of a term's counts, times the number of terms
   held by as many documents, tell how many such terms chance alone would bring forth; a term's trust
   is 1 / (1 + that number). Document counts by term cover all labelled training rows; every term
   below ``CHANCE`` is kept.
2. Automaton: the Levenshtein automata of all words (one edit; none for words under ``EDIT_FROM``
   or over ``EDIT_TO`` characters) are run along the lexicon's trie and determinised into one table, state x character
   class -> state; a stem is matched exactly and accepts any ending. The lexicon in order of its letters
   is split into as many tables as it takes, of ``TERMS`` terms each. Tasks step all words of a block
   through a table at once; most words leave it after a few characters. With more than one table, each
   distinct word of a block is stepped once; the best acceptance of all tables counts. Words with one
   of ``MARKS`` between them and nothing else (st*pid) are stepped once more as one word, mark included,
   where no word of them is a match on its own: the mark takes the place of a letter or is one too many.
3. Context: a window of ``WINDOW`` words to each side. A match inside quotation marks, or near a word of
   reporting, is a quotation; near a word of address it is aimed at somebody. Each kind scales a match.
4. Weights: how often training documents that hold a term, exactly or misspelled, are toxic
   (with a prior of the base rate); a misspelling that clean documents share so gets no weight.
Score: 1 - product over matches of (1 - weight x context); texts without match score 0. Terms of less
than half trust together add at most ``WEAK``: they rank texts, but reject none.

Rows: null and empty texts score 0; a repeated row is scored on its own; a document with several label
rows is toxic if one says so; rows without label, or with a null one, teach nothing; without any
toxic training row the lexicon is empty and all scores are 0; an empty table gives an empty result;
other columns are ignored (``score``) or kept (``clean``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import textkit as X
from tidewater.llm.common import bounded_batches, checkpointed, pick_ids

TERMS = 400  # most terms of one automaton; a larger lexicon has several
STEMS = tuple(range(4, 11))  # characters of stems
MIN_SHARE = 0.6  # share of toxic ones among training documents that hold a term
CHANCE = 20.0
EDIT_FROM = 5  # characters from which a term may be misspelled by one edit, and
EDIT_TO = 40  # up to which; longer words are matched as they stand, so that a table grows with the lexicon's letters alone
WINDOW = 6
THRESHOLD = 0.3
WEAK = 0.2
STRENGTH = 0.9  # greatest weight of one match
#: Factors of a match in a quotation, aimed at somebody, or neither.
CONTEXT = {"quoted": 0.2, "aimed": 1.0, "plain": 0.7}

# Words of reporting and of address, quotation marks.
REPORTING = "said says wrote quoted called quote word term slur says reported dit disait sagte schrieb dijo escribió palabra mot wort".split()
ADDRESS = "you your you're u ur tu te toi vous du dich dir sie usted eres".split()
QUOTES = "\"“”„«»‟‹›"
#: Characters that stand for letters inside a word.
MARKS = "@$*!#%_"

OTHER = 0  # class of characters that no term has
LAST, NONE = 1000, 1001  # orders of a misspelled word and of no acceptance; a stem's is LAST less its length


def label_fold(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def training(docs: DataFrame, labels: DataFrame, fold: Column | None) -> DataFrame:
    """text, toxic (boolean) of labelled rows; ``fold``: the condition on ``labels`` of rows to learn from."""
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    marks = marks if fold is None else marks.filter(fold)
    marks = pick_ids(checkpointed(marks.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))))
    return docs.select("doc_id", "text").filter("text IS NOT NULL").join(marks, "doc_id").select("text", "toxic")


def lexicon(train: DataFrame) -> dict[str, float]:
    """Every term below ``CHANCE`` and its trust, from document counts by term over all of ``train``."""
    words = F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), lambda w: F.length(w) >= 3)
    stems = [F.transform(F.filter("words", lambda w, k=k: F.length(w) > k), lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS]
    rows = train.select("toxic", F.array_distinct(words).alias("words"))
    rows = rows.select("toxic", F.explode(F.array_distinct(F.concat("words", *stems))).alias("word"))
    n = checkpointed(rows.groupBy("word").agg(F.sum(F.col("toxic").cast("long")).alias("bad"), F.count(F.lit(1)).alias("all")))
    base = train.agg(F.avg(F.col("toxic").cast("double"))).collect()[0][0]
    if not base or base == 1.0:
        return {}
    alike = pick_ids(checkpointed(n.groupBy("all").agg(F.count(F.lit(1)).alias("alike"))))
    good = F.col("all") - F.col("bad")
    # log of C(all, bad) by Stirling's series, which is within 1 % from 1 on
    fact = lambda x: F.when(x > 0, x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x)).otherwise(F.lit(0.0))
    odds = fact(F.col("all")) - fact(F.col("bad")) - fact(good) + F.col("bad") * math.log(base) + good * math.log1p(-base)
    strong = n.filter(F.col("bad") >= MIN_SHARE * F.col("all")).join(alike, "all")
    strong = strong.select("word", (odds + F.log("alike")).alias("chance")).filter(F.col("chance") < math.log(CHANCE))
    return {r["word"]: 1 / (1 + math.exp(r["chance"])) for r in sorted(strong.collect())}


def automata_of(terms: list[str], size: int = TERMS) -> list[dict]:
    """The automata of sorted ``terms``, ``size`` terms each."""
    return [automaton_of(terms[at : at + size]) | {"base": at} for at in range(0, len(terms), size)]


def automaton_of(terms: list[str], edit_from: int = EDIT_FROM) -> dict:
    """Determinised Levenshtein automata along the trie of ``terms``, as plain arrays to broadcast:
    class_of (character -> class), table (state x class -> state; 0 is dead, 1 the start), and per state
    the accepted term (or -1) with its edits and its order among acceptances (least first).
    """
    letters = sorted({c for t in terms for c in t.rstrip("*")})
    class_of = {c: i + 1 for i, c in enumerate(letters)}
    children: list[dict[int, int]] = [{}]
    words, stems, deep = [-1], [-1], [False]  # term that ends at a node; some word below may be misspelled
    for i, t in enumerate(terms):
        word, node, edit = t.rstrip("*"), 0, edit_from <= len(t) <= EDIT_TO and not t.endswith("*")
        deep[0] |= edit
        for k in (class_of[c] for c in word):
            if k not in children[node]:
                children[node][k] = len(children)
                children.append({})
                words.append(-1)
                stems.append(-1)
                deep.append(False)
            node = children[node][k]
            deep[node] |= edit
        (stems if t.endswith("*") else words)[node] = i

    # a state is a set of (node, edits so far) and of (-1 - term, 0) for stems that were met
    def closed(states):
        """With letters of the term left out of the word, and with the stems that end here."""
        out = set(states)
        for node, e in states:
            if node >= 0 and e == 0:
                if deep[node]:
                    out |= {(child, 1) for child in children[node].values() if deep[child]}
                if stems[node] >= 0:
                    out.add((-1 - stems[node], 0))
        return frozenset(s for s in out if s[1] == 0 or (s[0], 0) not in out)

    def step(states, k):
        out = set()
        for node, e in states:
            if node < 0:
                out.add((node, 0))
                continue
            if k in children[node]:
                child = children[node][k]
                if e == 0 or deep[child]:
                    out.add((child, e))
            if e == 0 and deep[node]:
                out.add((node, 1))  # a letter too many
                out |= {(child, 1) for child in children[node].values() if deep[child]}  # a letter exchanged
        return closed(out)

    def accepted(states):
        """Term, edits and order: an exact word first, then the longest stem, then a misspelled word."""
        found = [(0 if e == 0 else LAST, words[node], e) for node, e in states if node >= 0 and words[node] >= 0 and (e == 0 or edit_from <= len(terms[words[node]]) <= EDIT_TO)]
        found += [(LAST - len(terms[-1 - node]), -1 - node, 0) for node, _ in states if node < 0]
        return (*min(found)[1:], min(found)[0]) if found else (-1, 0, NONE)

    start = closed({(0, 0)})
    number, queue, table, accept = {frozenset(): 0, start: 1}, [start], [[0] * (len(letters) + 1)], [(-1, 0, NONE)]
    for states in queue:
        row = []
        for k in range(len(letters) + 1):
            new = step(states, k)
            if new not in number:
                number[new] = len(number)
                queue.append(new)
            row.append(number[new])
        table.append(row)
        accept.append(accepted(states))
    return {"longest": max((len(t) for t in terms), default=0) + 2, "class_of": class_of, "table": np.array(table, dtype=np.int32), "term": np.array([a[0] for a in accept], dtype=np.int32), "edits": np.array([a[1] for a in accept], dtype=np.int8), "order": np.array([a[2] for a in accept], dtype=np.int32)}


class Matcher:
    """Matches of automata in blocks of texts: text, term, edits and context of each."""

    def __init__(self, *automata: dict):
        self.automata = [(a, self.classes(a["class_of"])) for a in automata]
        cue = lambda words: np.array(sorted(self.hashes(words)), dtype=X.U)
        self.reporting, self.address = cue(REPORTING), cue(ADDRESS)
        self.quote_bytes = [q.encode() for q in QUOTES]

    @staticmethod
    def classes(class_of: dict[str, int]) -> np.ndarray:
        """Class by code point, up to the last letter; the entry after it is the class of all others."""
        out = np.zeros(max(map(ord, class_of), default=0) + 2, dtype=np.uint16)
        for c, k in class_of.items():
            out[ord(c)] = k
        return out

    @staticmethod
    def hashes(words: list[str]) -> set[int]:
        return {int(h) for h in X.Words(pa.array(words, pa.string())).hash}

    def run(self, texts: pa.Array):
        """(text index, term, edits, context 0 plain / 1 aimed / 2 quoted) arrays for the matches of ``texts``.

        A match across marks is placed at the first of its words.
        """
        texts = strip_quotes_as_separators(texts)
        w = X.Words(texts)
        raw = w.raw
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        lead = np.cumsum((raw & 0xC0) != 0x80)  # number of code points up to and with each byte
        first = lead[w.starts] - 1 if len(w.starts) else w.starts
        size = lead[w.ends - 1] - first if len(w.starts) else w.starts
        if len(self.automata) > 1:  # step each distinct word once
            _, one, same = np.unique(w.hash, return_index=True, return_inverse=True)
            term, edits = (x[same] for x in self.accepted(points, first[one], size[one]))
        else:
            term, edits = self.accepted(points, first, size)
        a, b = across_marks(w)
        if len(a):
            found = np.concatenate([[0], np.cumsum(term >= 0)])
            a, b = (x[found[b + 1] == found[a]] for x in (a, b))
            term[a], edits[a] = self.accepted(points, first[a], first[b] + size[b] - first[a])
        hit = np.flatnonzero(term >= 0)
        return w.owner[hit], term[hit], edits[hit], self.context(w, hit)

    def accepted(self, points: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term or -1, edits) of the words that begin at ``first`` in ``points``: the best acceptance of all automata."""
        term, edits = np.full(len(first), -1, dtype=np.int32), np.zeros(len(first), dtype=np.int8)
        order = np.full(len(first), NONE, dtype=np.int32)
        for a, classes in self.automata:
            final = self.final(a, classes, points, first, size)
            better = np.flatnonzero(a["order"][final] < order)
            to = final[better]
            term[better], edits[better], order[better] = a["term"][to] + a.get("base", 0), a["edits"][to], a["order"][to]
        return term, edits

    @staticmethod
    def final(automaton: dict, classes: np.ndarray, points: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """State of ``automaton`` after each word; 0 for words that left it."""
        table, beyond = automaton["table"], len(classes) - 1
        state = np.ones(len(first), dtype=np.int32)
        live = np.arange(len(first))
        final = np.zeros(len(first), dtype=np.int32)
        last = np.minimum(size, automaton["longest"])  # a longer word can hold no more than a stem, met by then
        at = 0
        while len(live):
            done = last[live] == at
            final[live[done]] = state[live[done]]
            live = live[~done]
            state[live] = table[state[live], classes[np.minimum(points[first[live] + at], beyond)]]
            live = live[state[live] > 0]
            at += 1
        return final

    def context(self, w: X.Words, hit: np.ndarray) -> np.ndarray:
        """Inside a pair of quotation marks of its line or near reporting: 2; near an address: 1."""
        kind = np.zeros(len(hit), dtype=np.int8)
        lo, hi = w.first[w.owner[hit]] if len(hit) else hit, None
        text = w.raw.tobytes()
        for i, word in enumerate(hit):
            own = w.owner[word]
            a = max(word - WINDOW, w.first[own])
            b = min(word + WINDOW + 1, w.first[own] + w.counts[own])
            near = w.hash[a:b]
            before, after = text[w.starts[a] : w.starts[word]], text[w.ends[word] : w.ends[b - 1] + 2]
            before = before.rsplit(b"\n", 1)[-1]
            after = after.split(b"\n", 1)[0]
            opens = sum(before.count(q) for q in self.quote_bytes) % 2 == 1 or w.starts[word] > 0 and text[w.starts[word] - 1 : w.starts[word]] == b'"'
            closes = any(q in after for q in self.quote_bytes)
            if opens and closes or np.isin(near, self.reporting).any() and (opens or closes):
                kind[i] = 2
            elif np.isin(near, self.address).any():
                kind[i] = 1
        return kind


def across_marks(w: X.Words) -> tuple[np.ndarray, np.ndarray]:
    """(first, last word) of the longest runs of two or more words of a text with one of ``MARKS`` between each two."""
    mark = np.zeros(256, dtype=bool)
    mark[[ord(c) for c in MARKS]] = True
    close = (w.starts[1:] - w.ends[:-1] == 1) & (w.owner[1:] == w.owner[:-1])
    close[close] = mark[w.raw[w.ends[:-1][close]]]
    linked = np.concatenate([[False], close, [False]])  # each word, and the end, with the word before
    if len(linked) > len(w.starts) + 1:  # no word at all
        return w.starts, w.starts
    return np.flatnonzero(~linked[:-1] & linked[1:]), np.flatnonzero(linked[:-1] & ~linked[1:])


def strip_quotes_as_separators(texts: pa.Array) -> pa.Array:
    """Typographic quotation marks set off by spaces, so that they are no part of a word."""
    return pc.replace_substring_regex(texts, f"([{QUOTES[1:]}’‘])", " \\1 ")


def counted(matcher: Matcher, texts: pa.Array):
    """For each part of ``texts``: (text index, term, edits, context) rows without repeats, and how often each is met."""
    for base, part in X.chunks(pc.fill_null(texts, "")):
        key, n = np.unique(np.stack(matcher.run(part), axis=1).astype(np.int64), axis=0, return_counts=True)
        key[:, 0] += base
        yield key, n


def matches(rows: DataFrame, automata) -> DataFrame:
    """toxic and hits (array of distinct term, edits) of every row of ``rows`` (text, toxic)."""
    kind = pa.list_(pa.struct([("term", pa.int32()), ("edits", pa.int32())]))

    def run(batches):
        matcher = Matcher(*automata.value)
        for batch in batches:
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for key, _ in counted(matcher, batch.column(1)):
                for own, term, edits in np.unique(key[:, :3], axis=0).tolist():
                    out[own].append({"term": term, "edits": edits})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["toxic", "hits"])

    return rows.select("toxic", "text").mapInArrow(run, "toxic boolean, hits array<struct<term: int, edits: int>>")


def weights(train: DataFrame, automata, terms: dict[str, float]) -> dict[tuple[int, int], float]:
    """(term, edits) -> weight, from all training documents; two values a term."""
    m = checkpointed(matches(train, automata))
    base = m.agg(F.avg(F.col("toxic").cast("double"))).collect()[0][0] or 0.0
    rows = m.select("toxic", F.explode("hits").alias("h"))
    n = rows.groupBy("h.term", "h.edits").agg(F.sum(F.col("toxic").cast("long")).alias("bad"), F.count(F.lit(1)).alias("all")).collect()
    share = {(r["term"], r["edits"]): (r["bad"] + base) / (r["all"] + 1) for r in n}
    # a misspelling that was never seen in training counts half its term; shares at the base rate weigh 0
    for t in range(len(terms)):
        share.setdefault((t, 0), 0.5)
        share.setdefault((t, 1), share[t, 0] / 2)
    trust = list(terms.values())
    return {(t, e): STRENGTH * trust[t] * max(0.0, (p - max(base, 0.3)) / (1 - max(base, 0.3))) for (t, e), p in share.items()}


def scored(docs: DataFrame, labels: DataFrame, fold: Column | None, keep: list[str], below: float | None = None) -> DataFrame:
    """``keep`` columns, renamed k0, k1, ..., and ``score`` of every row of ``docs``, or of those that score below ``below``.

    Texts pass through one worker a task, once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    train = training(docs, labels, fold)
    terms = lexicon(train)
    automata = spark.sparkContext.broadcast(automata_of(list(terms)))
    w = weights(train, automata, terms) if terms else {}
    factor = np.array([CONTEXT["plain"], CONTEXT["aimed"], CONTEXT["quoted"]])
    weight = np.array([w[t, e] for t in range(len(terms)) for e in (0, 1)]).reshape(-1, 2, 1)
    # what a match leaves of 1, by term, edits and context; which terms are firm
    value = spark.sparkContext.broadcast((1 - weight * factor, np.array([trust >= 0.5 for trust in terms.values()], dtype=bool)))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *([] if "text" in keep else [F.col("text").alias("body")]))
    at = keep.index("text") if "text" in keep else len(keep)
    schema = rows.drop("body").schema.add("score", "double")

    def run(batches):
        matcher, (left, firm) = Matcher(*automata.value), value.value
        for batch in batches:
            strong, weak = np.ones(batch.num_rows), np.ones(batch.num_rows)
            for key, n in counted(matcher, batch.column(at)):
                own, term, edits, context = key.T
                rest, sure = left[term, edits, context] ** n, firm[term]
                np.multiply.at(strong, own[sure], rest[sure])
                np.multiply.at(weak, own[~sure], rest[~sure])
            score = 1 - strong * np.maximum(weak, 1 - WEAK)
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score, pa.float64())], names=schema.names)
            yield out if below is None else out.filter(pa.array(score < below))

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, fold: Column | None = None) -> DataFrame:
    """doc_id, score of every row of ``docs``; ``fold``: condition on the labels to learn from."""
    return scored(docs, labels, fold, ["doc_id"]).withColumnRenamed("k0", "doc_id")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; learns from all labels."""
    found = scored(docs, labels, None, docs.columns, below=threshold)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
