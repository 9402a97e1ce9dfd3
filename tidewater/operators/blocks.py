"""Text scores of every (user, catalog item) pair, in blocks of users by blocks of items.

Users with their term profiles and items with their term vectors are written once to the shared folder, as Parquet
with a folder a tile; both are dealt by a hash. A task takes one tile of users and one of items: what is shuffled for it are the
records of its pairs and a row with its number, so neither profiles nor vectors are copied however many tiles
there are. It reads the items file by file and goes through a file in blocks of ``USER_ROWS`` by ``COLUMNS``: it adds up a block's scores by
matrix products over terms that many pairs share, term by term for the others, and keeps a few rows a user (its k
best, or its range), so no row a pair is ever made, shuffled or kept. Users are cut at ``TILE_USERS``, and both sides further only
where there would be too few tasks for the cores or a pair would hold too many records. One path for every catalog size; nothing passes through
the driver but the row counts that set the number of tiles. Tasks open the folder by themselves: one that all workers mount, or a
store that PyArrow opens by its URI.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

USER_ROWS, ITEM_ROWS = 1024, 8192  # that no tile is cut below
TILE_USERS, TILE_ITEMS = 16 * USER_ROWS, 8 * ITEM_ROWS  # of a tile of users, of a file of items: tens of MB of terms
TILE_RECORDS = 4_000_000  # of a pair of tiles on average, some 40 bytes each
TASKS_A_CORE = 2
PAIR_USERS, PAIR_ITEMS = 512, 4096  # of a tile whose pairs are all returned: some 50 MB of rows
MOST_TASKS, SPREAD = 20_000, 8  # partitions a pair of tiles: few hold two pairs, and empty ones cost next to nothing
COLUMNS = 2048  # items scored at once: blocks of 16 MB, which caches hold better
FIRST = 1024  # items of a first block in which the k best are searched by sorting; then by comparison
PLACES = 9  # hybrid scores are ranked at so many decimal places
LEAST = np.iinfo(np.int64).min // 4
DENSE, TERMS_AT_ONCE = 1 / 64, 256  # share of a block's pairs from which a term goes into matrix products; terms of one product


def tiles(users: int, items: int, records: int, cores: int) -> tuple[int, int]:
    """(tiles of users, tiles of items): the fewest at which a pair holds ``TILE_RECORDS`` on average and
    there are about ``TASKS_A_CORE`` pairs a core; no tile is cut below a block."""
    parts = lambda n, rows: max(1, -(-n // rows))
    nu, ni = parts(users, TILE_USERS), parts(items, TILE_ITEMS)
    most_u, most_i = parts(users, USER_ROWS), parts(items, ITEM_ROWS)
    while nu * ni < max(TASKS_A_CORE * cores, records / TILE_RECORDS) and (nu < most_u or ni < most_i):
        if ni >= most_i or nu < most_u and most_u / nu >= most_i / ni:  # the side whose tiles are more blocks long
            nu = min(2 * nu, most_u)
        else:
            ni = min(2 * ni, most_i)
    return nu, ni


def text_blocks(profiles: DataFrame, x: DataFrame, items: DataFrame, users: DataFrame, records: DataFrame, kernel, schema: str, every_pair: bool = False,
                kept: dict | None = None) -> DataFrame:
    """Run ``kernel(users, items, scores, records)`` on every block of every pair of tiles.

    ``profiles`` (user_id, term, p); ``x`` (doc_id, term, weight); ``items`` (item_id); ``users``
    (user_id and columns of its own); ``records`` (user_id, item_id and values of its own, cast to
    double; counted, so best checkpointed) of pairs that the kernel treats apart. The kernel gets the users' frame, the sorted item
    ids, the matrix of sums over shared terms of p * weight and the records with positions u, i; it
    returns a frame of ``schema``. What a kernel ``wants`` it gets by name: ``top``, a dict that it keeps
    from one block of items of the same users to the next (ids rise), or ``reach``, which pairs share
    a term (and one whose p is known: a p of NaN adds nothing). A kernel with ``folds`` returns a row a user, and its
    columns are folded by them over the blocks of a task. With ``every_pair`` a tile is one small block,
    as such a kernel returns up to a row a pair and a task holds the rows of one tile at a time.
    ``kept``: a dict that keeps the stored items for further calls with the same ``x`` and ``items``.
    """
    from tidewater.session import looked_up  # not of the module, which executors get by value
    spark, n_items = users.sparkSession, items.count()
    if every_pair:
        nu, ni = max(1, -(-users.count() // PAIR_USERS)), max(1, -(-n_items // PAIR_ITEMS))
    else:
        n_records, cores = records.count(), spark.sparkContext.defaultParallelism
        nu, ni = tiles(users.count(), n_items, n_records, cores)
        # a task takes as many files of items as it may: each file but the first adds few rows to its result
        ni = min(ni, max(1, math.ceil(max(TASKS_A_CORE * cores, n_records / TILE_RECORDS) / nu)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    own = [c for c in users.columns if c != "user_id"]
    values = [c for c in records.columns if c not in ("user_id", "item_id")]
    wants, folds = getattr(kernel, "wants", ""), getattr(kernel, "folds", None)
    items = looked_up(items, n_items)
    per = profiles.groupBy("user_id").agg(F.collect_list("term").alias("terms"), F.collect_list("p").alias("v"))
    user_path = stored(users.join(per, "user_id", "left").withColumn("tile", block("user_id", nu)), "user_id", nu)
    kept = {} if kept is None else kept
    if ni not in kept:
        vec = x.groupBy(F.col("doc_id").alias("item_id")).agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("v"))
        kept[ni] = stored(items.join(vec, "item_id", "left").withColumn("tile", block("item_id", ni)), "item_id", max(ni, -(-n_items // TILE_ITEMS)))
    item_path = kept[ni]
    number = (F.col("ub").cast("long") * ni + F.col("ib")).alias("pair")
    rec = records.where(F.col("user_id").isNotNull()).join(items, "item_id", "left_semi").withColumn("ub", block("user_id", nu)).withColumn("ib", block("item_id", ni))
    rec = rec.select(number, "user_id", "item_id", *[F.col(c).cast("double").alias(c) for c in values])
    pairs = spark.range(nu * ni).select(F.col("id").alias("pair"))

    def run(rec_pdf: pd.DataFrame, pair: pd.DataFrame) -> pd.DataFrame:
        at = int(pair["pair"].iloc[0])
        users_t = next(read(user_path, at // ni, ["user_id", *own]), None)
        blocks, some, tops, out, step = 0, {}, {}, [], min(ITEM_ROWS, COLUMNS)
        for items_t in read(item_path, at % ni, ["item_id"]) if users_t else ():
            ids = items_t["frame"]["item_id"].to_numpy(np.int64)
            rec, names = records_of(rec_pdf, users_t["frame"]["user_id"].to_numpy(np.int64), ids, values), items_t["names"]
            vectors = [entries(items_t["code"], items_t["row"], items_t["value"], i, step, len(ids)) for i in range(0, len(ids), step)]
            code = (names.get_indexer(users_t["names"]) if len(names) else np.full(len(users_t["names"]), -1))[users_t["code"]]
            for u in range(0, len(users_t["frame"]), USER_ROWS):
                if u not in some:
                    some[u] = users_t["frame"].iloc[u : u + USER_ROWS]
                mine = entries(code, users_t["row"], users_t["value"], u, USER_ROWS, len(users_t["frame"]))
                given = {"top": tops.setdefault(u, {})} if wants == "top" else {}
                a, b = np.searchsorted(rec["u"], [u, u + USER_ROWS])
                for n, i in enumerate(range(0, len(ids), step)):
                    here = a + np.flatnonzero((rec["i"][a:b] >= i) & (rec["i"][a:b] < i + step))
                    part = {c: v[here] for c, v in rec.items()}
                    part["u"], part["i"] = part["u"] - u, part["i"] - i
                    if wants == "reach":
                        given = {"reach": reached(mine, vectors[n], len(names))}
                    got = kernel(some[u], ids[i : i + step], products(mine, vectors[n], len(names)), part, **given)
                    if folds is None:
                        out.append(got)
                    else:
                        tops[u] = got if u not in tops else tops[u].assign(**{c: f(tops[u][c].to_numpy(), got[c].to_numpy()) for c, f in folds.items()})
                    blocks += 1
        if not blocks:
            none = {"reach": (np.zeros((0, 0), bool),) * 2} if wants == "reach" else {}
            few = users_t["frame"].iloc[:0] if users_t else pd.DataFrame({c: np.zeros(0) for c in ("user_id", *own)})
            return kernel(few, np.zeros(0, np.int64), np.zeros((0, 0)), {c: np.zeros(0, np.int64 if c in ("u", "i") else float) for c in ("u", "i", *values)}, **none)
        return pd.concat(out if folds is None else list(tops.values()), ignore_index=True)

    # rows of input say nothing of the work: pairs are dealt by number, not merged by bytes
    rec, pairs = (side.repartition(min(SPREAD * nu * ni, MOST_TASKS), "pair") for side in (rec, pairs))
    return rec.groupBy("pair").cogroup(pairs.groupBy("pair")).applyInPandas(run, schema)


def stored(rows: DataFrame, key: str, files: int) -> str:
    """URI (or path, if tasks mount it) of ``rows`` (with tile, terms and v) as Parquet, a folder a tile, in the order of ``key`` over its files and in each."""
    from tidewater.sources.files import shared_scratch
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_scratch(spark, "tiles"))
    rows = rows.repartitionByRange(files, "tile", key).sortWithinPartitions("tile", key)
    rows.write.option("maxRecordsPerFile", TILE_ITEMS if key == "item_id" else 0).partitionBy("tile").parquet(path.toString())
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else uri.toString()


def read(path: str, tile: int, columns: list[str]):
    """The files of a tile that ``stored`` wrote, in order: ``frame`` of the columns, and the code, row and value of all its terms, whose ``names`` are sorted.

    Users (``user_id``) come as one."""
    fs, root = pfs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (pfs.LocalFileSystem(), path)
    found = fs.get_file_info(pfs.FileSelector(f"{root}/tile={tile}", allow_not_found=True))
    files = sorted(f.path for f in found if f.base_name.startswith("part-"))
    tables = (pq.ParquetFile(fs.open_input_file(f)).read([*columns, "terms", "v"]) for f in files)
    if "user_id" in columns:
        tables = iter([pa.concat_tables(tables)] if files else [])
    for table in tables:
        if not len(table):
            continue
        frame = table.select(columns).to_pandas()
        if frame[columns[0]].isna().any() and columns[0] == "item_id":  # an item without an id comes last, as in a sorted frame
            order = np.argsort(frame["item_id"].to_numpy(), kind="stable")
            table, frame = table.take(order), frame.iloc[order].reset_index(drop=True)
        lists = table["terms"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        terms = lists.flatten().dictionary_encode()
        names = pd.Index(terms.dictionary.to_pandas())
        order = np.argsort(names.to_numpy(), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        value = pc.list_flatten(table["v"]).to_numpy()
        yield {"frame": frame, "code": rank[terms.indices.to_numpy(zero_copy_only=False)], "row": np.repeat(np.arange(len(size)), size),
               "value": np.asarray(value, float), "names": names[order]}


def flat(lists, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists and the row of each; null lists are empty."""
    size = np.array([0 if v is None else len(v) for v in lists], dtype=np.int64)
    full = [np.asarray(v) for v in lists if v is not None and len(v)]
    return (np.concatenate(full).astype(dtype) if full else np.zeros(0, dtype)), np.repeat(np.arange(len(size)), size)


def entries(code: np.ndarray, row: np.ndarray, value: np.ndarray, start: int, size: int, rows: int) -> tuple:
    """(codes, rows, values, number of rows) of the block of ``size`` rows from ``start``, by code; rows are in order."""
    a, b = np.searchsorted(row, [start, start + size])
    known = np.flatnonzero(code[a:b] >= 0)
    order = known[np.argsort(code[a:b][known], kind="stable")]
    return code[a:b][order], row[a:b][order] - start, value[a:b][order], min(size, rows - start)


def split_terms(uc: np.ndarray, ic: np.ndarray, users: int, items: int, terms: int):
    """Shared terms that a good part of the block's pairs share, and the others with their cuts."""
    ucut, icut = np.searchsorted(uc, np.arange(terms + 1)), np.searchsorted(ic, np.arange(terms + 1))
    pairs = np.diff(ucut).astype(float) * np.diff(icut)
    dense = np.flatnonzero(pairs > users * items * DENSE)
    return dense, np.flatnonzero((pairs > 0) & (pairs <= users * items * DENSE)), ucut, icut


def products(mine: tuple, vectors: tuple, terms: int) -> np.ndarray:
    """(users x items) sums over shared terms of p * weight: terms of many pairs by matrix products, others one by one."""
    uc, urow, p, users = mine
    ic, irow, w, items = vectors
    if np.isnan(p).any():
        known = ~np.isnan(p)
        uc, urow, p = uc[known], urow[known], p[known]
    dense, sparse, ucut, icut = split_terms(uc, ic, users, items, terms)
    out = np.zeros((users, items)) if not len(dense) else None
    for n in range(0, len(dense), TERMS_AT_ONCE):
        a, b = matrix(uc, urow, p, users, dense[n : n + TERMS_AT_ONCE]), matrix(ic, irow, w, items, dense[n : n + TERMS_AT_ONCE])
        if out is None:
            out = a @ b.T
        else:
            out += a @ b.T
    for n in sparse:
        a, b = slice(ucut[n], ucut[n + 1]), slice(icut[n], icut[n + 1])
        out[np.ix_(urow[a], irow[b])] += np.outer(p[a], w[b])
    return out


def scores_of(users: pd.DataFrame, items: pd.DataFrame) -> np.ndarray:
    """``products`` of frames with lists of terms and p, and of terms and w."""
    terms, row = flat(items["terms"], object)
    code, names = pd.factorize(terms, sort=True)
    vectors = entries(code, row, flat(items["w"], float)[0], 0, len(items), len(items))
    terms, row = flat(users["terms"], object)
    code = pd.Index(names).get_indexer(terms) if len(names) else np.full(len(terms), -1)
    return products(entries(code, row, flat(users["p"], float)[0], 0, len(users), len(users)), vectors, len(names))


def matrix(code: np.ndarray, row: np.ndarray, value: np.ndarray, rows: int, terms: np.ndarray, dtype=float) -> np.ndarray:
    """(rows x terms) of the entries of some terms (ascending)."""
    out = np.zeros((rows, len(terms)), dtype)
    at = np.searchsorted(terms, code)
    here = at < len(terms)
    here[here] = terms[at[here]] == code[here]
    out[row[here], at[here]] = value[here]
    return out


def reached(mine: tuple, vectors: tuple, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that share a term, and those that share one whose p is known."""
    uc, urow, p, users = mine
    ic, irow, w, items = vectors

    def shared(uc, urow):
        out = np.zeros((users, items), dtype=bool)
        dense, sparse, ucut, icut = split_terms(uc, ic, users, items, terms)
        if ((np.diff(ucut) == users) & (np.diff(icut) == items)).any():
            return ~out
        for n in range(0, len(dense), TERMS_AT_ONCE):
            some = dense[n : n + TERMS_AT_ONCE]
            ones = lambda v: np.ones(len(v), np.float32)
            out |= matrix(uc, urow, ones(uc), users, some, np.float32) @ matrix(ic, irow, ones(ic), items, some, np.float32).T > 0.5
        for n in sparse:
            out[np.ix_(urow[ucut[n] : ucut[n + 1]], irow[icut[n] : icut[n + 1]])] = True
        return out

    known = ~np.isnan(p)
    first = shared(uc, urow)
    return first, first if known.all() else shared(uc[known], urow[known])


def records_of(records: pd.DataFrame, users: np.ndarray, ids: np.ndarray, values: list[str]) -> dict[str, np.ndarray]:
    """The ``records`` of some users and items (both sorted): positions u (rising) and i, and their values."""
    item = records["item_id"].to_numpy(np.int64)
    at = np.searchsorted(ids, item)
    here = at < len(ids)
    here[here] = ids[at[here]] == item[here]
    here, user = np.flatnonzero(here), records["user_id"].to_numpy(np.int64)
    low, high = (np.searchsorted(users, user[here], side) for side in ("left", "right"))
    here, low = here[high > low], low[high > low]  # a user comes once
    order = np.argsort(low, kind="stable")
    here, low = here[order], low[order]
    return {"u": low, "i": at[here]} | {c: records[c].to_numpy(float)[here] for c in values}


def keys_of(score: np.ndarray, places: int) -> np.ndarray:
    """Scores in units of the last place, rounded half up."""
    return np.floor(score * 10**places + 0.5 + 1e-7).astype(np.int64)


def least_of(rows: int, top: dict | None) -> np.ndarray:
    """The least of the k best keys of each row so far."""
    return np.full(rows, LEAST) if top is None or "keys" not in top else top["keys"][:, 0]


def first_k(r: np.ndarray, c: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries (row, column, key) the k best of each row, in order: greatest key, then column."""
    order = np.lexsort((c, -key, r))
    r, c, key = r[order], c[order], key[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep], key[keep]


def added(r: np.ndarray, c: np.ndarray, key: np.ndarray, k: int, rows: int, top: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the k best of each row those above the least of its k best so far, which they join in ``top``."""
    if top is not None:
        held, keep = top.get("keys"), key > least_of(rows, top)[r]
        r, c, key = r[keep], c[keep], key[keep]
        new = np.full((rows, k), LEAST)
        new[r, np.arange(len(r)) - np.searchsorted(r, r)] = key
        top["keys"] = new if held is None else np.concatenate([held, new], axis=1)
        top["keys"] = np.sort(top["keys"], axis=1)[:, -k:]
    return r, c, key


def best(score: np.ndarray, k: int, places: int, top: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded score) of the k best columns of each row: score half up, then column.

    ``top`` holds the k best keys of each row so far; only what is above the least of them is returned
    (a tie stays with the earlier, lower id), and found by one comparison once they tell enough.
    """
    rows, columns = score.shape
    if not rows or not columns:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if top is not None and "keys" not in top and columns > FIRST:
        halves = [(at, best(part, k, places, top)) for at, part in ((0, score[:, :FIRST]), (FIRST, score[:, FIRST:]))]
        return tuple(np.concatenate([v[n] + at * (n == 1) for at, v in halves]) for n in range(3))
    least = least_of(rows, top)
    c = None
    if (least > LEAST).all():
        r, c = np.nonzero(score >= ((least + 0.499) / 10**places)[:, None])  # a little low, then exact
        if len(r) > 16 * k * rows:
            c = None
        else:
            r, c, key = first_k(r, c, keys_of(score[r, c], places), k)
    if c is None:
        key = keys_of(score, places)
        order = key * columns - np.arange(columns)  # columns are in the order of ids
        n = min(k, columns)
        some = np.argpartition(-order, n - 1, axis=1)[:, :n]
        r, c = np.repeat(np.arange(rows), n), some.ravel()
        r, c, key = first_k(r, c, key[r, c], k)
    r, c, key = added(r, c, key, k, rows, top)
    return r, c, key / 10**places


def unseen_kernel():
    """The score of every pair without a record."""

    def run(users, ids, sim, rec):
        open_ = np.ones(sim.shape, dtype=bool)
        open_[rec["u"], rec["i"]] = False
        r, c = np.nonzero(open_)
        return pd.DataFrame({"user_id": users["user_id"].to_numpy(np.int64)[r], "item_id": ids[c], "score": sim[r, c]})

    return run


def shared_kernel(divisor: str | None = None):
    """The score of every pair that shares a term and has no record; null where no such term's p is known."""

    def run(users, ids, sim, rec, reach):
        shared, known = reach
        if len(rec["u"]):
            shared = shared.copy()
            shared[rec["u"], rec["i"]] = False
        r, c = np.nonzero(shared)
        score = sim[r, c] if divisor is None else sim[r, c] / users[divisor].to_numpy(float)[r]
        return pd.DataFrame({"user_id": users["user_id"].to_numpy(np.int64)[r], "item_id": ids[c], "score": np.where(known[r, c], score, np.nan)})

    run.wants = "reach"
    return run


def best_unseen_kernel(k: int, positive: bool = False, places: int = 9):
    """k best items a user without a record, only those above 0 if ``positive``."""
    low = -1e4  # scores of pairs with a record; real ones are far above

    def run(users, ids, sim, rec, top=None):
        sim[rec["u"], rec["i"]] = low
        r, c, _ = best(sim, k, places, top)
        keep = sim[r, c] > (0 if positive else low / 2)
        return pd.DataFrame({"user_id": users["user_id"].to_numpy(np.int64)[r[keep]], "item_id": ids[c[keep]], "score": sim[r[keep], c[keep]]})

    run.wants = "top"
    return run


def material_kernel(k: int, weights: tuple[float, ...], carried: tuple[str, ...] = ()):
    """k best items a user by weights of volume, urgency, forecast and text similarity, each with the ``carried`` values of
    its record, null without one."""
    wv, wu, wf, ws = weights

    def run(users, ids, sim, rec, top=None):
        u, i = rec["u"], rec["i"]
        own = wv * rec["vol"] + wu * rec["urg"] + wf * rec["fs"] + ws * sim[u, i]
        sim *= ws
        sim[u, i] = own
        r, c, s = best(sim, k, 4, top)
        out = {"user_id": users["user_id"].to_numpy(np.int64)[r], "item_id": ids[c], "score": s}
        if carried:
            place, wanted = u * max(1, sim.shape[1]) + i, r * max(1, sim.shape[1]) + c
            order = np.argsort(place)
            at = np.searchsorted(place[order], wanted)
            has = at < len(place)
            has[has] = place[order[at[has]]] == wanted[has]
            for name in carried:
                out[name] = np.full(len(r), np.nan)
                out[name][has] = rec[name][order[at[has]]]
        return pd.DataFrame(out)

    run.wants = "top"
    return run


def copurchase_kernel(k: int):
    """k best items a user by score; of those with a record only the ones whose ``ind`` is above 0, which is their score."""
    low = -1e4  # real scores are far above

    def run(users, ids, sim, rec, top=None):
        u, i = rec["u"], rec["i"]
        sim[u, i] = np.where(rec["ind"] > 0, rec["ind"], low)
        r, c, s = best(sim, k, PLACES, top)
        keep = s > low / 2
        r, c, s = r[keep], c[keep], s[keep]
        bought = np.isin(r * len(ids) + c, u * len(ids) + i)
        return pd.DataFrame({"user_id": users["user_id"].to_numpy(np.int64)[r], "item_id": ids[c], "score": s, "bought": bought})

    run.wants = "top"
    return run


ENDS = {"cmn": np.minimum, "cmx": np.maximum, "bmn": np.minimum, "bmx": np.maximum}


def range_kernel():
    """Least and greatest text and collaborative score of each user in the block (absent: 0)."""

    def run(users, ids, cb, rec):
        cf = np.nan_to_num(rec["cf"])
        some = np.bincount(rec["u"], minlength=len(users)) < cb.shape[1]  # pairs without a record
        cmn, cmx = np.where(some, 0.0, np.inf), np.where(some, 0.0, -np.inf)
        np.minimum.at(cmn, rec["u"], cf)
        np.maximum.at(cmx, rec["u"], cf)
        few = not cb.size
        ends = lambda m, f: np.zeros(len(users)) if few else f(m, axis=1)
        return pd.DataFrame({"user_id": users["user_id"].to_numpy(np.int64), "cmn": cmn, "cmx": cmx, "bmn": ends(cb, np.min), "bmx": ends(cb, np.max)})

    run.folds = ENDS
    return run


def scaled(m: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.where(high > low, (m - low) / np.where(high > low, high - low, 1.0), m)


def hybrid_kernel(k: int, *alphas: float):
    """k best unseen items a user by the blend of both scores, each scaled to the user's range, for each of ``alphas``.

    A user's blend of the items without a record rises with their text score alone, so once k items are held, what may
    still be among the best is found in the block as it stands, by one comparison; only that is scaled and blended.
    """

    def run(users, ids, cb, rec, top=None):
        if top == {} and len(ids) > FIRST:
            part = lambda a, b: {c: v[(rec["i"] >= a) & (rec["i"] < b)] - a * (c == "i") for c, v in rec.items()}
            return pd.concat([run(users, ids[a:b], cb[:, a:b], part(a, b), top) for a, b in ((0, FIRST), (FIRST, len(ids)))], ignore_index=True)
        cmn, cmx, bmn, bmx = (users[c].to_numpy(float) for c in ("cmn", "cmx", "bmn", "bmx"))
        u, i = rec["u"], rec["i"]
        cf_n, cb_n = scaled(np.nan_to_num(rec["cf"]), cmn[u], cmx[u]), scaled(cb[u, i], bmn[u], bmx[u])
        absent, open_ = scaled(np.zeros(len(users)), cmn, cmx), rec["seen"] <= 0
        cb[u, i] = -np.inf
        width = np.where(bmx > bmn, bmx - bmn, 1.0)
        low = np.where(bmx > bmn, bmn, 0.0)
        out = []
        for alpha in alphas:
            own = (1.0 - alpha) * cf_n + alpha * cb_n
            base, held = (1.0 - alpha) * absent, top.setdefault(alpha, {}) if top is not None else None
            least, r = least_of(len(users), held), None
            if alpha > 0 and cb.size and (least > LEAST).all():
                floor = ((least + 0.49) / 10**PLACES - base) * width / alpha + low  # a little low, then exact
                r, c = np.nonzero(cb >= (floor - 1e-12 * np.abs(floor))[:, None])
                if len(r) > 16 * k * len(users):
                    r = None
                else:
                    key = keys_of((cb[r, c] - low[r]) / width[r] * alpha + base[r], PLACES)
                    r, c, key = (np.concatenate(v) for v in ((r, u[open_]), (c, i[open_]), (key, keys_of(own[open_], PLACES))))
                    r, c, key = added(*first_k(r, c, key, k), k, len(users), held)
                    s = key / 10**PLACES
            if r is None:
                full = (cb - low[:, None]) / width[:, None] * alpha + base[:, None] if alpha > 0 else np.repeat(base[:, None], cb.shape[1], axis=1)
                full[u, i] = np.where(open_, own, -1.0)
                r, c, s = best(full, k, PLACES, held)
            keep = s > 0
            out.append(pd.DataFrame({"user_id": users["user_id"].to_numpy(np.int64)[r[keep]], "item_id": ids[c[keep]], "hybrid": s[keep], "alpha": alpha}))
        return pd.concat(out, ignore_index=True) if len(out) > 1 else out[0]

    run.wants = "top"
    return run


def reach_range_kernel():
    """``range_kernel`` over the pairs that a record with ``has`` or a shared term reaches, and their number."""

    def run(users, ids, cb, rec, reach):
        cf, cb, on = both(cb, rec, reach)
        ends = lambda m, f, no: np.full(len(users), no) if not m.size else f(np.where(on, m, no), axis=1)
        out = {"cmn": ends(cf, np.min, np.inf), "cmx": ends(cf, np.max, -np.inf), "bmn": ends(cb, np.min, np.inf), "bmx": ends(cb, np.max, -np.inf)}
        return pd.DataFrame({"user_id": users["user_id"].to_numpy(np.int64), "n": on.sum(axis=1, dtype=np.int64)} | out)

    run.wants, run.folds = "reach", {"n": np.add} | ENDS
    return run


def both(cb, rec, reach) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both scores of a block (absent or null: 0) and the pairs that one of them reaches."""
    shared, known = reach
    cf = np.zeros_like(cb)
    cf[rec["u"], rec["i"]] = np.nan_to_num(rec["cf"])
    on = shared.copy()
    has = rec["has"] > 0
    on[rec["u"][has], rec["i"][has]] = True
    return cf, np.where(known, cb, 0.0), on


def hybrid_pairs_kernel(alpha: float):
    """Every reached pair: both scores, their blend and whether it was seen."""

    def run(users, ids, cb, rec, reach):
        cf, cb, on = both(cb, rec, reach)
        seen = np.zeros(cb.shape, dtype=bool)
        seen[rec["u"], rec["i"]] = rec["seen"] > 0
        r, c = np.nonzero(on)
        cmn, cmx, bmn, bmx = (users[n].to_numpy(float)[r] for n in ("cmn", "cmx", "bmn", "bmx"))
        cf, cb = cf[r, c], cb[r, c]
        h = (1.0 - alpha) * scaled(cf, cmn, cmx) + alpha * scaled(cb, bmn, bmx)
        return pd.DataFrame({"user_id": users["user_id"].to_numpy(np.int64)[r], "item_id": ids[c], "cf": cf, "cb": cb, "hybrid": h, "seen": seen[r, c]})

    run.wants = "reach"
    return run


def reached_unseen_kernel():
    """Every reached pair that was not seen."""

    def run(users, ids, cb, rec, reach):
        on = both(cb, rec, reach)[2]
        seen = rec["seen"] > 0
        on[rec["u"][seen], rec["i"][seen]] = False
        r, c = np.nonzero(on)
        return pd.DataFrame({"user_id": users["user_id"].to_numpy(np.int64)[r], "item_id": ids[c]})

    run.wants = "reach"
    return run
