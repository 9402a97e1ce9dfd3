"""Rankers: hybrid product ranker, material rankers, KNN / co-purchase rankers.

Every ranker scores *all* requested users in one job. Item-item matrices are
never materialised densely: content scores use the profile identity
``sum_j r_uj C_ij = x_i . (sum_j r_uj x_j)`` (user term profile joined to the
item-term table), collaborative scores join the user rows with the sparse
similarity table. What scores a whole catalog by its text does so in
blocks (``blocks``). Top-k uses ``row_number <= k`` (WindowGroupLimit). There
is one path for every catalog size; joins are left to the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import (
    COLD_START_SCORE, DEFAULT_TOP_K, HYBRID_ALPHA, POPULAR_PRODUCTS_N, r4,
)
from tidewater.operators import blocks
from tidewater.operators import similarity as sim
from tidewater.operators import text
from tidewater.session import BROADCAST_ROWS, cut_lineage, dealt, looked_up, sent


def rank_key(score: Column) -> Column:
    """Ranking key: scores rounded to 9 places so last-bit float noise cannot reorder ties."""
    return F.round(score, 9)


# ---------------------------------------------------------------- customers

def catalog_scores(user_scores: DataFrame, products: DataFrame) -> DataFrame:
    """(user_id, item_id, score) restricted to catalog items, one row per pair."""
    ids = products.select(F.col("product_id").alias("item_id"))
    return (user_scores.join(looked_up(ids), "item_id", "left_semi")
            .groupBy("user_id", "item_id").agg(F.sum("score").alias("score")))


def product_tfidf(products: DataFrame) -> DataFrame:
    docs = products.select("product_id", F.concat(F.col("category"), F.lit(" "), F.col("description")).alias("txt"))
    return text.tfidf(docs, "product_id", "txt")


def cf_scores(r: DataFrame, sums: int | None = None) -> DataFrame:
    """(user_id, item_id, cf) = (sum_j r_uj S_ij) / (sum_j |S_ij|), S = column cosine; ``sums``: about their number, where known."""
    s = sim.column_cosine(r, "user_id", "item_id", "score")
    den = s.groupBy("item_i").agg(F.sum(F.abs("sim")).alias("den")).select(
        "item_i", F.when(F.col("den") == 0, F.lit(1.0)).otherwise(F.col("den")).alias("den"))
    s = cut_lineage(s.join(den, "item_i"))
    num = per_user(r, s, F.col("item_id") == F.col("item_j"), to="item_i", sums=sums).groupBy("user_id", "item_i").agg(
        F.sum(F.col("score") * F.col("sim")).alias("num"), F.max("den").alias("den"))
    return num.select("user_id", F.col("item_i").alias("item_id"), (F.col("num") / F.col("den")).alias("cf"))


def text_profile(r: DataFrame, x: DataFrame) -> DataFrame:
    """(user_id, term, p) = sum_j r_uj x_j."""
    xb = x.select("doc_id", "term", "weight")
    return r.join(xb, r.item_id == xb.doc_id).groupBy("user_id", "term").agg(F.sum(F.col("score") * F.col("weight")).alias("p"))


def _content_join(prof: DataFrame, xb: DataFrame) -> DataFrame:
    cb = prof.join(xb, "term").groupBy("user_id", "doc_id").agg(F.sum(F.col("p") * F.col("weight")).alias("cb"))
    return cb.select("user_id", F.col("doc_id").alias("item_id"), "cb")


def known_profile(prof: DataFrame) -> DataFrame:
    """A profile as ``blocks`` takes it for what it reaches: users with an id, an unknown p as NaN."""
    return prof.where(F.col("user_id").isNotNull()).select("user_id", "term", F.coalesce("p", F.lit(float("nan"))).alias("p"))


def content_rest(prof: DataFrame, x: DataFrame) -> DataFrame:
    """Content scores of pairs without a user's or an item's id, which blocks cannot hold: a row a user and a row an item at most."""
    xb, user = x.select("doc_id", "term", "weight"), F.col("user_id")
    return _content_join(prof.where(user.isNull()), xb).unionByName(_content_join(prof.where(user.isNotNull()), xb.where(F.col("doc_id").isNull())))


def content_scores(r: DataFrame, x: DataFrame) -> DataFrame:
    """R2: (user_id, item_id, cb) = sum_j r_uj cos(x_i, x_j) via the user term profile.

    A row a pair is the result; pairs are made in blocks and never shuffled.
    """
    x, prof = cut_lineage(x.select("doc_id", "term", "weight")), cut_lineage(text_profile(r, x))
    xk, users = x.where(F.col("doc_id").isNotNull()), prof.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    items, none = xk.select(F.col("doc_id").alias("item_id")).distinct(), prof.select("user_id", F.lit(None).cast("long").alias("item_id")).limit(0)
    out = blocks.text_blocks(known_profile(prof), xk, items, users, none, blocks.shared_kernel(), "user_id long, item_id long, score double", every_pair=True)
    return out.withColumnRenamed("score", "cb").unionByName(content_rest(prof, x))


def _minmax(c: str, n_catalog) -> list[Column]:
    w = Window.partitionBy("user_id")
    partial = F.count("*").over(w) < n_catalog  # some catalog items carry an implicit 0
    mn = F.when(partial, F.least(F.min(c).over(w), F.lit(0.0))).otherwise(F.min(c).over(w))
    mx = F.when(partial, F.greatest(F.max(c).over(w), F.lit(0.0))).otherwise(F.max(c).over(w))
    return [mn, mx]


def _blend(cf: DataFrame, cb: DataFrame, n_catalog, alpha: float) -> DataFrame:
    """(user_id, item_id, cf, cb, hybrid) of users whose reached pairs are all in ``cf`` and ``cb``, by join."""
    j = cf.join(cb, ["user_id", "item_id"], "full")
    j = j.select("user_id", "item_id", F.coalesce("cf", F.lit(0.0)).alias("cf"), F.coalesce("cb", F.lit(0.0)).alias("cb"))
    cmn, cmx = _minmax("cf", n_catalog)
    bmn, bmx = _minmax("cb", n_catalog)
    j = j.select("user_id", "item_id", "cf", "cb", cmn.alias("cmn"), cmx.alias("cmx"), bmn.alias("bmn"), bmx.alias("bmx"))
    return j.select("user_id", "item_id", "cf", "cb", _blended(alpha))


def _blended(alpha: float) -> Column:
    cf_n = F.when(F.col("cmx") > F.col("cmn"), (F.col("cf") - F.col("cmn")) / (F.col("cmx") - F.col("cmn"))).otherwise(F.col("cf"))
    cb_n = F.when(F.col("bmx") > F.col("bmn"), (F.col("cb") - F.col("bmn")) / (F.col("bmx") - F.col("bmn"))).otherwise(F.col("cb"))
    return ((1.0 - alpha) * cf_n + alpha * cb_n).alias("hybrid")


def _reach_inputs(user_scores: DataFrame, products: DataFrame):
    """What the blocks over all reached pairs read: (r, cf, profile, x, items, users, records)."""
    r = cut_lineage(catalog_scores(user_scores, products))
    x = cut_lineage(product_tfidf(products).select("doc_id", "term", "weight"))
    prof, cf = cut_lineage(text_profile(r, x)), cut_lineage(cf_scores(r))
    id_ = F.col("user_id").isNotNull()
    seen = r.where(id_).select("user_id", "item_id", (F.col("score") > 0).cast("int").alias("seen"))
    rec = cf.where(id_).withColumn("has", F.lit(1)).join(seen, ["user_id", "item_id"], "full").select(
        "user_id", "item_id", F.coalesce("cf", F.lit(0.0)).alias("cf"), F.coalesce("has", F.lit(0)).alias("has"), F.coalesce("seen", F.lit(0)).alias("seen"))
    items = products.select(F.col("product_id").alias("item_id")).where(F.col("item_id").isNotNull()).distinct()
    return r, cf, prof, x, cut_lineage(items), cut_lineage(r.select("user_id").where(id_).distinct()), cut_lineage(rec)


def hybrid_scores(user_scores: DataFrame, products: DataFrame, alpha: float = HYBRID_ALPHA) -> DataFrame:
    """R3 scores before suppression: (user_id, item_id, cf, cb, hybrid, seen).

    Min-max runs per user over the whole catalog; items no path reaches hold
    an implicit 0 (folded into min/max), and keep the raw value when max = min.
    A row a reached pair is the result; pairs are made in blocks, twice, and never shuffled.
    """
    n_catalog = products.agg(F.count("*")).scalar()
    r, cf, prof, x, items, users, rec = _reach_inputs(user_scores, products)
    xk, known = x.where(F.col("doc_id").isNotNull()), known_profile(prof)
    # pairs without an item's id: one a user; they count in the range
    bare = cut_lineage(content_rest(prof, x).where(F.col("user_id").isNotNull()).select("user_id", "item_id", F.lit(0.0).alias("cf"), F.coalesce("cb", F.lit(0.0)).alias("cb")))
    names = ["cmn", "cmx", "bmn", "bmx"]
    ends = blocks.text_blocks(known, xk, items, users, rec, blocks.reach_range_kernel(), "user_id long, n long, cmn double, cmx double, bmn double, bmx double")
    ends = ends.unionByName(bare.select("user_id", F.lit(1).cast("long").alias("n"), F.col("cf").alias("cmn"), F.col("cf").alias("cmx"), F.col("cb").alias("bmn"), F.col("cb").alias("bmx")))
    ends = ends.groupBy("user_id").agg(F.sum("n").alias("n"), F.min("cmn").alias("cmn"), F.max("cmx").alias("cmx"), F.min("bmn").alias("bmn"), F.max("bmx").alias("bmx"))
    partial = F.col("n") < n_catalog  # some catalog items carry an implicit 0
    fold = lambda c: F.when(partial, (F.least if c.endswith("mn") else F.greatest)(F.col(c), F.lit(0.0))).otherwise(F.col(c))
    ends = cut_lineage(ends.where(F.col("n") > 0).select("user_id", *[fold(c).alias(c) for c in names]))
    out = blocks.text_blocks(known, xk, items, ends, rec, blocks.hybrid_pairs_kernel(alpha),
                             "user_id long, item_id long, cf double, cb double, hybrid double, seen boolean", every_pair=True)
    bare = bare.join(ends, "user_id").select("user_id", "item_id", "cf", "cb", _blended(alpha))
    no_user = F.col("user_id").isNull()
    bare = bare.unionByName(_blend(cf.where(no_user), _content_join(prof.where(no_user), x), n_catalog, alpha))
    return out.unionByName(bare.withColumn("seen", F.lit(False)))


def unseen_candidates(user_scores: DataFrame, products: DataFrame) -> DataFrame:
    """(user_id, item_id) of reached pairs that the user has no positive score for."""
    r, cf, prof, x, items, users, rec = _reach_inputs(user_scores, products)
    out = blocks.text_blocks(known_profile(prof), x.where(F.col("doc_id").isNotNull()), items, users, rec,
                             blocks.reached_unseen_kernel(), "user_id long, item_id long", every_pair=True)
    rest = cf.where(F.col("user_id").isNull()).select("user_id", "item_id").union(content_rest(prof, x).select("user_id", "item_id"))
    return out.unionByName(rest.distinct())


def personal_top_k(hybrid: DataFrame, k: int) -> DataFrame:
    cand = hybrid.where(~F.col("seen") & (F.col("hybrid") > 0))
    w = Window.partitionBy("user_id").orderBy(rank_key(F.col("hybrid")).desc(), F.col("item_id").asc())
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "user_id", "item_id", r4(F.col("hybrid")).alias("score"), "rank")


def personal_picks(user_scores: DataFrame, products: DataFrame, k: int, alpha: float = HYBRID_ALPHA) -> DataFrame:
    """``personal_top_k(hybrid_scores(...))`` without a row a pair: text scores in blocks, twice.

    The first pass gives each user's range over the whole catalog, the second the k best unseen items
    of every block of items.
    """
    return personal_top_k(blended_picks(user_scores, products, k, (alpha,)).withColumn("seen", F.lit(False)), k)


def blended_picks(user_scores: DataFrame, products: DataFrame, k: int, alphas: tuple[float, ...]) -> DataFrame:
    """(user_id, item_id, hybrid, alpha): what may be among a user's k best unseen items by the blend with each of ``alphas``.

    Ranges and text scores do not depend on the blend: each pass scores every pair once, whatever their number.
    """
    r = cut_lineage(catalog_scores(user_scores, products).where(F.col("user_id").isNotNull()))
    x, items, kept = cut_lineage(product_tfidf(products).select("doc_id", "term", "weight")), products.select(F.col("product_id").alias("item_id")), {}
    prof = cut_lineage(text_profile(r, x).where(F.col("p").isNotNull()))
    seen = r.select("user_id", "item_id", (F.col("score") > 0).cast("int").alias("seen"))
    rec = cf_scores(r).join(seen, ["user_id", "item_id"], "full").select("user_id", "item_id", F.coalesce("cf", F.lit(0.0)).alias("cf"), F.coalesce("seen", F.lit(0)).alias("seen"))
    rec = cut_lineage(rec)
    users = r.select("user_id").distinct()
    ends = blocks.text_blocks(prof, x, items, users, rec, blocks.range_kernel(), "user_id long, cmn double, cmx double, bmn double, bmx double", kept=kept)
    ends = ends.groupBy("user_id").agg(F.min("cmn").alias("cmn"), F.max("cmx").alias("cmx"), F.min("bmn").alias("bmn"), F.max("bmx").alias("bmx"))
    return blocks.text_blocks(prof, x, items, cut_lineage(ends), rec, blocks.hybrid_kernel(k, *alphas), "user_id long, item_id long, hybrid double, alpha double", kept=kept)


def popular_from_features(features: DataFrame, n: int = POPULAR_PRODUCTS_N,
                          count_col: str = "item_interaction_count") -> DataFrame:
    """A10: items by max(count) desc (ties: id), top n, with 1-based position."""
    g = features.groupBy("item_id").agg(F.max(count_col).alias("c"))
    return g.orderBy(F.col("c").desc(), F.col("item_id").asc()).limit(n).select(
        "item_id", F.row_number().over(Window.orderBy(F.col("c").desc(), F.col("item_id").asc())).alias("pos"))


def popular_from_events(events: DataFrame, n: int = POPULAR_PRODUCTS_N) -> DataFrame:
    """A11 raw path: by purchase count then total count (ties: id), top n, in one conditional aggregate."""
    g = events.groupBy("item_id").agg(
        F.count_if(F.col("interaction_type") == "purchase").alias("purchase_count"),
        F.count("*").alias("total_interactions"))
    order = [F.col("purchase_count").desc(), F.col("total_interactions").desc(), F.col("item_id").asc()]
    return g.orderBy(*order).limit(n).select("item_id", "purchase_count", "total_interactions",
                                              F.row_number().over(Window.orderBy(*order)).alias("pos"))


def _popular_array(popular: DataFrame) -> Column:
    """The (bounded, <= n) popular list as one ordered array, via a scalar subquery."""
    return popular.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item_id"))),
                                   lambda s: s["item_id"])).scalar()


def with_backfill(users: DataFrame, personal: DataFrame, popular: DataFrame, k: int) -> DataFrame:
    """Personal picks first, then popular items (first 2k, not already listed) up to k.

    Works on per-user arrays bounded by k and by the popular list, so no
    user x popular cross product is formed. Users without personal picks get
    the first k popular items (cold start) with score 0.5.
    """
    per = personal.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "score"))).alias("p"))
    u = users.select("user_id").distinct().join(per, "user_id", "left")
    u = u.withColumn("p", F.coalesce("p", F.array().cast("array<struct<rank:int,item_id:bigint,score:double>>")))
    u = u.withColumn("pop", F.slice(_popular_array(popular), 1, 2 * k))
    have = F.transform("p", lambda s: s["item_id"])
    fill = F.filter("pop", lambda i: ~F.array_contains(have, i))
    need = F.greatest(F.lit(k) - F.size("p"), F.lit(0))
    u = u.select("user_id",
                 F.transform("p", lambda s: F.struct(s["item_id"].alias("item_id"), s["score"].alias("score"),
                                                     F.lit("personal").alias("source"))).alias("a"),
                 F.transform(F.slice(fill, 1, need), lambda i: F.struct(i.alias("item_id"), F.lit(COLD_START_SCORE).alias("score"),
                                                                         F.lit("popular").alias("source"))).alias("b"))
    out = u.select("user_id", F.posexplode(F.concat("a", "b")).alias("pos", "rec"))
    return out.select("user_id", (F.col("pos") + 1).cast("long").alias("rank"), F.col("rec.item_id").alias("item_id"),
                      F.col("rec.score").alias("score"), F.col("rec.source").alias("source"))


def recommend_products(user_scores: DataFrame, products: DataFrame, popular: DataFrame, users: DataFrame,
                       k: int = DEFAULT_TOP_K, alpha: float = HYBRID_ALPHA, picks: DataFrame | None = None) -> DataFrame:
    """Top-k hybrid recommendations for ``users`` with back-fill and catalog attributes (J10 after top-k).

    ``picks``: ``blended_picks`` of the same scores for several blends, ``alpha`` among them, where kept.
    """
    if picks is None:
        personal = personal_picks(user_scores, products, k, alpha)
    else:
        personal = personal_top_k(picks.where(F.col("alpha") == alpha).withColumn("seen", F.lit(False)), k)
    recs = with_backfill(users, personal, popular, k)
    cat = looked_up(products.withColumnRenamed("product_id", "item_id"))
    return recs.join(cat, "item_id", "left").select(
        "user_id", "rank", F.col("item_id").alias("product_id"), "product_name", "category", "price",
        "description", "score", "source")


# ---------------------------------------------------------------- owners

def material_tfidf(materials: DataFrame) -> DataFrame:
    docs = materials.select("material_id", F.concat(F.col("category"), F.lit(" "), F.col("description")).alias("txt"))
    return text.tfidf(docs, "material_id", "txt")


def owner_profile(owner_items: DataFrame, x: DataFrame) -> DataFrame:
    """(user_id, term, p) = mean_j x_j over the owner's distinct catalog items."""
    xb = x.select("doc_id", "term", "weight")
    held = owner_items.select("user_id", "item_id").distinct().join(
        xb.select(F.col("doc_id").alias("item_id")).distinct(), "item_id", "left_semi")
    m = held.groupBy("user_id").agg(F.count("*").alias("m"))
    prof = held.join(xb, held.item_id == xb.doc_id).groupBy("user_id", "term").agg(F.sum("weight").alias("p"))
    return prof.join(m, "user_id").select("user_id", "term", (F.col("p") / F.col("m")).alias("p"))


def owner_similarity(owner_items: DataFrame, x: DataFrame) -> DataFrame:
    """Identity C: mean_j cos(x_i, x_j) over the owner's distinct catalog items = x_i . mean_j x_j.

    (user_id, item_id, sim) for every catalog item sharing a term with the owner profile.
    """
    xb, prof = x.select("doc_id", "term", "weight"), owner_profile(owner_items, x)
    s = prof.join(xb, "term").groupBy("user_id", "doc_id").agg(F.sum(F.col("p") * F.col("weight")).alias("sim"))
    return s.select("user_id", F.col("doc_id").alias("item_id"), "sim")


def _material_score(vol: Column, urg: Column, fs: Column, sim_: Column) -> Column:
    from tidewater.functions import W_FORECAST, W_SIMILARITY, W_URGENCY, W_VOLUME
    return F.lit(W_VOLUME) * vol + F.lit(W_URGENCY) * urg + F.lit(W_FORECAST) * fs + F.lit(W_SIMILARITY) * sim_


def forecast_score(q: Column) -> Column:
    from tidewater.functions import FORECAST_SCALE
    return F.when(q > 0, F.least(F.lit(1.0), q / FORECAST_SCALE)).otherwise(F.lit(0.0))


def free_positions(taken: DataFrame, owners: DataFrame, n: Column, k: int, rows: int | None = None) -> DataFrame:
    """(user_id, pos): the first k of positions 1..n that are not among an owner's taken ones.

    Between two taken positions lies a gap; only gaps with fewer than k free positions before them
    count, and each gives at most k rows. No array and no row per free position of the catalog.
    """
    marks = dealt(taken.select("user_id", "pos").unionByName(owners.select("user_id", F.lit(0).alias("pos"))), ["user_id"], rows)
    w = Window.partitionBy("user_id").orderBy("pos")
    g = marks.select("user_id", "pos", (F.col("pos") - F.row_number().over(w) + 1).alias("free"), F.lead("pos").over(w).alias("next"))
    last = F.coalesce(F.col("next") - 1, n)
    g = g.select("user_id", (F.col("pos") + 1).alias("a"), F.least(last, F.col("pos") + F.lit(k) - F.col("free")).alias("b"))
    return g.where(F.col("a") <= F.col("b")).select("user_id", F.explode(F.sequence("a", "b")).alias("pos"))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its rows numbered from 1 in ``order``: sorted by ranges, each range numbered on from the ones before.

    Only one count a partition reaches the driver.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("part_", F.spark_partition_id())
    counts = {r["part_"]: r["count"] for r in ranged.groupBy("part_").count().collect()}
    parts = max(counts, default=0) + 1
    before, offsets = 0, []
    for p in range(parts):
        offsets.append(before)
        before += counts.get(p, 0)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    at = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("part_") + 1)
    return ranged.withColumn(name, (place + at + 1).cast("int")).drop("part_")


def rank_materials(cand: DataFrame, defaults: DataFrame, owners: DataFrame, k: int,
                   blocked: DataFrame | None = None, score_round: int = 4, rows: int | None = None) -> DataFrame:
    """Top-k per owner over *all* catalog items, exactly.

    ``cand``: (user_id, item_id, score, demand, elapsed, cycle) for pairs a
    path reaches; ``defaults``: (item_id, score, demand) for every catalog
    item, the score an owner gets for an item no path reaches. The default
    picks of an owner are the first k positions of the global default order
    that are not among the owner's candidates. Ties: rounded score, then id. ``rows``: about the number of
    candidates, where known; tasks are then dealt by it.
    """
    order = [F.col("score").desc(), F.col("item_id").asc()]
    d = numbered(defaults.withColumn("score", F.round(F.col("score"), score_round)), order, "pos")  # one row per catalog item
    n = defaults.agg(F.count("*")).scalar().cast("int")
    c = dealt(cand.withColumn("score", F.round(F.col("score"), score_round)), ["user_id"], rows)
    cw = Window.partitionBy("user_id").orderBy(*order)
    top_c = c.withColumn("rank", F.row_number().over(cw)).where(F.col("rank") <= k)
    taken = c.select("user_id", "item_id")
    if blocked is not None:  # items an owner may not receive at all (e.g. already purchased)
        taken = taken.unionByName(blocked.select("user_id", "item_id")).distinct()
    o = owners.select("user_id").distinct()
    fill = free_positions(taken.join(d.select("item_id", "pos"), "item_id"), o, n, k, rows)
    extra = [c_ for c_ in d.columns if c_ not in ("item_id", "score", "pos")]
    fp = fill.join(o, "user_id", "left_semi").join(d, "pos").select("user_id", "item_id", "score", *extra)
    for c_ in top_c.columns:
        if c_ not in fp.columns and c_ != "rank":
            fp = fp.withColumn(c_, F.lit(0))
    allc = top_c.drop("rank").unionByName(fp, allowMissingColumns=True)
    w = Window.partitionBy("user_id").orderBy(*order)
    return allc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recommend_materials(features: DataFrame, materials: DataFrame, owners: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """R5 feature path: 0.3 volume + 0.3 urgency + 0.2 forecast + 0.2 similarity for every catalog item."""
    from tidewater.functions import (FEATURE_PATH_ELAPSED, URGENCY_HORIZON, VOLUME_SCALE, W_FORECAST, W_SIMILARITY,
                                     W_URGENCY, W_VOLUME)
    features = cut_lineage(features)  # read for the profiles, the records and the output
    x = material_tfidf(materials)
    cyc = F.col("avg_procurement_interval_days")
    fq = F.coalesce(F.col("avg_procurement_quantity"), F.lit(0.0))
    rec = features.select(
        "user_id", "item_id",
        F.coalesce(F.least(F.lit(1.0), F.col("procurement_count") / VOLUME_SCALE), F.lit(0.0)).alias("vol"),
        F.when(cyc > 0, F.least(F.lit(1.0), F.lit(URGENCY_HORIZON) / cyc)).otherwise(F.lit(0.5)).alias("urg"),
        forecast_score(fq).alias("fs"))
    items = materials.select(F.col("material_id").alias("item_id"))
    users = owners.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    kernel = blocks.material_kernel(k, (W_VOLUME, W_URGENCY, W_FORECAST, W_SIMILARITY))
    best = blocks.text_blocks(owner_profile(features, x), x, items, users, rec, kernel, "user_id long, item_id long, score double")
    w = Window.partitionBy("user_id").orderBy(F.col("score").desc(), F.col("item_id").asc())
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    own = features.select("user_id", "item_id", F.round(fq, 1).alias("demand"), F.lit(FEATURE_PATH_ELAPSED).alias("elapsed"), cyc.cast("int").alias("cycle"))
    ranked = best.join(own, ["user_id", "item_id"], "left").select(
        "user_id", "item_id", "rank", "score", F.coalesce("demand", F.lit(0.0)).alias("demand"),
        F.coalesce("elapsed", F.lit(0)).alias("elapsed"), F.coalesce("cycle", F.lit(0)).alias("cycle"))
    return _material_output(ranked, materials)


def _material_output(ranked: DataFrame, materials: DataFrame) -> DataFrame:
    cat = looked_up(materials.withColumnRenamed("material_id", "item_id"))
    return ranked.join(cat, "item_id").select(
        "user_id", F.col("rank").cast("long").alias("rank"), F.col("item_id").alias("material_id"),
        "material_name", "category", "price", "description",
        F.col("demand").alias("predicted_demand_qty"), F.col("elapsed").cast("long").alias("urgency_days_elapsed"),
        F.col("cycle").cast("long").alias("urgency_cycle_days"), "score")


def popular_materials_from_features(features: DataFrame, n: int) -> DataFrame:
    return popular_from_features(features, n, "material_interaction_count")


def recommend_materials_cold_start(owners: DataFrame, popular: DataFrame, materials: DataFrame, k: int) -> DataFrame:
    """First k of the popular list with demand 50.0, elapsed 7, cycle 14, score 0.5."""
    from tidewater.functions import COLD_CYCLE, COLD_DEMAND, COLD_ELAPSED
    arr = owners.select("user_id").distinct().withColumn("pop", F.slice(_popular_array(popular), 1, k))
    e = arr.select("user_id", F.posexplode("pop").alias("pos", "item_id"))
    ranked = e.select("user_id", (F.col("pos") + 1).alias("rank"), "item_id", F.lit(COLD_START_SCORE).alias("score"),
                      F.lit(COLD_DEMAND).alias("demand"), F.lit(COLD_ELAPSED).alias("elapsed"), F.lit(COLD_CYCLE).alias("cycle"))
    return _material_output(ranked, materials)


def recommend_materials_raw(events: DataFrame, materials: DataFrame, owners: DataFrame, model, k: int = DEFAULT_TOP_K,
                            weeks: DataFrame | None = None) -> DataFrame:
    """R6 raw path: counts, reorder urgency, next-week forecast and similarity for every catalog item.

    ``weeks``: the events' ``pair_weeks`` with times, where kept. A pair's history, forecast, cycle and urgency come from
    one row of it, so no rows of pairs are joined; its record goes through the tiles to the output.
    """
    from tidewater.functions import DEFAULT_MEAN_QTY, VOLUME_SCALE
    from tidewater.operators import forecasting as fc
    from tidewater.functions import W_FORECAST, W_SIMILARITY, W_URGENCY, W_VOLUME
    weeks = cut_lineage(fc.pair_weeks(events, times=True)) if weeks is None else weeks
    materials = cut_lineage(materials)
    x = cut_lineage(material_tfidf(materials).select("doc_id", "term", "weight"))
    items = sent(materials.select(F.col("material_id").alias("item_id")))
    means = cut_lineage(fc.item_means(weeks).withColumnRenamed("material_mean_qty", "im"))
    defaults = sent(cut_lineage(items.join(means, "item_id", "left").select(
        "item_id", F.coalesce("im", F.lit(DEFAULT_MEAN_QTY)).alias("dfq"))))
    h = fc.pair_history(dealt(weeks, ["user_id", "item_id"], weeks.count())).where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
    h = h.join(sent(means.select("item_id", "im")), "item_id", "left")
    j = fc.with_urgency(fc.with_cycle(fc.with_forecast(h, model)), means.agg(F.max("last_ts")).scalar())
    has_p = F.col("lag_1").isNotNull()
    # every item carries its default forecast score as one more term that every owner has; a pair with
    # events brings the difference to its own, so no pair without events is ever a row
    own = cut_lineage(j.select(
        "user_id", "item_id",
        F.when(has_p, F.least(F.lit(1.0), F.col("n_purchases") / VOLUME_SCALE)).otherwise(F.lit(0.0)).alias("vol"),
        F.when(has_p, F.coalesce("urgency", F.lit(0.0))).otherwise(F.lit(0.0)).alias("urg"),
        (forecast_score(F.col("forecast_qty")) - forecast_score(F.coalesce("im", F.lit(DEFAULT_MEAN_QTY)))).alias("fs"),
        F.round("forecast_qty", 1).alias("demand"),
        F.when(has_p, F.coalesce("days_elapsed", F.lit(0))).otherwise(F.lit(0)).alias("elapsed"),
        F.when(has_p, F.col("cycle_days").cast("int")).otherwise(F.lit(0)).alias("cycle")))
    users = cut_lineage(owners.select("user_id").where(F.col("user_id").isNotNull()).distinct())
    mark = F.lit("\x00forecast").alias("term")
    profile = owner_profile(dealt(own.select("user_id", "item_id"), ["user_id"], own.count()), sent(x)).unionByName(users.select("user_id", mark, F.lit(1.0).alias("p")))
    x = x.unionByName(defaults.select(F.col("item_id").alias("doc_id"), mark, (F.lit(W_FORECAST / W_SIMILARITY) * forecast_score(F.col("dfq"))).alias("weight")))
    carried = ("demand", "elapsed", "cycle")
    kernel = blocks.material_kernel(k, (W_VOLUME, W_URGENCY, W_FORECAST, W_SIMILARITY), carried)
    best = blocks.text_blocks(profile, x, items, users, own, kernel, "user_id long, item_id long, score double, demand double, elapsed double, cycle double")
    w = Window.partitionBy("user_id").orderBy(F.col("score").desc(), F.col("item_id").asc())
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    ranked = best.join(defaults, "item_id", "left").select(
        "user_id", "item_id", "rank", "score", F.coalesce("demand", F.round("dfq", 1)).alias("demand"),
        *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("elapsed", "cycle")])
    return _material_output(ranked, materials)


# ---------------------------------------------------------------- older tree

#: Slices of ``BROADCAST_ROWS`` rows of a table that are sent one by one; a larger table is joined by rows.
SLICES = 40


def per_user(rows: DataFrame, table: DataFrame, on, to: str = "item_j", sums: int | None = None) -> DataFrame:
    """``rows`` joined with ``table`` for sums by user and item. A table of few rows (checkpointed, as it is counted)
    goes to rows dealt by user, so the many rows of the join are summed where they are made. A larger one goes in up to ``SLICES`` slices by the item summed for (``to``):
    a sum is made in one task still, and only finished sums are shuffled. ``sums``: about their number, where known."""
    slices = -(-table.count() // BROADCAST_ROWS) or 1
    if slices > SLICES:
        return rows.join(table, on)
    by_user = rows.repartition("user_id") if sums is None else dealt(rows, ["user_id"], sums)
    parts = [by_user.join(F.broadcast(table.where(F.pmod(F.xxhash64(to), F.lit(slices)) == i) if slices > 1 else table), on) for i in range(slices)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def knn_cf_scores(user_item: DataFrame, neighbors: DataFrame, sums: int | None = None) -> DataFrame:
    """R7 CF: sum over bought items p of sim(p, o) * qty(u, p) for o among p's 20 neighbours (o != p),
    max-normalised per user; only positive scores. ``user_item`` (user_id, item_id, qty); ``sums``: about the number of scores, where known."""
    nb = cut_lineage(neighbors.where(F.col("item_i") != F.col("item_j")).select("item_i", "item_j", "sim"))
    raw = per_user(user_item.where(F.col("qty") > 0), nb, F.col("item_id") == F.col("item_i"), sums=sums).groupBy(
        "user_id", F.col("item_j").alias("item_id")).agg(F.sum(F.col("sim") * F.col("qty")).alias("cf"))
    mx = F.max("cf").over(Window.partitionBy("user_id"))  # <= catalog rows per user
    return raw.select("user_id", "item_id", F.when(mx > 0, F.col("cf") / mx).otherwise(F.col("cf")).alias("cf")).where(F.col("cf") > 0)


def preferred_category_scores(customers: DataFrame, products: DataFrame) -> DataFrame:
    """R11 (sparse form): (user_id, item_id, 1.0) for products in the customer's preferred category;
    every other product of a known customer carries the default 0.3."""
    from tidewater.functions import PREFERRED_SCORE
    p = products.select(F.col("product_id").alias("item_id"), "category")
    return customers.join(p, customers.preferred_category == p.category).select(
        F.col("customer_id").alias("user_id"), "item_id", F.lit(PREFERRED_SCORE).alias("content"))


def recommend_products_knn(user_item: DataFrame, neighbors: DataFrame, customers: DataFrame, products: DataFrame,
                           users: DataFrame, k: int = DEFAULT_TOP_K, sums: int | None = None) -> DataFrame:
    """0.7 * knn_cf + 0.3 * content (1.0 preferred category, else 0.3); bought items stay eligible.

    Candidates are the CF keys and, of the preferred category's other products,
    which all score alike, the first k by id; every other product scores
    0.3 * 0.3 or stands behind k better ones, and enters through the exact fill. All
    customers are served, with or without transactions; ``users`` without a
    customer row get their collaborative picks alone.
    """
    from tidewater.functions import KNN_W_CB, KNN_W_CF, OTHER_CATEGORY_SCORE
    from tidewater.functions import PREFERRED_SCORE
    cf = cut_lineage(knn_cf_scores(user_item, neighbors, sums))
    rows = cf.count()
    known = customers.select(F.col("customer_id").alias("user_id"))
    wants = customers.select(F.col("customer_id").alias("user_id"), "preferred_category").dropDuplicates(["user_id"])
    # products by place within their category; all that a customer has no neighbour score for tie there
    shelf = numbered(products.select(F.col("product_id").alias("item_id"), "category").where(F.col("category").isNotNull()), [F.col("category"), F.col("item_id")], "at")
    first = shelf.groupBy("category").agg(F.min("at").alias("start"))
    shelf = shelf.join(first, "category").select("item_id", "category", (F.col("at") - F.col("start") + 1).alias("place"))
    kept = dealt(cf, ["user_id"], rows).join(shelf.select("item_id", "category"), "item_id", "left").join(wants, "user_id", "left")
    liked = F.col("category") == F.col("preferred_category")
    kept = kept.select("user_id", "item_id", "cf", F.when(liked, F.lit(PREFERRED_SCORE)).alias("content"))
    taken = kept.where(F.col("content").isNotNull()).groupBy("user_id").agg(F.count("*").cast("int").alias("taken"))
    more = wants.where(F.col("preferred_category").isNotNull()).join(taken, "user_id", "left")
    more = more.select("user_id", F.col("preferred_category").alias("category"), F.explode(F.sequence(F.lit(1), F.lit(k) + F.coalesce("taken", F.lit(0)))).alias("place"))
    more = more.join(shelf, ["category", "place"]).select("user_id", "item_id").join(dealt(cf.select("user_id", "item_id"), ["user_id", "item_id"], rows), ["user_id", "item_id"], "left_anti")
    more = more.select("user_id", "item_id", F.lit(0.0).alias("cf"), F.lit(PREFERRED_SCORE).alias("content"))
    j = dealt(kept.unionByName(more), ["user_id"], rows).join(known.distinct().withColumn("known", F.lit(True)), "user_id", "left")
    content = F.coalesce(F.col("content"), F.when(F.col("known"), F.lit(OTHER_CATEGORY_SCORE)).otherwise(F.lit(0.0)))
    cand = j.select("user_id", "item_id", (F.lit(KNN_W_CF) * F.coalesce("cf", F.lit(0.0)) + F.lit(KNN_W_CB) * content).alias("score"))
    cand = cut_lineage(cand.withColumn("score", F.round("score", 9)))
    defaults = products.select(F.col("product_id").alias("item_id"), F.lit(KNN_W_CB * OTHER_CATEGORY_SCORE).alias("score"))
    by_user = dealt(cand, ["user_id"], rows)
    ranked = rank_materials(by_user.join(known, "user_id", "left_semi"), defaults, known, k, score_round=9, rows=rows)
    # users without a profile have no content score: only what the collaborative part reaches
    bare = users.select("user_id").distinct().join(known, "user_id", "left_anti")
    w = Window.partitionBy("user_id").orderBy(F.col("score").desc(), F.col("item_id").asc())
    bare = by_user.join(bare, "user_id", "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    ranked = ranked.select("user_id", "item_id", "score", "rank").unionByName(bare.select("user_id", "item_id", "score", "rank"))
    cat = products.withColumnRenamed("product_id", "item_id")
    return ranked.join(cat, "item_id").select("user_id", F.col("rank").cast("long").alias("rank"),
                                             F.col("item_id").alias("product_id"), "name", "category", "subcategory", "price", "score")


def industry_category_scores(owners: DataFrame, rules: DataFrame, materials: DataFrame) -> DataFrame:
    """0.5 for every catalog material in a category the owner's industry maps to (equi-joins)."""
    from tidewater.functions import INDUSTRY_RULE_SCORE
    m = materials.select(F.col("material_id").alias("item_id"), "category")
    oc = owners.join(rules, "industry")
    return oc.join(m, "category").select(F.col("owner_id").alias("user_id"), "item_id", F.lit(INDUSTRY_RULE_SCORE).alias("score"))


def owner_history_summary(purchases: DataFrame) -> DataFrame:
    """Per owner purchase count, quantity, span and the first material in history order (partial aggregates)."""
    order = F.struct("date", "l_orderkey", "l_linenumber", "l_partkey")
    return purchases.groupBy("owner_id").agg(
        F.count("*").alias("n_purchases"), F.sum("quantity").cast("long").alias("total_quantity"),
        F.min_by("material_id", order).alias("first_material_id"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def owner_history(purchases: DataFrame) -> DataFrame:
    """Every purchase with its place in the owner's history (date, then order line)."""
    w = Window.partitionBy("owner_id").orderBy("date", "l_orderkey", "l_linenumber", "l_partkey", "quantity")
    return purchases.select("owner_id", F.row_number().over(w).cast("long").alias("nth"), "material_id", "quantity", "date")


def recommend_materials_copurchase(purchases: DataFrame, materials: DataFrame, owners: DataFrame, rules: DataFrame,
                                   co_sim: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """Sum over every purchase row of co-purchase similarity to non-purchased materials,
    + 0.5 * 0.5 for materials of the owner's industry categories (purchased ones too); reason text.

    Owners without history get the k most purchased materials, score 1.0."""
    from tidewater.functions import INDUSTRY_RULE_WEIGHT, REASON_POPULAR, REASON_SIMILAR, REASON_TRENDS
    # read for the profiles, the records and the owners
    cnt = cut_lineage(purchases.groupBy(F.col("owner_id").alias("user_id"), F.col("material_id").alias("item_id")).agg(F.count("*").alias("c")))
    s = cut_lineage(co_sim.select("item_i", "item_j", "sim"))
    hist_owners = cut_lineage(cnt.select("user_id").distinct())
    known = hist_owners.where(F.col("user_id").isNotNull())
    asked = cut_lineage(owners.select(F.col("owner_id").alias("user_id"), "industry").where(F.col("industry").isNotNull()).join(known, "user_id", "left_semi")
                        .groupBy("user_id", "industry").agg(F.count("*").alias("times")))
    # an owner's industries are one more term, which the materials of their categories have: no row an owner and material
    kind = asked.groupBy("user_id").agg(F.array_sort(F.collect_set("industry")).alias("industries")).withColumn("kind", F.to_json("industries"))
    kind = cut_lineage(kind)
    kinds = kind.select("kind", "industries").distinct().select(F.col("kind").alias("owner_id"), F.explode("industries").alias("industry"))
    ind = cut_lineage(industry_category_scores(kinds, rules, materials).groupBy(F.col("user_id").alias("kind"), "item_id").agg(F.max(F.col("score") * INDUSTRY_RULE_WEIGHT).alias("ind")))
    term = lambda c, mark: F.concat(F.lit(mark), F.col(c).cast("string")).alias("term")
    profile = cnt.where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull()).select("user_id", term("item_id", "i"), F.col("c").cast("double").alias("p"))
    profile = profile.unionByName(kind.select("user_id", term("kind", "k"), F.lit(1.0).alias("p")))
    x = s.select(F.col("item_j").alias("doc_id"), term("item_i", "i"), F.col("sim").alias("weight")).unionByName(ind.select(F.col("item_id").alias("doc_id"), term("kind", "k"), F.col("ind").alias("weight")))
    bought = cnt.join(kind.select("user_id", "kind"), "user_id", "left").join(sent(ind), ["kind", "item_id"], "left")
    bought = cut_lineage(bought.select("user_id", "item_id", F.coalesce("ind", F.lit(0.0)).alias("ind")))
    items = cut_lineage(materials.select(F.col("material_id").alias("item_id")))
    best = blocks.text_blocks(profile, x, items, known, bought, blocks.copurchase_kernel(k), "user_id long, item_id long, score double, bought boolean")
    w = Window.partitionBy("user_id").orderBy(F.col("score").desc(), F.col("item_id").asc())
    best = cut_lineage(best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank"))
    # an owner listed more than once has the materials of their industry so many times
    liked = industry_category_scores(asked.select(F.col("industry").alias("owner_id"), "industry").distinct(), rules, materials)
    liked = cut_lineage(liked.groupBy(F.col("user_id").alias("industry"), "item_id").agg(F.count("*").alias("n")))
    times = best.join(asked, "user_id").join(sent(liked), ["industry", "item_id"]).groupBy("user_id", "item_id").agg(F.sum(F.col("times") * F.col("n")).alias("times"))
    best = best.join(times, ["user_id", "item_id"], "left").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long"))))).drop("times", "nth")
    # purchases of nobody known: a row a material
    bare = cnt.where(F.col("user_id").isNull()).join(s, F.col("item_id") == F.col("item_i")).groupBy("user_id", "item_j").agg(F.sum(F.col("c") * F.col("sim")).alias("s"))
    bare = bare.select("user_id", F.col("item_j").alias("item_id"), F.round("s", 9).alias("score"), F.lit(False).alias("bought"))
    ranked = best.unionByName(bare).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    first = owner_history_summary(purchases).select(F.col("owner_id").alias("user_id"), "first_material_id")
    names = materials.select(F.col("material_id").alias("first_material_id"), F.col("material_name").alias("first_name"))
    ranked = ranked.join(first, "user_id", "left").join(names, "first_material_id", "left")
    reason = F.when(F.col("bought"), F.lit(REASON_TRENDS)).otherwise(F.concat(F.lit(REASON_SIMILAR), F.col("first_name")))
    ranked = ranked.select("user_id", F.col("rank").cast("long").alias("rank"), "item_id", F.round("score", 6).alias("score"), reason.alias("reason"))
    most = purchases.groupBy(F.col("material_id").alias("item_id")).agg(F.count("*").alias("n"))
    order = [F.col("n").desc(), F.col("item_id").asc()]
    most = most.orderBy(*order).limit(k).select("item_id", F.row_number().over(Window.orderBy(*order)).alias("pos"))
    new = owners.select(F.col("owner_id").alias("user_id")).distinct().join(hist_owners, "user_id", "left_anti")
    new = new.withColumn("pop", _popular_array(most)).select("user_id", F.posexplode("pop").alias("at", "item_id"))
    new = new.select("user_id", (F.col("at") + 1).cast("long").alias("rank"), "item_id", F.lit(1.0).alias("score"), F.lit(REASON_POPULAR).alias("reason"))
    cat = materials.withColumnRenamed("material_id", "item_id")
    return ranked.unionByName(new).join(cat, "item_id").select(
        "user_id", "rank", F.col("item_id").alias("material_id"), "material_name", "category",
        F.col("price").alias("unit_cost"), "score", "reason")
