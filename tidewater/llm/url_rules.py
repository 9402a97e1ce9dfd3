"""URL filter by association rules (operator 9).

Spark's FP-growth mines combinations of URL tokens (scheme, host suffixes and labels, path segments,
query keys) together with the class of labelled pages. Rules "tokens -> block" are pruned by support,
confidence and lift, and by shorter rules that are as confident; rules have at most ``MAX_TOKENS`` tokens,
a parameter of the rule language (a longer rule is matched by its parts of that length, where these
are confident enough). Matching goes through an inverted
index: each rule is filed under its rarest token, a page looks up its tokens and checks the remaining
tokens of the rules found. Explicit rules, (host, path) pairs, come first: the longest that fits wins.

DataFrame and SQL functions only. Labels come from documents: the page's document is the number that
its last path segment begins with.

Rows: null urls, and urls without "://", have empty host and path, no token, and are allowed; repeated
rows are judged each; labels that are null or of no page serve no rule; without labelled pages there is
no mined rule; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import checkpointed, pick_ids

# Explicit rules (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Explicit rules are part of the expression that every url evaluates; more are refused.
MAX_RULES = 1000

SUPPORT = 0.001  # share of labelled pages that hold a rule's tokens and its class, and
LEAST = 10  # their least number
CONFIDENCE = 0.6
LIFT = 1.5
MAX_TOKENS = 4  # tokens of a rule

BLOCK = "=block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame) -> DataFrame:
    """``pages`` (with ``url``) and host, path."""
    at = F.instr("url", "://")
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", F.when(at > 0, host).otherwise(F.lit(""))).withColumn("path", F.when(at > 0, path).otherwise(F.lit("")))


def explicit(rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits host and path, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} explicit rules; at most {MAX_RULES}")
    fits = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        ok = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def tokens() -> Column:
    """Distinct tokens of a split url; numbers are left out, as they name single pages."""
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.filter(F.split(F.lower(F.concat_ws("/", "host", "path")), "[^\\p{L}\\p{N}]+"), lambda w: (F.length(w) > 1) & ~w.rlike("^[0-9]+$"))
    keys = F.regexp_extract_all(F.regexp_extract("url", "\\?([^#]*)", 1), F.lit("(?:^|&)([^=&]+)"), 1)
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index("url", "://", 1))))
    all_ = F.concat(scheme, suffixes, F.transform(words, lambda w: F.concat(F.lit("word:"), w)), F.transform(keys, lambda k: F.concat(F.lit("key:"), k)))
    return F.when(F.col("host") != "", F.array_distinct(all_)).otherwise(F.array().cast("array<string>"))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """tokens, bad of the pages whose document is labelled; bad: low quality or toxic."""
    number = F.regexp_extract("path", "/([0-9]{1,18})[^/]*/?$", 1)
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("doc")).agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) > 0)).alias("bad"))
    return pages.withColumn("doc", F.when(number != "", number.cast("long").cast("string"))).join(marks, "doc").select("tokens", "bad")


def mined(train: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """rule (sorted tokens), key (its rarest token), confidence, support of the pruned block rules."""
    spark = train.sparkSession
    schema = T.StructType([T.StructField("rule", T.ArrayType(T.StringType())), T.StructField("key", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("support", T.DoubleType())])
    train = checkpointed(train)
    n = train.count()
    if not n:
        return spark.createDataFrame([], schema)
    items = train.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / n)), minConfidence=confidence).fit(items)
    rules = model.associationRules.filter((F.element_at("consequent", 1) == BLOCK) & (F.size("antecedent") <= MAX_TOKENS) & (F.col("lift") >= lift))
    rules = checkpointed(rules.select(F.array_sort("antecedent").alias("rule"), "confidence", "support"))
    # a rule goes if one with fewer of its tokens is as confident: rules that share a token are compared
    each = rules.withColumn("token", F.explode("rule"))
    shorter = each.select("token", F.col("rule").alias("short"), F.col("confidence").alias("short_confidence"))
    beaten = each.join(shorter, "token").filter((F.size("short") < F.size("rule")) & (F.size(F.array_except("short", "rule")) == 0) & (F.col("short_confidence") >= F.col("confidence"))).select("rule").distinct()
    rules = rules.join(beaten, "rule", "left_anti")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    keyed = rules.withColumn("token", F.explode("rule")).join(single, "token")
    keyed = keyed.groupBy("rule").agg(F.min(F.struct("freq", "token")).alias("k"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    return keyed.select("rule", F.col("k.token").alias("key"), "confidence", "support")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict and the confidence of the mined rule that fits best, if any."""
    p = split_url(pages.select("page_id", "url")).withColumn("tokens", tokens())
    found = checkpointed(mined(labelled(p, labels), **options))
    index = pick_ids(found.select(F.col("key").alias("token"), F.col("rule").alias("mined"), "confidence"))
    urls = p.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    urls = urls.filter(F.size(F.array_except("mined", "tokens")) == 0)
    hit = urls.groupBy("url").agg(F.max("confidence").alias("confidence")).withColumnRenamed("url", "hit_url")
    best = explicit(rules)
    out = p.withColumn("x", best).join(hit, F.col("url") == F.col("hit_url"), "left")
    method = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("x.rule").alias("rule"), F.coalesce(F.col("x.verdict"), method).alias("verdict"), "confidence")
