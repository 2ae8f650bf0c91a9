"""Operator 6: URL filter with list rules and mined association rules.

A list of (host, path, verdict) rules is applied first; the longest fitting
rule wins.  URLs it says nothing about are judged by association rules: the
URLs with a label are baskets of tokens, FP-growth finds the frequent token
combinations with each label, and rules of enough support and confidence stay
unless a shorter rule says the same with no less confidence.  Matching uses an
inverted index: each rule hangs under its rarest token, a URL looks up its own
tokens, and only rules found this way have their other tokens compared.

FP-growth's frequent token sets, and with them the rules, are bounded by the
support; rules of any length are kept, and no row is left out.

Defined cases: a null URL or one without ``://`` has empty host and path, no
rule and the default verdict; no labelled rows: the default verdict; repeated
rows are judged alike; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict); a host stands for itself and all its subdomains.
LIST = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
        ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def split_url(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    rest = F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1)
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (urls.withColumn("host", F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, lower))
            .withColumn("path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)))


def fit_list(urls: DataFrame, rules=LIST) -> DataFrame:
    """Adds ``rule`` (host/path of the longest fitting rule, or null) and its
    verdict; a handful of rules, so one expression a rule and no join."""
    hits = [F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p),
                   F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in rules]
    best = F.array_max(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    return urls.withColumn("_b", best).withColumn("rule", F.col("_b.rule")).withColumn(
        "list_verdict", F.col("_b.verdict")).drop("_b")


def tokens():
    """Distinct tokens of a URL: every host label, the last two labels together
    and every path segment are worth a token each; numbers in a segment fold to
    one sign, so that those of one form are one token."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    last = F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2))
    segs = F.filter(F.split(F.regexp_replace("path", "[0-9]+", "0"), "/"), lambda x: x != "")
    return F.array_distinct(F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
        F.when(F.size(labels) > 0, F.array(F.concat(F.lit("d:"), F.array_join(last, ".")))).otherwise(F.array().cast("array<string>")),
        F.transform(segs, lambda x: F.concat(F.lit("p:"), x))))


def mine_rules(labelled: DataFrame, support: float = 0.01, confidence: float = 0.9) -> DataFrame:
    """labelled: (items array<string>, label string).  Returns rules (rule_id,
    items, label, confidence, support), redundant ones left out."""
    spark = labelled.sparkSession
    total = labelled.count()
    schema = "rule_id long, items array<string>, label string, confidence double, support double"
    if not total:
        return spark.createDataFrame([], schema)
    baskets = labelled.select(F.concat(F.col("items"), F.array(F.concat(F.lit("label="), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    is_label = lambda x: x.startswith("label=")
    sets = model.freqItemsets
    with_label = (sets.where(F.exists("items", is_label) & (F.size("items") > 1))
                  .select(F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("items"),
                          F.expr("substr(filter(items, x -> startswith(x, 'label='))[0], 7)").alias("label"),
                          F.col("freq").alias("both")))
    alone = sets.where(~F.exists("items", is_label)).select(F.array_sort("items").alias("items"), "freq")
    rules = (with_label.join(alone, "items")
             .select("items", "label", (F.col("both") / F.col("freq")).alias("confidence"),
                     (F.col("both") / F.lit(float(total))).alias("support"))
             .where(F.col("confidence") >= confidence))
    # a rule is redundant when a rule of one of its tokens' subsets is as sure
    s, g = rules.alias("s"), rules.alias("g")
    general = (F.col("s.label") == F.col("g.label")) & (F.size("g.items") < F.size("s.items")) & (
        F.size(F.array_except("g.items", "s.items")) == 0) & (F.col("g.confidence") >= F.col("s.confidence"))
    anchor = s.withColumn("_a", F.explode("s.items")).alias("s")
    held = anchor.join(g.withColumn("_b", F.col("g.items")[0]).alias("g"), (F.col("s._a") == F.col("g._b")) & general,
                       "left_semi").select("s.items", "s.label").distinct()
    rules = rules.join(held, ["items", "label"], "left_anti")
    return rules.withColumn("rule_id", F.xxhash64("items", "label"))


def match_rules(urls: DataFrame, rules: DataFrame, row: str = "_row", items: str = "items") -> DataFrame:
    """(row, label, rule_id) of the best rule of each row that has one: most
    confident, then most supported, then longest, then smallest id."""
    freq = rules.select(F.explode("items").alias("t"), F.col("support").alias("s")).groupBy("t").agg(F.max("s").alias("s"))
    rarest = (rules.select("rule_id", F.explode("items").alias("t")).join(freq, "t").groupBy("rule_id")
              .agg(F.min(F.struct("s", "t")).alias("m")).select("rule_id", F.col("m.t").alias("_t")))
    index = rules.withColumnRenamed("items", "_need").join(rarest, "rule_id")
    return (urls.select(row, items, F.explode(items).alias("_t")).join(index, "_t")
            .where(F.size(F.array_except("_need", items)) == 0)
            .groupBy(row).agg(F.max(F.struct("confidence", "support", F.size("_need").alias("n"),
                                             (-F.col("rule_id")).alias("i"), "label", "rule_id")).alias("b"))
            .select(row, F.col("b.label").alias("label"), F.col("b.rule_id").alias("rule_id")))


def url_filter(pages: DataFrame, rules=LIST, labels: DataFrame | None = None, default: str = "allow",
               support: float = 0.01, confidence: float = 0.9, url: str = "url", key: str = "page_id") -> DataFrame:
    """Judges every URL.  ``labels`` (url, label) are further labelled URLs;
    URLs the list decides are labelled by it.  Rows of one token basket get
    one verdict, so baskets are matched once each."""
    judged = fit_list(split_url(pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))), rules)
    judged = judged.withColumn("items", tokens())
    train = judged.where("list_verdict is not null").select("items", F.col("list_verdict").alias("label"))
    if labels is not None:
        train = train.unionByName(split_url(labels.select(F.col(url).alias("url"), "label"))
                                  .withColumn("items", tokens()).select("items", "label"))
    mined = mine_rules(train.where("size(items) > 0 and label is not null"), support, confidence)
    # rows the list decides take no part in the join
    basket = F.sha1(F.array_join("items", "\0").cast("binary"))
    open_ = judged.where("list_verdict is null").withColumn("_row", basket)
    best = match_rules(open_.select("items", "_row").distinct(), mined).select("_row", F.col("label").alias("_label"), "rule_id")
    out = lambda df, *verdicts: df.select("page_id", "host", "path", "rule", F.coalesce(*verdicts).alias("verdict"), "rule_id")
    return out(judged.where("list_verdict is not null").withColumn("rule_id", F.lit(None).cast("long")), F.col("list_verdict")).unionByName(
        out(open_.join(best, "_row", "left"), F.col("_label"), F.lit(default)))
