"""URL filter: listed rules, and association rules mined from labelled URLs.

A URL is a set of tokens: its host's suffixes, path segments and query keys,
runs of digits being alike.  FP-growth mines the token combinations that are
frequent among labelled URLs, the label (block or allow) being one more item.  A
rule "combination => label" needs a least support, and a confidence of
``CONFIDENCE`` and of ``CERTAINTY`` of the way from the label's share of all
labelled URLs to 1; it goes when a part of the combination gives the same label
with the same confidence or more.  Rules match through an inverted index: each
is entered under one of its tokens, the one that the fewest labelled URLs have,
and looked at only for URLs with that token.  Of the rules that a URL holds, the
one furthest on that way decides.

All tokens of a URL are mined.  Tokens that stand in the same labelled URLs (the
fixed parts of a long template) are mined as one: a combination with two of them
says no more than with one of them, so it is no rule.  The rules found are then
written out for each of them, which gives just the rules of mining them all.
Beyond that the work grows with the number of frequent combinations, whatever
the lengths.
"""

from __future__ import annotations

import logging
import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import staged

logger = logging.getLogger(__name__)

# The listed rules, as (verdict, host, path).
LISTED = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Least share and number of the labelled URLs with the combination and the label.
SUPPORT, LEAST = 0.001, 10
#: Least share of the label among those with the combination, and how far that is from the label's overall share (0) to 1.
CONFIDENCE, CERTAINTY = 0.5, 0.25
BLOCK, ALLOW = "=block", "=allow"


def host_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def listed_rule(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest listed rule that fits, and its verdict; nulls where none does."""
    name = verdict = F.lit(None).cast("string")
    for said, on, under in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(under)
        name, verdict = F.when(fits, on + under).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def tokens(url: str = "url") -> Column:
    """The URL's tokens, distinct and sorted; empty for a null url."""
    host, path = host_path(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    numbers = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), numbers(x)))
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(
        F.filter(F.split(query, "&"), lambda x: x != ""),
        lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)),
    )
    return F.array_sort(F.array_distinct(F.filter(F.concat(suffixes, segments, keys), lambda x: x != "h:")))


def _baskets(labelled: DataFrame, frequency: DataFrame, least: float, items: int | None) -> DataFrame:
    """``tokens, label`` of each row of ``labelled(tokens, block)``; with ``items``, of a longer row the rarest frequent tokens only."""
    label = F.when(F.col("block"), BLOCK).otherwise(ALLOW).alias("label")
    if items is None:
        return labelled.select("tokens", label)
    long = labelled.filter(F.size("tokens") > items).select("tokens").distinct()
    of = long.select("tokens", F.explode("tokens").alias("entry")).join(frequency.filter(F.col("_n") >= least), "entry")
    rarest = F.slice(F.sort_array(F.collect_list(F.struct("_n", "entry"))), 1, items)  # a list is one URL's tokens
    short = of.groupBy("tokens").agg(rarest["entry"].alias("_some"))
    some = F.coalesce("_some", F.when(F.size("tokens") > items, F.array().cast("array<string>")).otherwise(F.col("tokens")))
    return labelled.join(short, "tokens", "left").select(some.alias("tokens"), label)


def _twins(baskets: DataFrame, least: float) -> DataFrame:
    """``entry, members``: frequent tokens that stand in the same baskets, two or more, under the first of them.

    The baskets that a token is in are known by 128 bits of hashes.
    """
    sets = baskets.groupBy("tokens").agg(F.count("*").alias("_n"))
    hashes = [F.xxhash64(F.lit(i), "tokens").alias(f"_x{i}") for i in range(2)]
    marks = sets.select(F.explode("tokens").alias("entry"), "_n", *hashes)
    marks = marks.groupBy("entry").agg(F.sum("_n").alias("_n"), *[F.bit_xor(f"_x{i}").alias(f"_x{i}") for i in range(2)])
    members = F.array_sort(F.collect_list("entry")).alias("members")  # all of one URL
    alike = marks.filter(F.col("_n") >= least).groupBy("_x0", "_x1").agg(members).filter(F.size("members") > 1)
    return alike.select(F.col("members")[0].alias("entry"), "members")


def _without_twins(baskets: DataFrame, twins: DataFrame) -> DataFrame:
    """``baskets`` with the first of each twins alone."""
    more = twins.select(F.explode(F.slice("members", 2, F.size("members"))).alias("entry"))
    held = baskets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("entry"))
    gone = held.join(F.broadcast(more), "entry").groupBy("tokens").agg(F.collect_list("entry").alias("_gone"))
    rest = F.when(F.col("_gone").isNull(), F.col("tokens")).otherwise(F.array_except("tokens", "_gone"))
    return baskets.join(gone, "tokens", "left").select(rest.alias("tokens"), "label")


def _with_twins(rules: DataFrame, twins: DataFrame) -> DataFrame:
    """Each rule once for every choice of a twin for each of its tokens."""
    said = [c for c in rules.columns if c not in ("items", "label")]
    each = rules.select("*", F.explode("items").alias("entry")).join(F.broadcast(twins), "entry", "left")
    options = F.collect_list(F.coalesce("members", F.array("entry"))).alias("_of")
    wide = each.groupBy("items", "label").agg(*[F.first(c).alias(c) for c in said], options)
    none = F.array(F.array().cast("array<string>"))
    chosen = F.aggregate("_of", none, lambda all, some: F.flatten(F.transform(all, lambda x: F.transform(some, lambda y: F.array_append(x, y)))))
    return wide.select(F.explode(chosen).alias("items"), "label", *said).withColumn("items", F.array_sort("items"))


def _least_rules(rules: DataFrame, sure: DataFrame) -> DataFrame:
    """``rules`` of which no part gives the same label with the same confidence or more.

    ``sure(items, label, confidence)`` holds the rules and all their parts.  From
    size to size, a combination takes the best confidence of any part of it from
    those with one token less.
    """
    largest = rules.agg(F.max(F.size("items"))).first()[0] or 1
    best = sure.filter(F.size("items") == 1).select("items", "label", F.col("confidence").alias("_best"))
    beaten = None
    for size in range(2, largest + 1):
        own = sure.filter(F.size("items") == size).withColumnRenamed("items", "_whole")
        parts = own.select("_whole", "label", "confidence", F.explode(F.transform("_whole", lambda x: F.array_remove("_whole", x))).alias("items"))
        within = parts.join(best, ["items", "label"]).groupBy(F.col("_whole").alias("items"), "label")
        level = staged(within.agg(F.first("confidence").alias("confidence"), F.max("_best").alias("_within")), "parts")
        best = level.select("items", "label", F.greatest("confidence", "_within").alias("_best"))
        lost = level.filter(F.col("_within") >= F.col("confidence")).select("items", "label")
        beaten = lost if beaten is None else beaten.unionByName(lost)
    return rules if beaten is None else rules.join(beaten, ["items", "label"], "left_anti")


def mined_rules(
    labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, certainty: float = CERTAINTY, items: int | None = None, least: int = LEAST
) -> DataFrame:
    """``items, label, confidence, support, certainty, entry`` of the rules in ``labelled(tokens, block)``.

    ``entry`` is the index token.  With fewer than ``least`` rows there are none.
    Only when asked by ``items`` does a row give no more than so many tokens.
    """
    spark = labelled.sparkSession
    schema = "items array<string>, label string, confidence double, support double, certainty double, entry string"
    rows, bad = labelled.agg(F.count("*"), F.count_if("block")).first()
    if rows < max(least, 1):
        return spark.createDataFrame([], schema)
    support = max(support, least / rows)
    frequency = labelled.select(F.explode("tokens").alias("entry")).groupBy("entry").agg(F.count("*").alias("_n"))
    baskets = _baskets(labelled, frequency, support * rows - 1e-6, items)
    twins = staged(_twins(baskets, support * rows - 1e-6), "twins")
    some = not twins.isEmpty()
    baskets = _without_twins(baskets, twins) if some else baskets
    found = FPGrowth(itemsCol="items", minSupport=support).fit(baskets.select(F.array_append("tokens", F.col("label")).alias("items"))).freqItemsets
    sets = staged(found.select(F.array_sort("items").alias("items"), "freq"), "frequent")
    # The labels sort before every token.
    label, rest = F.col("items")[0], F.slice("items", 2, F.size("items"))
    sure = sets.filter(label.isin(BLOCK, ALLOW) & (F.size("items") > 1)).select(rest.alias("items"), label.alias("label"), "freq")
    sure = sure.join(sets.withColumnRenamed("freq", "_all"), "items").withColumn("confidence", F.col("freq") / F.col("_all"))
    sure = staged(sure.select("items", "label", "confidence", (F.col("freq") / rows).alias("support")), "sure")
    share = F.when(F.col("label") == BLOCK, bad / rows).otherwise(1 - bad / rows)
    rules = sure.withColumn("certainty", F.try_divide(F.col("confidence") - share, 1 - share))
    rules = rules.filter((F.col("confidence") >= confidence) & (F.col("certainty") >= certainty))
    rules = _least_rules(rules, sure.select("items", "label", "confidence"))
    rules = _with_twins(rules, twins) if some else rules
    ranked = rules.select("*", F.explode("items").alias("entry")).join(frequency, "entry")
    said = ["confidence", "support", "certainty"]
    return ranked.groupBy("items", "label").agg(*[F.first(c).alias(c) for c in said], F.min(F.struct("_n", "entry"))["entry"].alias("entry"))


def matched(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens, label, learned``: the sets of ``token_sets(tokens)`` that hold a rule, and the surest of the rules held.

    Ties go to the greater support, then to block, then to the last in order.
    """
    entries = token_sets.distinct().select("tokens", F.explode("tokens").alias("entry"))
    found = entries.join(rules, "entry").filter(F.size(F.array_except("items", "tokens")) == 0)
    best = F.max(F.struct("certainty", "support", "label", F.array_join("items", " ").alias("learned")))
    return found.groupBy("tokens").agg(best["label"].alias("label"), best["learned"].alias("learned"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = LISTED) -> DataFrame:
    """``page_id, host, path, rule, verdict, learned`` of every row of ``pages(page_id, url, ...)``.

    A listed rule decides where one fits; elsewhere the surest mined rule that
    the url holds (``learned``: its tokens), and a url without any is allowed.
    The number of rules of each label is logged.  A page's label is that of
    the document with its id: block where ``toxic`` is 1 or ``quality`` 0; null
    labels count for nothing.  Null urls have empty host and path and are
    allowed.  Rows that repeat are judged each, further columns are ignored,
    and an empty table gives an empty result.
    """
    host, path = host_path()
    rule, verdict = listed_rule(rules, F.col("host"), F.col("path"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), tokens().alias("tokens"))
    bad = F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False)))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(bad.alias("block"))
    labelled = staged(rows.filter("size(tokens) > 0").join(known, "page_id").select("tokens", "block"), "labelled")
    mined = staged(mined_rules(labelled), "mined")
    for r in mined.groupBy("label").count().collect():  # two rows at most
        logger.info("rules mined: %d for %s", r["count"], r["label"].removeprefix("="))
    learned = matched(rows.select("tokens"), mined)
    return rows.join(learned, "tokens", "left").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("label") == BLOCK, "block").otherwise("allow")).alias("verdict"),
        "learned",
    )
