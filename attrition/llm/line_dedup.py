"""Line deduplication by distinct-site spread.

Every line of a text is known by a 128-bit digest.  For each line the sites it
stands on are counted by a HyperLogLog sketch, made in the map tasks and merged
by aggregation.  A line whose estimate is within the sketch's error of the
limit has its sites counted exactly.  A line on ``MIN_SITES`` sites or more is
boilerplate: it stays where it stands first (the smallest doc_id, its first
place there) and goes everywhere else, so no content is lost for good.  Lines
of any length count; a blank one (ASCII white space only) parts paragraphs and
always stays.

Built-in functions only.  Lines are cut, digested and counted before any
shuffle; the texts themselves are joined once, by row, to the places of their
boilerplate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import staged

#: Sites from which a line counts as boilerplate.
MIN_SITES = 5
#: What a line that is not blank holds.
INK = r"[^\x20\x09-\x0D]"
#: log2 of the sketch's registers: a relative error of about 1.04 / 2 ** (LG_K / 2).
LG_K = 8
#: Width of the band around the limit that is counted exactly, in relative errors.
SIGMAS = 4


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, site, at, line`` of every line that is not blank; ``line`` is a digest."""
    lines = F.posexplode(F.split("text", "\n", -1)).alias("at", "t")
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("source").alias("site"), lines)
    trimmed = F.trim(F.col("t"))
    digest = F.struct(F.xxhash64(trimmed).alias("x"), F.xxhash64(trimmed, F.lit(1)).alias("y"))
    return cut.filter(F.col("t").rlike(INK)).select("doc_id", "text_hash", "site", "at", digest.alias("line"))


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``line, sites, first``: boilerplate lines, their number of sites and where they stand first.

    ``sites`` is exact near the limit and an estimate beyond; ``first`` is the
    smallest ``(doc_id, at)``.  A null source is no site.
    """
    error = SIGMAS * 1.04 / 2 ** (LG_K / 2)
    low, high = min_sites * (1 - error), min_sites * (1 + error)
    lines = _lines(docs)
    spread = lines.groupBy("line").agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("_sketch"),
        F.count("*").alias("_rows"),
        F.min(F.struct("doc_id", "at")).alias("first"),
    )
    spread = spread.filter(F.col("_rows") >= min_sites)
    spread = spread.select("line", "first", F.hll_sketch_estimate("_sketch").alias("_about"))
    spread = staged(spread.filter(F.col("_about") >= low), "spread")
    near = spread.filter(F.col("_about") <= high)
    exact = (
        lines.select("line", "site")
        .join(near.select("line"), "line", "left_semi")
        .groupBy("line")
        .agg(F.count_distinct("site").alias("_exact"))
    )
    counted = spread.join(exact, "line", "left").select(
        "line", F.coalesce("_exact", F.col("_about").cast("long")).alias("sites"), "first"
    )
    return counted.filter(F.col("sites") >= min_sites)


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` without repeated boilerplate lines, plus ``n_lines`` and ``n_removed``.

    ``docs`` has doc_id, text and source; other columns are kept as they are,
    but for any named ``n_lines`` or ``n_removed``, which are replaced.  A null
    text has no lines and stays null; a text whose lines all go becomes empty.
    Rows that share a doc_id and text are cleaned alike, so each keeps the line
    that stands there first.  A null doc_id is smaller than any other.  An
    empty table gives an empty result.
    """
    found = staged(boilerplate_lines(docs, min_sites), "boilerplate")
    lines = _lines(docs).join(found.select("line", "first"), "line")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at"))
    # One row for each text that loses lines, so null ids do not meet in one.
    away = lines.filter(~stays).groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("away"))
    # The rows' own columns go by number here, so none of their names can clash.
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    own = {c: f"c{i}" for i, c in enumerate(others)}
    rows = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in own.items()])
    text = F.col(own["text"])
    met = F.col(own["doc_id"]).eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("text_hash"))
    joined = rows.join(away, met, "left").withColumn("lines", F.split(text, "\n", -1))
    # Places that stay: a set difference, linear in a text's lines.
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("away"))
    kept = F.when(F.col("away").isNull(), text).otherwise(F.array_join(F.transform(places, lambda i: F.col("lines")[i]), "\n"))
    return joined.select(
        *[(kept if c == "text" else F.col(n)).alias(c) for c, n in own.items()],
        F.when(text.isNull(), 0).otherwise(F.size("lines")).alias("n_lines"),
        F.coalesce(F.size(F.col("away")), F.lit(0)).alias("n_removed"),
    )
