"""Removal of boilerplate lines by their share of a site's pages.

For every host the pages that contain a line are counted; lines on more than ``ratio`` of the host's pages are
boilerplate of that host and are dropped from all of them. A line is compared without surrounding white space; blank
lines are never boilerplate. Hosts with fewer than ``min_pages`` pages are left alone, since a share of so few
pages says nothing.

With ``copies_once``, the form for a pipeline that settles copies later, pages of a host with the same sequence of lines count
as one, so that a group of copies never makes its own text boilerplate; and hosts of fewer than ``min_pages`` different pages
lose a line too if it is on ``LEAST_PAGES`` different pages and on more than ``ratio`` of them.

Lines travel as 16-byte digests, never as text. Counts are combined before the shuffle, so that a line of a third of
all pages costs one row per task; the look-up of a page's lines is a plain equi-join whose hot keys Spark splits.
A host can have at most (mean lines per page / ratio) boilerplate lines.

Defined cases: null text stays null with no lines; null host is a host of its own; the empty text has no line to drop;
repeated rows are pages of their own (counted once with ``copies_once``), and lines are dropped from each; a page whose lines all go keeps an empty text;
extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshift.llm.common import row_key

RATIO = 0.05
MIN_PAGES = 20
LEAST_PAGES = 3     # different pages that must hold a line on a small host


def _digest(line):
    return F.unhex(F.md5(F.trim(F.regexp_replace(line, "[\\t\\x0B\\f\\r]", " "))))


def _keyed(pages: DataFrame, host: str) -> DataFrame:
    """(host, page key, e): the digests and positions of a page's lines that have a word."""
    return pages.select(
        F.col(host).alias("host"), *row_key(),
        F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(
            F.when(x.rlike("[^ \\t\\x0B\\f\\r]"), _digest(x)).alias("digest"), i.alias("pos"))),
            lambda e: e["digest"].isNotNull()).alias("e"))


def _page(e) -> Column:
    """A hash of a page's sequence of lines; null if it has none."""
    return F.when(F.size(e) > 0, F.xxhash64(F.transform(e, lambda x: x["digest"])))


def _different(pages: DataFrame, host: str) -> tuple[DataFrame, DataFrame]:
    """(host, digest, n_pages) and (t_host, host_pages) over different pages; pages without lines do not count."""
    paged = _keyed(pages, host).select("host", _page(F.col("e")).alias("page"), F.array_distinct(
        F.transform("e", lambda x: x["digest"])).alias("digests")).filter("page is not null")
    counted = (paged.select("host", "page", F.explode("digests").alias("digest")).groupBy("host", "digest")
               .agg(F.countDistinct("page").alias("n_pages")))
    return counted, paged.groupBy(F.col("host").alias("t_host")).agg(F.countDistinct("page").alias("host_pages"))


def _lines(pages: DataFrame, host: str) -> DataFrame:
    """(host, page key, digest, position, first): one row per line that has a word; first marks a page's first copy."""
    keyed = _keyed(pages, host)
    ordered = keyed.withColumn("e", F.sort_array("e"))
    return ordered.select("host", "k_id", "k_text", F.explode(F.transform("e", lambda x, i: F.struct(
        x["digest"].alias("digest"), x["pos"].alias("pos"),
        ((i == 0) | (F.get("e", i - 1)["digest"] != x["digest"])).alias("first")))).alias("e")
    ).select("host", "k_id", "k_text", "e.*")


def boilerplate(pages: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES,
                copies_once: bool = False) -> DataFrame:
    """(host, digest, n_pages, host_pages) of the lines on more than ``ratio`` of a host's pages."""
    if copies_once:
        counted, totals = _different(pages, host)
        counted = counted.filter(F.col("n_pages") > min(ratio * min_pages, LEAST_PAGES - 1))
        enough = (F.col("host_pages") >= min_pages) | (F.col("n_pages") >= LEAST_PAGES)
    else:
        totals = pages.groupBy(F.col(host).alias("t_host")).agg(F.count(F.lit(1)).alias("host_pages"))
        counted = (_lines(pages, host).filter("first").groupBy("host", "digest")
                   .agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") > ratio * min_pages))
        enough = F.col("host_pages") >= min_pages
    return (counted.join(totals, F.col("host").eqNullSafe(F.col("t_host")))
            .filter(enough & (F.col("n_pages") > ratio * F.col("host_pages")))
            .select("host", "digest", "n_pages", "host_pages"))


def drop_boilerplate(pages: DataFrame, host: str = "source", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES, counts: bool = True, copies_once: bool = False) -> DataFrame:
    """The input's rows and columns with the remaining lines as ``text``; with ``counts`` also ``n_lines`` and
    ``n_dropped``, which replace columns of these names."""
    common = boilerplate(pages, host, ratio, min_pages, copies_once).select(F.col("host").alias("b_host"),
                                                               F.col("digest").alias("b_digest"))
    lines = _lines(pages, host)
    hits = (lines.join(common, (lines["digest"] == common["b_digest"]) & lines["host"].eqNullSafe(common["b_host"]),
                       "left_semi")
            .groupBy("host", "k_id", "k_text").agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    keyed = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("page"),
                         F.col(host).alias("p_host"), *[k.alias(f"p_{i}") for i, k in enumerate(row_key())])
    joined = keyed.join(hits, (keyed["p_0"] == hits["k_id"]) & (keyed["p_1"] == hits["k_text"])
                        & keyed["p_host"].eqNullSafe(hits["host"]), "left")
    split = joined.withColumn("l", F.split("page.text", "\n"))
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size("l") - 1), "gone"), lambda i: F.get("l", i))
    columns = [F.col("page")[c].alias(c) if c != "text" else
               F.when(F.col("gone").isNull(), F.col("page.text")).otherwise(F.array_join(rest, "\n")).alias("text")
               for c in pages.columns if not counts or c not in ("n_lines", "n_dropped")]
    return split.select(*columns, *[] if not counts else [
                        F.when(F.col("page.text").isNull(), 0).otherwise(F.size("l")).cast("long").alias("n_lines"),
                        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped")])
