"""Line dedup by site-relative frequency: lines on too large a share of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import BLANKS, col, fresh_name

RATIO = 0.1
LEAST_PAGES = 3
BROADCAST_BYTES = 8_000_000

# What separates lines in HTML.
_HIDDEN = (
    r"(?is)<!--.*?-->|<script(?:[ \t\n\f\r/][^>]*)?>.*?</script[ \t\n\f\r]*>|"
    r"<style(?:[ \t\n\f\r/][^>]*)?>.*?</style[ \t\n\f\r]*>|<head(?:[ \t\n\f\r/][^>]*)?>.*?</head[ \t\n\f\r]*>"
)
_BREAK = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|div|dd|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|html|"
    r"li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)(?:[ \t\n\f\r/][^>]*)?>"
)
_TAG = r"<[^>]*>"


def html_lines(html: Column) -> Column:
    """Visible text of a page, one line per block element; null for null."""
    text = F.regexp_replace(html, _HIDDEN, "\n")
    return F.regexp_replace(F.regexp_replace(text, _BREAK, "\n"), _TAG, "")


def url_host(url: Column) -> Column:
    """Lower-case host of a url, '' if there is none; null for null."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def drop_boilerplate_lines(
    df: DataFrame,
    host: str,
    text: str,
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
    kept: str = "kept_text",
    n_lines: str = "n_lines",
    n_dropped: str = "n_dropped",
) -> DataFrame:
    """Every row of ``df`` with three more columns: the text without boilerplate lines, the number of its lines
    that are not blank, and how many of those went.

    Lines end at \\n and are compared trimmed. A line is boilerplate on a host if it stands on at least
    ``least_pages`` of its rows and on more than ``ratio`` of them. Blank lines stay. Null hosts are one host;
    a null text has no lines and stays null; repeated rows count as so many pages; an empty table gives an empty result;
    extra columns are passed on, whatever their names (new columns replace those of the same name, case-blind).

    Lines are reduced to 128-bit digests, so line texts are never shuffled; a host's counts meet by
    (host, digest) after map-side sums, so a hot host is spread over its lines. A host has at most (lines per
    page) / ratio boilerplate lines, however many pages it has: that list, not a page, is joined by host,
    broadcast only where its measured size is within a fixed bound.
    """
    rows = df.drop(kept, n_lines, n_dropped)
    by_host, its_lines, left_lines = fresh_name(rows, "_bl_host", "_bl_lines", "_bl_left")
    lines = F.split(col(text), "\n", -1)
    digest = lambda x: F.unhex(F.md5(_trimmed(x)))
    full = F.filter(lines, lambda x: _trimmed(x) != "")
    pages = rows.select(col(host).alias("h"), F.array_distinct(F.transform(full, digest)).alias("d"))
    totals = pages.groupBy("h").agg(F.count(F.lit(1)).alias("pages"))
    counts = pages.select("h", F.explode("d").alias("d")).groupBy("h", "d").agg(F.count(F.lit(1)).alias("n"))
    often = counts.filter(F.col("n") >= least_pages)
    listed = (
        often.join(totals.withColumnRenamed("h", "th"), F.col("h").eqNullSafe(F.col("th")))
        .filter(F.col("n") > F.lit(float(ratio)) * F.col("pages"))
        .groupBy(F.col("h").alias(by_host))
        .agg(F.collect_list("d").alias(its_lines))
    )
    listed = settle(listed)
    weight = listed.agg(F.sum(F.size(its_lines) * 16 + 64)).first()[0] or 0
    if weight <= BROADCAST_BYTES:
        listed = F.broadcast(listed)
    joined = rows.join(listed, col(host).eqNullSafe(F.col(by_host)), "left")
    left = F.filter(lines, lambda x: ~F.array_contains(F.col(its_lines), digest(x)))
    judged = joined.withColumn(left_lines, F.when(F.col(its_lines).isNull(), lines).otherwise(left))
    number = lambda c: F.when(c.isNull(), 0).otherwise(F.size(c)).cast("bigint")
    return judged.select(
        *[col(c) for c in rows.columns],
        F.array_join(left_lines, "\n").alias(kept),
        number(full).alias(n_lines),
        (number(lines) - number(F.col(left_lines))).alias(n_dropped),
    )
