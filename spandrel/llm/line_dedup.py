"""Site-relative line deduplication, in DataFrame functions only.

Pages are grouped by host.  A line's frequency is the number of the host's
pages that contain it, divided by the host's pages; lines above a ratio are
boilerplate and leave every page of that host.  A line on one page only repeats
nothing and is never boilerplate, however few pages the host has.

At scale: the lines of all pages are written once to the shared folder.  They are
counted by host and a mark of 128 bits, once per page, with map-side sums, so the
count moves no text.  What comes back is small: a host has at most (lines of a
page) / ratio boilerplate lines.  They return to the pages by (host, salt), so that one host
with a third of all pages is spread over SALTS groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: A line on more than this share of its host's pages is boilerplate.
RATIO = 0.3
#: A line on fewer pages of a host repeats nothing.
LEAST_PAGES = 2
#: Groups over which a host's pages are dealt when lines return to them.
SALTS = 64
#: A \n-separated line is taken without white space at its ends.
TRIM = r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user or port; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def visible_lines(html: Column) -> Column:
    """The lines of a page: scripts, styles, comments and tags go, block tags and
    \\n end lines; lines are trimmed and empty ones dropped."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)</?(?:p|div|br|li|ul|ol|tr|td|table|nav|article|section|header|footer|h[1-6]|title|body|head|html)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, TRIM, "")), lambda x: x != "")


def plain_lines(text: Column) -> Column:
    """The trimmed, non-empty \\n-separated lines of a text."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, TRIM, "")), lambda x: x != "")


def mark_of(line: Column) -> Column:
    """128 bits that stand for a line: two hashes of different seeds.  Lines of equal
    marks count as equal."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def line_dedup(pages: DataFrame, id_col: str = "page_id", host: Column | None = None, lines: Column | None = None, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, kept_text) of every row: a line goes if at
    least ``least`` pages, and more than ``ratio`` of the pages, of its host have it.

    A null or empty page has no lines and an empty kept_text.  A null or
    unparsable URL belongs to the host ''.  Every row is a page of its own,
    repeated rows and null ids too.  All of a page's copies of a boilerplate
    line go; other repeats stay.  An empty table gives no rows.
    """
    host = host_of(F.col("url")) if host is None else host
    lines = visible_lines(F.col("html")) if lines is None else lines
    # read twice below: a page's markup is taken apart once
    cells = written(pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), lines.alias("lines")))
    marks = cells.select("host", F.explode(F.array_distinct(F.transform("lines", mark_of))).alias("mark"))
    counts = marks.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    common = counts.where(F.col("n") >= least).join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    drop = common.groupBy("host").agg(F.collect_set("mark").alias("boilerplate"))
    # every page has one salt; the few boilerplate lines of a host go to all salts
    drop = drop.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = cells.withColumn("salt", F.pmod(F.xxhash64("page_id", F.size("lines")), F.lit(SALTS)).cast("int"))
    joined = salted.join(drop, ["host", "salt"], "left")
    kept = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("boilerplate", mark_of(x))))
    return joined.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept")).select(
        "page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text")
    )
