"""Line dedup by site-relative frequency (native): lines on most pages of a host are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, let, quoted

#: Elements whose content is no text, and elements that begin or end a line (the rest are inline).
SILENT = "script|style|template|noscript|head"
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
#: Character references that are decoded, the ampersand last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; "" if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_text(html: Column) -> Column:
    """The text of a page, a line a block: comments and silent elements go, block tags break lines, other tags vanish."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    for name in SILENT.split("|"):
        t = F.regexp_replace(t, rf"(?is)<{name}\b.*?</{name}\s*>", "")
    t = F.regexp_replace(t, r"[\r\n]+", " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for ref, character in REFERENCES:
        t = F.replace(t, F.lit(ref), F.lit(character))
    return t


def lines(text: Column) -> Column:
    """The lines of a text that have a word, trimmed, white space runs as one space."""
    flat = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, f"{SPACE}+", " ")))
    return F.filter(flat, lambda x: x != "")


#: A host with more than one page in so many is hot: there are no more hot hosts than that. So many parts a hot host's pages are dealt to.
HOT, SALTS = 500, 64


def boilerplate(pages: DataFrame, totals: DataFrame, ratio: float, least_repeats: int) -> DataFrame:
    """(host, boiler): the hashes of lines on at least `ratio` of the host's pages and on least_repeats of them.

    pages: host and lines; totals: host and pages. A line counts once a page. Only hashes of lines are shuffled, counted
    before and after; a host's list is no longer than its mean page over ratio, whatever its size.
    """
    counts = pages.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line")).groupBy("host", "line").count()
    often = counts.where(F.col("count") >= least_repeats).join(totals, "host").where(F.col("count") >= F.col("pages") * ratio)
    return often.groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("boiler"))


def drop_boilerplate(pages: DataFrame, key: str = "page_id", url: str = "url", html: str | None = "html", text: str | None = None, ratio: float = 0.1, least_repeats: int = 3) -> DataFrame:
    """A row a page: page_id, host, n_lines, n_dropped, text (the lines that stay).

    A line is dropped if at least `ratio` of its host's pages hold it, and least_repeats of them: what a site does not repeat is
    no boilerplate, however few pages it has; a line exactly at the ratio goes. Pages come as html, or as text with lines already parted.
    They are parsed once and their lines written to the shared folder.

    Pages without a host (null or odd URLs) count as one site named ""; a null or empty page has no lines and counts as a page; very
    long pages and lines are taken whole; a line that repeats within a page counts once and is dropped or kept in all places; repeated
    rows are pages of their own; an empty table gives no rows. Columns other than the three are not read, whatever their names.
    Hot hosts: counts are added up by (host, line) before the shuffle, and pages of a hot host
    are dealt to SALTS parts for the join with its list.
    """
    body = page_text(pages[quoted(html)]) if text is None else pages[quoted(text)].cast("string")
    at = pages.select(pages[quoted(key)].alias("page_id"), host(pages[quoted(url)]).alias("host"), lines(body).alias("lines"))
    at = Scratch(pages.sparkSession).save(at, "lines")
    totals = at.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    hot = F.broadcast(totals.where(F.col("pages") * HOT > at.count()).select("host", F.lit(SALTS).alias("salts")))  # HOT rows at most
    dealt = at.join(hot, "host", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id", "lines"), F.col("salts")), F.lit(0)))
    boiler = boilerplate(at, totals, ratio, least_repeats).join(hot, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1)))
    out = dealt.drop("salts").join(boiler.drop("salts"), ["host", "salt"], "left")
    gone = F.array_intersect(F.transform("lines", lambda x: F.xxhash64(x)), F.coalesce("boiler", F.array().cast("array<bigint>")))
    kept = let(gone, lambda b: F.filter("lines", lambda x: ~F.array_contains(b, F.xxhash64(x))))
    out = out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), "lines", kept.alias("kept"))
    return out.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
