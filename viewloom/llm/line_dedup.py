"""Site-relative line frequency: drop lines that stand on too large a share of their host's pages.

Every row is a page. The host comes from the URL; pages without a host belong to no site and keep all
their lines. A line counts once per page. It goes where (pages of the host with the line) / (pages of the
host) exceeds `max_ratio` and at least `min_pages` pages have it, so that small hosts are not emptied.

Null or empty markup gives no lines and an empty text; a page all of whose lines go stays, with an empty
text. Repeated rows count as separate pages. Extra columns are ignored.

`min_pages` is a part of the rule beside the ratio: 1 is the plain ratio.

Markup is parsed once and kept in the shared folder. Lines are counted by (host, hash, length) with map-side sums, so a line on a third
of all pages costs one row per task. The lines to drop are few per host: at most (lines per page) / max_ratio. They are broadcast
where they are few altogether, else joined by host, the pages of a host with very many dealt over salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.llm.common import BROADCAST_KEYS, cut, hot_keys, lookup

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
# Every pattern reads a character a bounded number of times: tags hold no "<", and hidden parts that nobody closes end with the page.
HIDDEN = r"(?is)<(?:script|style|noscript)\b.*?(?:</(?:script|style|noscript)>|\z)|<!--.*?(?:-->|\z)"
BLOCK = (
    r"(?i)</?(?:p|div|br|li|ul|ol|nav|article|section|header|footer|h[1-6]|table|tr|td|th|"
    r"body|html|head|title|main|aside|pre|blockquote)\b[^<>]*>"
)
TAG = r"<[^<>]*>"
BLANKS = r"[ \t\x0B\f]+"


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, HOST, 1), F.lit("")))


def markup_lines(html: Column) -> Column:
    """The visible lines of a page: hidden parts and tags go, block tags end lines, white space collapses."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, "\n"), BLOCK, "\n"), TAG, "")
    text = F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")
    return F.filter(F.transform(F.split(text, "[\\n\\r]+"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def _line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("hash"), F.length(line).alias("size"))


def drop_site_lines(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    max_ratio: float = 0.3,
    min_pages: int = 3,
) -> DataFrame:
    """One row per page: id, host, n_lines, n_dropped, text (the kept lines, joined by newlines)."""
    page = cut(pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), markup_lines(F.col(html_col)).alias("lines")))
    sited = page.where("host is not null")
    totals = sited.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    frequent = (
        sited.select("host", F.explode(F.array_distinct(F.transform("lines", _line_key))).alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("line_pages"))
        .where(F.col("line_pages") >= min_pages)
    )
    large = hot_keys(totals.withColumnRenamed("host_pages", "size"))
    boilerplate = lookup(frequent, totals, "host", large, spread=["line"]).where(F.col("line_pages") / F.col("host_pages") > max_ratio)
    # a host has at most (lines of a page) / max_ratio lines to drop
    drops = cut(boilerplate.groupBy("host").agg(F.collect_list("line").alias("drop")))
    if (drops.agg(F.sum(F.size("drop"))).first()[0] or 0) <= BROADCAST_KEYS:
        joined = page.join(F.broadcast(drops), "host", "left")
    else:
        joined = lookup(page, drops, "host", large, "left")
    kept = F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), _line_key(x)))
    return joined.withColumn("kept", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(kept)).select(
        "page_id",
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )


def oracle(max_ratio: float = 0.3, min_pages: int = 3) -> str:
    return rf"""
WITH page AS (
  SELECT row_number() OVER () AS r, page_id, lower(nullif(regexp_extract(url, '{HOST}', 1), '')) AS host,
         list_filter(list_transform(string_split_regex(coalesce(regexp_replace(regexp_replace(regexp_replace(
           html, '{HIDDEN}', chr(10), 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g'), ''), '[\n\r]+'),
           lambda x: trim(regexp_replace(x, '{BLANKS}', ' ', 'g'), ' ')), lambda x: length(x) > 0) AS lines
  FROM pages),
line AS (SELECT r, page_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM page),
freq AS (SELECT host, line, count(DISTINCT r) AS n FROM line WHERE host IS NOT NULL GROUP BY host, line),
total AS (SELECT host, count(*) AS n FROM page WHERE host IS NOT NULL GROUP BY host),
bad AS (SELECT f.host, f.line FROM freq f JOIN total t USING (host)
        WHERE f.n >= {min_pages} AND f.n / t.n > {max_ratio}),
kept AS (SELECT l.r, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, count(*) AS n
         FROM line l LEFT JOIN bad b ON l.host = b.host AND l.line = b.line WHERE b.line IS NULL GROUP BY l.r)
SELECT p.page_id, p.host, CAST(len(p.lines) AS BIGINT) AS n_lines,
       CAST(len(p.lines) - coalesce(k.n, 0) AS BIGINT) AS n_dropped, coalesce(k.text, '') AS text
FROM page p LEFT JOIN kept k USING (r)"""
