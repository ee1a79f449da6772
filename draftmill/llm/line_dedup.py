"""Operator 8: drop lines that a site repeats on many of its pages.

A line's frequency is relative to its site: the pages of a host that contain
it, divided by all pages of the host.  Lines over the boilerplate ratio go.

Only DataFrame functions.  Counting is map-side combined on (host, line), so a
host with a third of all pages costs no more than any other.  Per host the
lines over the ratio number fewer than its mean distinct lines a page divided
by the ratio, so they fit an array; pages are then cleaned row by row against
their host's array, without exploding and regrouping them.

Patterns run over whole pages of any length: none repeats a group, and no tag
reaches beyond the next ``<``, so a search takes linear time and no recursion.
A comment, script or style without an end goes on to the end of the page.

Edge cases: null html or text is one empty page; a null or unparsable URL has
the host ''; repeated rows are pages in their own right; a line on one page
alone is never boilerplate, as every line of a lone page has ratio 1; pages
without line ends and very long pages are handled like others; columns of the
input that clash with working names come through; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmill.llm.common import HOT_SHARE, free_name, save

#: Boilerplate arrays are broadcast up to this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
#: Removed without a line break: comments, scripts, styles, inline tags.
INLINE_PATTERN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|</?(?:a|abbr|b|code|em|font|i|mark|s|small|span|strong|sub|sup|u)(?:\s[^<>]*)?>"
#: Any other tag, and line ends, part lines; what they leave empty goes.
BREAK_PATTERN = r"<[^<>]*>|[\r\n]"
#: A line on this many pages at least may be boilerplate.
LEAST_PAGES = 2
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST_PATTERN, 1))


def html_lines(html: Column) -> Column:
    """Visible lines of a page, trimmed, without empty ones."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), INLINE_PATTERN, "")
    lines = F.split(text, BREAK_PATTERN)

    def clean(line: Column) -> Column:
        for entity, char in ENTITIES:
            line = F.replace(line, F.lit(entity), F.lit(char))
        return F.trim(line)

    return F.filter(F.transform(lines, clean), lambda x: x != "")


def drop_site_boilerplate(df: DataFrame, host: Column, lines: Column, ratio: float = 0.3) -> DataFrame:
    """df with ``host``, ``n_lines``, ``n_dropped`` and ``clean_text`` added; columns of df by these names are replaced."""
    all_lines, bad, all_host, hot_bad, key = free_name(df, "lines", "bad", "host", "hot", "key")
    pages = df.select("*", host.alias(all_host), lines.alias(all_lines))
    totals = save(pages.groupBy(all_host).agg(F.count("*").alias("pages")), "site-pages")
    # Hosts of over HOT_SHARE of all pages, of which there are at most 1 / HOT_SHARE, meet their rows by broadcast.
    everything = totals.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    hot = totals.where(F.col("pages") > everything * HOT_SHARE)
    seen = pages.select(all_host, F.explode(F.array_distinct(all_lines)).alias("line")).groupBy(all_host, "line").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    seen = seen.join(F.broadcast(hot.withColumnRenamed("pages", "hot_pages")), all_host, "left")
    # Their lines look for no total in the shuffled join, under keys that spread them.
    seen = seen.withColumn(key, F.when(F.col("hot_pages").isNull(), F.col(all_host)).otherwise(F.concat(F.lit("\0"), "line")))
    seen = seen.join(totals.select(F.col(all_host).alias(key), F.col("pages").alias("light_pages")), key, "left").withColumn("pages", F.coalesce("hot_pages", "light_pages"))
    # At most a few lines a host are left, so the arrays stay short.
    often = seen.where(F.col("n") > F.lit(ratio) * F.col("pages")).groupBy(all_host).agg(F.collect_list("line").alias(bad), F.max("hot_pages").alias("hot_pages"))
    often = save(often, "boilerplate")
    held = often.agg(F.coalesce(F.sum(F.octet_length(F.to_json(bad)) + 64), F.lit(0))).first()[0]
    if held <= BROADCAST_BYTES:
        joined = pages.join(F.broadcast(often.drop("hot_pages")), all_host, "left")
    else:
        joined = pages.join(F.broadcast(often.where("hot_pages is not null").select(all_host, F.col(bad).alias(hot_bad))), all_host, "left")
        spread = F.concat(F.lit("\0"), F.xxhash64(all_lines).cast("string"))
        light = often.where("hot_pages is null").select(F.col(all_host).alias(key), bad)
        joined = joined.withColumn(key, F.when(F.col(hot_bad).isNull(), F.col(all_host)).otherwise(spread)).join(light, key, "left").withColumn(bad, F.coalesce(hot_bad, bad))
    # The page's own boilerplate first, by a hash of the host's: few lines to look each line up in.
    own = F.array_intersect(all_lines, bad)
    kept = F.when(F.col(bad).isNull(), F.col(all_lines)).otherwise(F.get(F.transform(F.array(own), lambda o: F.filter(all_lines, lambda x: ~F.array_contains(o, x))), F.lit(0)))
    fresh = [c for c in df.columns if c.lower() not in ("host", "n_lines", "n_dropped", "clean_text")]
    kept_name = f"{bad}k"
    return joined.withColumn(kept_name, kept).select(
        *fresh,
        F.col(all_host).alias("host"),
        F.size(all_lines).cast("long").alias("n_lines"),
        (F.size(all_lines) - F.size(kept_name)).cast("long").alias("n_dropped"),
        F.array_join(kept_name, "\n").alias("clean_text"),
    )
