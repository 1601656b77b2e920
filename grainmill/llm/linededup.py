"""Line dedup by site-relative frequency.

Method. A page is cut into lines at block markup; group by host; the share of a host's pages that contain a line is
its boilerplate ratio; lines above `ratio` (and on at least `min_pages` pages) are dropped from that host's pages.

Lines are counted by a 64-bit hash first and by their text only where the hash passes, so that little text is
shuffled. A page counts a line once, before any shuffle, and counts are added up map-side, so a hot host or a line on
every page is a few rows. A host's boilerplate lines number at most its mean lines a page over `ratio`; they go to all
executors while all hosts' lines together are within the broadcast limit, else pages join them by host, where Spark
splits hot hosts.

Defined results. Null html counts as empty: no lines, text ''. Pages without a host (null or relative url) keep all
lines. Character references stay as they are written. Lines are compared after trimming and folding ASCII white space;
empty lines are no lines. Repeated rows count as pages of their own. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, SPACE, cut, pick

#: Elements whose tags end a line (fixed values).
BLOCKS = "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BREAKS = rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def page_lines(html: Column) -> Column:
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), "<[^>]*>", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[\x09\x0B-\x0D ]+", " "), " ?\n[\n ]*", "\n")
    return F.filter(F.split(F.trim(text), "\n"), lambda x: x != "")


def line_dedup(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """(id, host, n_lines, n_dropped, text), one row for each row of pages; text: the lines that stay, by newlines."""
    rows = cut(pick(pages, {"id": F.col(id_col), "host": host(F.col(url_col)), "lines": page_lines(F.col(html_col))}))
    sited = rows.where("host <> ''")
    totals = sited.groupBy("host").agg(F.count("*").alias("pages"))
    once = sited.select("host", F.explode(F.array_distinct("lines")).alias("line")).withColumn("h", F.xxhash64("line"))
    often = (F.col("n") >= min_pages) & (F.col("n") > ratio * F.col("pages"))
    hashes = cut(once.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).join(totals, "host").where(often).select("host", "h"))
    few = hashes.count() * 48 <= BROADCAST_LIMIT
    likely = once.join(F.broadcast(hashes) if few else hashes, ["host", "h"], "left_semi")
    exact = likely.groupBy("host", "line").agg(F.count("*").alias("n")).join(totals, "host").where(often)
    drops = cut(exact.groupBy("host").agg(F.collect_list("line").alias("drops")))
    size = drops.agg(F.sum(F.length(F.concat_ws("", "drops")) + 64)).first()[0] or 0
    out = rows.join(F.broadcast(drops) if 4 * size <= BROADCAST_LIMIT else drops, "host", "left")
    stays = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("drops", x)))
    return out.withColumn("stays", stays).select("id", "host", F.size("lines").alias("n_lines"), (F.size("lines") - F.size("stays")).alias("n_dropped"), F.concat_ws("\n", "stays").alias("text"))
