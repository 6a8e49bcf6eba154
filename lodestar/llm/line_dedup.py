"""Line de-duplication by site-relative frequency, in DataFrame functions only.

Text is split at ``\\n`` only. A line counts once per page of its host; the
share of the host's pages that hold it is its boilerplate ratio. Every
occurrence of a line whose ratio exceeds the limit is dropped.

* A line without a word (only space or control characters) is never dropped.
* A null host is a host of its own; a null text has no lines and stays null.
* A line must stand on ``min_pages`` pages, two as a rule: one page is no evidence of
  repetition, whatever its share of a small host.
* Repeated rows are pages of their own. Rows are never dropped, only lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a host's pages above which a line is boilerplate.
BOILERPLATE_RATIO = 0.1
#: Pages that must hold a line before it can be boilerplate.
MIN_PAGES = 2
#: A host above 1/HOT_SHARE of all pages is split; there are at most HOT_SHARE such hosts.
HOT_SHARE = 1000
#: Parts into which the rows of a split host are dealt for the join.
PARTS = 64

_WORD = r"[^\x00-\x20]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = BOILERPLATE_RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """One row per boilerplate line: ``host``, ``line_hash``, ``n_pages``, ``host_pages``."""
    slim = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = slim.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    # Lines travel as 64-bit hashes; a line counts once per page.
    hashes = F.array_distinct(
        F.transform(F.filter(_lines(F.col("text")), lambda x: x.rlike(_WORD)), lambda x: F.xxhash64(x))
    )
    counted = (
        slim.select("host", F.explode(hashes).alias("line_hash"))
        .groupBy("host", "line_hash")
        .agg(F.count(F.lit(1)).alias("n_pages"))
        .where(F.col("n_pages") >= min_pages)
    )
    return (
        counted.alias("c")
        .join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
        .where(F.col("n_pages") > F.lit(ratio) * F.col("host_pages"))
        .select("c.host", "line_hash", "n_pages", "host_pages")
    )


def drop_boilerplate(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = BOILERPLATE_RATIO,
    min_pages: int = MIN_PAGES,
    dropped: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``; other columns unchanged.

    ``dropped`` and ``total`` name columns to add: lines taken out, and lines before.

    The lines of a host are few (their shares add up to the mean lines of a
    page), so they are joined as one array per host. Rows of hot hosts are
    dealt to PARTS keys; the list of hot hosts is bounded by HOT_SHARE.
    """
    # The caller's columns travel as one, so that none can clash with those made here.
    rows = pages.select(F.struct("*").alias("row"))
    own_host, own_text = F.col("row").getField(host), F.col("row").getField(text)
    totals = pages.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    every = pages.agg(F.count(F.lit(1))).scalar()
    # At most HOT_SHARE rows by arithmetic, whatever the data.
    hot = totals.where(F.col("n") * HOT_SHARE > every)
    hot = hot.select(F.col("host").alias("hot_host"), F.lit(PARTS).alias("parts"))
    bad = (
        boilerplate_lines(pages, host, text, ratio, min_pages)
        .groupBy("host")
        .agg(F.collect_set("line_hash").alias("bad"))
        .join(F.broadcast(hot), F.col("host").eqNullSafe(F.col("hot_host")), "left")
        .select(
            F.col("host").alias("bad_host"),
            "bad",
            F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("bad_part"),
        )
    )
    deal = F.xxhash64(own_text, *([] if "doc_id" not in pages.columns else [F.col("row.doc_id")]))
    dealt = rows.join(F.broadcast(hot), own_host.eqNullSafe(F.col("hot_host")), "left").select(
        "row", F.pmod(deal, F.coalesce(F.col("parts"), F.lit(1))).cast("int").alias("part")
    )
    joined = dealt.join(bad, own_host.eqNullSafe(F.col("bad_host")) & (F.col("part") == F.col("bad_part")), "left")
    lines = _lines(own_text)
    kept = F.filter(lines, lambda x: ~(F.array_contains("bad", F.xxhash64(x)) & x.rlike(_WORD)))
    columns = []
    for name in pages.columns:
        column = F.col("row").getField(name)
        if name == text:
            column = F.when(F.col("bad").isNull(), column).otherwise(F.array_join(kept, "\n"))
        columns.append(column.alias(name))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    if dropped:
        gone = F.when(F.col("bad").isNull() | own_text.isNull(), 0).otherwise(n_lines - F.size(kept))
        columns.append(F.coalesce(gone, F.lit(0)).cast("bigint").alias(dropped))
    if total:
        columns.append(F.when(own_text.isNull(), 0).otherwise(n_lines).cast("bigint").alias(total))
    return joined.select(*columns)
