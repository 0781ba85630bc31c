"""Contents by URL: which loader takes a row, what none can load, and pages joined to documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import google_export_url, loader_of

#: Fixed value: what stands between the pages of a document.
PAGE_BREAK = "\n\n\n\n"


def join_pages(pages: DataFrame, document: str, number: str, text: str, out_col: str = "text") -> DataFrame:
    """One text per document, its pages in order; a page without text counts as empty.

    A group is one document's pages, so it is no larger than the text it makes.
    """
    page = F.struct(F.col(number).alias("n"), F.coalesce(text, F.lit("")).alias("t"))
    ordered = F.array_sort(F.collect_list(page))
    return pages.groupBy(document).agg(F.array_join(F.transform(ordered, lambda p: p["t"]), PAGE_BREAK).alias(out_col))


def fault(kind: Column, available: list[str]) -> Column:
    """Why a row of this loader can't be loaded; null if it can."""
    return (
        F.when(kind.isNull(), F.lit("no url"))
        .when(kind == "image", F.lit("images are not supported"))
        .when(~kind.isin(available), F.concat(F.lit("no loader for "), kind))
    )


def load(rows: DataFrame, fetchers: dict[str, Callable[[DataFrame], DataFrame]], url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """Loaded rows with ``content``, and failed ones with ``reason``.

    A fetcher gets its rows with ``fetch_url`` and adds ``content``; one that
    leaves it null has failed.  Loaders without a fetcher fail.
    """
    kind = loader_of(F.col(url_col))
    marked = rows.withColumn("loader", kind).withColumn("reason", fault(kind, sorted(fetchers)))
    target = F.when(F.col("loader") == "google-doc", google_export_url(F.col(url_col))).otherwise(F.col(url_col))
    good, failed = marked.where("reason is null").withColumn("fetch_url", target), marked.where("reason is not null")
    loaded = None
    for name in sorted(fetchers):
        got = fetchers[name](good.where(F.col("loader") == name))
        loaded = got if loaded is None else loaded.unionByName(got)
    if loaded is None:
        loaded = good.withColumn("content", F.lit(None).cast("string"))
    missed = loaded.where("content is null").withColumn("reason", F.lit("nothing fetched"))
    return loaded.where("content is not null").drop("reason", "fetch_url"), failed.unionByName(missed.select(failed.columns))
