"""Caption files as transcripts: cues parsed, rolling lines merged, all by column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A cue's times, with or without hours, with a point or a comma.
TIMES = r"(?m)^\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{3})\s*-->\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{3})"


def seconds(stamp):
    """``h:m:s.f`` as seconds."""
    parts = F.reverse(F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":"))
    at = lambda k: F.coalesce(F.get(parts, F.lit(k)).cast("double"), F.lit(0.0))
    return F.round(at(0) + at(1) * 60 + at(2) * 3600, 3)


def cues(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, cue, begin, end, lines): the cues of each file in order; headers, notes and numbers of cues are left out."""
    blocks = F.split(F.regexp_replace(F.col(text_col), "\r\n?", "\n"), r"\n[ \t]*\n")
    rows = files.select(id_col, F.posexplode(blocks).alias("block", "body")).where(F.col("body").rlike(TIMES))
    after = F.regexp_replace("body", rf"(?sm)\A.*?{TIMES[4:]}[^\n]*\n?", "")
    plain = F.regexp_replace(F.regexp_replace(after, r"<[^<>\n]*>", ""), r"[ \t]+", " ")
    lines = F.filter(F.transform(F.split(plain, "\n"), F.trim), lambda x: x != "")
    stamp = lambda n: seconds(F.regexp_extract("body", TIMES, n))
    return rows.select(id_col, F.col("block").alias("cue"), stamp(1).alias("begin"), stamp(2).alias("end"), lines.alias("lines"))


def transcripts(files: DataFrame, id_col: str, text_col: str, out_col: str = "text") -> DataFrame:
    """One text per file that has cues; a line shown again by the next cue, as captions that roll do, counts once."""
    found = cues(files, id_col, text_col)
    lines = found.select(id_col, F.col("begin"), "cue", F.posexplode("lines").alias("place", "line"))
    order = Window.partitionBy(id_col).orderBy("begin", "cue", "place")
    said = lines.withColumn("before", F.lag("line").over(order)).where(F.col("before").isNull() | (F.col("before") != F.col("line")))
    # a file's lines are no more than the file
    whole = F.array_sort(F.collect_list(F.struct("begin", "cue", "place", "line")))
    return said.groupBy(id_col).agg(F.array_join(F.transform(whole, lambda x: x["line"]), " ").alias(out_col))


def fetcher(files: DataFrame):
    """For :func:`tesserae.sources.loaders.load`: contents of video URLs that have a caption file (url, captions)."""
    by_url = transcripts(files.dropDuplicates(["url"]), "url", "captions", "content").withColumnRenamed("url", "_url")
    return lambda rows: rows.join(by_url, rows["fetch_url"] == by_url["_url"], "left").drop("_url")
