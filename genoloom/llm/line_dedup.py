"""Removal of lines that spread over many sites, by HyperLogLog sketches of the sites of each line.

Main path: DataFrame functions only. Sketches of each line's sites merge by aggregation; a line whose estimate is well
above the limit is boilerplate, one well below is not, and lines near the limit get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.llm.text_columns import fresh
from genoloom.session import materialize


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _normal(line: Column) -> Column:
    """What makes two lines the same: the line without blanks, tabs and returns at its ends."""
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate_lines(rows: DataFrame, min_sites: int, margin: float = 0.1, lg_k: int = 12) -> DataFrame:
    """(h1, h2, first): hashes of the lines that are on at least ``min_sites`` sites, and their first place.

    rows: (h1, h2, site, place). margin is over three times the sketches' relative standard error (1.04 / 2**(lg_k/2)),
    and estimates within it of the limit are settled by exact counts.
    """
    sketched = rows.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.min("place").alias("first"))
    sketched = materialize(sketched.where(F.col("sites") >= min_sites * (1 - margin)), "line-sketches")
    near = sketched.where(F.col("sites") < min_sites * (1 + margin))
    exact = rows.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("exact")).where(F.col("exact") >= min_sites)
    return sketched.where(F.col("sites") >= min_sites * (1 + margin)).select("h1", "h2", "first").unionByName(near.join(exact.select("h1", "h2"), ["h1", "h2"]).select("h1", "h2", "first"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, removed_col: str | None = None) -> DataFrame:
    """docs with every line that is on ``min_sites`` sites or more taken out of all texts but its first place.

    Lines end at newline and are compared without blanks at their ends; lines without a visible character stay. A null
    site is one site. The first place is the smallest (id, line number); it stays, so no text is lost wholly. Rows of equal
    id and text are one document and keep the same lines; rows with a null id keep their text, and count for the spread.
    Null texts stay null. ``removed_col`` adds the number of lines taken out. Row count and order of lines never change.
    """
    th = fresh(docs, "_text_hash")
    keyed = docs.withColumn(th, F.xxhash64(text_col))
    cells = keyed.select(F.col(id_col).alias("id"), F.col(th).alias("th"), F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("n")).alias("site"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    line = _normal(F.col("line"))
    rows = cells.where(line.rlike("[^\\x20\\x09-\\x0D]")).select("id", "th", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("2"), line).alias("h2"))
    rows = materialize(rows, "lines").withColumn("place", F.when(F.col("id").isNotNull(), F.struct("id", "pos")))
    spread = boilerplate_lines(rows, min_sites)
    gone = rows.where(F.col("id").isNotNull()).join(spread, ["h1", "h2"]).where(F.col("place") != F.col("first"))
    lists = gone.groupBy("id", "th").agg(F.collect_set("pos").alias("gone"))  # at most a document's own lines
    lists = lists.withColumnsRenamed({"id": fresh(keyed, "_id"), "th": fresh(keyed, "_th"), "gone": fresh(keyed, "_gone")})
    i, t, g = lists.columns
    joined = keyed.join(lists, (F.col(id_col) == F.col(i)) & (F.col(th) == F.col(t)), "left")
    every = _lines(F.col(text_col))
    left = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col(g))
    # The array of lines is bound once a row; positions index it.
    kept = F.get(F.transform(F.array(F.struct(every.alias("x"), left.alias("left"))), lambda s: F.array_join(F.transform(s["left"], lambda p: F.get(s["x"], p)), "\n")), F.lit(0))
    text = F.when(F.col(g).isNull(), F.col(text_col)).otherwise(kept)
    cols = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if removed_col:
        cols.append(F.coalesce(F.size(F.when(F.col(g).isNotNull(), F.col(g))), F.lit(0)).cast("long").alias(removed_col))
    return joined.select(*cols)
