"""Mixing sources to target weights by systematic sampling within each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.llm.text_columns import fresh, words
from genoloom.operators.ordered import ordered_positions
from genoloom.session import materialize


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """sources(is_null, source, source_size) with ``target`` and ``rate``, the copies that a document of the source expects.

    Sources by code point, null last, weigh ``weights`` in turn and share the summed sizes. No target is above ``most``
    times its source's size; the excess is shared again by weight until none is above. Each round takes two sums from the
    source table; the level only rises, so the rounds end after at most as many as there are sources that get capped.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    ranked = ordered_positions(sources.withColumn("_all", F.lit(0)), ["_all"], [F.col("is_null"), F.col("source").asc_nulls_last()], "_rank").drop("_all")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("is_null", "source", "source_size", weight.alias("_w"), (most * F.col("source_size")).alias("_cap")), "mix-sources")
    total, shared = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    level, capped = (total or 0) / (shared or 1), -1
    while True:
        over = F.col("_w") * F.lit(level) > F.col("_cap")
        n, caps, rest = ranked.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0.0)), F.sum(F.when(~over, F.col("_w")))).first()
        if n == capped or not rest:
            break
        level, capped = ((total or 0) - caps) / rest, n
    over = F.col("_w") * F.lit(level) > F.col("_cap")
    target = F.when(over, F.col("_cap")).otherwise(F.col("_w") * F.lit(level))
    rate = F.when(over, F.lit(most)).when(F.col("source_size") > 0, F.least(F.lit(most), target / F.col("source_size"))).otherwise(0.0)
    return ranked.select("is_null", "source", "source_size", target.alias("target"), rate.alias("rate"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: id, source, size, source_size, target, copies, taken (and the columns in ``keep``).

    A document's expected copies, its source's rate, are summed along the source in order of size and id; one offset for
    each source, drawn from ``seed``, is added; the document comes out once for each whole number that its interval
    crosses. In order of size, what a source gives differs from its target by about one document. Null text has size 0;
    null sources are one source, the last; a source without words has target 0 and gives nothing. Reruns agree.
    """
    text = F.col(text_col)
    src = F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), src.isNull().alias("is_null"), F.coalesce(src, F.lit("")).alias("source"), F.size(words(text)).cast("long").alias("size"), F.xxhash64(text).alias("_tie"), *(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)))
    placed = ordered_positions(rows, ["is_null", "source"], [F.col("size"), F.col("_id"), F.col("_tie")], "_at")
    placed = materialize(placed, "mix-placed")
    sources = placed.groupBy("is_null", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, most)
    rate, at = F.col("rate"), F.col("_at").cast("double")
    # The offset: 52 bits of a digest of seed and source, as a fraction of 1.
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("is_null").cast("string"), F.lit(":"), F.col("source"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    copies = (F.floor(offset + (at + 1) * rate) - F.floor(offset + at * rate)).cast("long")
    out = placed.join(targets, ["is_null", "source"])
    return out.select(
        F.col("_id").alias(id_col), F.when(~F.col("is_null"), F.col("source")).alias("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"),
        *(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)),
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7) -> DataFrame:
    """The documents that the mix takes, each repeated as often as it is taken, with the columns of docs."""
    h1, h2, copies = (fresh(docs, c) for c in ("_h1", "_h2", "_copies"))
    told = [*docs.columns, *(F.col(c).isNull() for c in docs.columns)]
    rows = docs.withColumns({h1: F.xxhash64(*told), h2: F.xxhash64(F.lit(1), *told)})
    # Equal rows are taken together: one of them stands for all, with the sum of their copies.
    taken = mix_plan(rows, id_col, text_col, source_col, weights, most, seed, keep=(h1, h2)).where("copies > 0").groupBy(h1, h2).agg(F.sum("copies").alias(copies))
    one = F.row_number().over(Window.partitionBy(h1, h2).orderBy(F.lit(0)))
    joined = rows.join(taken, [h1, h2]).withColumn(fresh(docs, "_one"), one).where(F.col(fresh(docs, "_one")) == 1)
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
