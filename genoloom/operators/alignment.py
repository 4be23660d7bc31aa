"""Comparison of two annotations by aligned sequences.

Coding features of both sides are ranked along their record; features whose ranks differ by no more than a limit meet in
blocks of ranks (a feature is sent to the few blocks that its band touches, not once for each partner), and a bit-parallel
kernel gives the longest common subsequence of each pair, which is the score of a global alignment that pays 1 for a match
and nothing for mismatches and gaps.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.locations import part_sequences, with_parts
from genoloom.operators.ordered import ordered_positions

BLOCK_RANKS = 64


class Subsequence:
    """Longest common subsequences with one text: a bit for each of its characters, a step for each character of the other."""

    def __init__(self, text: str):
        self.text, self.count = text, Counter(text)
        turned = text[::-1]
        self.masks = {c: int("".join(["1" if x == c else "0" for x in turned]), 2) for c in self.count}
        self.full = (1 << len(text)) - 1

    def length(self, other: str) -> int:
        v, full, none = self.full, self.full, 0
        for mask in [self.masks.get(c, none) for c in other]:
            u = v & mask
            v = ((v + u) | (v - u)) & full
        return len(self.text) - v.bit_count()

    def identity(self, other: str, least: float) -> float | None:
        """Common length over the longer text's, or None if it is below ``least``; bounds by length and letters come first."""
        longer = max(len(self.text), len(other))
        if not longer or min(len(self.text), len(other)) < least * longer:
            return None
        if self.text == other:
            return 1.0
        if sum((self.count & Counter(other)).values()) < least * longer:
            return None
        found = self.length(other) / longer
        return found if found >= least else None


def _banded_pairs(a: DataFrame, b: DataFrame, least: float, band: int) -> DataFrame:
    """(record, a, b, apart, identity) of the pairs of ranked sequences (record, id, rank, seq) within ``band`` ranks that reach ``least``."""
    blocks = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BLOCK_RANKS), F.floor(hi / BLOCK_RANKS)))
    left = a.withColumns({"block": F.floor(F.col("rank") / BLOCK_RANKS), "side": F.lit(0)})
    right = b.withColumn("block", blocks(F.greatest(F.col("rank") - band, F.lit(0)), F.col("rank") + band)).withColumn("side", F.lit(1))
    laid = left.unionByName(right).repartition("record", "block").sortWithinPartitions("record", "block", "side", "rank")
    kind = dict(a.dtypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for x in batches:
            yield from x.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for _, group in groupby(rows(batches), lambda r: (r["record"], r["block"])):
            sides: tuple[list, list] = ([], [])
            for r in group:
                sides[r["side"]].append(r)
            first = 0
            for x in sides[0]:
                while first < len(sides[1]) and sides[1][first]["rank"] < x["rank"] - band:
                    first += 1
                kernel = None
                for y in sides[1][first:]:
                    if y["rank"] > x["rank"] + band:
                        break
                    kernel = kernel or Subsequence(x["seq"])
                    same = kernel.identity(y["seq"], least)
                    if same is not None:
                        found.append({"record": x["record"], "a": x["id"], "b": y["id"], "apart": abs(x["rank"] - y["rank"]), "identity": same})
            if len(found) >= 4096:
                yield pa.RecordBatch.from_pylist(found)
                found = []
        if found:
            yield pa.RecordBatch.from_pylist(found)

    return laid.mapInArrow(run, f"record {kind['record']}, a {kind['id']}, b {kind['id']}, apart long, identity double")


def _ranked(cds: DataFrame, seqs: DataFrame, key: str) -> DataFrame:
    """Coding features (record, id, rank, seq, and what is told of them), ranked by start, stop and id."""
    have = lambda c: F.col(c) if c in cds.columns else F.lit(None).cast("string").alias(c)
    slim = with_parts(cds).select(F.col(key).alias("record"), F.col("feature_id").alias("id"), "start", "stop", "strand", "parts", have("product"), have("note"))
    placed = ordered_positions(slim.withColumn("_group", F.struct("record")), ["_group"], [F.col("start"), F.col("stop"), F.col("id")], "rank").drop("_group")
    return part_sequences(placed, seqs, "record").drop("parts")


def _place(x: str) -> Column:
    """(start-stop strand, n bp) of one side."""
    sign = F.when(F.col(f"{x}.strand") > 0, "+").otherwise("-")
    bases = F.col(f"{x}.stop") - F.col(f"{x}.start")
    return F.concat(F.lit("("), F.col(f"{x}.start").cast("string"), F.lit("-"), F.col(f"{x}.stop").cast("string"), F.lit(" "), sign, F.lit(", "), bases.cast("string"), F.lit(" bp)"))


def annotation_compare(a: DataFrame, b: DataFrame, seqs_a: DataFrame, seqs_b: DataFrame | None = None, least: float = 0.7, skipped: int = 10, key: str = "record_id") -> DataFrame:
    """(record, first, second, similarity, identity, length_difference, length_class, hypothetical, place and product and note of both) of coding features.

    Two features match if at least ``least`` of the longer one's bases align, their ranks in their records differ by
    ``skipped`` at most, and each is the other's best (by identity, then rank difference, then id). This is not a greedy walk along
    both lists, so a long stretch that only one side has moves all later ranks and should be compared with a larger
    ``skipped``. identity is in percent, 0 for features without a match; products and notes are taken from columns of these
    names. Features of records without a sequence are left out; empty features match nothing.
    """
    x, y = _ranked(a, seqs_a, key), _ranked(b, seqs_a if seqs_b is None else seqs_b, key)
    slim = lambda d: d.select("record", "id", "rank", "seq")
    pairs = _banded_pairs(slim(x), slim(y), least, skipped)
    best = lambda own, other: F.row_number().over(Window.partitionBy("record", own).orderBy(F.desc("identity"), "apart", other))  # noqa: E731  2 * skipped + 1 rows at most
    pairs = pairs.withColumns({"_r1": best("a", "b"), "_r2": best("b", "a")}).where("_r1 = 1 and _r2 = 1").select("record", "a", "b", "identity")
    told = ("id", "start", "stop", "strand", "product", "note")
    side = lambda d, name: d.select(F.col("record"), F.col("id").alias(f"_{name}"), F.struct(*told, F.length("seq").alias("bases")).alias(name))
    one, two = side(x, "x"), side(y, "y")
    met = one.join(pairs.withColumnRenamed("a", "_x").withColumnRenamed("b", "_y"), ["record", "_x"], "left").join(two, ["record", "_y"], "full")
    identity, matched = F.col("identity"), F.col("identity").isNotNull()
    similarity = F.when(identity == 1, "Exact match").when(matched, "Inexact match").when(F.col("y.id").isNull(), "In First but not Second").otherwise("In Second but not First")
    difference = F.when(matched, F.col("x.bases") - F.col("y.bases"))
    length_class = F.when(difference == 0, "Same Length").when(difference > 0, "First Longer").when(difference < 0, "Second Longer")
    unknown = lambda c: F.coalesce(F.contains(F.lower(F.col(f"{c}.product")), F.lit("hypothetical")), F.lit(False))
    hypothetical = F.when(matched, F.when(unknown("x") & unknown("y"), "Hypothetical").when(unknown("x"), "No Longer Hypothetical").when(unknown("y"), "Became Hypothetical").otherwise("Not Hypothetical"))
    return met.select(
        F.col("record").alias(key), F.col("x.id").alias("first"), F.col("y.id").alias("second"), similarity.alias("similarity"), F.coalesce(F.round(identity * 100, 2), F.lit(0.0)).alias("identity"),
        difference.cast("long").alias("length_difference"), length_class.alias("length_class"), hypothetical.alias("hypothetical"), _place("x").alias("first_place"), _place("y").alias("second_place"),
        F.col("x.product").alias("first_product"), F.col("y.product").alias("second_product"), F.col("x.note").alias("first_note"), F.col("y.note").alias("second_note"),
    )


def annotation_summary(compared: DataFrame) -> DataFrame:
    """One row of counts over an ``annotation_compare`` table: features of both sides, exact and inexact matches by length class, features of one side, changes from or to hypothetical."""
    n = lambda c: F.count_if(c).alias
    is_, inexact = lambda c, v: F.col(c) == v, F.col("similarity") == "Inexact match"
    return compared.agg(
        F.count("first").alias("features_first"), F.count("second").alias("features_second"), n(is_("similarity", "Exact match"))("exact"), n(inexact)("inexact"),
        *(n(inexact & is_("length_class", v))(name) for v, name in (("Same Length", "same_length"), ("First Longer", "first_longer"), ("Second Longer", "second_longer"))),
        n(is_("similarity", "In First but not Second"))("only_first"), n(is_("similarity", "In Second but not First"))("only_second"),
        n(F.col("hypothetical").isin("No Longer Hypothetical", "Became Hypothetical"))("hypothetical_change"), n(F.col("hypothetical").isin("Hypothetical", "Became Hypothetical"))("hypothetical"),
    )
