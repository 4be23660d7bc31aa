"""Quality rules: counts on whole texts, and how far a text's histograms are from those of its language.

Main path: DataFrame functions only. A text is rejected by its base counts (too few words, too many words in repeated
five-word windows) or because the Jensen-Shannon distance of its character-class, mark or common-word histogram to the
reference of its language is above a limit. Marks are the classes of punctuation, symbols and other ASCII signs alone. The references are made over all documents of the language that the base counts do
not reject: the median share of each character class and of each kind of mark, which junk does not move, and summed
counts of the common words. Texts too short for a histogram to mean anything are judged by the base counts alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.llm.text_columns import fresh, let, words
from genoloom.session import materialize

#: Common words of four languages, in order of language.
COMMON_WORDS = (
    "the", "of", "and", "to", "a", "in", "that", "is", "for", "it", "was", "with",
    "la", "le", "les", "des", "et", "que", "dans", "un", "une", "du", "est", "pour",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "nicht", "ist", "ein", "auf",
    "el", "los", "y", "se", "del", "las", "por", "una", "no", "con", "su", "en", "de",
)
#: Character classes in the order in which they are taken out of a text; what is left is outside ASCII.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", "[\\x20\\x09-\\x0D]+", "[.,;:!?'\"()-]+", "[#*$%&|<>]+", "[\\x00-\\x7F]+")
SYMBOLS = 5
MARKS = slice(4, 7)
_CODES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Limits:
    """Distances are between 0 and 1; a histogram counts only from its least size on."""

    min_words: int = 10
    repeat_percent: int = 20
    window: int = 5
    max_class_distance: float = 0.33
    max_mark_distance: float = 0.5
    max_word_distance: float = 0.6
    min_chars: int = 200
    min_marks: int = 10
    min_histogram_words: int = 60
    min_reference_words: int = 2000


def _class_counts(text: Column) -> Column:
    """Code points of each class and of the rest, by taking one class out after the other."""

    def step(left: Column, rest: tuple[str, ...], counts: tuple[Column, ...]) -> Column:
        if not rest:
            return F.array(*counts, F.length(left))
        return let(F.regexp_replace(left, rest[0], ""), lambda after: step(after, rest[1:], (*counts, F.length(left) - F.length(after))))

    return let(text, lambda t: step(t, CLASSES, ()))


def _word_counts(text: Column) -> Column:
    """Counts of each common word, then of all other words of letters."""
    codes = F.create_map(*(F.lit(x) for w, c in zip(COMMON_WORDS, _CODES) for x in (w, c)))

    def counted(all_words: Column) -> Column:
        common = F.filter(all_words, lambda w: w.isin(*COMMON_WORDS))
        coded = F.array_join(F.transform(common, lambda w: F.element_at(codes, w)), "")
        return let(coded, lambda s: F.array(*(F.length(s) - F.length(F.replace(s, F.lit(c), F.lit(""))) for _, c in zip(COMMON_WORDS, _CODES)), F.size(all_words) - F.length(s)))

    return let(F.array_remove(F.split(F.lower(text), "[^\\p{L}]+", -1), ""), counted)


def _repeated(found: Column, window: int) -> Column:
    """Words in windows of ``window`` words that are found twice or more in the text."""
    n = F.size(found)
    hashes = F.when(n > window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*(F.get(found, i + k) for k in range(window))))).otherwise(F.array().cast("array<long>"))

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ranked, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        total = F.aggregate(places, start, lambda a, p: F.struct((p + window).alias("end"), (a["n"] + p + window - F.greatest(p, a["end"])).alias("n")))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), total["n"]).otherwise(0)

    return let(hashes, covered)


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def quality_counts(text: Column, limits: Limits = Limits()) -> Column:
    """A struct of the base counts, base_failed and both histograms of a text (null: empty)."""

    def of(t: Column) -> Column:
        return let(
            words(t),
            lambda w: let(
                F.struct(F.size(w).alias("n"), _repeated(w, limits.window).alias("r"), _class_counts(t).alias("c")),
                lambda x: F.struct(
                    x["n"].cast("long").alias("n_words"),
                    (F.length(t) - F.get(x["c"], F.lit(3))).cast("long").alias("word_chars"),
                    F.get(x["c"], F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                    _duplicate_lines(t).cast("long").alias("n_dup_lines"),
                    x["r"].cast("long").alias("n_repeat_words"),
                    ((x["n"] < limits.min_words) | (x["r"].cast("long") * 100 > x["n"].cast("long") * limits.repeat_percent)).alias("base_failed"),
                    x["c"].alias("classes"),
                    _word_counts(t).alias("common"),
                ),
            ),
        )

    return let(F.coalesce(text, F.lit("")), of)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of equal length, rounded to nine places; 0 if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def shares(a: Column) -> Column:
        return let(total(a), lambda t: F.transform(a, lambda x: F.when(t > 0, x / t).otherwise(0.0)))

    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    parts = let(F.struct(shares(p).alias("p"), shares(q).alias("q")), lambda s: F.zip_with(s["p"], s["q"], lambda x, y: (term(x, y) + term(y, x)) / 2))
    both = (total(p) > 0) & (total(q) > 0)
    return F.when(both, F.round(F.sqrt(F.greatest(F.lit(0.0), total(parts))), 9)).otherwise(0.0)


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits(), keep: tuple[str, ...] | None = None) -> tuple[DataFrame, str]:
    """docs (its columns, or those in ``keep``) with one struct column more, whose name is returned too.

    The struct has the counts, class_distance, mark_distance, word_distance and kept. Null text counts as empty and fails the base rule.
    A null language is a language of its own. A language with too little text for a reference is judged by the base
    counts alone. The counts are made once and written to the shared folder; references are mergeable aggregates over all of them.
    """
    q, ref = fresh(docs, "_quality"), fresh(docs, "_reference")
    lang = fresh(docs, "_lang")
    names = docs.columns if keep is None else list(keep)
    counted = docs.withColumn(q, quality_counts(F.col(text_col).cast("string"), limits)).withColumn(lang, F.coalesce(F.col(lang_col).cast("string"), F.lit("\0")))
    counted = materialize(counted.select(*names, lang, q), "quality-counts")
    k, m = len(CLASSES) + 1, len(COMMON_WORDS) + 1
    doubles = lambda a: F.transform(a, lambda v: v.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    marks = lambda a: F.slice(a, MARKS.start + 1, MARKS.stop - MARKS.start)
    good = counted.where(~F.col(q)["base_failed"]).select(lang, doubles(F.col(q)["classes"]).alias("c"), F.col(q)["common"].alias("w"))
    good = good.withColumn("n", total(F.col("c"))).withColumn("nm", total(marks(F.col("c"))))
    median = lambda x: F.percentile_approx(x, 0.5, 10000)
    aggs = [median(F.when(F.col("n") >= limits.min_chars, F.get("c", F.lit(i)) / F.col("n"))).alias(f"c{i}") for i in range(k)]
    aggs += [median(F.when(F.col("nm") >= limits.min_marks, F.get("c", F.lit(i)) / F.col("nm"))).alias(f"m{i}") for i in range(MARKS.start, MARKS.stop)]
    aggs += [F.sum(F.get("w", F.lit(i)).cast("long")).cast("double").alias(f"w{i}") for i in range(m)]
    column = lambda c, ids: F.array(*(F.coalesce(f"{c}{i}", F.lit(0.0)) for i in ids)).alias(c)
    refs = good.groupBy(lang).agg(*aggs).select(lang, F.struct(column("c", range(k)), column("m", range(MARKS.start, MARKS.stop)), column("w", range(m))).alias(ref))
    refs = materialize(refs, "quality-references")  # one row a language; Spark broadcasts it if its files are small
    joined = counted.join(refs, lang, "left")
    x, r = F.col(q), F.col(ref)
    trusted = F.coalesce(total(r["w"]) >= limits.min_reference_words, F.lit(False))
    n_chars = total(doubles(x["classes"]))
    n_hist = total(doubles(x["common"]))
    by_class = F.when(trusted & (n_chars >= limits.min_chars), distance(doubles(x["classes"]), r["c"])).otherwise(0.0)
    own_marks = marks(doubles(x["classes"]))
    by_mark = F.when(trusted & (total(own_marks) >= limits.min_marks), distance(own_marks, r["m"])).otherwise(0.0)
    by_word = F.when(trusted & (n_hist >= limits.min_histogram_words), distance(doubles(x["common"]), r["w"])).otherwise(0.0)
    scored = joined.withColumn(ref, F.struct(by_class.alias("class_distance"), by_mark.alias("mark_distance"), by_word.alias("word_distance")))
    near = [r[f"{h}_distance"] <= getattr(limits, f"max_{h}_distance") for h in ("class", "mark", "word")]
    kept = ~x["base_failed"] & near[0] & near[1] & near[2]
    base = [x[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return scored.select(*names, F.struct(*base, *(r[c].alias(c) for c in ("class_distance", "mark_distance", "word_distance")), kept.alias("kept")).alias(q)), q


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """(id, counts, base_failed, class_distance, mark_distance, word_distance, kept) of each row."""
    out, q = judge(docs, text_col, lang_col, limits, keep=(id_col,))
    return out.select(id_col, f"{q}.*")


def keep_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns."""
    out, q = judge(docs, text_col, lang_col, limits)
    return out.where(F.col(q)["kept"]).drop(q)
