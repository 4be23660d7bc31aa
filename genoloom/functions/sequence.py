"""Column functions on sequences: all are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from genoloom.functions import codon as C

#: IUPAC bases and their complements, upper and lower case.
IUPAC = "ACGTUWSMKRYBDHVNacgtuwsmkrybdhvn"
COMPLEMENT = "TGCAAWSKMYRVHDBNtgcaawskmyrvhdbn"
#: What an IUPAC letter stands for, as a character class.
IUPAC_CLASS = {"R": "[AG]", "Y": "[CT]", "S": "[GC]", "W": "[AT]", "K": "[GT]", "M": "[AC]", "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]", "N": "[ACGT]"}


def reverse_complement(seq: Column) -> Column:
    """IUPAC-aware reverse complement; other letters stay."""
    return F.reverse(F.translate(seq, IUPAC, COMPLEMENT))


def codon_list(seq: Column) -> Column:
    """In-frame codons, in one pass; a trailing partial codon is left out."""
    return F.regexp_extract_all(seq, F.lit("(?s)..."), F.lit(0))


def translate(seq: Column, number: int = 11, to_stop: bool = True, start_as_m: bool = True) -> Column:
    """Protein of a DNA column; unknown codons read X. Cut at the first stop if ``to_stop``; a valid start of a complete coding sequence reads M."""
    table = C.mapping(C.table(number))
    protein = F.array_join(F.transform(codon_list(F.upper(seq)), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")
    if start_as_m:
        body = F.substring_index(protein, "*", 1)
        whole = (F.length(seq) % 3 == 0) & (F.length(body) == F.length(protein) - 1) & protein.endswith("*") & F.substring(F.upper(seq), 1, 3).isin(*C.STARTS[number])
        protein = F.when(whole, F.concat(F.lit("M"), F.substring(protein, F.lit(2), F.length(protein)))).otherwise(protein)
    return F.substring_index(protein, "*", 1) if to_stop else protein


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of seq are among ``letters``."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def weighted(seq: Column, values: dict[str, float]) -> Column:
    """Sum of a value for each letter, by letter counts."""
    return sum((F.lit(float(v)) * count_of(seq, k) for k, v in values.items()), F.lit(0.0))


def rotate(seq: Column, k: Column | int) -> Column:
    """The sequence with its origin moved to position k (0-based, modulo the length)."""
    k = F.pmod(F.lit(k) if isinstance(k, int) else k, F.greatest(F.length(seq), F.lit(1)))
    return F.concat(F.substring(seq, k + 1, F.length(seq)), F.substring(seq, F.lit(1), k))


def junction_window(seq: Column, n: int) -> Column:
    """The last n bases with the last three in brackets, then the first n bases: the join of a circular sequence."""
    tail = F.right(seq, F.lit(n))
    return F.concat(F.substring(tail, F.lit(1), F.greatest(F.length(tail) - 3, F.lit(0))), F.lit("["), F.right(tail, F.lit(3)), F.lit("]"), F.left(seq, F.lit(n)))


def highlight(seq: Column, start: Column, stop: Column) -> Column:
    """Lower case but for [start, stop)."""
    return F.concat(F.lower(F.substring(seq, F.lit(1), start)), F.upper(F.substring(seq, start + 1, stop - start)), F.lower(F.substring(seq, stop + 1, F.length(seq))))


#: The terms of the melting temperature: degrees for A/T and G/C of short oligos; then the base, the GC
#: factor and offset without salt; the factor of log10 of salt and the salt of short oligos; base and length term with salt.
TM_SHORT_AT, TM_SHORT_GC, TM_SHORT_BELOW = 2.0, 4.0, 14
TM_BASE, TM_GC, TM_GC_OFFSET = 64.9, 41.0, 16.4
TM_SALT, TM_SHORT_SODIUM, TM_SALT_BASE, TM_SALT_LENGTH = 16.6, 0.050, 100.5, 820.0


def melting_temp(seq: Column, sodium: float | None = None) -> Column:
    """Melting temperature of an oligo: by base counts below 14 bases, by GC share from there; with or without salt (mol/l)."""
    a, c, g, t = (count_of(seq, x) for x in "ACGT")
    n = F.length(seq)
    short = TM_SHORT_AT * (a + t) + TM_SHORT_GC * (g + c)
    if sodium is None:
        long = TM_BASE + F.try_divide(TM_GC * (g + c - TM_GC_OFFSET), n)
    else:
        salt = TM_SALT * F.log10(F.lit(sodium))
        short = short - TM_SALT * F.log10(F.lit(TM_SHORT_SODIUM)) + salt
        long = TM_SALT_BASE + F.try_divide(TM_GC * (g + c), n) - F.try_divide(F.lit(TM_SALT_LENGTH), n) + salt
    return F.when(n < TM_SHORT_BELOW, short).otherwise(long)


#: Masses of nucleotides within an oligo, and what its ends lack.
BASE_MASS = {"A": 313.21, "T": 304.2, "C": 289.18, "G": 329.21}
END_MASS = 61.96


def oligo_mass(seq: Column) -> Column:
    """Mass of a single strand."""
    return weighted(seq, BASE_MASS) - END_MASS


def iupac_pattern(site: Column) -> Column:
    """A recognition sequence as a regular expression."""
    out = site
    for k, v in IUPAC_CLASS.items():
        out = F.replace(out, F.lit(k), F.lit(v.lower()))
    return F.upper(out)
