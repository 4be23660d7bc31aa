"""Codon tables as literal map columns, and per-letter values of residues and bases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "TCAG"
#: Residues of the 64 codons in the order of BASES at each place, for translation tables 1, 4 and 11.
TABLES = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    4: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    11: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
}
#: Start codons of the same tables.
STARTS = {1: ("TTG", "CTG", "ATG"), 4: ("TTA", "TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG"), 11: ("TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG")}
#: Names of the stop codons.
STOP_NAMES = {"TAG": "Amber", "TAA": "Ochre", "TGA": "Opal"}
#: Hydropathy of residues on the Kyte-Doolittle scale.
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def codons() -> list[str]:
    """The 64 codons in table order."""
    return [a + b + c for a in BASES for b in BASES for c in BASES]


def table(number: int = 1) -> dict[str, str]:
    """Codon to residue of a translation table."""
    return dict(zip(codons(), TABLES[number]))


def mapping(values: dict) -> Column:
    """A literal map column."""
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def stops(number: int = 1) -> list[str]:
    """Stop codons of a table."""
    return [c for c, r in table(number).items() if r == "*"]
