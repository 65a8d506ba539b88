"""Column expressions over whole sequences: no residue is exploded, all stays in one projection."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from peptora.functions.tables import HYDROPATHY10, RESIDUES


def letters(text: Column) -> Column:
    """A text's ASCII letters in upper case; others go first, as upper-casing may change their number."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]+", ""))


def normalised(sequence: Column) -> Column:
    return F.upper(F.regexp_replace(sequence, r"\s", ""))


def count_of(sequence: Column, aa: str) -> Column:
    """How often any of the letters ``aa`` occurs."""
    n = F.octet_length(sequence)
    found = [n - F.octet_length(F.replace(sequence, F.lit(a), F.lit(""))) for a in aa]
    return sum(found[1:], found[0]).cast("long")


def fraction_of(sequence: Column, aa: str) -> Column:
    """Share of the letters ``aa``; null for an empty sequence."""
    n = F.length(sequence)
    return F.when(n > 0, count_of(sequence, aa).cast("double") / n)


def charged_fraction(sequence: Column) -> Column:
    """FCR: the share of D, E, K and R, whatever else the sequence holds."""
    return fraction_of(sequence, "DEKR")


def is_standard(sequence: Column) -> Column:
    return sequence.rlike(f"^[{RESIDUES}]+$")


def scale_sum(sequence: Column, scale: Mapping[str, int]) -> Column:
    """Sum of whole-numbered residue values by one count for each distinct value."""
    total = F.lit(0).cast("long")
    for aa, v in scale.items():
        if v:
            total = total + count_of(sequence, aa) * v
    return total


def _exposures(n: int, radius: int) -> tuple[int, list[int]]:
    """How much each residue of ``n`` counts in a mean of window means, as whole parts of a unit: the windows that cover it, by their widths."""
    unit = math.lcm(*range(1, 2 * radius + 2))
    width = [min(k, radius) + min(n - 1 - k, radius) + 1 for k in range(n)]
    return unit, [sum(unit // w for w in width[max(0, k - radius) : k + radius + 1]) for k in range(n)]


def mean_of_window_means(sequence: Column, scale: Mapping[str, int], radius: int = 3) -> Column:
    """The mean over all positions of centred window means, cut at the ends; null for an empty sequence.

    A residue counts once, but for 2 * radius at either end, whose windows are cut. So it is a sum of letter counts and of those
    ends, and for texts under 4 * radius of each letter by its own weight: exact whole numbers, no residue is exploded.
    """
    n, end = F.length(sequence), 2 * radius
    unit, whole = _exposures(4 * end, radius)
    table = F.array(*[F.lit(scale.get(chr(65 + k), 0)).cast("long") for k in range(26)])

    def at(k: int) -> Column:
        """The value of the k-th letter, counted from the end if negative."""
        return F.coalesce(F.get(table, F.ascii(F.substring(sequence, k + 1 if k >= 0 else k, 1)) - 65), F.lit(0).cast("long"))

    ends = sum(((at(k) + at(-k - 1)) * (whole[k] - unit) for k in range(1, end)), (at(0) + at(-1)) * (whole[0] - unit))
    weights = F.array(*[F.array(*[F.lit(w).cast("long") for w in _exposures(m, radius)[1]] or [F.lit(0).cast("long")]) for m in range(2 * end)])
    own = F.get(weights, n)
    short = sum((at(k) * F.coalesce(F.get(own, F.lit(k)), F.lit(0)) for k in range(1, 2 * end)), at(0) * F.get(own, F.lit(0)))
    total = F.when(n >= 2 * end, scale_sum(sequence, scale) * unit + ends).otherwise(short)
    return F.when(n > 0, total.cast("double") / (n * unit))


def hydropathy(sequence: Column) -> Column:
    """Mean of (Kyte-Doolittle + 4.5) / 9; null unless all residues are of the 20."""
    n = F.length(sequence)
    return F.when(is_standard(sequence), (scale_sum(sequence, HYDROPATHY10).cast("double") / 10.0 / n + 4.5) / 9.0)


def unsupported(sequence: Column) -> Column:
    """The other letters, distinct and in order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(sequence, f"[{RESIDUES}]", ""), ""), lambda c: c != "")))


def charge_metrics(sequence: Column) -> dict[str, Column]:
    """Net charge a residue, its absolute value, and the aromatic share."""
    net = (count_of(sequence, "KR") - count_of(sequence, "DE")).cast("double") / F.length(sequence)
    return {"ncpr": net, "mean_net_charge": F.abs(net), "aromatic": fraction_of(sequence, "FWY")}


def charge_labels(sequence: Column) -> Column:
    """1 for each charged residue, else 0."""
    return F.transform(F.split(sequence, ""), lambda a: F.when(a.isin("D", "E", "K", "R"), 1).otherwise(0))


def positions_of(sequence: Column, aa: str) -> Column:
    """0-based positions of the letters ``aa``."""
    at = F.transform(F.split(sequence, ""), lambda a, k: F.when(a.isin(*aa), k))
    return F.filter(at, lambda k: k.isNotNull())


def composition(sequence: Column) -> dict[str, Column]:
    return {aa: fraction_of(sequence, aa) for aa in RESIDUES}


def accession(header: Column, strict: bool = True) -> Column:
    """Accession of a FASTA header: the second part of sp|…| and tr|…|, else the identifier at its start.

    ``strict``: the identifier ends at the first character that is no letter, digit, ``_``, ``.`` or ``-``.
    """
    parts = F.split(header, r"\|")
    first = F.regexp_extract(header, r"^([A-Za-z0-9_.\-]+)" if strict else r"^(\S+)", 1)
    return F.when(parts[0].isin("sp", "tr") & (F.size(parts) >= 2) & (parts[1] != ""), parts[1]).otherwise(first)


def profile_span(length: Column, radius: int = 25) -> Column:
    """0-based positions that a profile over windows of 2 radius + 1 covers; empty if too short."""
    low, high = radius - 1, length - radius - 2
    return F.when(high >= low, F.sequence(F.lit(low), high)).otherwise(F.array().cast("array<int>"))


def suffix_span(length: Column, n: Column) -> Column:
    """Positions of a shorter array aligned to the end; empty if it is empty or longer."""
    return F.when((n > 0) & (n <= length), F.sequence(length - n, length - 1)).otherwise(F.array().cast("array<int>"))


def binary_coil(scores: Column, threshold: float) -> Column:
    """1.0 if any score reaches the threshold."""
    return (F.array_max(scores) >= threshold).cast("double")
