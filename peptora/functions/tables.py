"""Published residue tables and protocol constants."""

from __future__ import annotations

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"

# Kyte-Doolittle hydropathy, in tenths (J Mol Biol 157:105, 1982).
HYDROPATHY10 = {
    "A": 18, "C": 25, "D": -35, "E": -35, "F": 28, "G": -4, "H": -32, "I": 45, "K": -39, "L": 38,
    "M": 19, "N": -35, "P": -16, "Q": -35, "R": -45, "S": -8, "T": -7, "V": 42, "W": -9, "Y": -13,
}

# Scales of the granule propensity formula in hundredths, and its coefficients
# in hundredths: RNA binding (classical, non-classical), disorder (classical, non-classical),
# FG and RG content (Bolognesi et al., Cell Rep 16:222, 2016).
SCALE_NAMES = ("rc", "rn", "dc", "dn", "pfg", "prg")
COEFFICIENTS100 = {"rc": 48, "rn": 724, "dc": 26, "dn": 1154, "pfg": 142, "prg": 198}
LENGTH_COEFFICIENT = 0.25
SCALES100 = {
    "A": (45, 46, 8, 3, 0, 0),
    "C": (0, 0, 24, 1, 0, 0),
    "D": (61, 61, 56, 29, 0, 0),
    "E": (44, 70, 0, 9, 0, 0),
    "F": (59, 38, 5, 8, 100, 0),
    "G": (92, 52, 63, 100, 100, 100),
    "H": (51, 38, 40, 19, 0, 0),
    "I": (46, 37, 17, 9, 0, 0),
    "K": (59, 100, 18, 22, 0, 0),
    "L": (30, 37, 6, 5, 0, 0),
    "M": (24, 5, 6, 11, 0, 0),
    "N": (67, 40, 53, 67, 0, 0),
    "P": (69, 40, 100, 9, 0, 0),
    "Q": (56, 51, 24, 21, 0, 0),
    "R": (89, 72, 17, 5, 0, 100),
    "S": (70, 44, 47, 24, 0, 0),
    "T": (44, 45, 50, 0, 0, 0),
    "V": (44, 39, 1, 14, 0, 0),
    "W": (46, 21, 23, 9, 0, 0),
    "Y": (100, 54, 45, 17, 0, 0),
}
# Mean and standard deviation of the raw score over the yeast proteome, by route.
NORMALISATION = {"paper": (7.986059960947538, 0.5180457469917111), "legacy": (7.984683786232663, 0.5177112878123772)}

# Residue frequencies of yeast prion-like domains (28 of Alberti et al., Cell
# 137:146, 2009) and of the yeast proteome, in the order of RESIDUES.
PRION = (0.04865, 0.00219, 0.01638, 0.00783, 0.02537, 0.07603, 0.0181, 0.02018, 0.01641, 0.02639, 0.02975, 0.25885, 0.05126, 0.15178, 0.025, 0.10988, 0.03841, 0.01972, 0.00157, 0.05624)
YEAST = (0.0550, 0.0126, 0.0586, 0.0655, 0.0441, 0.0498, 0.0217, 0.0655, 0.0735, 0.0950, 0.0207, 0.0615, 0.0438, 0.0396, 0.0444, 0.0899, 0.0592, 0.0556, 0.0104, 0.0337)
#: What an unknown residue gets in either table before both are scaled to one.
UNKNOWN_FREQUENCY = 0.00001
# The two-state model of prion-like stretches: transitions and start.
HMM_STAY, HMM_ENTER, HMM_LEAVE, HMM_KEEP = 0.999, 0.001, 0.02, 0.98
HMM_START = (0.9524, 0.0476)

# Odds of each residue in prion-forming sequences against their library, as
# published (Toombs et al., Mol Cell Biol 30:319, 2010), in the order of RESIDUES.
PAPA_ODDS = (
    0.67267686, 1.5146198, 0.27887323, 0.5460614, 2.313433, 0.96153843, 0.75686276, 2.2562358, 0.20664589, 0.9607843,
    1.9615384, 1.0836071, 0.30196398, 1.0716166, 0.6664044, 1.1432927, 0.8917492, 2.2562358, 1.9478673, 2.1785367,
)

# FoldIndex (Prilusky et al., Bioinformatics 21:3435, 2005).
FOLD_H, FOLD_R, FOLD_C = 2.785, -1.0, -1.151
FOLD_WINDOW = 41
# Low-complexity segments (Wootton and Federhen, Comput Chem 17:149, 1993): window, trigger and extension entropies in bits, longest trim.
SEG_WINDOW, SEG_LOW, SEG_HIGH, SEG_TRIM = 12, 2.2, 2.5, 100
COIL_THRESHOLD = 0.82
CORE = 60
PROFILE_RADIUS = 25
FEATURES = ["Hydropathy", "FCR", "IDR", "LCR", "PScore", "PLAAC", "catGRANULE", "DeepCoil"]
HUMAN_FEATURES = [*FEATURES, "Phos freq", "DeepPhase"]


def granule10000() -> dict[str, int]:
    """Each residue's scales weighted by the coefficients, in ten-thousandths: the formula is linear, so one window does."""
    return {a: sum(COEFFICIENTS100[n] * v for n, v in zip(SCALE_NAMES, row)) for a, row in SCALES100.items()}


def prion_ratio() -> dict[str, float]:
    """ln(prion / proteome) of each residue, both tables scaled to one with the unknown residue's share."""
    import math

    p, q = sum(PRION) + 2 * UNKNOWN_FREQUENCY, sum(YEAST) + 2 * UNKNOWN_FREQUENCY
    return {a: math.log((x / p) / (y / q)) for a, x, y in zip(RESIDUES, PRION, YEAST)}


def prion_propensity() -> dict[str, float]:
    """ln of the published odds of each residue."""
    import math

    return {a: math.log(x) for a, x in zip(RESIDUES, PAPA_ODDS)}
