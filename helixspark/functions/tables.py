"""Constants that results depend on."""

from __future__ import annotations

BASES = "TCAG"
#: Amino acids of the 64 codons, bases in the order of BASES.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
TRIGRAMS = {
    "R": "Arg", "H": "His", "K": "Lys", "D": "Asp", "E": "Glu", "S": "Ser", "T": "Thr", "N": "Asn", "Q": "Gln", "C": "Cys", "U": "Sec",
    "G": "Gly", "P": "Pro", "A": "Ala", "V": "Val", "I": "Ile", "L": "Leu", "M": "Met", "F": "Phe", "Y": "Tyr", "W": "Trp", "*": "End",
}
#: Complement of IUPAC letters and white space; lower-case r, y, s turn to upper case.
COMPLEMENT = ("ACGTNRYSWKMBDHVacgtnryswkmbdhv \n\r-", "TGCANYRSWMKVHDBtgcanYRSwmkvhdb  \r-")
IUPAC = "ACGTNRYSWKMBDHV"

#: Nearest-neighbour enthalpy and entropy (kcal/mol, cal/K/mol), SantaLucia 1998; N stands for the mean.
NN_H = {
    "AA": -7.9, "TT": -7.9, "AG": -7.8, "CT": -7.8, "AT": -7.2, "AC": -8.4, "GT": -8.4, "GA": -8.2, "TC": -8.2, "GG": -8.0, "CC": -8.0, "GC": -9.8, "TA": -7.2, "TG": -8.5, "CA": -8.5, "CG": -10.6,
    "GN": -8.6, "AN": -7.825, "TN": -7.95, "CN": -8.725, "NG": -8.725, "NA": -7.95, "NT": -7.825, "NC": -8.6, "NN": -8.275,
}
NN_S = {
    "AA": -22.2, "TT": -22.2, "AG": -21.0, "CT": -21.0, "AT": -20.4, "AC": -22.4, "GT": -22.4, "GA": -22.2, "TC": -22.2, "GG": -19.9, "CC": -19.9, "GC": -24.4, "TA": -21.3, "TG": -22.7, "CA": -22.7, "CG": -27.2,
    "GN": -22.225, "AN": -21.5, "TN": -22.1, "CN": -22.7, "NG": -22.7, "NA": -22.1, "NT": -21.5, "NC": -22.225, "NN": -22.13125,
}
#: Terms of an end base.
END_H = {"A": 2.3, "T": 2.3, "C": 0.1, "G": 0.1, "N": 1.2}
END_S = {"A": 4.1, "T": 4.1, "C": -2.8, "G": -2.8, "N": 0.65}
#: Free energies of nearest neighbours, and those for the stability of the 3' end with its first term.
DELTA_G = {
    "AA": -1.0, "TT": -1.0, "AT": -0.88, "TA": -0.58, "CA": -1.45, "TG": -1.45, "GT": -1.44, "AC": -1.44, "CT": -1.28, "AG": -1.28, "GA": -1.3, "TC": -1.3, "CG": -2.17, "GC": -2.24, "GG": -1.84, "CC": -1.84,
    "GN": -1.705, "NG": -1.685, "AN": -1.15, "NA": -1.0825, "TN": -1.0825, "NT": -1.15, "CN": -1.685, "NC": -1.705, "NN": -1.405625,
}
DELTA_G_END = {
    "AA": -1.9, "TT": -1.9, "AT": -1.5, "TA": -0.9, "CA": -1.9, "TG": -1.9, "GT": -1.3, "AC": -1.3, "CT": -1.6, "AG": -1.6, "GA": -1.6, "TC": -1.6, "CG": -3.6, "GC": -3.1, "GG": -3.1, "CC": -3.1,
    "GN": -2.275, "NG": -2.55, "AN": -1.575, "NA": -1.575, "TN": -1.575, "NT": -1.575, "CN": -2.55, "NC": -2.275, "NN": -1.99375,
}
INIT_G_END = {"G": -1.96, "C": -1.96, "A": -2.01, "T": -2.01, "N": -1.005}
GAS = 1.98722
#: Constants a to g of the divalent salt correction (Owczarzy 2008, table 2).
SALT = {"a": 3.92e-5, "b": -9.11e-6, "c": 6.26e-5, "d": 1.42e-5, "e": -4.82e-4, "f": 5.25e-4, "g": 8.31e-5}
#: Kelvin at 0 degrees Celsius, and the value that compat=True uses.
KELVIN, KELVIN_COMPAT = 273.15, 273.5

#: Number of the first of sixteen consecutive chromosome accessions, and the mitochondrial one.
FIRST_ACCESSION, MITOCHONDRIAL = 1133, 1224
GENE_ISSUES = ["PREMATURE_STOP", "LENGTH_NOT_MULT_OF_3", "STRANGE_START_CODON", "MISSING_STOP_CODON"]
VCF_STATUS = {
    "DEPTH_TOO_LOW": "coverage_too_low", "DEPTH_TOO_HIGH": "coverage_too_high", "ALT_DEPTH_TOO_LOW": "alternate_base_coverage_too_low", "MAPPING_QUAL_TOO_LOW": "mapping_quality_too_low",
    "FAILED_PV": "failed_Pvalues_thresholds", "FAILED_HWE": "failed_HWE", "BETTER_NEIGHBORING_MUTATION": "better_mutation_in_neighborhood", "NEIGHBORING_INDEL": "indel_in_neighborhood", "PASS": "pass_filter",
}


def chromosomes() -> dict[str, int]:
    """Chromosome number by accession."""
    return {f"ref|NC_{n:06d}|": i for i, n in enumerate([*range(FIRST_ACCESSION, FIRST_ACCESSION + 16), MITOCHONDRIAL], 1)}
