"""Small parameter tables: modifications, ion hierarchy, neutral losses, immonium ions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Residue (or [ for a terminus), UNIMOD number, mass.
MODS = [
    ("C", 4, 57.0215), ("M", 35, 15.9949), ("[", 1, 42.0106), ("S", 21, 79.9663), ("T", 21, 79.9663), ("Y", 21, 79.9663),
    ("[", 121, 114.042927), ("K", 121, 114.042927), ("T", 121, 114.042927), ("C", 121, 114.042927), ("S", 121, 114.042927),
    ("K", 737, 229.1629), ("S", 737, 229.1629), ("T", 737, 229.1629), ("H", 737, 229.1629), ("[", 737, 229.1629),
    ("Q", 28, -17.0265), ("E", 27, -18.01057), ("C", 26, 39.9950), ("Q", 7, 0.984016), ("R", 7, 0.984016), ("N", 7, 0.984016),
]
MASSES = {ident: mass for _, ident, mass in MODS}

_BEAM = ["imm", "y", "b", "a", "y-NL", "b-NL", "a-NL", "int", "int-NL", "unknown"]
#: Ion types by fragmentation method, best first.
HIERARCHY = {
    "HCD": _BEAM,
    "CID": _BEAM,
    "ETD": ["zdot", "c", "z", "y", "unknown"],
    "ETHCD": ["imm", "y", "b", "a", "zdot", "c", "z", "cdot", "y-NL", "b-NL", "a-NL", "int", "int-NL", "unknown"],
    "ECD": ["c", "zdot", "zprime", "y", "cdot", "b", "a+1", "c", "x+1", "a", "x", "unknown"],
    "EID": ["y", "b", "a", "zdot", "c", "a+1", "x+1", "zprime", "cdot", "x", "unknown"],
    "UVPD": ["y", "b", "a", "a+1", "zdot", "c", "x+1", "zprime", "cdot", "x", "unknown"],
    "ETCID": ["cdot", "zdot", "zprime", "y", "b", "a+1", "c", "x+1", "a", "x", "unknown"],
}

#: Neutral losses, their mass and the class of modification that they need.
LOSSES = [
    ("NH3", 17.02655, None), ("H2O", 18.01057, None), ("CO", 27.99492, None), ("C2H5NOS", 91.00918, None),
    ("HPO3", 79.96633, "phos"), ("H3PO4", 97.97689, "phos"), ("H5PO5", 115.98746, "phos"), ("H7PO6", 133.99802, "phos"), ("CH3SOH", 63.99829, "ox"),
]
LOSS_MASSES = {name: mass for name, mass, _ in LOSSES}

#: Immonium and related ions; the second letter of the name is the residue.
IMMONIUM = {
    "ICA": 76.021545, "IDA": 88.039304, "IDB": 70.028793, "IEA": 102.054954, "IFA": 120.080775, "IFB": 91.054226, "IHA": 110.071273, "IHB": 82.05255,
    "IHC": 121.039639, "IHD": 123.055289, "IHE": 138.066188, "IHF": 156.076753, "IIA": 86.096425, "IIC": 72.080776, "IKA": 101.107324, "IKB": 112.07569,
    "IKC": 84.080776, "IKD": 129.102239, "IKE": 56.049476, "IKF": 175.118952, "ILA": 86.096426, "ILC": 72.080776, "IMA": 104.052846, "IMB": 61.010647,
    "IMC": 120.047761, "INA": 87.055289, "INB": 70.02874, "IPA": 70.065126, "IQA": 101.070939, "IQB": 56.049476, "IQC": 84.04439, "IQD": 129.065854,
    "IRA": 129.113473, "IRB": 59.060375, "IRC": 70.065126, "IRD": 73.076025, "IRE": 87.091675, "IRF": 100.086924, "IRG": 112.086924, "IRH": 60.055624,
    "IRI": 116.070605, "IRJ": 175.118952, "ISA": 60.04439, "ITA": 74.06004, "ITB": 119.0814, "IVA": 72.080776, "IVC": 55.054227, "IVD": 69.033491,
    "IWA": 159.091675, "IWB": 77.038577, "IWC": 117.057301, "IWD": 130.065126, "IWE": 132.080776, "IWF": 170.06004, "IWH": 142.065126, "IYA": 136.07569,
    "IYB": 91.054227, "IYC": 107.049141, "ICCAM": 133.04301,
}


def mod_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODS, "residue string, id int, mass double")


def losses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOSSES, "loss string, mass double, class string")


def immonium(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, n[1], m) for n, m in IMMONIUM.items()], "name string, residue string, mass double")


def hierarchy(spark: SparkSession) -> DataFrame:
    """method, ion, priority; the first place of an ion counts."""
    return spark.createDataFrame([(m, ion, names.index(ion) + 1) for m, names in HIERARCHY.items() for ion in dict.fromkeys(names)], "method string, ion string, priority int")


def known_method(method: Column) -> Column:
    """The method in capitals; one without a hierarchy counts as HCD."""
    return F.when(F.upper(method).isin(*HIERARCHY), F.upper(method)).otherwise("HCD")
