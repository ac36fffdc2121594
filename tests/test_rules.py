"""Rules with fixed expected values: headers, instruments, eligibility, hierarchies, model texts, files of several runs."""

import pytest
from pyspark.sql import functions as F

from massloom.functions import peptides
from massloom.plans import tables
from massloom.sources import readers, sinks


@pytest.mark.parametrize(
    ("header", "database", "ident", "gene", "decoy"),
    [
        ("sp|P12345|PROT_HUMAN Protein description GN=BRCA1 PE=1 SV=2", "uniprot", "P12345", "BRCA1", False),
        ("sp|P12345|PROT_HUMAN Protein description without gene", "uniprot", "P12345", "", False),
        ("sp|P12345|PROT_HUMAN Protein GN=GENE1 GN=GENE2 PE=1", "uniprot", "P12345", "GENE1", False),
        ("NP_000537.3 cellular tumor antigen p53 GN=TP53 [Homo sapiens]", "ncbi", "NP_000537.3", "TP53", False),
        ("NP_001234567.1 tumor protein p53 [Homo sapiens]", "ncbi", "NP_001234567.1", "", False),
        ("ENSP00000269305 pep chromosome:GRCh38:17:43044295:43125483:1 gene:ENSG00000141510", "ensembl", "ENSP00000269305", "ENSG00000141510", False),
        ("ENSP00000379334 gene:ENSG00000141510.17 description", "ensembl", "ENSP00000379334", "ENSG00000141510.17", False),
        ("ENSP00000379334|ENST00000395929|ENSG00000141510.17|TP53", "cptac_ensembl", "ENSP00000379334", "ENSG00000141510.17", False),
        ("nxp|NX_P04637|TP53|Tumor protein p53", "nextprot", "NX_P04637", "TP53", False),
        ("AT1G01010 | Symbols: NAC001 | NAC domain protein | chr1:3760-5630", "tair", "", "NAC001", False),
        ("AT without symbols", "generic", "AT without symbols", "", False),
        ("RandomProteinHeader", "generic", "RandomProteinHeader", "", False),
        ("rev_sp|P12345|PROT_HUMAN Decoy protein GN=BRCA1", "uniprot", "P12345", "BRCA1", True),
        ("contam_sp|P12345|PROT_HUMAN Contaminant protein", "uniprot", "P12345", "", False),
        ("rev_contam_sp|P12345|PROT_HUMAN Decoy contaminant", "uniprot", "P12345", "", True),
        ("contam_rev_sp|P12345|X", "uniprot", "P12345", "", False),
        ("WP_000001.1 x", "ncbi", "WP_000001.1", "", False),
        ("UniRef100_A0A000 x", "uniref", "", "", False),
    ],
)
def test_headers(spark, header, database, ident, gene, decoy):
    cols = peptides.protein_header(F.col("h"))
    got = spark.createDataFrame([(header,)], "h string").select(*(c.alias(k) for k, c in cols.items())).first()
    assert (got["database"], got["id"], got["gene"], got["decoy"], got["part"]) == (database, ident, gene, decoy, header.split(" ")[0])


def test_eligible(spark):
    cases = [
        ("PEPOTIDEK", 2, 9, "alphapept", True), ("PEPOTIDEK", 2, 9, "diann", True), ("PEPOTIDEK", 2, 9, "Prosit_2020_intensity_HCD", False), ("PEPTIDEX", 2, 8, "im2deep", False),
        ("A" * 31, 2, 31, "ms2pip_2021", False), ("A" * 31, 2, 31, "unispec", True), ("A" * 41, 2, 41, "unispec", False), ("A" * 60, 2, 60, "deeplc", True), ("A" * 61, 2, 61, "im2deep", False),
        ("AAA", 6, 3, "prosit", True), ("AAA", 7, 3, "prosit", False), ("AAA", 6, 3, "unispec", False), ("AAA", 30, 3, "predfull", True), ("AAA", 2, 61, "deeplc", False), ("A" * 99, 9, 999, "diann", True),
    ]
    for stripped, charge, size, model, want in cases:
        row = spark.createDataFrame([(stripped, charge, "x" * size)], "s string, z int, t string")
        assert row.select(peptides.eligible(F.col("s"), F.col("z"), F.col("t"), model)).first()[0] is want, (stripped, model)


def test_hierarchies():
    assert tables.HIERARCHY["HCD"][:4] == ["imm", "y", "b", "a"] and tables.HIERARCHY["CID"] == tables.HIERARCHY["HCD"]
    assert tables.HIERARCHY["ETD"] == ["zdot", "c", "z", "y", "unknown"]
    assert sorted(map(len, tables.HIERARCHY.values())) == [5, 10, 10, 11, 11, 11, 12, 14]
    assert all(names[-1] == "unknown" for names in tables.HIERARCHY.values())
    assert len(tables.LOSSES) == 9 and len(tables.IMMONIUM) == 59
    assert [n for n, _, c in tables.LOSSES if c == "ox"] == ["CH3SOH"] and sum(c == "phos" for _, _, c in tables.LOSSES) == 4


@pytest.mark.parametrize(
    ("base", "target", "want"),
    [
        ("Q[-17.0265]IDNARLAADDF", "alphapept", "Q[UNIMOD:28]IDNARLAADDF"),
        ("E[-18.0106]IDNARLAADDF", "alphapept", "E[UNIMOD:27]IDNARLAADDF"),
        ("[42.0106]AC[57.0215]M[15.9949]", "alphapept", "[UNIMOD:1]-AC[UNIMOD:4]M[UNIMOD:35]"),
        ("[42.0106]AC[57.0215]M[15.9949]", "unispec", "[UNIMOD:1]AC[UNIMOD:4]M[UNIMOD:35]"),
        ("[42.0106]AC[57.0215]M[15.9949]", "diann", "[UniMod:1]AC[UniMod:4]M[UniMod:35]"),
        ("[42.0106]AC[57.0215]M[15.9949]", "librarytsv", "_(UniMod:1)AC(UniMod:4)M(UniMod:35)"),
        ("[42.0106]AC[57.0215]M[15.9949]", "predfull", "ACM[UNIMOD:35]"),
        ("ACM[15.9949]C", "prosit", "AC[UNIMOD:4]M[UNIMOD:35]C[UNIMOD:4]"),
        ("AS[229.1629]K[229.1629]", "prosit_tmt", "[UNIMOD:737]-ASK[UNIMOD:737]"),
        ("[229.1629]AK", "prosit_tmt", "[UNIMOD:737]-AK"),
        ("AS[79.9663]K[1.2345]", "ms2pip", "ASK"),
        ("M[57.0215]", "prosit", "M"),
        ("", "alphapept", ""),
    ],
)
def test_model_texts(spark, base, target, want):
    rows = spark.createDataFrame([(base,)], "base string")
    assert peptides.to_model_peptide(rows, tables.MODS, target).first()["model_peptide"] == want


def test_modified_c_terminus(spark):
    rows = spark.createDataFrame([("AK[42.0106]", True), ("AK[42.0106]", False)], "base string, c boolean")
    got = [r["model_peptide"] for r in peptides.to_model_peptide(rows, tables.MODS, "alphapept", c_terminal=F.col("c")).collect()]
    assert got == ["AK-[UNIMOD:1]", "AK"]


@pytest.mark.parametrize("line", ["\n", "\r\n"])
def test_spectra_of_two_runs(spark, tmp_path, line):
    """The same scan number in two files is two spectra, whatever ends the lines; the first block of a scan wins."""
    block = lambda scan, mz: f"# a remark\nBEGIN IONS\nTITLE=x.{scan}.{scan}.2\nRTINSECONDS=90\n{mz} 5\n{mz + 1}\t6\nEND IONS\n"
    for name, blocks in (("one", [block(7, 100), block(8, 300), block(7, 500)]), ("two_uncalibrated", [block(7, 200)])):
        (tmp_path / f"{name}.mgf").write_bytes("".join(blocks).replace("\n", line).encode())
    got = sorted((r["run"], r["scan_num"], r["rt"], [p["mz"] for p in r["peaks"]]) for r in readers.mgf_spectra(spark, str(tmp_path)).collect())
    assert got == [("one", 7, 1.5, [100.0, 101.0]), ("one", 8, 1.5, [300.0, 301.0]), ("two", 7, 1.5, [200.0, 201.0])]


@pytest.mark.parametrize("line", ["\n", "\r\n"])
def test_library_lines(spark, tmp_path, line):
    text = 'Name: AAK/2\nComment: Mods=0 iRT=1.5\nNum peaks: 2\n100.0\t1.0\t"y1"\n200.0\t0.0\t"b2"\n\nName: CCK/3\nComment: Mods=0 iRT=2\nNum peaks: 1\n300.5\t2.0\t"y2^2"\n'
    (tmp_path / "a.msp").write_bytes(text.replace("\n", line).encode())
    got = sorted((r["precursor"], r["rt"], [(p["mz"], p["annotation"]) for p in r["fragments"]]) for r in readers.msp_library(spark, str(tmp_path)).collect())
    assert got == [("AAK|2", 1.5, [(100.0, "y1")]), ("CCK|3", 2.0, [(300.5, "y2^2")])]


def test_edited_results_lose_rows_over_the_limit(spark, tmp_path):
    rows = spark.createDataFrame([("a", "K.AA.R", ["P1", "P2"], 1.0), ("b", "K.CC.R", ["P3"], 9.0), ("c", "K.DD.R", ["P4"], None)], "SpecId string, Peptide string, proteins array<string>, delta double")
    sinks.edited_pin(rows, ["SpecId", "Peptide"], ["delta"], str(tmp_path / "pin"), delta="delta", limit=5.0)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "pin")).collect() if not r["value"].startswith("SpecId")]
    assert sorted(lines) == ["a\t1.0000\tK.AA.R\tP1\tP2", "c\tnull\tK.DD.R\tP4"]
