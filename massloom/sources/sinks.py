"""Writers: edited results, libraries, predictor inputs and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massloom.sources.store import written


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name).lstrip("_")


def edited_pin(rows: DataFrame, original: list[str], features: list[str], path: str, before: str = "Peptide", proteins: str = "proteins", delta: str | None = None, limit: float | None = None) -> None:
    """Tab-separated files with the feature columns, as %.4f and in snake case, before ``before`` and the proteins spread out at the end; each file starts with the header.

    With a ``limit``, rows whose ``delta`` (a retention-time error) is above it are left out.
    """
    if limit is not None:
        rows = rows.filter(F.col(delta).isNull() | ~(F.col(delta) > limit))
    at = original.index(before)
    cols = {c: F.col(c).cast("string") for c in original[:at]}
    cols |= {snake(f): F.format_string("%.4f", F.col(f).cast("double")) for f in features}
    cols |= {c: F.col(c).cast("string") for c in original[at:]}
    # One column that holds the whole line, so that nothing is quoted; its name is the header.
    line = F.concat_ws("\t", *(F.coalesce(c, F.lit("")) for c in cols.values()), F.concat_ws("\t", proteins))
    plain = {"sep": "\x01", "header": True, "quote": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.select(line.alias("\t".join([*cols, "Proteins"]))).write.options(**plain).csv(path)


def mgf_blocks(library: DataFrame) -> DataFrame:
    """value: one block per precursor with fragments; the isotope column only where some isotope is above 0; peaks without intensity are left out."""
    peaks = F.filter("fragments", lambda f: f["intensity"] > 0)
    isotopes = F.exists("fragments", lambda f: f["isotope"] > 0)
    line = lambda f: F.concat_ws("\t", f["mz"].cast("string"), f["intensity"].cast("string"), f["ion_type"], F.when(isotopes, f["isotope"].cast("string")))
    head = F.concat(F.lit("BEGIN IONS\nTITLE="), F.split("precursor", r"\|")[0], F.lit("\nCHARGE="), F.split("precursor", r"\|")[1], F.lit("\nRT="), F.col("rt").cast("string"), F.lit("\n1/K0="), F.col("im").cast("string"), F.lit("\n"))
    return library.filter(F.size(peaks) > 0).select(F.concat(head, F.array_join(F.transform(peaks, line), "\n"), F.lit("\nEND IONS")).alias("value"))


def write_mgf(library: DataFrame, path: str) -> None:
    mgf_blocks(library).write.text(path)


def predictor_input(psms: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Distinct inputs of a predictor over all runs."""
    return psms.select(*(c.alias(n) for n, c in columns.items())).distinct()


def batches(rows: DataFrame, size: int, order: tuple[str, ...]) -> DataFrame:
    """Adds ``batch`` (0, 1, ..): ``size`` rows each, in order.

    Rows are numbered within ranges, which are written first so that their bounds hold, and ranges by a running sum over
    as many rows as there are ranges; no task sees all rows.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__part").orderBy(*order))).join(F.broadcast(before), "__part")
    return placed.withColumn("batch", F.floor((F.col("__before") + F.col("__r") - 1) / size)).drop("__part", "__r", "__before")


def even_batches(rows: DataFrame, k: int, key: tuple[str, ...]) -> DataFrame:
    """Adds ``batch``: k parts of nearly equal size by a hash of the key."""
    return rows.withColumn("batch", F.pmod(F.xxhash64(*key), F.lit(k)).cast("int"))


#: Models that are told no collision energy, those that are told the instrument, and those that are told the fragmentation.
NO_ENERGY, WITH_INSTRUMENT, WITH_FRAGMENTATION = ("Prosit_2020_intensity_CID", "ms2pip", "Prosit_2025_intensity_MultiFrag"), ("alphapept", "unispec"), ("predfull", "TMT", "Prosit_2024_intensity_cit", "Prosit_2025_intensity_MultiFrag")


def request_tensors(model: str, prop: str) -> list[tuple[str, str, str]]:
    """(tensor, column, datatype) that a model is sent for a property (rt, im, ms2): rt takes peptides, im charges too, ms2 what the model needs."""
    tensors = [("peptide_sequences", "peptide", "BYTES")]
    if prop in ("ms2", "im"):
        tensors.append(("precursor_charges", "charge", "INT32"))
    if prop == "ms2":
        family = model.lower().split("_")[0]
        if not any(name in model for name in NO_ENERGY):
            tensors.append(("collision_energies", "energy", "FP32"))
        if family in WITH_INSTRUMENT:
            tensors.append(("instrument_types", "instrument", "BYTES"))
        if any(name in model for name in WITH_FRAGMENTATION[1:]) or family == "predfull":
            tensors.append(("fragmentation_types", "fragmentation", "BYTES"))
    return tensors


def request_batches(rows: DataFrame, model: str, size: int, order: tuple[str, ...] = ("peptide",)) -> DataFrame:
    """Adds ``batch`` and ``place``: the model family that wants its batches by sequence length gets them so, the others in the order given."""
    if model.lower().startswith("alphapept"):
        rows = rows.withColumn("length", F.length(F.regexp_replace("peptide", r"\[[^\]]*\]|[^A-Za-z]", "")))
        order = ("length", *order)
    return batches(rows, size, order).withColumn("place", F.struct(*order))


def json_requests(batched: DataFrame, tensors: list[tuple[str, str, str]]) -> DataFrame:
    """batch, n, body: one JSON document per batch of ``request_batches`` with a named tensor of n rows and one column each."""
    columns = [column for _, column, _ in tensors]
    held = batched.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", *(F.col(c).alias(f"of_{c}") for c in columns)))).alias("rows"), F.count("*").alias("n"))

    def tensor(name: str, column: str, kind: str) -> Column:
        data = F.transform("rows", lambda r: F.array(r[f"of_{column}"]))
        return F.to_json(F.struct(F.lit(name).alias("name"), F.array(F.col("n"), F.lit(1).cast("long")).alias("shape"), F.lit(kind).alias("datatype"), data.alias("data")))

    inputs = F.concat_ws(",", *(tensor(*about) for about in tensors))
    return held.select("batch", "n", F.concat(F.lit('{"id":"0","inputs":['), inputs, F.lit("]}")).alias("body"))


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """Typed CSV as Parquet; without a schema Spark infers it from the file."""
    reader = spark.read.options(header=True, sep=sep)
    (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(source).write.parquet(target)
    return spark.read.parquet(target)


def with_genes(library: DataFrame, genes: DataFrame, protein: str = "protein") -> DataFrame:
    """Adds ``gene``: of each protein of a ``;`` list, in order, the protein itself where unknown; a decoy prefix stays."""
    parts = library.select(F.col(protein), F.posexplode(F.split(protein, ";")).alias("pos", "part")).distinct()
    parts = parts.withColumns({"decoy": F.when(F.col("part").startswith("rev_"), "rev_").otherwise(""), "plain": F.regexp_replace("part", "^rev_", "")})
    named = parts.join(genes.select(F.col("protein").alias("plain"), "gene"), "plain", "left").withColumn("shown", F.concat("decoy", F.coalesce("gene", "plain")))
    lists = named.groupBy(protein).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda s: s["shown"]), ";").alias("gene"))
    return library.join(lists, protein, "left")


def library_tsv(library: DataFrame, path: str) -> None:
    library.write.options(sep="\t", header=True).csv(path)


def merge_parquet(spark: SparkSession, paths: list[str], target: str) -> DataFrame:
    """Part libraries, perhaps with different columns, as one."""
    out = spark.read.parquet(paths[0])
    for p in paths[1:]:
        out = out.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    out.write.parquet(target)
    return spark.read.parquet(target)


#: What separates cells and lines, and the escape itself; a null cell is NONE.
ESCAPED, NONE = (("%", "%25"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")), "%00"


def _cell(value: Column) -> Column:
    text = value.cast("string")
    for plain, code in ESCAPED:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return F.coalesce(text, F.lit(NONE))


def _uncell(cell: Column) -> Column:
    text = cell
    for plain, code in reversed(ESCAPED):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return F.when(cell != NONE, text)


def calibration_files(grid: DataFrame, anchors: DataFrame, by: tuple[str, ...], path: str) -> None:
    """The two outputs of a fit below one path: ``part=table`` holds the grid of each group's curve (by, y and x, tab-separated), ``part=peptides`` the peptides that it was fitted on (by and peptide), one a line, repeats included.

    Both are one table, written by one job with one commit, so a reader never finds the one without the other. Groups
    without a curve have neither. A file holds many groups, so files are as many as tasks and not as groups; the lines of
    a group stand together in one file of each part, those of a grid by x.
    """
    table = grid.select(F.lit("table").alias("part"), *by, F.col("x").alias("__at"), F.concat_ws("\t", _cell(F.col("y")), _cell(F.col("x"))).alias("__rest"))
    curves = grid.select(*by).distinct()
    used = anchors.join(curves, list(by), "left_semi").select(F.lit("peptides").alias("part"), *by, F.lit(None).cast("double").alias("__at"), _cell(F.col("peptide")).alias("__rest"))
    rows = table.unionByName(used).repartition("part", *by).sortWithinPartitions("part", *by, "__at")
    rows.select("part", F.concat_ws("\t", *(_cell(F.col(b)) for b in by), "__rest").alias("value")).write.partitionBy("part").text(path)


def read_calibration(spark: SparkSession, path: str, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The table (by, y, x) and the peptides (by, peptide) of ``calibration_files``; groups are texts."""
    rows = spark.read.schema("value string, part string").text(path)
    cells = F.split("value", "\t", -1)
    group = [_uncell(cells[k]).alias(b) for k, b in enumerate(by)]
    number = lambda k: _uncell(cells[len(by) + k]).cast("double")
    table = rows.filter("part = 'table'").select(*group, number(0).alias("y"), number(1).alias("x"))
    return table, rows.filter("part = 'peptides'").select(*group, _uncell(cells[len(by)]).alias("peptide"))
