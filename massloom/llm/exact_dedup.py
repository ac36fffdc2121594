"""Exact deduplication by a log-structured merge index of text digests, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.common import bit_table, by_class, marked, shared_dir, text_or_empty, written

#: Words of 64 bits in the filter of a run: at most 2 MB, whatever the input.
FILTER_WORDS = 1 << 17
#: Rows of a memtable for each shuffle partition, runs of a level that are merged into one, and flushes at most (of larger memtables).
MEMTABLE_ROWS, FAN_IN, FLUSHES = 4096, 4, 64


def normalised(text_col: str = "text") -> Column:
    """The text with each run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text_col), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _least() -> Column:
    """The smallest identifier (null ids last, then the row) of what is grouped."""
    return F.min(F.struct(F.col("id").isNull().alias("void"), "id", "row"))


class Run:
    """A sorted run: digest, keep (its smallest identifier) and n (its rows), one row per digest, with its filter."""

    def __init__(self, rows: DataFrame, table: DataFrame):
        self.rows, self.filter = rows, table


class DigestIndex:
    """A log-structured merge index below one folder.

    ``flush`` takes a memtable: its rows are merged by digest, sorted and written as a run of level 0, with a bit filter
    of its digests and, in each of its files, the smallest and largest digest, so that a lookup reads only the files that
    may hold one. When a level has ``fan_in`` runs, they are compacted into one run of the next level, which keeps the
    smallest identifier of each digest and the sum of its rows. A lookup asks the filter of each run first.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = FAN_IN):
        self.spark, self.path, self.fan_in = spark, path or shared_dir(spark, "digest-index"), fan_in
        self.levels: list[list[Run]] = []
        self.hits: list[DataFrame] = []
        self.written = 0

    def _run(self, rows: DataFrame) -> Run:
        """Write rows (digest, keep, n), one per digest, as a run."""
        at, self.written = f"{self.path}/run{self.written}", self.written + 1
        rows.repartitionByRange("digest").sortWithinPartitions("digest").write.parquet(at)
        held = self.spark.read.schema(rows.schema).parquet(at)
        key = F.xxhash64("digest")
        return Run(held, written(bit_table(held, key, FILTER_WORDS), "run-filter"))

    def flush(self, rows: DataFrame) -> None:
        """rows: row (unique long), id, digest (binary); a memtable's worth.

        ``hits`` gets the digests that the memtable holds twice or that a run before it holds.
        """
        run = self._run(rows.groupBy("digest").agg(_least().alias("keep"), F.count("*").alias("n")))
        again = run.rows.filter("n > 1").select("digest")
        if self.runs():
            again = again.unionByName(self.lookup(run.rows).select("digest"))
        self.hits.append(written(again, "digest-hits"))
        self._add(0, run)

    def _add(self, level: int, run: Run) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            merged = self._merged(self.levels[level])
            self.levels[level] = []
            self._add(level + 1, merged)

    def _merged(self, runs: list[Run]) -> Run:
        rows = runs[0].rows
        for run in runs[1:]:
            rows = rows.unionByName(run.rows)
        return self._run(rows.groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("n").alias("n")))

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def compact(self) -> DataFrame:
        """All runs as one: digest, keep, n."""
        runs = self.runs()
        if len(runs) > 1:
            self.levels = [[] for _ in self.levels] + [[self._merged(runs)]]
        return self.runs()[0].rows

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The entries of the digests wanted, from all runs: a run is joined with those only that its filter lets through."""
        wanted = wanted.select("digest").distinct()
        found = []
        for run in self.runs():
            asked = marked(wanted, F.xxhash64("digest"), run.filter, FILTER_WORDS).filter("__maybe").select("digest")
            found.append(run.rows.join(asked, "digest"))
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        return rows.groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, memtable_rows: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept`` and ``digest`` (binary).

    Texts are equal when identical after ``normalised``; of equal texts the row with the smallest id is kept (null ids
    last; of rows with the same id, one). Digests go through a ``DigestIndex``, memtable by memtable; the rows of every
    hit have their text compared byte for byte, and texts that only share a digest are split into groups of their own.

    Null and empty texts form one group. An empty table gives no rows; extra columns are ignored.
    """
    spark, n = docs.sparkSession, docs.count()
    rows = memtable_rows or max(MEMTABLE_ROWS * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // FLUSHES))
    tables = max(1, -(-n // rows))
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), normalised(text_col).alias("text")).withColumn("digest", digest(F.col("text")))
    entries = plain.select("row", "id", "digest", F.pmod(F.xxhash64("row"), F.lit(tables)).cast("int").alias("memtable"))
    entries = written(entries, "digests", "memtable") if tables > 1 else written(entries, "digests")
    index = DigestIndex(spark, fan_in=fan_in)
    for k in range(tables):
        index.flush(entries.filter(F.col("memtable") == k))
    classes, hits = index.compact(), index.hits[0]
    for more in index.hits[1:]:
        hits = hits.unionByName(more)

    # Bytes of all hits: the filter, of bounded size, lets only their rows carry a text on.
    key = F.xxhash64("digest")
    texts = marked(plain, key, bit_table(hits, key, FILTER_WORDS), FILTER_WORDS).filter("__maybe").groupBy("digest", "text").agg(F.count("*").alias("n"))
    clashes = written(texts.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"), "digest-clashes")
    if clashes.isEmpty():
        return _decided(entries, classes, id_col)
    apart = plain.join(clashes, "digest", "left_semi")
    by_text = apart.groupBy("digest", "text").agg(_least().alias("keep"), F.count("*").alias("n"))
    split = apart.join(by_text, ["digest", "text"])
    clean = lambda df: df.join(clashes, "digest", "left_anti")
    return _decided(clean(entries), clean(classes), id_col).unionByName(_columns(split, id_col))


def _columns(found: DataFrame, id_col: str) -> DataFrame:
    return found.select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "digest",
    )


def _decided(entries: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    return _columns(by_class(entries, classes, "digest", "n"), id_col)


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that ``dedup`` keeps, with all their columns. Only rows that it may drop are shuffled with their texts."""
    found = dedup(docs, id_col=id_col, text_col=text_col)
    pairs = found.groupBy(F.col(id_col).alias("__id"), F.col("digest").alias("__digest")).agg(F.max("kept").alias("__kept"), F.count("*").alias("__n"))
    touched = written(pairs.filter("not __kept or __n > 1"), "dropped")
    key = F.xxhash64("__id")
    part = marked(docs, F.xxhash64(F.col(id_col)), bit_table(touched, key, FILTER_WORDS), FILTER_WORDS)
    rest = part.filter("__maybe").withColumn("__text_digest", sha256(normalised(text_col)))
    same = rest[id_col].eqNullSafe(touched["__id"]) & (rest["__text_digest"] == touched["__digest"])
    joined = rest.join(touched, same, "left").filter("__kept is null or __kept")
    names = docs.columns
    out = part.filter("not __maybe").select(names).unionByName(joined.filter("__kept is null").select(names))
    repeated = joined.filter("__kept")
    return out if touched.filter("__kept").isEmpty() else out.unionByName(repeated.dropDuplicates(["__id", "__digest"]).select(names))
