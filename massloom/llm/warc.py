"""WARC archives of pages with revisit records, and a two-level capture index for range reads."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massloom.llm.common import bit_table, by_class, filesystem, marked, shared_dir, text_or_empty, written

#: Bytes after which a task starts another archive, and lines of an index block.
ARCHIVE_BYTES, BLOCK_LINES = 64 << 20, 3000
#: Words of the filter of digests with several pages: at most 2 MB, whatever the input.
FILTER_WORDS = 1 << 17
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ENTRY = "key string, id string, file string, offset long, length long"
_RECORD = "id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def surt(url: str) -> str:
    """Sort key of a URL: host labels reversed, lower case, without a leading www; then the path and query."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return f")/{url}"
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _name(page: str | None, row: int) -> str:
    """Record identifier of a page's row, unlike that of any other row."""
    return f"<urn:row:{row}>" if page is None else f"<urn:page:{quote(page, safe='')}:{row}>"


def _page(name: str) -> str | None:
    kind, page, *_ = name[1:-1].removeprefix("urn:").split(":")
    return unquote(page) if kind == "page" else None


def _record(name: str, url: str, kind: str, first: str | None, digest: str, size: int, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {uri}\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
    if kind == "revisit":
        head += f"WARC-Refers-To: {first}\r\nWARC-Profile: {_REVISIT}\r\n"
        payload = b""
    head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n"
    return head.encode("utf-8", "surrogatepass") + http + payload + b"\r\n\r\n"


def _info(path: str) -> bytes:
    """The warcinfo record that opens an archive."""
    body = b"software: massloom\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Filename: {path.rpartition('/')[2]}\r\n"
    return f"{head}Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def _member(record: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def parse(record: bytes) -> tuple:
    """The columns of _RECORD of one uncompressed record."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    page = lambda name: _page(fields[name]) if name in fields else None
    kind = fields["WARC-Type"]
    if kind == "revisit":
        size, digest, payload = int(re.search(rb"Content-Length: (\d+)", http)[1]), fields["WARC-Payload-Digest"].partition(":")[2], None
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return page("WARC-Record-ID"), fields["WARC-Target-URI"], kind, page("WARC-Refers-To"), size, digest, payload


def _arrow(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 1000) -> DataFrame:
    """Write one record per page into gzip-member WARC files below ``folder``; returns the written table of index entries.

    Of pages with equal payloads of at least ``least_revisit`` bytes, the one with the largest id is a response and the
    others are revisits of it; all other pages are responses. Digests and ids alone are grouped; only pages whose digest
    a filter of bounded size marks as shared are shuffled. A task writes files under names of its own attempt, and only
    the entries of attempts that Spark accepts are kept, so lost or repeated tasks leave no entry behind.

    Null payloads and URLs count as empty. Pages with a null id are responses. Rows that repeat the largest id are
    responses too. An empty table gives no archives and no entries; extra columns are ignored.
    """
    names = ["key", "id", "file", "offset", "length"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    body = text_or_empty(payload_col)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_or_empty(url_col).alias("url"), body.alias("payload"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size"))
    shared = rows.filter((F.col("size") >= least_revisit) & F.col("id").isNotNull())
    firsts = written(shared.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1"), "warc-firsts")
    key = F.xxhash64("digest")
    part = marked(rows, key, bit_table(firsts, key, FILTER_WORDS), FILTER_WORDS)
    found = by_class(part.filter("__maybe"), firsts, "digest", "n", "left").drop("__maybe", "n")
    alone = part.filter("not __maybe").drop("__maybe").withColumn("first", F.lit(None).cast(firsts.schema["first"].dataType))
    first = F.when((F.col("size") >= least_revisit) & (F.col("first.id") != F.col("id")), F.col("first"))
    rows = found.unionByName(alone).withColumn("first", first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        task = TaskContext.get()
        fs.create_dir(root, recursive=True)
        out, path, at, n = None, "", 0, 0
        for batch in batches:
            entries = []
            for row, page, url, payload, digest, size, to, to_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    path, n = f"{root}/{task.partitionId():06d}-{n:03d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz", n + 1
                    out = fs.open_output_stream(path, compression=None)
                    out.write(opening := _member(_info(path)))
                    at = len(opening)
                kind, first = ("response", None) if to_row is None else ("revisit", _name(to, to_row))
                member = _member(_record(_name(page, row), url, kind, first, digest, size, payload))
                out.write(member)
                entries.append((surt(url), page, path, at, len(member)))
                at += len(member)
            yield _arrow(entries, names, kinds)
        if out is not None:
            out.close()

    payload = F.when(F.col("first").isNull(), F.col("payload")).otherwise("").cast("binary")  # a revisit has none
    told = rows.select("row", F.col("id").cast("string"), "url", payload, "digest", "size", F.col("first.id").cast("string"), F.col("first.row"))
    return written(told.toDF("row", "id", "url", "payload", "digest", "size", "to", "to_row").mapInArrow(run, _ENTRY), "warc-entries")


class CaptureIndex:
    """Two-level index of archive entries, sorted by reversed-host key.

    ``blocks``: compressed runs of BLOCK_LINES sorted lines; ``directory``: the first line's key and id of each block. Both
    are tables below the shared folder. Equal keys may fill many blocks and many tasks: lines are ranged by key and id.
    """

    def __init__(self, blocks: DataFrame, folder: str):
        self.blocks = blocks
        self.folder = folder
        self.directory = blocks.select("part", "block", "first_key", "first_id", "lines")

    @classmethod
    def build(cls, entries: DataFrame, folder: str, lines: int = BLOCK_LINES) -> CaptureIndex:
        names = ["part", "block", "first_key", "first_id", "lines", "data"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.binary()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, block, held = TaskContext.get().partitionId(), 0, []

            def made(some: list[tuple]) -> tuple:
                text = "\n".join("\t".join("\\N" if v is None else re.sub(r"[\t\n\\]", lambda m: f"\\{ord(m[0]):02x}", str(v)) for v in e) for e in some)
                return part, block, some[0][0], some[0][1], len(some), zlib.compress(text.encode("utf-8", "surrogatepass"))

            for batch in batches:
                held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
                while len(held) >= lines:
                    yield _arrow([made(held[:lines])], names, kinds)
                    held, block = held[lines:], block + 1
            if held:
                yield _arrow([made(held)], names, kinds)

        ordered = entries.repartitionByRange("key", "id", "file", "offset").sortWithinPartitions("key", "id", "file", "offset")
        schema = "part int, block int, first_key string, first_id string, lines int, data binary"
        return cls(written(ordered.select("key", "id", "file", "offset", "length").mapInArrow(run, schema), "warc-index"), folder)

    @staticmethod
    def _lines(data: bytes) -> list[list[str]]:
        return [line.split("\t") for line in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")]

    def entries(self) -> DataFrame:
        """All entries, read from the blocks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    yield _entries(CaptureIndex._lines(data))

        return self.blocks.select("data").mapInArrow(run, _ENTRY)

    def _blocks_of(self, wanted: DataFrame, by: list[str]) -> DataFrame:
        """by, part, block: the blocks that may hold each wanted row: all that begin with it, and the last one that begins before it.

        Wanted rows and the directory are sorted together in ranges, and each row takes the last block before it; the
        ranges' own last blocks, one row a range, fill in where a range begins without one.
        """
        firsts = self.directory.select(F.col("first_key").alias("key"), F.col("first_id").alias("id"), F.struct("part", "block").alias("at")).select(*by, "at")
        same = wanted.alias("w").join(firsts.alias("d"), [F.col(f"w.{c}").eqNullSafe(F.col(f"d.{c}")) for c in by]).select(*(F.col(f"w.{c}") for c in by), "d.at")
        both = wanted.select(*by, F.lit(None).cast(firsts.schema["at"].dataType).alias("at")).unionByName(firsts).withColumn("known", F.col("at").isNotNull())
        ranged = written(both.repartitionByRange(*by, "known", "at").withColumn("range", F.spark_partition_id()), "warc-asked")
        last = F.last("at", ignorenulls=True)
        order = Window.partitionBy("range").orderBy(*by, "known", "at")
        ends = ranged.groupBy("range").agg(F.max(F.when(F.col("known"), F.struct(*by, "at"))).alias("end"))
        before = ends.select("range", F.last("end.at", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
        found = ranged.withColumn("at", last.over(order)).filter("not known").join(F.broadcast(before), "range")  # one row a range
        found = found.select(*by, F.coalesce("at", "before").alias("at")).filter("at is not null")
        return found.unionByName(same).select(*by, "at.part", "at.block")

    def lookup(self, urls: DataFrame, url_col: str = "url", id_col: str | None = None) -> DataFrame:
        """Entries of the captures of each distinct URL, or with ``id_col`` of each distinct URL and id.

        The directory tells the blocks; a block is read once for up to BLOCK_LINES of what is asked of it, and its lines
        are found by binary search.
        """
        by = ["key", "id"] if id_col else ["key"]

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = pa.array([surt(u or "") for u in batch.column(0).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([keys, *batch.columns[1:]], by)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rank = lambda row: (row[0], *((v is not None, v or "") for v in row[1:]))
            for batch in batches:
                for asked, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    lines, found = CaptureIndex._lines(data), []
                    keys = [rank([_plain(v) for v in line[: len(by)]]) for line in lines]
                    for row in asked:
                        key = rank([row[c] for c in by])
                        at = bisect_left(keys, key)
                        while at < len(keys) and keys[at] == key:
                            found.append(lines[at])
                            at += 1
                    if found:
                        yield _entries(found)

        told = urls.select(F.col(url_col).cast("string").alias("url"), *([F.col(id_col).cast("string").alias("id")] if id_col else []))
        wanted = written(told.distinct().mapInArrow(keyed, ", ".join(f"{c} string" for c in by)).distinct(), "warc-wanted")
        asked = self._blocks_of(wanted, by)
        nth = F.row_number().over(Window.partitionBy("part", "block").orderBy(*by))
        groups = asked.withColumn("chunk", F.floor((nth - 1) / BLOCK_LINES)).groupBy("part", "block", "chunk").agg(F.collect_list(F.struct(*by)).alias("asked"))
        return groups.join(self.blocks.select("part", "block", "data"), ["part", "block"]).select("asked", "data").mapInArrow(search, _ENTRY)

    def read(self, entries: DataFrame) -> DataFrame:
        """The records at the entries, by range reads, file by file in order."""
        names = [f.split()[0] for f in _RECORD.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, _ = filesystem(folder)
            source, path = None, None
            for batch in batches:
                rows, held = [], 0
                for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if file != path:
                        source, path = fs.open_input_file(file), file
                    rows.append(parse(zlib.decompress(source.read_at(length, offset), 31)))
                    held += len(rows[-1][-1] or b"")
                    if held >= 16 << 20:
                        yield _arrow(rows, names, kinds)
                        rows, held = [], 0
                if rows:
                    yield _arrow(rows, names, kinds)

        # A number of its own, as Spark would merge the small entries, and with them all the reading, into few tasks.
        parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return entries.select("file", "offset", "length").repartition(parts, "file").sortWithinPartitions("file", "offset").mapInArrow(run, _RECORD)


def _plain(field: str) -> str | None:
    return None if field == "\\N" else re.sub(r"\\([0-9a-f]{2})", lambda m: chr(int(m[1], 16)), field)


def _entries(lines: list[list[str]]) -> pa.RecordBatch:
    rows = [(_plain(k), _plain(i), _plain(f), int(o), int(n)) for k, i, f, o, n in lines]
    return _arrow(rows, ["key", "id", "file", "offset", "length"], [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()])


def archive(spark: SparkSession, pages: DataFrame, **columns) -> CaptureIndex:
    """Write the pages' archives and their index below the shared folder."""
    folder = shared_dir(spark, "warc")
    return CaptureIndex.build(write_archives(pages, folder, **columns), folder)
