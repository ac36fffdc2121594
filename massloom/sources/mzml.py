"""Spectra of mzML files by their byte ranges: an index of all spectra, and a reader of those that are asked for."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.sources import readers

#: Bytes that are read at once where a file is searched; bytes of a file that one task reads spectra of; largest gap that is read over.
BLOCK, SPAN, GAP = 4 << 20, 64 << 20, 1 << 16
END = b"</spectrum>"
_tail = re.compile(rb"<indexListOffset>\s*(\d+)\s*</indexListOffset>")
_list = re.compile(rb'<index\s+name="spectrum"\s*>(.*?)</index>', re.DOTALL)
_offset = re.compile(rb"<offset\b[^>]*?>\s*(\d+)\s*</offset>")
_opens = re.compile(rb"<spectrum\s[^>]*>")
_scan = re.compile(rb"scan=(\d+)")


def _open(uri: str):
    """An input file of the store that the URI names."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def listed(file, size: int) -> list[int] | None:
    """The places of the spectra by the file's own index, or None if it has none that holds."""
    file.seek(max(0, size - 4096))
    found = _tail.search(file.read(4096))
    if not found or int(found[1]) >= size:
        return None
    file.seek(int(found[1]))
    part = _list.search(file.read(size - int(found[1])))
    places = sorted(int(m[1]) for m in _offset.finditer(part[1])) if part else []
    if not places or places[-1] >= size:
        return None
    file.seek(places[0])
    return places if file.read(9) == b"<spectrum" else None


def searched(file, size: int) -> Iterator[tuple[int, bytes]]:
    """Place and opening tag of each spectrum, found by reading the file block by block."""
    at, rest = 0, b""
    while at < size:
        file.seek(at)
        block = rest + file.read(BLOCK)
        base, last = at - len(rest), 0
        for m in _opens.finditer(block):
            yield base + m.start(), m[0]
            last = m.end()
        at = base + len(block)
        cut = block.rfind(b"<", last)  # a tag may go on in the next block
        rest = block[cut:] if cut >= 0 and b">" not in block[cut:] else b""


def spectra_index(spark: SparkSession, path: str) -> DataFrame:
    """file, run, scan_num, start and stop: the bytes of each spectrum of mzML files; no array is read or decoded.

    Places come from a file's own index list; a file without one that holds is searched for its spectra. A spectrum's
    scan number stands in its opening tag. A file's bytes up to its next spectrum are its range (of the last one, up to the
    index list or the file's end). Empty files and files without spectra give no rows. One task goes through one file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                with _open(uri) as file:
                    places = listed(file, size)
                    found = [(p, None) for p in places] if places else searched(file, size)
                    starts, scans = [], []
                    for at, tag in found:
                        if tag is None:
                            file.seek(at)
                            tag = file.read(512)
                        scan = _scan.search(tag[: tag.find(b">") + 1 or None])
                        starts.append(at)
                        scans.append(int(scan[1]) if scan else None)
                stops = [*starts[1:], size]
                for k in range(0, len(starts), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    n = len(starts[part])
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * n, pa.string()), pa.array(scans[part], pa.int64()), pa.array(starts[part], pa.int64()), pa.array(stops[part], pa.int64())], ["file", "scan_num", "start", "stop"])

    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0").repartition("path")
    rows = files.mapInArrow(run, "file string, scan_num long, start long, stop long")
    return rows.select("file", readers.run_name(F.col("file")).alias("run"), "scan_num", "start", "stop")


def _texts(uri: str, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    """The spectrum elements at ascending ranges of a file; ranges that lie close together are read at once."""
    with _open(uri) as file:
        k = 0
        while k < len(ranges):
            first, until = ranges[k]
            last = k + 1
            while last < len(ranges) and ranges[last][0] - until <= GAP and ranges[last][1] - first <= BLOCK:
                until = ranges[last][1]
                last += 1
            file.seek(first)
            block = file.read(min(until - first, BLOCK)) if last == k + 1 else file.read(until - first)
            while last == k + 1 and END not in block and len(block) < until - first:  # one long spectrum, or the file's last
                block += file.read(min(BLOCK, until - first - len(block)))
            for start, stop in ranges[k:last]:
                text = block[start - first : stop - first]
                yield text[: text.find(END) + len(END)]
            k = last


def spectra_at(wanted: DataFrame) -> DataFrame:
    """The spectra at the rows of an index, with the columns of ``readers.spectra_scan``; only their bytes are read and only their arrays decoded.

    Ranges are dealt by file and span of bytes, so that a file that many scans are wanted of is read by many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, ranges = None, []

        def told() -> Iterator[pa.RecordBatch]:
            texts, size = [], 0
            for text in _texts(uri, ranges) if ranges else ():
                texts.append(text.decode("utf-8"))
                size += len(text)
                if size > BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * len(texts)), pa.array(texts)], ["file", "value"])
                    texts, size = [], 0
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(texts)), pa.array(texts)], ["file", "value"])

        for batch in batches:
            for name, start, stop in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if name != uri:
                    yield from told()
                    uri, ranges = name, []
                ranges.append((start, stop))
            yield from told()
            ranges = []

    dealt = wanted.select("file", "start", "stop").distinct().repartition("file", F.floor(F.col("start") / SPAN)).sortWithinPartitions("file", "start")
    texts = dealt.mapInArrow(run, "file string, value string")
    rows = texts.select(F.col("file").alias("path"), F.from_xml("value", readers.SPECTRUM, {"mode": "FAILFAST"}).alias("s")).select("path", "s.*")
    return readers.spectra(rows, F.col("path"))
