"""Substring deduplication over a compacted De Bruijn graph of repeated word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.common import bit_table, marked, written

#: 64-bit words of the filters that tasks hold: 8 MB each, and with more than 4 million documents up to 32 MB.
FILTER_WORDS, MOST_FILTER_WORDS = 1 << 20, 1 << 22
#: Words of the seed k-mer whose minimum anchors a window.
SEED = 5


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def seeds(words: list[bytes], k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words."""
    import xxhash

    v = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(v) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = v[:n].copy()
    for j in range(1, k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + v[j : j + n]
    return _mix(h)


def anchors(h: np.ndarray, span: int) -> np.ndarray:
    """The least seed hash of each window: windows with equal words have equal anchors."""
    width, least = 1, h
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    return least


def windows(h: np.ndarray, span: int, k: int, hash_bits: int = 64) -> np.ndarray:
    """A hash of each window of span + k - 1 words, of seed hashes that cover it."""
    n = len(h) - span + 1
    out = np.zeros(n, np.uint64)
    for at in sorted({*range(0, span, k), span - 1}):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[at : at + n]
    return _mix(out) >> np.uint64(64 - hash_bits)


def _maybe(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(64 * len(table) - 1)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _held(table: DataFrame, words: int):
    """The bit table as a broadcast array of fixed size."""
    rows = table.toArrow()
    bits = np.zeros(words, np.uint64)
    bits[np.asarray(rows.column("word"), np.int64)] = np.asarray(rows.column("bits"), np.int64).view(np.uint64)
    return table.sparkSession.sparkContext.broadcast(bits)


def _per_document(docs: DataFrame, rows_of: Callable, names: list[str]) -> DataFrame:
    """Rows (id, *names) of each document, all long; rows_of(words) gives equally long arrays."""
    schema = T.StructType([T.StructField("doc", docs.schema["doc"].dataType), *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, found = [], []
            for i, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                rows = rows_of(words)
                if len(rows[0]):
                    index.append(np.full(len(rows[0]), i, np.int64))
                    found.append(rows)
            if index:
                cols = [np.concatenate([f[j] for f in found]) for j in range(len(names))]
                where = np.concatenate(index)
                for at in range(0, len(where), 1 << 18):
                    part = slice(at, at + (1 << 18))
                    arrays = [batch.column(0).take(pa.array(where[part])), *(pa.array(c[part].view(np.int64)) for c in cols)]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc", *names])

    return docs.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 13, filter_words: int = FILTER_WORDS, hash_bits: int = 64) -> DataFrame:
    """Maximal shared paths: ``doc``, ``start`` and ``length`` (words), ``src`` and ``src_start``, one row per occurrence in a document with a larger id than the path's first one.

    Edges of the graph are windows of ``width`` words, hashed to ``hash_bits`` bits. (1) Each window is anchored by the least hash of
    the seed k-mers in it; anchors that occur in two documents are found by one aggregation and kept as a bit filter of
    fixed size, so that only windows that may repeat are shuffled; a full filter lets more through but loses none. (2)
    Windows are aggregated to edges with their source coordinates (smallest document and a place in it) and a fingerprint
    of all their occurrences, as they are and moved by one word. (3) An edge continues in the next one along the source
    if all occurrences of the one go on in the other and none joins from elsewhere, which is when they are as many and
    the moved fingerprint of the first equals the second's: such nonbranching paths compact to one row. A node (width - 1
    words) branches exactly where this fails, so the runs of steps along the sources are the graph's unbranched paths,
    and no table of nodes is built. (4) Occurrences of the paths' first
    edges are joined with the paths, again behind a filter.
    """
    k = min(SEED, width)
    span = width - k + 1
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc is not null")

    def anchored(words):
        h = seeds(words, k)
        return (np.unique(anchors(h, span)) if len(h) >= span else h[:0],)

    common = _per_document(rows, anchored, ["anchor"]).groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high")
    known = _held(bit_table(common, F.col("anchor"), filter_words), filter_words)

    def candidates(words, heads=None):
        h = seeds(words, k)
        if len(h) < span:
            return h[:0], h[:0]
        at = np.flatnonzero(_maybe(known.value, anchors(h, span)))
        edge = windows(h, span, k, hash_bits)[at] if len(at) else h[:0]
        if heads is not None:
            mask = _maybe(heads.value, edge)
            at, edge = at[mask], edge[mask]
        return edge, at

    low = F.lit((1 << 32) - 1).cast("long")
    here = F.xxhash64("doc", "pos").bitwiseAND(low)
    moved = F.shiftleft(F.xxhash64("doc", F.col("pos") + 1), 32)
    occurrences = _per_document(rows, candidates, ["edge", "pos"])
    edges = occurrences.groupBy("edge").agg(
        F.min_by("pos", "doc").alias("pos"),
        F.min("doc").alias("src"),
        F.max("doc").alias("high"),
        F.bit_xor(here.bitwiseOR(moved)).alias("where"),
        F.count("*").alias("times"),
    ).filter("src < high")

    along = Window.partitionBy("src").orderBy("pos", "edge")
    goes_on = (F.col("pos") == F.lag("pos").over(along) + 1) & (F.col("high") == F.lag("high").over(along)) & (F.col("times") == F.lag("times").over(along)) & (F.shiftrightunsigned(F.lag("where").over(along), 32) == F.col("where").bitwiseAND(low))
    steps = edges.withColumn("opens", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    paths = steps.withColumn("path", F.sum("opens").over(along)).groupBy("src", "path").agg(F.count("*").alias("n"), F.min("pos").alias("src_start"), F.max(F.when(F.col("opens") == 1, F.col("edge"))).alias("edge")).drop("path")
    paths = written(paths, "paths")

    heads = _held(bit_table(paths, F.col("edge"), filter_words), filter_words)
    starts = _per_document(rows, lambda words: candidates(words, heads), ["edge", "pos"])
    found = starts.join(paths, "edge").filter("doc > src")
    return found.select("doc", F.col("pos").alias("start"), (F.col("n") + width - 1).alias("length"), "src", "src_start")


def _asked(docs: DataFrame, places: DataFrame, filter_words: int, id_col: str, text_col: str) -> DataFrame:
    """doc, text, places (start, length) of the documents that hold a place; only rows that a filter marks are shuffled."""
    asked = places.groupBy("doc").agg(F.collect_list(F.struct("start", "length")).alias("places"))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    key = F.xxhash64("doc")
    return marked(rows, key, bit_table(asked, key, filter_words), filter_words).filter("__maybe").select("doc", "text").join(asked, "doc")


def odd_paths(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", filter_words: int) -> DataFrame:
    """src, src_start, length of the paths that have a span whose words differ from those at its source coordinates.

    Each distinct place is read once, so a passage that many documents share is one place of its source.
    """
    places = spans.select("doc", "start", "length").unionByName(spans.select(F.col("src").alias("doc"), F.col("src_start").alias("start"), "length")).distinct()
    held = _asked(docs, places, filter_words, id_col, text_col)
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("digest", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, found = [], []
            for i, (text, asks) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                for a in asks:
                    index.append(i)
                    found.append((a["start"], a["length"], hashlib.sha256(b" ".join(words[a["start"] : a["start"] + a["length"]])).digest()))
            starts, lengths, digests = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests, pa.binary())], schema.names)

    digests = written(held.mapInArrow(run, schema), "span-digests")
    target = spans.join(digests.withColumnRenamed("digest", "own"), ["doc", "start", "length"], "left")
    source = digests.select(F.col("doc").alias("src"), F.col("start").alias("src_start"), "length", F.col("digest").alias("theirs"))
    place = ["src", "src_start", "length"]
    # All spans of one source place that hold the same words are one row before they meet the source.
    kinds = target.groupBy(*place, "own").agg(F.count("*").alias("n")).drop("n")
    odd = kinds.join(source, place, "left").filter(~F.coalesce(F.col("own") == F.col("theirs"), F.lit(False)))
    return written(odd.select(*place).distinct(), "odd-paths")


def spans_by_words(docs: DataFrame, paths: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 13, filter_words: int, hash_bits: int = 64) -> DataFrame:
    """The spans, one window each, of all windows that share a hash with a window of the paths (src, src_start, length).

    Windows are told apart by the SHA-256 of their words, so hashes that meet do no harm. Other windows that the filter
    lets through give right spans too.
    """
    k = min(SEED, width)
    span = width - k + 1
    places = paths.select(F.col("src").alias("doc"), F.col("src_start").alias("start"), "length")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, asks in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                h = seeds((text.as_py() or "").encode("utf-8", "surrogatepass").split(), k)
                edges = windows(h, span, k, hash_bits) if len(h) >= span else h[:0]
                found = np.unique(np.concatenate([edges[a["start"] : a["start"] + a["length"] - width + 1] for a in asks]))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["edge"])

    edges = _asked(docs, places, filter_words, id_col, text_col).mapInArrow(hashed, "edge long").distinct()
    known = _held(bit_table(edges, F.col("edge"), filter_words), filter_words)

    def occurrences(words):
        h = seeds(words, k)
        at = np.flatnonzero(_maybe(known.value, windows(h, span, k, hash_bits))) if len(h) >= span else np.empty(0, np.int64)
        digests = b"".join(hashlib.sha256(b" ".join(words[i : i + width])).digest() for i in at.tolist())
        return (at, *np.frombuffer(digests, np.int64).reshape(-1, 4).T)

    digest = ["d0", "d1", "d2", "d3"]
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc is not null")
    found = written(_per_document(rows, occurrences, ["start", *digest]), "windows-by-words")
    first = found.groupBy(*digest).agg(F.min("doc").alias("src"), F.max("doc").alias("high"), F.min_by("start", "doc").alias("src_start")).filter("src < high")
    return found.join(first, digest).filter("doc > src").select("doc", "start", F.lit(width).cast("long").alias("length"), "src", "src_start")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 13, filter_words: int | None = None, hash_bits: int = 64) -> DataFrame:
    """One row per input row: the id, ``n_words``, ``n_removed``, ``spans`` (start, length, src, src_start) and ``kept`` (the words left, joined by one space).

    A word goes if a window of ``width`` words that covers it also starts in a document with a smaller id; windows are
    judged on the input. Words stand between ASCII white space. Spans come from ``repeated_spans``; each one's words are
    then compared with the words at its source coordinates by SHA-256. Where they differ (in a large corpus hashes of
    other windows meet), ``spans_by_words`` finds the spans of these paths anew, so that no word goes or stays for a
    chance match.

    Null and empty texts have no words. A document with a null id, and one whose id is not larger, is never shortened
    for another; rows that repeat an id do not shorten each other, and count as copies of one document. An empty table
    gives no rows; extra columns are ignored.
    """
    names = {"id_col": id_col, "text_col": text_col}
    filter_words = filter_words or min(max(FILTER_WORDS, 1 << (docs.count() // 4).bit_length()), MOST_FILTER_WORDS)
    spans = written(repeated_spans(docs, **names, width=width, filter_words=filter_words, hash_bits=hash_bits), "spans")
    odd = odd_paths(docs, spans, **names, filter_words=filter_words >> 3)
    if not odd.isEmpty():
        exact = spans_by_words(docs, odd, **names, width=width, filter_words=filter_words, hash_bits=hash_bits)
        spans = written(spans.join(odd, ["src", "src_start", "length"], "left_anti").unionByName(exact), "spans")
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    by_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "length", "src", "src_start")).alias("spans"))
    part = marked(rows, F.xxhash64("doc"), bit_table(by_doc, F.xxhash64("doc"), filter_words >> 3), filter_words >> 3)
    hit = part.filter("__maybe").drop("__maybe").join(by_doc, "doc", "left")
    clean = part.filter("not __maybe").drop("__maybe").withColumn("spans", F.lit(None).cast(by_doc.schema["spans"].dataType))

    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", by_doc.schema["spans"].dataType), T.StructField("kept", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, texts = [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                sizes.append(len(words))
                if not found.is_valid:
                    gone.append(0)
                    texts.append(b" ".join(words))
                    continue
                cover = np.zeros(len(words) + 1, np.int64)
                held = found.values
                np.add.at(cover, held.field("start").to_numpy(), 1)
                np.add.at(cover, np.minimum(held.field("start").to_numpy() + held.field("length").to_numpy(), len(words)), -1)
                left = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                gone.append(len(words) - len(left))
                texts.append(b" ".join([words[i] for i in left]))
            kept = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), batch.column(2), kept], schema.names)

    return hit.unionByName(clean).mapInArrow(run, schema)
