"""Token id files in document order, compressed by Re-Pair grammars, one grammar per shard."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massloom.llm.common import filesystem, shared_dir, written
from massloom.llm.tokens import WordBpe, encoder

MAGIC = b"RPTOK2\n"
#: Ids after which a task starts another shard.
SHARD_IDS = 4 << 20
#: A pair makes a rule if it occurs so often, or in one of so many symbols: a rule takes 12 bytes, and each use saves a symbol.
LEAST, SHARE = 24, 20_000


def _starts(symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a pair may be replaced at each place: within a document, and of a run of equal symbols at every other place from its start."""
    ok = ~last[:-1]
    same = (symbols[:-1] == symbols[1:]) & ok
    if same.any():
        at = np.flatnonzero(same)
        opens = np.concatenate(([True], np.diff(at) > 1))
        first = np.maximum.accumulate(np.where(opens, at, 0))
        ok[at[(at - first) % 2 == 1]] = False
    return ok


def _frequent(symbols: np.ndarray, ok: np.ndarray, least: int) -> np.ndarray:
    """Packed neighbouring pairs at the places given that can be replaced ``least`` times or more, most frequent first."""
    key = symbols[:-1][ok].astype(np.uint64) << np.uint64(32) | symbols[1:][ok]
    pairs, counts = np.unique(key, return_counts=True)
    often = np.flatnonzero(counts >= least)
    return pairs[often[np.lexsort((pairs[often], -counts[often]))]]


def _chosen(pairs: np.ndarray) -> list[int]:
    """Pairs that cannot overlap: no symbol is the left part of one and the right part of another; a pair of equal symbols stands alone."""
    side: dict[int, int] = {}
    chosen = []
    for pair in pairs.tolist():
        a, b = pair >> 32, pair & 0xFFFFFFFF
        if a == b:
            if a not in side:
                side[a] = 2
                chosen.append(pair)
        elif side.get(a, 0) == 0 and side.get(b, 1) == 1:
            side[a], side[b] = 0, 1
            chosen.append(pair)
    return chosen


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int, *, least: int = LEAST, share: int = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules as rows of two symbols, symbols up to the end of each document).

    Rounds go on as long as some pair occurs ``least`` times (and in one of ``share`` symbols); each replaces the
    frequent pairs that cannot overlap by new nonterminals, from left to right. Pairs do not cross documents. The counts
    of old pairs only fall, so a round counts those with a symbol of the round before and those left over from it.
    """
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    last[ends[ends > 0] - 1] = True
    made: list[tuple[int, int]] = []
    least = max(least, 2, len(symbols) // share)
    fresh, left_over = 0, np.empty(0, np.uint64)
    while len(symbols) > 1:
        ok = _starts(symbols, last)
        asked = ok
        if fresh:
            young = symbols >= fresh
            asked = young[:-1] | young[1:]
            if len(left_over):
                lefts, rights = np.zeros(vocabulary + len(made), bool), np.zeros(vocabulary + len(made), bool)
                lefts[left_over >> np.uint64(32)], rights[left_over & np.uint64(0xFFFFFFFF)] = True, True
                asked |= lefts[symbols[:-1]] & rights[symbols[1:]]
            asked &= ok
        pairs = _frequent(symbols, asked, least)
        chosen = _chosen(pairs)
        if not chosen:
            break
        first = fresh = vocabulary + len(made)
        left_over = pairs[~np.isin(pairs, np.array(chosen, np.uint64))]
        made += [(p >> 32, p & 0xFFFFFFFF) for p in chosen]
        lefts, rights = np.zeros(first, bool), np.zeros(first, bool)
        lefts[[p >> 32 for p in chosen]] = True
        rights[[p & 0xFFFFFFFF for p in chosen]] = True
        at = np.flatnonzero(lefts[symbols[:-1]] & rights[symbols[1:]] & ok)
        keys = symbols[at].astype(np.uint64) << np.uint64(32) | symbols[at + 1]
        table = np.array(chosen, np.uint64)
        order = np.argsort(table)
        found = np.minimum(np.searchsorted(table, keys, sorter=order), len(table) - 1)
        hit = table[order[found]] == keys
        at, rule = at[hit], order[found[hit]]
        symbols[at] = (first + rule).astype(np.uint32)
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, last = symbols[keep], last[keep]
    marks = np.flatnonzero(last) + 1
    stops = np.zeros(len(ends), np.int64)
    stops[np.diff(ends, prepend=0) > 0] = marks
    return symbols, np.array(made, np.uint32).reshape(-1, 2), np.maximum.accumulate(stops) if len(stops) else stops


class Grammar:
    """Rules with their expansion lengths; decodes any run of symbols, or a part of what it stands for."""

    def __init__(self, vocabulary: int, rules: np.ndarray, lengths: np.ndarray | None = None):
        if lengths is None:
            lengths = np.zeros(len(rules), np.int64)
            known = [1] * vocabulary
            for i, (a, b) in enumerate(rules.tolist()):
                known.append(known[a] + known[b])
                lengths[i] = known[-1]
        self.size = np.concatenate((np.ones(vocabulary, np.int64), lengths.astype(np.int64)))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.empty(int(self.size.sum()), np.uint32)
        self.flat[:vocabulary] = np.arange(vocabulary, dtype=np.uint32)
        start, size = self.start.tolist(), self.size.tolist()
        for i, (a, b) in enumerate(rules.tolist(), vocabulary):
            at, n = start[i], size[a]
            self.flat[at : at + n] = self.flat[start[a] : start[a] + n]
            self.flat[at + n : at + size[i]] = self.flat[start[b] : start[b] + size[b]]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.size[symbols]
        upto = np.cumsum(size)
        if not len(upto):
            return np.empty(0, np.uint32)
        return self.flat[np.repeat(self.start[symbols] - (upto - size), size) + np.arange(upto[-1])]

    def part(self, symbols: np.ndarray, low: int, high: int) -> np.ndarray:
        """Ids low to high (exclusive) of the expansion: the lengths tell the symbols that hold them, and only those are expanded."""
        upto = np.cumsum(self.size[symbols])
        if low >= high or not len(upto):
            return np.empty(0, np.uint32)
        first, end = int(np.searchsorted(upto, low, "right")), int(np.searchsorted(upto, high, "left")) + 1
        before = int(upto[first - 1]) if first else 0
        return self.expand(symbols[first:end])[low - before : high - before]


def dump(names: list[str | None], ids: np.ndarray, ends: np.ndarray, vocabulary: int) -> bytes:
    """A shard: header, then document names, ids and symbols up to each document's end, rules, expansion lengths, symbols."""
    symbols, rules, stops = compress(ids, ends, vocabulary)
    kind = "<u2" if vocabulary + len(rules) <= 1 << 16 else "<u4"
    lengths = Grammar(vocabulary, rules).size[vocabulary:]
    arrays = [(ends, "<i8"), (stops, "<i8"), (rules, "<u4"), (lengths, "<u4"), (symbols, kind)]
    parts = [json.dumps(names).encode(), *(a.astype(k).tobytes() for a, k in arrays)]
    head = json.dumps({"vocabulary": vocabulary, "kind": kind, "docs": len(names), "sizes": [len(p) for p in parts]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


class Shard:
    """An open shard file; ``document(i)`` and ``part(i, low, high)`` read only the symbols of that document."""

    def __init__(self, source):
        self.source = source
        head = source.read_at(len(MAGIC) + 4, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        size = struct.unpack("<I", head[len(MAGIC) :])[0]
        about = json.loads(source.read_at(size, len(head)))
        self.kind, at, raw = about["kind"], len(head) + size, []
        for n in about["sizes"][:-1]:
            raw.append(source.read_at(n, at))
            at += n
        self.symbols_at, self.symbols_size = at, about["sizes"][-1]
        self.names = json.loads(raw[0])
        self.ends, self.stops, rules, lengths = (np.frombuffer(r, k) for r, k in zip(raw[1:], ("<i8", "<i8", "<u4", "<u4"), strict=True))
        self.grammar = Grammar(about["vocabulary"], rules.reshape(-1, 2), lengths)

    def _symbols(self, i: int) -> np.ndarray:
        low, high = (int(self.stops[i - 1]) if i else 0), int(self.stops[i])
        width = int(self.kind[-1])
        return np.frombuffer(self.source.read_at((high - low) * width, self.symbols_at + low * width), self.kind)

    def document(self, i: int) -> np.ndarray:
        return self.grammar.expand(self._symbols(i))

    def part(self, i: int, low: int, high: int) -> np.ndarray:
        """Ids low to high (exclusive) of a document."""
        return self.grammar.part(self._symbols(i), low, high)

    def all(self) -> np.ndarray:
        return self.grammar.expand(np.frombuffer(self.source.read_at(self.symbols_size, self.symbols_at), self.kind))


_MANIFEST = "part int, shard int, file string, docs long, ids long"


def write_shards(docs: DataFrame, tokenizer: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Tokenise the documents in ascending order of their ids and write them as shards below ``folder``.

    Returns the written manifest, in the order of ``part`` and ``shard``. Ranges of ids go to tasks; a task closes a shard
    after ``shard_ids`` ids. Files carry the name of the task attempt; only accepted attempts are in the manifest.

    Each document is followed by ``end_id``. Null and empty texts are the end id alone; null ids come first; rows that
    repeat an id follow each other. An empty table gives no shards; extra columns are ignored.
    """
    names = ["part", "shard", "file", "docs", "ids"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(WordBpe, tokenizer)
        vocabulary = encode.whole.get_vocab_size(with_added_tokens=True)
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        task, shard = TaskContext.get(), 0
        held: list[bytes] = []
        docs_held: list[str | None] = []
        total = 0

        def close() -> pa.RecordBatch:
            nonlocal held, docs_held, total, shard
            path = f"{root}/{task.partitionId():06d}-{shard:04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.tok"
            ends = np.cumsum([len(h) // 4 for h in held])
            with fs.open_output_stream(path, compression=None) as out:
                out.write(dump(docs_held, np.frombuffer(b"".join(held), "<u4"), ends, vocabulary))
            row = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((task.partitionId(), shard, path, len(held), total), kinds, strict=True)], names)
            held, docs_held, total, shard = [], [], 0, shard + 1
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for name, ids in zip(part.column(0).to_pylist(), encode.batch([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    held.append(ids + end)
                    docs_held.append(name)
                    total += len(ids) // 4 + 1
                    if total >= shard_ids:
                        yield close()
        if held:
            yield close()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select(F.col("id").cast("string"), "text")
    return written(ordered.mapInArrow(run, _MANIFEST), "shards")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """``id`` (string), ``start`` (ids of all documents before it) and ``ids`` (binary, little-endian unsigned 32-bit) of every document, from the files.

    The manifest has one row per shard; its running sum is the only step that sees all of them.
    """
    names, kinds = ["id", "start", "ids"], [pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(file) as source:
                    shard = Shard(source)
                    ids = shard.all().astype("<u4")
                starts = np.concatenate(([0], shard.ends[:-1]))
                for low in range(0, len(starts), 4096):
                    part = range(low, min(low + 4096, len(starts)))
                    yield pa.RecordBatch.from_arrays([pa.array([shard.names[i] for i in part], kinds[0]), pa.array(before + starts[low : low + 4096], kinds[1]), pa.array([ids[starts[i] : shard.ends[i]].tobytes() for i in part], kinds[2])], names)

    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("ids").over(order), F.lit(0)))
    # A number of its own, as Spark would merge the few manifest rows, and with them all the reading, into one task.
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.select("file", "before").repartition(parts, "file").mapInArrow(run, "id string, start long, ids binary")


def store(docs: DataFrame, tokenizer: str, **columns) -> DataFrame:
    """Write the documents' ids below the shared folder and read them back; the id column has its name and type again."""
    folder, name = shared_dir(docs.sparkSession, "tokens"), columns.get("id_col", "doc_id")
    found = read_shards(write_shards(docs, tokenizer, folder, **columns), folder)
    return found.select(F.col("id").cast(docs.schema[name].dataType).alias(name), "start", "ids")
