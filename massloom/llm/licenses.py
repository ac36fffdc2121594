"""License scans by an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.common import bit_table, by_class, marked, text_or_empty, written
from massloom.llm.license_texts import NOTICES, PHRASES

#: Lower-cases A-Z and turns what stands between words into blanks, in UTF-8 bytes.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Templates and their words are held by every task; more than this is refused.
MOST_WORDS = 1_000_000
#: Words of the filter of texts with candidates: at most 2 MB, whatever the input.
FILTER_WORDS = 1 << 17


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass
class Template:
    """A template's words, and its distinct words in ascending corpus frequency.

    A block that shares ``least`` of them shares one of the first total - least + 1 (the prefix), and of the first j at
    least j - (total - least): ``looked_for`` holds twice the prefix, and ``need`` of them must be in the text.
    """

    label: str
    words: list[bytes]
    exact: bool  #: its words must stand consecutively in order
    least: int = 0  #: distinct words that a block must share
    need: int = 0
    order: dict[bytes, int] = field(default_factory=dict)
    looked_for: list[bytes] = field(default_factory=list)

    def arrange(self, counts: dict[bytes, int], threshold: float) -> None:
        ranked = sorted(set(self.words), key=lambda w: (counts.get(w, 0), w))
        total = len(ranked)
        self.order = {w: i for i, w in enumerate(ranked)}
        self.least = total if self.exact else max(1, math.ceil(threshold * total - 1e-9))
        prefix = total - self.least + 1
        self.looked_for = ranked[: min(total, 2 * prefix)]
        self.need = len(self.looked_for) - prefix + 1


def _blocks(template: Template, words: list[bytes], anchors: list[int]) -> Iterator[tuple[int, float]]:
    """(start, containment) of every block of len(template.words) words that shares at least ``least`` distinct words.

    A block is as long as the template, or the whole text if that is shorter. Only blocks around an anchor, a place of a
    word that is looked for, are counted, and neighbouring blocks from each other.
    """
    size, total, order = min(len(template.words), len(words)), len(template.order), template.order
    if size < template.least:
        return
    done = -1
    counts: Counter = Counter()
    for anchor in sorted(anchors):
        first, last = max(anchor - size + 1, done + 1, 0), min(anchor, len(words) - size)
        for start in range(first, last + 1):
            if template.exact:
                if words[start : start + size] == template.words:
                    yield start, 1.0
                continue
            if start == done + 1 and counts:
                out, into = words[start - 1], words[start + size - 1]
                if out in order:
                    counts[out] -= 1
                    if not counts[out]:
                        del counts[out]
                if into in order:
                    counts[into] += 1
            else:
                counts = Counter(w for w in words[start : start + size] if w in order)
            done = start
            if len(counts) >= template.least:
                yield start, len(counts) / total
        done = max(done, last)


def template_counts(docs: DataFrame, templates: list[Template], text_col: str = "text") -> dict[bytes, int]:
    """How often each word of the templates occurs in all documents; as many rows as the templates have words."""
    wanted = {w for t in templates for w in t.words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(filter(wanted.__contains__, words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = docs.select(text_or_empty(text_col)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}


def candidates(docs: DataFrame, templates: list[Template], text_col: str = "text") -> DataFrame:
    """said (digest of a text), n (its rows), asks (templates and the places of their words): the texts that may hold a block of a template.

    The places of the words that are looked for join the templates that look for them; of a text and a template stay
    those with enough such words (position) in a text that is long enough (length).
    """
    known = {w for t in templates for w in t.looked_for}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, found, places, sizes = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                if known.isdisjoint(words):
                    continue
                at: dict[bytes, list[int]] = {}
                for p, w in enumerate(words):
                    if w in known:
                        at.setdefault(w, []).append(p)
                index += [i] * len(at)
                found += at
                places += at.values()
                sizes += [len(words)] * len(at)
            columns = [batch.column(0).take(pa.array(index, pa.int64())), pa.array(found, pa.binary()), pa.array(places, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["said", "word", "places", "size"])

    told = docs.select(F.unhex(F.md5(text_or_empty(text_col))).alias("said"), text_or_empty(text_col).alias("text"))
    tokens = told.mapInArrow(run, "said binary, word binary, places array<long>, size long")
    tokens = tokens.groupBy("said", "word").agg(F.first("places").alias("places"), F.first("size").alias("size"), F.count("*").alias("n"))
    rows = [(bytearray(w), k, t.need, min(t.least, len(t.words))) for k, t in enumerate(templates) for w in t.looked_for]
    wanted = docs.sparkSession.createDataFrame(rows, "word binary, template int, need int, least int")  # at most MOST_WORDS rows
    joined = tokens.join(F.broadcast(wanted), "word").filter("size >= least")
    enough = joined.groupBy("said", "template").agg(F.count("*").alias("held"), F.first("need").alias("need"), F.flatten(F.collect_list("places")).alias("places"), F.max("n").alias("n"))
    return enough.filter("held >= need").groupBy("said").agg(F.max("n").alias("n"), F.collect_list(F.struct("template", "places")).alias("asks"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, threshold: float = 0.8) -> DataFrame:
    """One row per input row: the id, ``n_words`` and ``matches``: array of (label, exact, start, length, containment).

    Every block of consecutive words as long as a notice that shares at least ``threshold`` of its distinct words is a
    match, and every place where the words of a phrase stand in order. Words of all templates are ordered by their
    frequency in all documents; ``candidates`` joins texts and templates by the rarest ones, and what is left is counted
    exactly. Equal texts are looked for once; the rows of a text that many documents share are not joined by one task.

    The templates must have at most MOST_WORDS words, as each task holds them. Null texts count as empty and have no
    words. Repeated rows stay. An empty table gives no rows; extra columns are ignored.
    """
    templates = [Template(k, words_of(v), True) for k, v in phrases.items()] + [Template(k, words_of(v), False) for k, v in notices.items()]
    templates = [t for t in templates if t.words]
    if sum(len(t.words) for t in templates) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words of templates")
    counts = template_counts(docs, templates, text_col)
    for t in templates:
        t.arrange(counts, threshold)

    asked = written(candidates(docs, templates, text_col), "license-candidates")
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text_or_empty(text_col))).alias("said"), text_or_empty(text_col).alias("text"))
    key = F.xxhash64("said")
    part = marked(rows, key, bit_table(asked, key, FILTER_WORDS), FILTER_WORDS)
    hit = by_class(part.filter("__maybe"), asked, "said", "n", "left").select("id", "text", "asks")
    rest = part.filter("not __maybe").select("id", "text", F.lit(None).cast(asked.schema["asks"].dataType).alias("asks"))

    match = pa.struct([("label", pa.string()), ("exact", pa.bool_()), ("start", pa.int64()), ("length", pa.int64()), ("containment", pa.float64())])
    kinds = [("label", T.StringType()), ("exact", T.BooleanType()), ("start", T.LongType()), ("length", T.LongType()), ("containment", T.DoubleType())]
    found = T.ArrayType(T.StructType([T.StructField(*k) for k in kinds]))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("matches", found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, matches = [], []
            for text, asks in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = words_of(text.as_py())
                sizes.append(len(words))
                held = []
                for ask in sorted(asks or [], key=lambda a: a["template"]):
                    t = templates[ask["template"]]
                    size = min(len(t.words), len(words))
                    held += [{"label": t.label, "exact": t.exact, "start": s, "length": size, "containment": c} for s, c in _blocks(t, words, ask["places"])]
                matches.append(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(matches, pa.list_(match))], schema.names)

    return hit.unionByName(rest).mapInArrow(run, schema)
