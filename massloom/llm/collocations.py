"""Phrase collocations: windows of the top order are counted once, and a rollup sums their prefixes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massloom.llm.common import bit_table, text_or_empty, written
from massloom.operators.ranks import first_rows

#: Longest phrase.
ORDER = 4
#: Bytes of a text whose words are a list at once, and words that a task counts at once.
TEXT_BLOCK, BLOCK = 1 << 20, 1 << 19
#: 64-bit words of the pair filter: as the frequent pairs ask for, at most 32 MB.
LEAST_FILTER, MOST_FILTER = 1 << 10, 1 << 22
#: Ends of pieces become line feeds, tabs become blanks.
_ends = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n\n ")
_cut = re.compile(rb"[\x20\x09-\x0d.,;:!?]").search


def tokens(text: str) -> Iterator[list[bytes | None]]:
    """The words of a text (A-Z lower-cased), in lists of a bounded part of it each; None stands between pieces and at the end."""
    raw, at = text.encode("utf-8", "surrogatepass").lower(), 0
    while at < len(raw):
        cut = _cut(raw, at + TEXT_BLOCK)
        end = cut.start() if cut else len(raw)
        found = []
        for k, piece in enumerate(raw[at:end].translate(_ends).split(b"\n")):
            if k:
                found.append(None)
            found += piece.split()
        yield found
        at = end
    yield [None]


def blocks(batches: Iterator[pa.RecordBatch], ahead: int) -> Iterator[tuple[str, list[bytes | None]]]:
    """Language and words of many texts in a row; each word but the last ``ahead`` of a block is to be handled, those come again in the next one."""
    held, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            for part in tokens(text.as_py()):
                held.setdefault(lang, []).extend(part)
                size += len(part)
                if size >= BLOCK:
                    for k, words in held.items():
                        if len(words) > ahead:
                            yield k, words
                            held[k] = words[len(words) - ahead :]
                    size = 0
    for lang, words in held.items():
        yield lang, words + [None] * ahead


def _numbers(words: list[bytes | None]) -> tuple[np.ndarray, list[bytes | None]]:
    """Each word's number among the distinct ones; 0 is the end of a piece."""
    known: dict[bytes | None, int] = {None: 0}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return ids, list(known)


def _single(lang: str, names: list[bytes | None]) -> np.ndarray:
    """A hash of each word of the language."""
    import xxhash

    said = lang.encode("utf-8", "surrogatepass") + b"\0"
    return np.fromiter((xxhash.xxh3_64_intdigest(said + (w or b"")) for w in names), np.uint64, len(names))


def _longer(phrase: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word each."""
    mixed = phrase * np.uint64(0x9E3779B97F4A7C15) + last
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return mixed ^ (mixed >> np.uint64(29))


Counts = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]


def _frequent(texts: DataFrame, counts: Counts, least: int) -> DataFrame:
    """h: the hashes that the tasks' counts (hashes and their numbers, by parts) sum to ``least`` or more of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, n in counts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h")


def frequent_pairs(texts: DataFrame, least: int) -> DataFrame:
    """h: hashes under which at least ``least`` words or two neighbouring ones stand. Every word and pair that is so frequent is among them."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lang, words in blocks(batches, 1):
            ids, names = _numbers(words)
            h, n = _single(lang, names), np.bincount(ids[:-1], minlength=len(names))
            said = np.flatnonzero(n[1:]) + 1
            yield h[said], n[said]
            inside = (ids[:-1] > 0) & (ids[1:] > 0)
            yield np.unique(_longer(h[ids[:-1]], h[ids[1:]])[inside], return_counts=True)

    return _frequent(texts, counts, least)


def frequent_triples(texts: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """h: hashes under which at least ``least`` three neighbouring words stand; of those over pairs that are frequent, every triple that is so too is among them."""
    held = _filter(pairs)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lang, words in blocks(batches, 2):
            ids, names = _numbers(words)
            h = _single(lang, names)
            two = _longer(h[ids[:-1]], h[ids[1:]])
            on = _often(held.value, two) & (ids[:-1] > 0) & (ids[1:] > 0)
            yield np.unique(_longer(two[:-1], h[ids[2:]])[on[:-1] & on[1:]], return_counts=True)

    return _frequent(texts, counts, least)


def _filter(hashes: DataFrame) -> Broadcast:
    """A bit filter of the hashes, of a size that follows their number, up to 32 MB."""
    size, many = LEAST_FILTER, hashes.count()
    while size < MOST_FILTER and size * 4 < many:
        size *= 2
    rows = bit_table(hashes, F.col("h"), size).toArrow()  # at most ``size`` rows
    bits = np.zeros(size, np.uint64)
    bits[np.asarray(rows.column("word"), np.int64)] = np.asarray(rows.column("bits"), np.int64).view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def _often(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash is perhaps in the filter."""
    at = h & np.uint64(64 * len(table) - 1)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def windows(texts: DataFrame, frequent: DataFrame) -> DataFrame:
    """lang, w1 to w4 (lead columns) and n: the windows that begin at each word, counted by parts of the input.

    A window is padded with nulls from where its piece ends, and from the first word, pair or triple of neighbours that
    is not frequent: no phrase over such a one is. These reach the tasks as one bit filter of their hashes, of up to
    32 MB; beyond some 10^8 hashes it lets more windows through whole and loses none.
    """
    held = _filter(frequent)
    columns = ["lang", *(f"w{k + 1}" for k in range(ORDER)), "n"]

    def told(lang: str, names: pa.Array, ids: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        said = [names.take(pa.array(i)) for i in ids]
        return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), *said, pa.array(n.astype(np.int64))], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for lang, words in blocks(batches, ORDER - 1):
            ids, words = _numbers(words)
            m = len(ids) - ORDER + 1
            h = _single(lang, words)
            two = _longer(h[ids[:-1]], h[ids[1:]])
            often = _often(table, two) & (ids[:-1] > 0) & (ids[1:] > 0)
            three = _often(table, _longer(two[:-1], h[ids[2:]])) & often[:-1] & often[1:]
            names, lead, on = pa.array(words, pa.binary()).cast(pa.string()), [ids[:m]], ids[:m] > 0
            for k in range(1, ORDER):
                on = on & (often[:m] if k == 1 else three[k - 2 : k - 2 + m])
                lead.append(np.where(on, ids[k : k + m], 0))
            single = (lead[0] > 0) & (lead[1] == 0)
            n = np.bincount(lead[0][single], minlength=len(words))
            known = _often(table, h)
            n[0], known[0] = n[~known].sum(), True  # words that are rare count for their language alone
            n[~known] = 0
            alone = np.flatnonzero(n)
            yield told(lang, names, [alone] + [np.zeros(len(alone), np.int64)] * (ORDER - 1), n[alone])
            code = np.zeros(1, np.int64)
            for x in lead:  # numbers of distinct prefixes, word by word
                x = x[lead[1] > 0]
                code, first, inverse, n = np.unique(code * len(words) + x, return_index=True, return_inverse=True, return_counts=True)
                code = inverse
            yield told(lang, names, [x[lead[1] > 0][first] for x in lead], n)

    schema = ", ".join(["lang string", *(f"w{k + 1} string" for k in range(ORDER)), "n long"])
    return texts.mapInArrow(run, schema)


def phrases(texts: DataFrame, least: int) -> DataFrame:
    """lang, size, words, phrase and f: every phrase of 1 to 4 words with f >= ``least`` occurrences in its language, and with size 0 the number of all its words.

    The distinct windows are counted by one ROLLUP: its levels are the windows' prefixes, so each phrase's count is the sum of
    the windows that begin with it. Levels whose last word is padding are left out.
    """
    pairs = written(frequent_pairs(texts, least), "frequent-pairs")
    frequent = pairs.unionAll(written(frequent_triples(texts, pairs, least), "frequent-triples"))
    lead = [f"w{k + 1}" for k in range(ORDER)]
    counted = windows(texts, frequent).groupBy("lang", *lead).agg(F.sum("n").alias("n"))
    summed = counted.rollup("lang", *lead).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # Of the grouping bits, one for lang and each word, the low ones are set for the columns that a level sums over.
    size = ORDER - F.round(F.log2(F.col("level") + 1)).cast("int")
    rows = summed.filter(F.col("level") < 2**ORDER).withColumn("size", size).withColumn("words", F.slice(F.array(*lead), 1, F.greatest("size", F.lit(0))))
    rows = rows.filter((F.col("size") == 0) | ((F.col("f") >= least) & F.get("words", F.col("size") - 1).isNotNull()))
    return rows.select("lang", "size", "words", F.array_join("words", " ").alias("phrase"), "f")


def _exact(x) -> F.Column:
    return x.cast("decimal(20,0)")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 30, first: int = 2000, inside: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's ``first`` phrases by score, a (both descending) and phrase.

    A candidate is a phrase of 2 to 4 words with a >= ``least`` occurrences. Cut after its first words, with l and r
    occurrences of the two parts, it scores floor(2000000 a / (l + r)); its lowest cut counts (ties: the shortest first
    part). It is left out if a longer candidate around it has ``inside`` hundredths of its occurrences or more. All is
    counted by language (null: und); n is the number of words of the language. Null and empty texts have no words, and
    repeated rows count again.

    Parts of candidates are frequent phrases themselves, so their counts are looked up by joins.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    found = written(phrases(texts, least), "phrases")
    candidates = found.filter("size > 1").select("lang", "phrase", "words", "size", F.col("f").alias("a"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    said = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "cut", said(F.lit(1), F.col("cut")).alias("head"), said(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("tail"))
    known = lambda part, count: found.filter("size > 0").select("lang", F.col("phrase").alias(part), F.col("f").alias(count))
    cuts = cuts.join(known("head", "l"), ["lang", "head"]).join(known("tail", "r"), ["lang", "tail"])
    top, below = _exact(F.lit(2_000_000)) * _exact(F.col("a")), _exact(F.col("l")) + _exact(F.col("r"))
    cuts = cuts.withColumns({"top": top, "below": below}).withColumn("score", F.expr("top div below"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))

    part = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: F.array_join(F.slice("words", at, n), " ")))))
    longer = candidates.filter("size > 2").select("lang", part.alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("f").isNull() | (_exact(F.col("f")) * 100 < _exact(F.col("a")) * inside))

    rows = kept.select("lang", "phrase", "a", "low.l", "low.r", "low.score", (-F.col("low.score")).alias("__score"), (-F.col("a")).alias("__a"))
    order = ("__score", "__a", "phrase")
    rows = first_rows(rows, first, ("lang",), order).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    totals = found.filter("size = 0").select("lang", F.col("f").alias("n"))
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
