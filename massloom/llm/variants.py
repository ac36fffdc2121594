"""Spelling variants: words one code point apart, found as equal pairs of trie nodes."""

from __future__ import annotations

import os.path
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.common import written

#: Characters of a text that are runs at once, and distinct words that a task counts before it passes them on.
TEXT_BLOCK, HELD = 1 << 20, 200_000
_runs = re.compile("[a-zÀ-ÿ]+").findall
_other = re.compile("[^a-zÀ-ÿ]").search


def _parts(text: str) -> Iterator[list[str]]:
    """The lower-cased (A-Z only) runs of letters of a text, as lists of a bounded part of it each."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    at = 0
    while at < len(text):
        cut = _other(text, at + TEXT_BLOCK)
        end = cut.start() if cut else len(text)
        yield _runs(text[at:end])
        at = end


def slipped(run: str, seed: int, every: int) -> str:
    """The run, or, where ``every`` divides the CRC-32 that goes on from ``seed`` over it, the run less the code point that this number picks."""
    h = zlib.crc32(run.encode("utf-8"), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def occurrences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every: int = 97, shortest: int = 5) -> DataFrame:
    """word, n: occurrences of each word of at least ``shortest`` code points over all texts, after slips.

    A slip depends on the document's id (as text; a null id is empty) and the run. A null text has no words, and rows
    that repeat count again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                seed = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for part in _parts(text.as_py() or ""):
                    for word, n in Counter(part).items():
                        word = slipped(word, seed, every)
                        if len(word) >= shortest:
                            held[word] += n
                    if len(held) >= HELD:
                        yield told()
        yield told()

    rows = docs.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shared(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


def trie(words: DataFrame) -> DataFrame:
    """word and ``nodes``, the numbers of the trie nodes of its prefixes, from the empty one to the whole word.

    words: distinct ``word``. Words are ranged and sorted, so the words below a node are neighbours; a node's number is
    the number of letters (and ends) of all words before the first one below it, plus its depth. Each task numbers its
    range from 0; a range's start and the nodes that its first word shares with the range before come from one row a
    task. Numbers of whole words ascend with the words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, nodes, at = TaskContext.get().partitionId(), None, [], 0
        for batch in batches:
            found = []
            for word in batch.column(0).to_pylist():
                k = -1 if before is None else _shared(before, word)
                nodes = nodes[: k + 1] + list(range(at + k + 1, at + len(word) + 1))
                found.append(nodes)
                at += len(word) + 1
                before = word
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * batch.num_rows, pa.int32()), pa.array(found, pa.list_(pa.int64()))], ["word", "part", "nodes"])

    ranged = words.select("word").repartitionByRange("word").sortWithinPartitions("word")
    local = written(ranged.mapInArrow(run, "word string, part int, nodes array<long>"), "trie")
    ends = local.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last"), F.max_by("nodes", "word").alias("nodes"), F.sum(F.size("nodes")).alias("used"))
    moves, base, last, path = [], 0, None, []
    for r in sorted(ends.collect(), key=lambda r: r["part"]):  # one row a task
        shared = -1 if last is None else _shared(last, r["first"])
        known = path[: shared + 1]
        path = [known[x] if x <= shared else base + x for x in r["nodes"]]
        moves.append((r["part"], base, shared, known))
        base, last = base + r["used"], r["last"]
    moves = words.sparkSession.createDataFrame(moves, "part int, base long, shared long, known array<long>")
    number = lambda x: F.when(x <= F.col("shared"), F.get("known", x.cast("int"))).otherwise(F.col("base") + x)
    return local.join(F.broadcast(moves), "part").select("word", F.transform("nodes", number).alias("nodes"))


#: Kinds of entries: a word cut at a place, a word that skips a letter, and one that skips the first of equal letters.
CUT, SKIP, FIRST = 0, 1, 2


def entries(words: DataFrame) -> DataFrame:
    """p, s (prefix node, suffix node), kind, leaf and n: for each word its pair at every cut and over every skipped letter.

    words: leaf, n, word, pre and post (nodes of prefixes and of suffixes by length). Two words that skip to one pair
    differ by a replaced letter; a word that skips to a pair at which another is cut has one letter more. Skipping any of
    equal neighbours leaves the same word, so only the first of them counts as a deletion.
    """
    letters = F.split("word", "")
    size = F.size("pre") - 1
    entry = lambda p, s, kind: F.struct(p.alias("p"), s.alias("s"), kind.cast("tinyint").alias("kind"))
    again = lambda i: F.coalesce(F.get("letters", i) == F.get("letters", i - 1), F.lit(False))
    cuts = F.transform(F.sequence(F.lit(0), F.col("size")), lambda i: entry(F.get("pre", i), F.get("post", F.col("size") - i), F.lit(CUT)))
    skips = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: entry(F.get("pre", i), F.get("post", F.col("size") - i - 1), F.when(again(i), SKIP).otherwise(FIRST)))
    rows = words.withColumns({"letters": letters, "size": size}).select("leaf", "n", F.explode(F.concat(cuts, skips)).alias("e"))
    return rows.select("e.p", "e.s", "e.kind", "leaf", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """leaf, n_near (its near words) and best (struct: less, the negative count of its most frequent near word, and that word's leaf; ties to the smallest word).

    A pair of nodes holds at most one word that is cut there and one that skips there for each letter, 91 in all for the
    letters of ``occurrences``, so no group grows with the input, and no pair of words is emitted.
    """
    member = F.struct((-F.col("n")).alias("less"), "leaf", "kind")
    groups = entries(words).groupBy("p", "s").agg(F.array_sort(F.collect_list(member)).alias("m")).filter(F.size("m") > 1)
    replaced = lambda x, y: (x["kind"] != CUT) & (y["kind"] != CUT) & (x["leaf"] != y["leaf"])
    shifted = lambda x, y: ((x["kind"] == CUT) & (y["kind"] == FIRST)) | ((x["kind"] == FIRST) & (y["kind"] == CUT))
    met = F.transform("m", lambda x: F.struct(x["leaf"].alias("leaf"), F.filter("m", lambda y: replaced(x, y) | shifted(x, y)).alias("near")))
    rows = groups.select(F.explode(met).alias("x")).select("x.leaf", F.size("x.near").alias("near"), F.get("x.near", F.lit(0)).alias("y")).filter("near > 0")
    return rows.groupBy("leaf").agg(F.sum("near").alias("n_near"), F.min(F.struct("y.less", "y.leaf")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """leaf and root, the end of its chain of forms: pointers double in each round, and counts double along a chain, so six rounds do."""
    up = written(forms.select("leaf", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not up.filter("moved").isEmpty():
        further = up.select(F.col("leaf").alias("root"), F.col("root").alias("next"))
        step = up.select("leaf", "root").join(further, "root", "left")
        up = written(step.select("leaf", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return up.select("leaf", "root")


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every: int = 97, shortest: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of at least ``shortest`` code points and ``least`` occurrences.

    Two words are near if one inserted, deleted or replaced code point parts them. A word's form is its most frequent
    near word (ties: smallest) if that is ``times`` as frequent, else null; root is the end of the chain of forms.
    Nodes of the forward and the reversed trie are numbered (``trie``), and near words meet under one pair of numbers
    (``neighbours``). Null and empty texts have no words; an empty table gives no rows; repeated rows count again.
    """
    words = written(occurrences(docs, id_col=id_col, text_col=text_col, every=every, shortest=shortest).filter(F.col("n") >= least), "words")
    forward = trie(words).select("word", F.col("nodes").alias("pre"))
    back = trie(words.select(F.reverse("word").alias("word"))).select(F.reverse("word").alias("word"), F.col("nodes").alias("post"))
    words = written(words.join(forward, "word").join(back, "word").withColumn("leaf", F.element_at("pre", -1)), "words-numbered")
    near = written(neighbours(words), "near")
    lean = words.select("leaf", "word", "n")
    known = lean.join(near, "leaf", "left").withColumn("form", F.when(-F.col("best.less") >= F.col("n") * times, F.col("best.leaf")))
    forms = known.filter("form is not null").select("leaf", "form")
    said = lambda at, word, *more: lean.select(F.col("leaf").alias(at), F.col("word").alias(word), *more)
    ends = roots(forms).join(said("root", "root_word"), "root").select("leaf", "root_word")
    rows = known.join(said("form", "form_word", F.col("n").alias("form_n")), "form", "left").join(ends, "leaf", "left")
    return rows.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
