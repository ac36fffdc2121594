"""Jaccard similarity of word shingles: prefix-filtered candidates, comparison of whole sets, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.common import bit_table, by_class, marked, text_or_empty, word_lists, written
from massloom.llm.components import components
from massloom.llm.tokens import let_go, tidied

#: Common shingles that tasks know the counts of, shingles that a task counts at once, and rounds before all pairs are compared.
COMMON, BLOCK, ROUNDS = 200_000, 1 << 20, 1
#: Bytes of texts that are sets at once in a task, and texts that meet one copy of the text they are compared with.
TEXT_BYTES, FAN = 4 << 20, 256
FILTER_WORDS = 1 << 17
SEED = 42
#: Words of 64 bits of a set's bitmap.
MAP_WORDS = 8


def hashes(text: str, width: int) -> np.ndarray:
    """The XXH64 values of the text's word shingles in order, repeats included; none without words.

    A-Z is lower-cased, words stand between ASCII white space, a text of fewer than ``width`` words is one shingle.
    """
    import xxhash

    found, words = [], []
    for part in word_lists(text.encode("utf-8", "surrogatepass").lower()):
        words += part
        n = len(words) - width + 1
        if n > 0:
            said = zip(*(words[k:] for k in range(width)), strict=False)
            found.append(np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in said), np.uint64, n))
            words = words[n:]
    if found:
        return found[0] if len(found) == 1 else np.concatenate(found)
    return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)


def shingles(values: np.ndarray) -> np.ndarray:
    """The set of hashes, sorted; that of a text without words holds one number, so that such texts equal each other."""
    return np.unique(values) if len(values) else np.zeros(1, np.uint64)


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of some TEXT_BYTES of its text column; a longer text is a part with those before it."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64) // TEXT_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
    for at, end in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(at, end - at)


def _mapped(rows: DataFrame, schema: str | T.StructType, column: int, rows_of: Callable) -> DataFrame:
    """rows_of each part of a batch and the number of its first row; numbers are unique over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in _blocks(batch, column):
                yield rows_of(part, number)
                number += part.num_rows

    return rows.mapInArrow(tidied(run), schema)


def bitmap(values: np.ndarray) -> np.ndarray:
    """A set as MAP_WORDS numbers: each shingle turns one bit over, so two bitmaps differ in at most as many bits as the sets in shingles."""
    odd = np.bincount((values % np.uint64(64 * MAP_WORDS)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def common(docs: DataFrame, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts hold, sorted, and their counts over all documents.

    Each task counts the sets of all its texts, some millions of shingles at a time, and tells those that it saw
    twice or more; the counts only order the shingles, and any order gives the same pairs. At most COMMON come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            often = n > 1
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["s", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.append(shingles(hashes(text.as_py(), width)))
                size += len(held[-1])
                if size >= BLOCK:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    said = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(tidied(run), "s long, n long")
    totals = written(said.groupBy("s").agg(F.sum("n").alias("n")), "common-shingles")
    # The least count of which at most COMMON shingles are: a table of counts, which are few.
    upto = totals.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).limit(COMMON).collect()
    least, held = 0, 0
    for row in upto:
        held += row["m"]
        if held > COMMON:
            break
        least = row["n"]
    found = totals.filter(F.col("n") >= (least or 1 << 62)).toArrow()
    names, counts = (found.column(c).to_numpy() for c in ("s", "n"))
    order = np.argsort(names.view(np.uint64))
    let_go()
    return names[order].view(np.uint64), counts[order]


def _prefix(values: np.ndarray, names: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rarest shingles, in order, of which two sets of similarity num / den share one at least: all but ceil(n * num / den) - 1."""
    n = len(values)
    often = np.zeros(n, np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, values), len(names) - 1)
        often = np.where(names[at] == values, counts[at], 0)
    return values[np.lexsort((values, often))][: n - -(-n * num // den) + 1]


def _said(text_col: str) -> Column:
    """Name of a whole text."""
    return F.unhex(F.md5(text_or_empty(text_col)))


def shingled(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, print_of: Callable[[np.ndarray], int]) -> DataFrame:
    """id, c (a number of the row), said (digest of the text), n (size of its set), fp (print_of its hashes), keys (the prefix of its set) and map (its bitmap)."""
    names, counts = common(docs, text_col, width)
    kinds = [("id", docs.schema[id_col].dataType), ("c", T.LongType()), ("said", T.BinaryType()), ("n", T.LongType()), ("fp", T.LongType()), ("keys", T.ArrayType(T.LongType())), ("map", T.ArrayType(T.LongType()))]

    def rows_of(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        prints, sizes, keys, maps = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64), [], []
        for k, text in enumerate(batch.column(2)):
            values = hashes(text.as_py(), width)
            prints[k] = print_of(values) if len(values) else 0
            values = shingles(values)
            sizes[k] = len(values)
            keys.append(_prefix(values, names, counts, num, den))
            maps.append(bitmap(values))
        numbers = pa.array(np.arange(at, at + batch.num_rows, dtype=np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), numbers, batch.column(1), pa.array(sizes), pa.array(prints.view(np.int64)), _lists(keys), _lists(maps)], [n for n, _ in kinds])

    told = docs.select(F.col(id_col).alias("id"), _said(text_col).alias("said"), text_or_empty(text_col).alias("text"))
    return _mapped(told, T.StructType([T.StructField(*k) for k in kinds]), 2, rows_of)


Verify = Callable[[DataFrame], DataFrame]


def _compared(width: int, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of texts in the order of their groups, each led by the text (``leads``) that the group's others are compared with, the pairs that are near.

    A task holds the set of the leading text and that of one other at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.empty(0, np.uint64)
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for k, (leads, text) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                values = shingles(hashes(text.as_py(), width))
                if leads.as_py():
                    first = values
                else:
                    both = len(np.intersect1d(first, values, assume_unique=True))
                    near[k] = both * (num + den) >= (len(first) + len(values)) * num
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def verifier(docs: DataFrame, rows: DataFrame, text_col: str, width: int, num: int, den: int) -> Verify:
    """A function of written pairs (a, b) that gives those whose sets have a similarity of num / den or more.

    Of a pair, the text that is in more pairs leads; a text that leads many is sent once for some FAN others, which are
    a group in one task's order. Only texts that the pairs name are shuffled, as texts, and no row holds a set.
    """
    told = docs.select(_said(text_col).alias("said"), text_or_empty(text_col).alias("text"))
    repeated = rows.agg((F.count("*") > F.countDistinct("said")).alias("any")).first()["any"]

    def verify(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
        ends = written(ends.join(rows.select("c", "said"), "c"), "near-ends")
        of = lambda c: ends.select(F.col("c").alias(c), F.col("n").alias(f"n_{c}"), F.col("said").alias(f"of_{c}"))
        asked = by_class(by_class(pairs.select("a", "b"), of("a"), "a", "n_a"), of("b"), "b", "n_b")
        more = F.col("n_a") >= F.col("n_b")
        asked = asked.select("a", "b", F.when(more, F.col("of_a")).otherwise(F.col("of_b")).alias("lead"), F.when(more, F.col("of_b")).otherwise(F.col("of_a")).alias("said"), F.greatest("n_a", "n_b").alias("n"))
        asked = written(asked.withColumn("part", F.pmod(F.xxhash64("said"), F.ceil(F.col("n") / FAN))).drop("n"), "near-asked")
        none = F.lit(None).cast("long")
        leads = asked.select("lead", "part").distinct().select(F.col("lead").alias("said"), "lead", "part", F.lit(True).alias("leads"), none.alias("a"), none.alias("b"))
        sides = leads.unionAll(asked.select("said", "lead", "part", F.lit(False), "a", "b"))
        hashed = F.xxhash64("said")
        texts = marked(told, hashed, bit_table(ends, hashed, FILTER_WORDS), FILTER_WORDS).filter("__maybe").select("said", "text")
        if repeated:
            texts = texts.dropDuplicates(["said"])
        groups = sides.join(texts.hint("shuffle_merge"), "said").repartition("lead", "part").sortWithinPartitions("lead", "part", F.desc("leads"))
        return groups.select("leads", "text", "a", "b").mapInArrow(tidied(_compared(width, num, den)), "a long, b long")

    return verify


def _can_reach(num: int, den: int) -> Column:
    """Length bound, and the bound of what can follow the shared shingle in both orders (places i and j)."""
    longest = F.least("n", "m") * den >= F.greatest("n", "m") * num
    behind = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    return longest & (behind * (num + den) >= (F.col("n") + F.col("m")) * num)


def _enough(num: int, den: int) -> Column:
    """Bound of two sets that share ``both`` shingles of their prefixes: of the one whose prefix ends first, only what follows it can be shared beside."""
    behind = F.greatest(F.ceil(F.col("n") * num / den), F.ceil(F.col("m") * num / den)) - 1
    return (F.col("both") + behind) * (num + den) >= (F.col("n") + F.col("m")) * num


def _shared(keys: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The keys of two sets or more, without those of two sets that cannot reach the similarity there: most chance meetings end here.

    The second table tells the keys left out: ``lost`` of each pair (a, b).
    """
    held = F.struct("c", F.col("n").cast("long").alias("n"), F.col("i").cast("long").alias("i"))
    found = keys.groupBy("key").agg(F.count("*").alias("many"), F.min(held).alias("lo"), F.max(held).alias("hi")).filter("many > 1")
    ends = found.select("key", "many", F.col("lo.c").alias("a"), F.col("hi.c").alias("b"), "lo.n", "lo.i", F.col("hi.n").alias("m"), F.col("hi.i").alias("j"))
    stays = F.when(F.col("many") > 2, True).otherwise(_can_reach(num, den))
    seen = written(ends.select("key", "a", "b", stays.alias("stays")), "shared-keys")
    return seen.filter("stays").select("key"), seen.filter("not stays").groupBy("a", "b").agg(F.count("*").alias("lost"))


def _mixed(left: DataFrame, found: DataFrame, compared: DataFrame) -> DataFrame:
    """left with ``root``, the component of each set over the links found, less the keys whose sets are all of one or are two that were compared."""
    roots = written(components(found).select(F.col("node").alias("c"), F.col("root").alias("now")), "near-roots")
    rest = written(left.join(roots, "c", "left").select("key", "c", "n", "i", F.coalesce("now", "c").alias("root")), "near-rooted")
    held = rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("many"), F.min("c").alias("a"), F.max("c").alias("b"))
    mixed = held.filter("lo <> hi")
    two = mixed.filter("many = 2").join(compared, ["a", "b"], "left_anti")
    mixed = mixed.filter("many > 2").select("key").unionAll(two.select("key"))
    return written(rest.join(mixed, "key"), "near-left")


MAP = [f"x{k}" for k in range(MAP_WORDS)]


def _differ(words: list[Column]) -> Column:
    return sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0]))


def _few(differ: Column, n: Column, m: Column, num: int, den: int) -> Column:
    """Bound of two sets of at most n and m shingles that differ in ``differ`` ones at least."""
    return differ * (num + den) <= (n + m) * (den - num)


def _near_roots(left: DataFrame, sets: DataFrame, lost: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of components (r, q) with sets that may reach the similarity, by the bounds of ``links`` over the sizes, places and bitmaps of each one's sets.

    First the pairs with at most as many pairs of their sets as these meet under the keys, then key, r, q of the others.

    A key holds a component once, so a group of copies under a common key is one row there. Of a component's bitmaps
    there are the bits that all have and those that some have: a bit that all of one have and none of the other differs
    in every pair of their sets.
    """
    every, some = ([f"{w}{c}" for c in MAP] for w in ("all_", "any_"))
    held = left.groupBy("key", "root").agg(F.count("*").alias("many"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("i").alias("at"), *(F.bit_and(c).alias(e) for c, e in zip(MAP, every, strict=True)), *(F.bit_or(c).alias(e) for c, e in zip(MAP, some, strict=True)))
    held = written(held, "near-held")
    one, two = (held.select("key", F.col("root").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("many", "lo", "hi", "at", *every, *some))) for x in "rq")
    apart = lambda x, y: [F.col(f"{e}_{x}").bitwiseAND(F.bitwise_not(f"{s}_{y}")) for e, s in zip(every, some, strict=True)]
    few = _few(_differ(apart("r", "q") + apart("q", "r")), F.col("hi_r"), F.col("hi_q"), num, den)
    sizes = (F.col("hi_r") * den >= F.col("lo_q") * num) & (F.col("hi_q") * den >= F.col("lo_r") * num)
    place = lambda x, y: F.col(f"hi_{x}") * den - F.col(f"at_{x}") * (num + den) >= F.col(f"lo_{y}") * num
    ends = [F.min("lo_r").alias("lo_r"), F.max("hi_r").alias("hi_r"), F.min("lo_q").alias("lo_q"), F.max("hi_q").alias("hi_q")]
    under = one.join(two, "key").filter((F.col("r") < F.col("q")) & sizes & few)
    under = written(under.select("key", "r", "q", *(f"{c}_{x}" for x in "rq" for c in ("many", "lo", "hi", "at"))), "near-under")
    met = under.groupBy("r", "q").agg(F.count("*").alias("both"), F.sum(F.col("many_r") * F.col("many_q")).alias("meet"), F.max(place("r", "q") & place("q", "r")).alias("reach"), *ends).filter("reach")
    root = sets.select("c", "root")
    gone = lost.join(root.select(F.col("c").alias("a"), F.col("root").alias("x")), "a").join(root.select(F.col("c").alias("b"), F.col("root").alias("y")), "b")
    gone = gone.groupBy(F.least("x", "y").alias("r"), F.greatest("x", "y").alias("q")).agg(F.sum("lost").alias("lost"))
    both = (F.col("both") + F.coalesce("lost", F.lit(0))) * den * (num + den)
    enough = lambda x, y: both + F.col(f"hi_{x}") * num * num >= F.col(f"lo_{y}") * num * den
    near = met.join(gone, ["r", "q"], "left").filter(enough("r", "q") | enough("q", "r"))
    size = lambda x: sets.groupBy(F.col("root").alias(x)).agg(F.count("*").alias(f"size_{x}"))
    near = near.join(size("r"), "r").join(size("q"), "q").select("r", "q", (F.col("size_r") * F.col("size_q") <= F.col("meet")).alias("whole"))
    near = written(near, "near-roots-pairs")
    return near.filter("whole").select("r", "q"), under.select("key", "r", "q").join(near.filter("not whole"), ["r", "q"], "left_semi")


def _candidates(left: DataFrame, maps: DataFrame, lost: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that may reach the similarity; left: key, c, n, i, root.

    The sets of two components share most of their keys, so they would meet once a key. All their pairs are listed once
    instead, without the keys, unless the components are so large and meet under so few keys that these list fewer.
    """
    sets = written(left.select("c", "n", "root").distinct().join(maps, "c"), "near-sets")
    left = written(left.join(sets.select("c", *MAP), "c"), "near-mapped")
    whole, keyed = _near_roots(left, sets, lost, num, den)
    keyed = written(keyed, "near-keyed")
    one = lambda t, *more: t.select(*more, F.col("c").alias("a"), "n", F.col("root").alias("r"), *MAP)
    two = lambda t, *more: t.select(*(F.col(c).alias({"i": "j"}.get(c, c)) for c in more), F.col("c").alias("b"), F.col("n").alias("m"), F.col("root").alias("q"), *(F.col(c).alias(f"y{c}") for c in MAP))
    long = F.least("n", "m") * den >= F.greatest("n", "m") * num
    few = _few(_differ([F.col(c).bitwiseXOR(F.col(f"y{c}")) for c in MAP]), F.col("n"), F.col("m"), num, den)
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    pairs = one(sets).join(whole, "r").join(two(sets), "q").filter(long & few).select(*ends)
    if keyed.isEmpty():
        return pairs
    met = one(left, "key", "i").join(keyed, ["key", "r"]).join(two(left, "key", "i"), ["key", "q"]).filter(long & few)
    met = met.groupBy("a", "b", "n", "m").agg(F.count("*").alias("both"), F.max(_can_reach(num, den)).alias("reach"))
    either = lost.unionAll(lost.select(F.col("b").alias("a"), F.col("a").alias("b"), "lost"))
    met = met.filter("reach").join(either, ["a", "b"], "left").withColumn("both", F.col("both") + F.coalesce("lost", F.lit(0)))
    return pairs.unionAll(met.filter(_enough(num, den)).select(*ends))


def links(keys: DataFrame, lost: DataFrame, maps: DataFrame, verify: Verify, near: DataFrame, num: int, den: int, rounds: int = ROUNDS) -> DataFrame:
    """Pairs (a, b) of sets at num / den or more that form the same components as all such pairs.

    keys: ``key``, ``c``, ``n``, ``i`` (prefix shingle, set, its size, the shingle's place in it); near: pairs to compare
    in the first round; lost: how many keys of a pair are left out of keys; maps: ``c`` and the words of its bitmap. In
    each of the first rounds a set is compared with one other only: of the sets under its keys, one that has the fewest
    rarer shingles, which in a group of edited copies is the text that they were made of. A key whose sets are then all
    of one component is done, so groups of copies fall together in a number of comparisons linear in their sets. Of the
    keys that are left, pairs of different components meet once a key, and of those that may be near by their sizes,
    their bitmaps and the keys that they share, all pairs of sets are compared that can reach the similarity by their
    lengths and by their bitmaps (near sets differ in few shingles, so in few bits). Pairs are listed once for two
    components, or, of those that meet under few keys, once a key; then the place of a shared shingle and the number of
    shingles that their prefixes share tell too
    (a key that both hold is left, or lost, or was dropped because they are of one component or were compared).
    """
    left, found = keys, near.limit(0)
    for k in range(max(1, rounds)):
        pairs = near.limit(0) if k else near
        if rounds:
            left = left if k else left.withColumn("root", F.col("c"))
            first = left.groupBy("key").agg(F.min(F.struct("i", F.xxhash64("c", F.lit(k)).alias("turn"), "c", "n", "root")).alias("f"))
            met = left.join(first, "key").withColumns({"m": F.col("f.n"), "j": F.col("f.i")}).filter((F.col("root") != F.col("f.root")) & _can_reach(num, den))
            met = met.groupBy("c").agg(F.min(F.struct("f.i", "f.turn", "f.c")).alias("f"))
            pairs = pairs.unionAll(met.select(F.least("c", "f.c").alias("a"), F.greatest("c", "f.c").alias("b")))
        pairs = written(pairs.distinct(), "near-pairs")
        found = written(found.unionAll(verify(pairs)), "near-links")
        left = _mixed(left.select("key", "c", "n", "i"), found, pairs)
    pairs = _candidates(left, maps, lost, num, den)
    return found.unionAll(verify(written(pairs, "near-pairs")))


def linked(docs: DataFrame, rows: DataFrame, near: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """The id of every row of ``shingled`` and ``component_id``, the smallest id of its component; near: pairs (a, b) to be compared first."""
    keys = rows.select("c", "n", F.posexplode("keys").alias("i", "key"))
    shared, lost = _shared(keys, num, den)
    hashed = F.col("key")
    maybe = marked(keys, hashed, bit_table(shared, hashed, FILTER_WORDS), FILTER_WORDS).filter("__maybe").select("key", "c", "n", "i")
    keys = written(maybe.join(shared, "key"), "near-keys")

    verify = verifier(docs, rows, text_col, width, num, den)
    maps = rows.select("c", *(F.col("map")[k].alias(c) for k, c in enumerate(MAP)))
    roots = components(links(keys, lost, maps, verify, near, num, den)).withColumnRenamed("node", "c")
    void = F.struct(F.col("id").isNull().alias("void"), "id")
    least = rows.select("c", "id").join(roots, "c")
    known = least.join(least.groupBy("root").agg(F.min(void).alias("first")), "root").select("c", "first")
    return rows.join(known, "c", "left").select(F.col("id").alias(id_col), F.when(F.col("first").isNotNull(), F.col("first.id")).otherwise(F.col("id")).alias("component_id"))
