"""SimHash near-duplicates: 64-bit fingerprints, pigeonring candidates, exact Hamming links, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm import jaccard
from massloom.llm.common import by_class, written
from massloom.llm.components import components

#: Shingles whose bits are counted at once, fingerprints under one key above which links go over midpoints, and
#: fingerprints from which keys of three segments (20 times the keys, 8,192 times fewer chance pairs) cost less than of two.
BLOCK, DENSE, LONG_KEYS = 65_536, 4096, 1_000_000_000


def majority(values: np.ndarray) -> int:
    """The bits that are set in over half of the unsigned 64-bit values, as an unsigned number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), BLOCK):
        part = values[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int = 4) -> int:
    """The SimHash of the text's word shingles as an unsigned number; 0 without words.

    A-Z is lower-cased, words stand between ASCII white space, a text of fewer than ``width`` words is one shingle. A bit
    is 1 if it is set in over half of the shingles' XXH64 values, repeats included.
    """
    values = jaccard.hashes(text, width)
    return majority(values) if len(values) else 0


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """id and ``fp`` (the fingerprint as a signed long) of every row; null and empty texts have 0."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py() or "", width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _widths(bits: int) -> list[int]:
    """Segment widths for a threshold of ``bits``: one segment more than that, as even as they go."""
    n = bits + 1
    return [64 // n + (i < 64 % n) for i in range(n)]


def _turned(fp: Column, by: int) -> Column:
    """fp rotated right, so that the segment that starts at bit ``by`` comes first."""
    return F.shiftrightunsigned(fp, by).bitwiseOR(F.shiftleft(fp, 64 - by)) if by else fp


def _mask(n: int) -> Column:
    return F.lit((1 << n) - 1 if n < 64 else -1).cast("long")


def _masks(ring: list[int], i: int, chain: int, bits: int) -> list[int]:
    """The differences that a chain of ``chain`` segments from segment i may have, within the budget of each of its beginnings."""
    n, at, found = len(ring) // 2, ring[i], [(0, 0)]
    for length in range(2, chain + 1):
        places = [1 << (at + t) for t in range(ring[i + length - 1])]
        budget = length * bits // n
        found = [(e + k, m | sum(more)) for e, m in found for k in range(budget - e + 1) for more in combinations(places, k)]
        at += len(places)
    return [m for _, m in found]


def links(prints: DataFrame, *, bits: int = 4, dense: int = DENSE, chain: int | None = None) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, linked at ``bits`` or fewer differing bits.

    prints: distinct ``fp``. The 64 bits form a ring of bits + 1 segments. By the pigeonring principle two linked
    fingerprints have a first segment from which every chain of l segments differs in at most l * bits / (bits + 1)
    bits. The first segment is thus equal and the chain of two differs in at most one bit: that is an equality join of
    each fingerprint's keys of ``chain`` segments with the same keys and all those within the budgets. ``chain`` is two,
    or three from LONG_KEYS fingerprints on. Longer chains prune the pairs, the whole ring is the full Hamming check.

    Under a key with more than ``dense`` fingerprints, pairs are not listed: each fingerprint goes to all numbers within
    bits / 2 (rounded up) of it, and those that meet there, which are within the threshold or are linked over the
    members they share, link to the smallest. Components are the same, and rows stay linear in the fingerprints.
    """
    if not 2 <= bits <= 4:
        raise ValueError("bits must be 2, 3 or 4")
    widths = _widths(bits)
    offsets = [sum(widths[:i]) for i in range(len(widths))]
    ring = widths + widths
    n = len(widths)
    chain = chain or (2 if prints.count() < LONG_KEYS else min(3, bits))

    def key(i: int, fp: Column) -> Column:
        return F.shiftleft(_turned(fp, offsets[i]).bitwiseAND(_mask(sum(ring[i : i + chain]))), 4).bitwiseOR(F.lit(i).cast("long"))

    base = prints.select(F.explode(F.array(*(key(i, F.col("fp")) for i in range(n)))).alias("key"), F.col("fp").alias("b"))
    flips = [F.array(*(F.lit(m << 4).cast("long") for m in _masks(ring, i, chain, bits))) for i in range(n)]
    probe = prints.select("fp", F.explode(F.array(*(F.struct(key(i, F.col("fp")).alias("key"), flips[i].alias("flips")) for i in range(n)))).alias("p"))
    probe = probe.select("fp", "p.key", F.explode("p.flips").alias("flip")).select(F.col("key").bitwiseXOR(F.col("flip")).alias("key"), F.col("fp").alias("a"))
    crowded = written(base.groupBy("key").count().filter(F.col("count") > dense).select("key"), "dense-keys")
    sparse_base = base if crowded.isEmpty() else base.join(crowded, "key", "left_anti")

    differ = F.col("a").bitwiseXOR(F.col("b"))
    budget = F.lit(False)
    for i in range(n):
        turned = _turned(differ, offsets[i])
        chains = F.lit(True)
        for length in range(chain + 1, n + 1):
            chains &= F.bit_count(turned.bitwiseAND(_mask(sum(ring[i : i + length])))) <= length * bits // n
        budget |= (F.col("key").bitwiseAND(F.lit(15)) == i) & chains
    pairs = probe.join(sparse_base.hint("shuffle_hash"), "key").filter((F.col("a") < F.col("b")) & budget).select("a", "b")
    if sparse_base is base:
        return pairs.distinct()
    members = base.join(crowded, "key", "left_semi").select(F.col("b").alias("fp")).distinct()
    members = members.unionAll(probe.join(crowded, "key", "left_semi").select(F.col("a").alias("fp"))).distinct()
    return pairs.unionAll(_over_midpoints(members, bits)).distinct()


def _near(members: DataFrame, radius: int) -> DataFrame:
    """z, fp: every number z within ``radius`` (1 or 2) bits of each member."""
    bit = lambda at: F.when(at < 64, F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))
    spread = members.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    if radius == 1:
        return spread.select(F.col("fp").bitwiseXOR(bit(F.col("i"))).alias("z"), "fp")
    spread = spread.select("fp", "i", F.explode(F.sequence(F.least(F.col("i") + 1, F.lit(64)), F.lit(64))).alias("j"))
    return spread.select(F.col("fp").bitwiseXOR(bit(F.col("i"))).bitwiseXOR(bit(F.col("j"))).alias("z"), "fp")


def _over_midpoints(members: DataFrame, bits: int) -> DataFrame:
    """Links among members at ``bits`` or fewer differing bits, up to the components that they form.

    Two differ in at most 4 (2) bits exactly if some number is within 2 (1) bits of both; all that meet in one number
    link to the smallest there. For 3, one side walks 1 bit and the other 2.
    """
    if bits in (2, 4):
        stars = _near(members, bits // 2)
        least = stars.groupBy("z").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter("a < top").select("z", "a")
        return stars.join(least, "z").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    found = _near(members, 1).withColumnRenamed("fp", "a").join(_near(members, 2).withColumnRenamed("fp", "b"), "z")
    return found.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4) -> DataFrame:
    """One row per input row: the id, ``fp`` and ``component_id``, the smallest id reachable over links, its own included.

    Null and empty texts have fingerprint 0 and link like any other. Null ids count as larger than any other and are
    answered with the smallest id of their component. Repeated rows fall into one component; an empty table gives no
    rows; extra columns are ignored.
    """
    rows = written(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = components(links(prints.select("fp"), bits=bits)).withColumnRenamed("node", "fp")
    linked = prints.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("linked"))
    known = roots.join(least, "root").select("fp", "linked")
    classes = written(prints.join(known, "fp", "left").select("fp", "n", F.coalesce("linked", "least").alias("component_id")), "fingerprint-classes")
    return by_class(rows, classes, "fp", "n").select(F.col("id").alias(id_col), "fp", "component_id")


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 4, den: int = 5, bits: int = 4) -> DataFrame:
    """One row per input row: the id and ``component_id``, the smallest id reachable over texts whose shingle sets have a Jaccard similarity of num / den or more.

    Fingerprints come first: rows with equal ones, and the pigeonring's pairs at ``bits`` or fewer differing bits, are
    candidates whose whole sets are compared, which joins most members of a group of copies at a cost linear in the
    group. A fingerprint cannot find the rest (at a similarity of 0.8 two of them differ in 10 of 64 bits on average), so
    every other pair that can reach the similarity is found by the rarest shingles of its sets (``jaccard.links``).
    Nothing is sampled or capped.

    Null and empty texts are copies of each other. Null ids count as larger than any other. Repeated rows are copies. An
    empty table gives no rows; extra columns are ignored.
    """
    rows = written(jaccard.shingled(docs, id_col, text_col, width, num, den, majority), "shingle-prefixes")
    prints = written(rows.groupBy("fp").agg(F.min("c").alias("hub"), F.count("*").alias("n")), "distinct-fingerprints")
    hubs = lambda side: prints.select(F.col("fp").alias(side), F.col("hub").alias(f"hub_{side}"))
    near = links(prints.select("fp"), bits=bits).join(hubs("a"), "a").join(hubs("b"), "b")
    near = near.select(F.least("hub_a", "hub_b").alias("a"), F.greatest("hub_a", "hub_b").alias("b"))
    same = by_class(rows.select("c", "fp"), prints.filter("n > 1"), "fp", "n").filter("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b"))
    return jaccard.linked(docs, rows, written(near.unionAll(same), "near-prints"), id_col, text_col, width, num, den)
