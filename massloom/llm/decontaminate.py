"""Benchmark decontamination by a prefix-filtered join of shingles, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.common import ascii_lower, text_or_empty, written

#: Characters between words, A-Z counted as word characters: their case is dealt with word by word.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of the benchmark's windows (words, and 16 for each item of a window) that may be broadcast; beyond, the join is shuffled.
BROADCAST_BYTES = 32 << 20


def _shingle(a: Column, b: Column) -> Column:
    """A key that is equal for equal shingles; lower() only joins more than A-Z, which the check afterwards undoes."""
    return F.xxhash64(F.lower(a), F.lower(b))


def _windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """words, items (ids as strings), one row per distinct window: each ``width`` words in a row of an item, or all of fewer."""
    words = F.filter(F.split(ascii_lower(text_or_empty(text_col)), BREAK), lambda w: w != "")
    rows = items.select(F.col(id_col).cast("string").alias("item"), words.alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - width + 1))
    rows = rows.select("item", "all", F.explode(starts).alias("at")).select("item", F.slice("all", F.col("at"), F.lit(width)).alias("words"))
    return rows.groupBy("words").agg(F.collect_set("item").alias("items"))


def _prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per window with its rarest shingle (``key``) and that shingle's place in it.

    Containment is whole, so the shingles of a window, ordered by rarity, have a necessary prefix of one.
    """
    pair = F.struct(F.col("i").alias("place"), _shingle(F.element_at("words", F.col("i") + 1), F.try_element_at("words", F.col("i") + 2)).alias("key"))
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 2))
    shingles = windows.select("words", "items", F.explode(places).alias("i")).select("words", "items", pair.alias("s"))
    ranked = shingles.join(counts, F.col("s.key") == counts["key"], "left").groupBy("words").agg(F.first("items").alias("items"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "s")).alias("rarest"))
    return ranked.select(F.col("rarest.s.key").alias("key"), F.col("rarest.s.place").alias("place"), F.array_join("words", " ").alias("window"), F.size("words").alias("size"), "items")


def _exploded(rows: DataFrame, single: bool) -> DataFrame:
    """Each word's place and shingle key; ``single`` adds the key of the word alone, for windows of one word."""
    here = F.posexplode("parts").alias("pos", "word")
    out = rows.select("*", here)
    pair = _shingle(F.col("word"), F.try_element_at("parts", F.col("pos") + 2))
    if not single:
        return out.withColumn("key", pair)
    alone = _shingle(F.col("word"), F.lit(None).cast("string"))
    return out.withColumn("key", F.explode(F.array_distinct(F.array(pair, alone))))


def _parted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, parts (words, perhaps between two empty strings), lead (1 if an empty one comes first), n_words."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.split(text_or_empty(text_col), BREAK).alias("parts"))
    lead, tail = (F.element_at("parts", i) == "" for i in (1, -1))
    n = F.size("parts") - lead.cast("int") - (tail & (F.size("parts") > 1)).cast("int")
    return rows.withColumns({"lead": lead.cast("int"), "n_words": n})


def _verified() -> Column:
    """Length and positional bounds, then the words themselves.

    Built of functions that Spark compiles with the explode before it, so that only verified rows leave that loop; a
    lambda here would hold one copy of a text's words for each of its words.
    """
    start = F.col("pos") - F.col("place")
    inside = (start >= F.col("lead")) & (start + F.col("size") <= F.col("lead") + F.col("n_words"))
    words = ascii_lower(F.array_join(F.slice("parts", F.greatest(start, F.lit(0)) + 1, F.col("size")), " "))
    return F.col("size").isNotNull() & inside & (words == F.col("window"))


def _covered(spans: Column) -> Column:
    """Number of places in the union of sorted (start, end) spans."""
    seed = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def add(acc: Column, s: Column) -> Column:
        more = F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto"))

    return F.aggregate(spans, seed, add)["n"]


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs: the id, ``n_words``, ``n_hit``, ``items`` (sorted ids as strings) and ``spans`` (start, end).

    A window is ``width`` consecutive words of an item, or all words of an item with fewer; a word of a document inside
    any occurrence of a window is hit. Each window joins by its rarest two-word shingle (counted over all documents); a
    match must lie within the document and is then compared word for word. Windows of up to
    ``broadcast_bytes`` are broadcast; beyond, the join is shuffled on narrow rows and the documents are joined back for
    the comparison.

    Null and empty texts have no words; an item without words has no windows. Repeated rows and ids stay one row each.
    An empty table of documents gives no rows, an empty benchmark no hits; extra columns are ignored.
    """
    windows = written(_windows(items, item_id_col, item_text_col, width), "windows")
    size = F.octet_length(F.array_join("words", " ")) + 16 * F.size("items") + 64
    held, single = windows.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)), F.coalesce(F.max(F.size("words") == 1), F.lit(False))).first()
    small = held <= broadcast_bytes
    hint = F.broadcast if small else (lambda df: df)

    keys = windows.select(F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 2))).alias("i"), "words")
    keys = keys.select(_shingle(F.element_at("words", F.col("i") + 1), F.try_element_at("words", F.col("i") + 2)).alias("key")).distinct()
    parted = _parted(docs, id_col, text_col)
    found = _exploded(parted.select("parts"), single).select("key").join(hint(keys), "key", "left_semi")
    counts = found.groupBy("key").agg(F.count("*").alias("n"))
    prefixes = written(_prefixes(windows, counts), "prefixes")

    if small:
        matched = _exploded(parted, single).join(F.broadcast(prefixes), "key", "left")
    else:
        parted = written(parted, "parted")
        near = _exploded(parted, single).select("row", "pos", "key").join(prefixes, "key")
        near = near.unionByName(parted.select("row", F.lit(0).alias("pos")), allowMissingColumns=True)
        matched = parted.join(near, "row")
    hit = F.col("hit")
    start = F.col("pos") - F.col("place") - F.col("lead")
    kept = matched.withColumn("hit", F.coalesce(_verified(), F.lit(False))).filter(hit | (F.col("pos") == 0))
    found = kept.groupBy("row").agg(
        F.first("id").alias("id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(hit, F.struct(start.alias("start"), (start + F.col("size")).alias("end"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items")))))).alias("items"),
    )
    return found.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), _covered(F.col("spans")).cast("long").alias("n_hit"), "items", "spans")
