"""Stage near_dedup of the pipeline against brute force over five-word Jaccard similarity."""

import random

import corpus_pipeline as pipeline
import numpy as np
import pytest
from massloom.llm import jaccard, simhash


def sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def kept(texts):
    """Indices that are the smallest of their component of texts at 0.8 or more."""
    said, root = list(map(sets, texts)), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in enumerate(said):
        for b in range(a + 1, len(said)):
            y = said[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                i, j = sorted((find(a), find(b)))
                root[j] = i
    return {i for i in range(len(texts)) if find(i) == i}


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"e{rng.random()}"
    return " ".join(words)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("rounds", [1, 2, 0])
def test_near_dedup_equals_brute_force(spark, sf, monkeypatch, rounds):
    """Copies with 1 to 6 words changed, most over 4 bits of a fingerprint apart; a crowd of copies of one text; texts that share a passage only."""
    monkeypatch.setattr(jaccard.links, "__defaults__", (rounds,))
    rng = random.Random(3)
    texts = []
    for k in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 150))]
        texts += [" ".join(words)] + [edited(rng, words, min(n, len(words))) for n in rng.sample(range(1, 7), 2)]
    crowd = [f"c{k}" for k in range(120)]
    texts += [edited(rng, crowd, 1 + k % 5) for k in range(100)]
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [passage + " " + " ".join(f"q{rng.random()}" for _ in range(30)) for _ in range(80)] + ["", "  ", "Four Words of text", "four words of TEXT"]
    rng.shuffle(texts)
    got = {r["doc_id"] for r in dict(pipeline.STAGES)["near_dedup"](spark, frame(spark, texts), sf).collect()}
    assert got == kept(texts) and len(got) < len(texts)


def test_near_dedup_of_documents(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    assert {r["doc_id"] for r in dict(pipeline.STAGES)["near_dedup"](spark, frame(spark, texts), sf).collect()} == kept(texts)


def test_near_copies_of_odd_rows(spark):
    """Null and empty texts are copies; null ids come last; repeated rows, extra columns and an empty table."""
    said = " ".join(f"w{i}" for i in range(40))
    rows = [(None, said), (7, said + " x"), (3, None), (4, " "), (None, "alone here"), (9, said), (9, said)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], "doc_id long, text string, c int, key int, said int, fp int, n int")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["component_id"]) for r in simhash.near_copies(docs).collect() if r["component_id"] is not None)
    assert got == [(-1, 7), (3, 3), (4, 3), (7, 7), (9, 7), (9, 7)]
    assert simhash.near_copies(docs).count() == len(rows)
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_large_texts_and_crowds_of_one_text(spark, sf, monkeypatch):
    """A text over a block, copies of it, and a text that leads more others than one copy of it serves; tiny blocks and groups."""
    monkeypatch.setattr(jaccard, "TEXT_BYTES", 2000)
    monkeypatch.setattr(jaccard, "FAN", 8)
    rng = random.Random(5)
    long = [f"l{k % 70_001}x{k}" for k in range(120_000)]
    assert len(" ".join(long)) > 1 << 20
    crowd = [f"c{k}" for k in range(90)]
    texts = [" ".join(long), edited(rng, long, 900), edited(rng, long, 5000)]
    texts += [edited(rng, crowd, 1) for _ in range(60)] + [edited(rng, crowd, 20) for _ in range(20)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in dict(pipeline.STAGES)["near_dedup"](spark, docs, sf).collect()}
    assert got == kept(texts)


def test_pairs_that_share_part_of_a_prefix(spark, sf):
    """Pairs near the threshold among texts with common passages of all lengths: the number of shared rare shingles loses none."""
    rng = random.Random(11)
    texts = []
    for k in range(25):
        words = [f"s{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        texts.append(" ".join(words))
        for _ in range(4):
            cut = rng.randrange(len(words) // 3 + 1)
            texts.append(" ".join(words[cut:] + [f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(1 + len(words) // 6))]))
    got = {r["doc_id"] for r in dict(pipeline.STAGES)["near_dedup"](spark, frame(spark, texts), sf).collect()}
    assert got == kept(texts)


def test_bitmaps_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(7)
    for n in (1, 3, 40, 900, 20_000):
        every = np.unique(rng.integers(0, 2**64, 2 * n, np.uint64))
        one, two = every[: n + n // 2], every[n // 4 :]
        apart = sum(int(x).bit_count() for x in jaccard.bitmap(one) ^ jaccard.bitmap(two))
        assert jaccard.bitmap(one).shape == (jaccard.MAP_WORDS,)
        assert apart <= len(np.setxor1d(one, two)) and (apart == 0) == (len(np.setxor1d(one, two)) == 0)


def test_sets_of_two_components_meet_once(spark, monkeypatch):
    """40 sets and one share 60 keys: 40 pairs are listed, not 40 a key. Two large components that meet in one key list that key's pairs only."""
    listed = []
    monkeypatch.setattr(jaccard, "written", lambda df, name: listed.append((name, df.localCheckpoint())) or listed[-1][1])
    shared = list(range(60))
    rows = [(k, c, 300, k, 0) for c in range(40) for k in shared] + [(k, 1000, 300, k, 1000) for k in shared]
    rows += [(500 + c // 9, c, 9, 0, 2000) for c in range(2000, 2018)] + [(600 + c // 9, c, 9, 0, 3000) for c in range(3000, 3018)] + [(700, 2000, 9, 0, 2000), (700, 3000, 9, 0, 3000)]
    left = spark.createDataFrame(rows, "key long, c long, n long, i long, root long")
    maps = left.select("c").distinct().selectExpr("c", *(f"0L as {w}" for w in jaccard.MAP))
    lost = spark.createDataFrame([], "a long, b long, lost long")
    got = sorted(tuple(r) for r in jaccard._candidates(left, maps, lost, 4, 5).collect())
    assert got == [(c, 1000) for c in range(40)] + [(2000, 3000)]
    found = {name: df for name, df in listed}
    assert [tuple(r) for r in found["near-keyed"].select("key", "r", "q").collect()] == [(700, 2000, 3000)]
