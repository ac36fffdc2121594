"""Spelling variants, collocations and toxicity against brute force and held-out labels, on small tables with odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.llm import collocations, quality, toxicity, variants

SCHEMA = "doc_id long, text string, lang string, word string, n long, part int, h string, nodes string"


def table(spark, rows):
    """Documents with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, g, "a", 1, 2, "b", "c") for i, t, g in rows], SCHEMA)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows, least=3):
    counts = Counter()
    for i, text, _ in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= least}
    form, out = {}, []
    for w, n in counts.items():
        close = sorted((v for v in counts if near(v, w)), key=lambda v: (-counts[v], v))
        form[w] = (close[0] if close and counts[close[0]] >= 2 * n else None, len(close))
    for w, n in counts.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        f = form[w][0]
        out.append((w, f, root, n, form[w][1], counts.get(f)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(5)
    words = ["".join(rng.choice("abà") for _ in range(rng.randint(3, 8))) for _ in range(500)] + ["aaaaaa", "aaaaa", "aaaaaaa", "ÉTÉÉTÉ", "étéété", "naïveté", "naivete", "x" * 3000, "x" * 2999]
    rows = [(None, None, None), (1, "", "en"), (2, " \n ", "en"), (3, "x" * 3000 + " " + "x" * 2999, "en")]
    for i in range(60):
        said = [rng.choice(words[: 1 + rng.randrange(len(words))]) for _ in range(rng.randint(1, 400))]
        rows.append((i // 2, "".join(w + rng.choice([" ", ", ", "9", "_", "\n"]) for w in said), "en"))
    return rows + [(None, "aaaaaa aaaaab", None), (None, "aaaaaa aaaaab", None)] + [rows[-1]] * 3


def test_variants_against_brute_force(spark, misspelt):
    got = variants.variants(table(spark, misspelt).repartition(5))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    assert found == plain_variants(misspelt) and sum(r[1] is not None for r in found) > 20
    assert variants.variants(table(spark, misspelt).limit(0)).count() == 0
    assert variants.variants(table(spark, [(1, "too few words here", None)])).count() == 0


def test_trie_numbers_nodes_over_ranges(spark):
    """Equal prefixes have equal numbers and others not, however the words are ranged."""
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(400)} | {"", "aaaa"})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = variants.trie(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    number = {}
    for r in rows:
        for k, node in enumerate(r["nodes"]):
            assert number.setdefault(r["word"][:k], node) == node
    assert len(set(number.values())) == len(number) and len(rows) == len(words)
    leaves = [r["nodes"][-1] for r in sorted(rows)]
    assert leaves == sorted(leaves)


def test_runs_in_blocks(monkeypatch, misspelt):
    texts = [t or "" for _, t, _ in misspelt]
    whole = [[w for p in variants._parts(t) for w in p] for t in texts]
    monkeypatch.setattr(variants, "TEXT_BLOCK", 5)
    assert [[w for p in variants._parts(t) for w in p] for t in texts] == whole


def plain_collocations(rows, least, first=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lower):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    held = defaultdict(int)
    for g, a in candidates.items():
        for k in range(2, len(g) - 1):
            for i in range(1, len(g) - k + 1):
                held[(g[0], *g[i : i + k])] = max(held[(g[0], *g[i : i + k])], a)
    out = defaultdict(list)
    for g, a in candidates.items():
        score, _, l, r = min((2_000_000 * a // (f[g[: k + 1]] + f[(g[0], *g[k + 1 :])]), k, f[g[: k + 1]], f[(g[0], *g[k + 1 :])]) for k in range(1, len(g) - 1))
        if 100 * held[g] < 80 * a:
            out[g[0]].append((-score, -a, " ".join(g[1:]).encode(), l, r))
    return {(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, all_ in out.items() for k, (s, a, p, l, r) in enumerate(sorted(all_)[:first])}


@pytest.fixture(scope="module")
def said():
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(25)] + ["É", "x\x1fy", "\U0001f600", "A"]
    rows = [(1, None, "en"), (2, "", None), (3, " \t. ,\n", "fr"), (4, "the quick brown fox " * 40, "en"), (5, "New York City! " * 35, None), (6, "new york city? " * 4, "und"), (7, "a a a a a " * 30, "de")]
    for i in range(50):
        rows.append((i, "".join(rng.choice(vocabulary[: 2 + rng.randrange(len(vocabulary) - 1)]) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", "\x0b"]) for _ in range(rng.randint(1, 300))), rng.choice(["en", "fr", None])))
    return rows + [rows[-1]] * 2


@pytest.mark.parametrize("least,first", [(30, 2000), (8, 2000), (8, 3)])
def test_collocations_against_brute_force(spark, said, least, first):
    got = collocations.collocations(table(spark, said).repartition(4), least=least, first=first)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_collocations(said, least, first)
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 5


def test_collocations_of_nothing(spark, said):
    assert collocations.collocations(table(spark, said).limit(0)).count() == 0
    assert collocations.collocations(table(spark, said[:3])).count() == 0


def test_windows_in_blocks(monkeypatch, said):
    """Parts of texts and blocks of words of any size give the same windows."""
    import pyarrow as pa

    def windows(ahead):
        batch = pa.RecordBatch.from_pydict({"lang": [g or "und" for _, _, g in said], "text": [t or "" for _, t, _ in said]})
        out = Counter()
        for lang, words in collocations.blocks(iter([batch]), ahead):
            out.update((lang, *words[i : i + ahead + 1]) for i in range(len(words) - ahead) if words[i])
        return out

    whole = windows(1), windows(3)
    monkeypatch.setattr(collocations, "TEXT_BLOCK", 9)
    monkeypatch.setattr(collocations, "BLOCK", 5)
    assert (windows(1), windows(3)) == whole


def test_windows_end_before_rare_phrases(spark, monkeypatch):
    """Words, pairs and triples below the least frequency are in no window, those of it in all, and every word counts for its language."""
    monkeypatch.setattr(collocations, "LEAST_FILTER", 1 << 16)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", f"r{rng.randrange(900)}"]) for _ in range(200)) for _ in range(20)]
    f = Counter(tuple(w[i : i + k]) for w in map(str.split, texts) for k in range(1, 4) for i in range(len(w) - k + 1))
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    pairs = collocations.frequent_pairs(docs, 30)
    frequent = pairs.unionAll(collocations.frequent_triples(docs, pairs, 30))
    assert frequent.count() == sum(n >= 30 for n in f.values())
    got = collocations.windows(docs, frequent).collect()
    said = [(tuple(w for w in r[1:5] if w is not None), r["n"]) for r in got]
    assert sum(n for _, n in said) == 20 * 200
    assert min(f[w[at : at + k]] for w, _ in said for k in range(1, 4) for at in range(len(w) - k + 1)) >= 30
    for words, n in f.items():
        assert n < 30 or n == sum(m for w, m in said if w[: len(words)] == words)


def test_label_model_finds_accuracies_and_dependences():
    """Voters of known accuracy, one of which is repeated by two others, and labels of which some are wrong."""
    rng = np.random.default_rng(4)
    y = rng.random(6000) < 0.3
    speak = lambda toxic, clean: rng.random(len(y)) < np.where(y, toxic, clean)
    one, two, three = speak(0.5, 0.02), speak(0.3, 0.1), speak(0.4, 0.01)
    votes = np.stack([one, one & (rng.random(len(y)) < 0.95), one & (rng.random(len(y)) < 0.9), two, three, ~(one | two | three)], 1)
    label = np.where(rng.random(len(y)) < 0.02, ~y, y).astype(int)
    model, post = toxicity.label_model(votes, label, np.ones(len(y)))
    for j in range(5):
        assert abs(model.accuracy[j] - y[votes[:, j]].mean()) < 0.05
    linked = {frozenset((j, int(p))) for j, p in enumerate(model.parent) if p >= 0}
    assert sum(len(e & {0, 1, 2}) == 2 for e in linked) == 2  # the repeats hang together
    assert not any(len(e & {0, 1, 2}) == 1 for e in linked)
    assert ((post > 0.5) == y).mean() >= (label == y).mean()
    weights = toxicity.linear(votes, post, np.ones(len(y)))
    assert weights[4] + weights[-1] > 0 > weights[5] + weights[-1]


def planted(n=900, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    rows, marks = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "Moron", "zzgrub" + rng.choice("abc"), "zzgrubber"]))
        rows.append((i, " ".join(words), "en"))
        marks.append((i, int(toxic)))
    return rows, marks


def test_toxicity_on_held_out_labels(spark):
    rows, marks = planted()
    docs, labels = table(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels.filter(~quality.held_out()))
    assert any(e.startswith("zzgrub") for e in model.voters.names)
    got = toxicity.scores(docs, model).withColumn("held", quality.held_out()).toPandas()
    truth = dict(marks)
    held = got[got.held]
    right = (held.score >= 0.5) == held.doc_id.map(truth).astype(bool)
    assert len(held) > 100 and right.mean() > 0.97
    again = toxicity.train(docs.repartition(7), labels.filter(~quality.held_out()).repartition(3))
    assert again.weights.tolist() == model.weights.tolist() and again.voters.names == model.voters.names


def test_toxicity_of_odd_rows(spark):
    rows, marks = planted(300)
    odd = [(None, None, None), (None, "idiot", "en"), (5, "", None), (5, "idiot " * 5, "en"), (6, "x" * 30_000, "en"), (7, "idiot " * 30_000, "en"), (7, "idiot " * 30_000, "en")]
    labels = spark.createDataFrame([*marks, (None, 1), (5, None), (1, 0), (1, 1)], "doc_id long, toxic int")
    docs = table(spark, rows + odd)
    model = toxicity.train(docs, labels)
    got = toxicity.scores(table(spark, odd), model).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.scores(docs.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        model = toxicity.train(docs, few)
        assert len({r["score"] for r in toxicity.scores(table(spark, odd), model).collect()}) == 1
    assert toxicity.train(docs.limit(0), labels).score("idiot") == 0.5


def test_voters_in_blocks(monkeypatch):
    text = "You are an idiot! " * 3 + "VERY LOUD WORDS ARE SAID HERE AND THERE! " * 9
    voters = toxicity.Voters(["loud", "idi-"])
    whole = voters(text)
    monkeypatch.setattr(toxicity, "TEXT_BLOCK", 3)
    assert voters(text) == whole
    names = {voters.names[k] for k in whole}
    assert {"loud", "idi-", "insult", "shouting", "addressing"} <= names and "quiet" not in names
    assert [voters.names[k] for k in voters("")] == ["short", "quiet"]
