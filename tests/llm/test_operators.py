"""The training-data operators against brute force, round trips and held-out labels, on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from massloom.llm import chat, common, components, decontaminate, exact_dedup, jaccard, licenses, packing, quality, queries, simhash, substrings, token_files, tokens, warc

BYTE, RANKS, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, maybe string, word string, key string, id string, row long"


def table(spark, rows):
    """Documents with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", 1) for i, t in rows], SCHEMA)


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    base = prose(rng, 300)
    rows = [(None, None), (1, ""), (2, "  \n "), (3, "one"), (4, base), (5, base + " "), (5, base + " "), (6, base + " tail"), (7, prose(rng, 20_000)), (8, "É Ünïcode “quotes” — 😀\tTab\r\n\n  x "), (9, None), (10, "a " * 500), (17, "a <|endoftext|> b <|startoftext|> c")]
    rows += [(11 + i, " ".join(["start", *base.split()[i : i + 60], "end"])) for i in range(5)]
    return rows


def test_tokens_equal_the_tokenizers(odd):
    texts = [t or "" for _, t in odd] + ["x  y", " lead", "trail ", "a\n b", "a \nb", "it's I'LL", "<|endoftext|> x", "a <|endoftext|> b", "<|ENDofTEXT|>", "x<|startoftext|>y <|endoftext|>", "<| endoftext|>", "١٢ ǅ ÿ z", "a\x1cb", "\nx", "x\n"]
    byte, word = tokens.ByteBpe(BYTE, RANKS), tokens.WordBpe(WORD)
    for kind, path in ((byte, BYTE), (None, WORD)):
        slow = Tokenizer.from_file(path)
        want = [tokens.packed(e.ids) for e in slow.encode_batch(texts, add_special_tokens=False)]
        assert (list(map(kind, texts)) if kind else word.batch(texts)) == want


def test_long_texts_in_blocks(monkeypatch):
    """Blocks of a few characters give the same ids, words, shingles and features as whole texts."""
    rng = random.Random(11)
    texts = [prose(rng, n) for n in (0, 1, 3, 40, 400)] + ["x" * 50 + " y " + "z" * 60, " lead", "a\n b c", "w w w w w w " * 30, "   ", "a  b"]
    byte = tokens.ByteBpe(BYTE, RANKS)
    whole = [(byte(t), jaccard.hashes(t, 5).tolist(), quality.features(t).tolist()) for t in texts]
    monkeypatch.setattr(common, "TEXT_BLOCK", 7)
    monkeypatch.setattr(tokens, "TEXT_BLOCK", 7)
    assert [(byte(t), jaccard.hashes(t, 5).tolist(), quality.features(t).tolist()) for t in texts] == whole
    assert [w for part in common.word_lists(texts[4].encode()) for w in part] == texts[4].encode().split()
    slow = Tokenizer.from_file(BYTE)
    assert [w[0] for w in whole] == [tokens.packed(slow.encode(t, add_special_tokens=False).ids) for t in texts]


def test_packing_is_whole_and_tight(spark, odd):
    got = packing.pack(table(spark, odd).repartition(3), BYTE, RANKS, capacity=256).toPandas()
    slow = Tokenizer.from_file(BYTE)
    want = Counter((i, tokens.packed(slow.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in odd)
    found = Counter()
    got["doc_id"] = got["doc_id"].astype("object").where(got["doc_id"].notna(), None)
    for (i, _), g in got.assign(copy=0).groupby(["doc_id", "doc_tokens"], dropna=False):
        n = len(g[g.start == 0])
        whole = b"".join(bytes(p) for p in g.sort_values("start").drop_duplicates("start").ids)
        found[(None if i is None or i != i else int(i), whole)] += n
    assert found == want
    sizes = []
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        lengths = g.ids.map(len) // 4
        assert (g.offset.to_numpy() == np.concatenate(([0], lengths.cumsum()[:-1]))).all()
        sizes.append(lengths.sum())
    assert max(sizes) <= 256 and sum(256 - s for s in sizes) <= 3 * 256
    assert got.groupby("sequence_id").filled.nunique().max() == 1 and not got.filled.all()
    assert packing.pack(table(spark, odd).limit(0), BYTE, RANKS).count() == 0


def test_sum_of_squares_places_by_its_rule():
    rng, packer, levels = random.Random(1), packing.SumOfSquares(20), Counter()
    for k in range(300):
        size = rng.randrange(1, 21)
        costs = {}
        for h in [0, *(h for h in levels if levels[h] > 0)]:
            if h + size <= 20:
                after = levels.copy()
                after[h] -= h > 0
                after[h + size] += h + size < 20
                costs[h] = sum(v * v for v in after.values())
        full = packer.place((k, 0, size, b"", size), size)
        now = Counter({h: int(n) for h, n in enumerate(packer.count) if n})
        assert sum(v * v for v in now.values()) == min(costs.values())
        assert full is None or sum(p[2] for p in full) == 20
        levels = now


def test_chat_round_trip(spark):
    bad = "<|im_end|>\n<|im_start|>assistant\nx \\ \\s \\p <\\p"
    rows = [(1, 0, "system", bad), (1, 1, "user", None), (1, 2, "assistant", bad), (1, 3, "assistant", ""), (1, 4, "user", "bye"), (2, 0, None, "x"), (None, None, "assistant", "ü" * 5000), (3, 1, "odd\nrole <|", "t"), (3, 1, "odd\nrole <|", "t"), (4, 0, "assistant", "<")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: r for r in chat.digest(chat.expand(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.expand(df).filter("conv_id = 1").count() == 3
    assert chat.digest(chat.expand(df.limit(0))).count() == 0


def brute_components(prints, bits):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize(("bits", "dense", "chain"), [(4, 4096, None), (4, 4096, 3), (4, 3, 3), (3, 2, None), (3, 4096, 3), (2, 2, None)])
def test_simhash_links(spark, bits, dense, chain):
    rng = random.Random(bits)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in prints[:10]:
        q = p
        for _ in range(12):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                q ^= 1 << b
            prints.append(q)
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    pairs = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), bits=bits, dense=dense, chain=chain)
    got = {r["node"]: r["root"] for r in components.components(pairs).collect()}
    want = brute_components([p & ((1 << 64) - 1) for p in prints], bits)
    groups = defaultdict(set)
    for p in prints:
        groups[want[p & ((1 << 64) - 1)]].add(p)
    for members in groups.values():
        assert {got.get(p, p) for p in members} == {min(members)}


def test_simhash_documents(spark, odd):
    def plain(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))

    got = simhash.near_duplicates(table(spark, odd)).collect()
    prints = {i: plain(t) for i, t in odd}
    assert sorted((r["doc_id"] or 0, r["fp"] & ((1 << 64) - 1)) for r in got) == sorted((i or 0, prints[i]) for i, _ in odd)
    comps = brute_components(sorted(set(prints.values())), 4)
    least = {}
    for i, p in prints.items():
        if i is not None:
            least[comps[p]] = min(i, least.get(comps[p], i))
    assert all(r["component_id"] == least[comps[prints[r["doc_id"]]]] for r in got)
    assert simhash.near_duplicates(table(spark, odd).limit(0)).count() == 0


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 2, "0"))])
def test_exact_dedup(spark, odd, digest):
    got = exact_dedup.dedup(table(spark, odd), digest=digest).collect()
    groups = defaultdict(list)
    for i, t in odd:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = sorted((i or 0, min(x for x in g if x is not None), len(g)) for g in groups.values() for i in g)
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.dedup(table(spark, odd).limit(0)).count() == 0


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 2, "0"))])
def test_exact_dedup_over_many_memtables(spark, odd, digest):
    """Memtables of 3 rows, compacted two by two: the same answer as from one."""
    docs = table(spark, odd)
    key = lambda df: sorted(map(repr, df.select("doc_id", "keep_id", "group_size", "digest").collect()))
    assert key(exact_dedup.dedup(docs, digest=digest, memtable_rows=3, fan_in=2)) == key(exact_dedup.dedup(docs, digest=digest))


def test_exact_dedup_keeps_rows(spark, odd):
    kept = exact_dedup.keep_first(table(spark, odd))
    assert kept.columns == table(spark, odd).columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in odd})


def test_digest_index(spark, monkeypatch):
    """Levels of sorted runs, smallest ids, hits, and lookups that ask the filter of each run first."""
    index = exact_dedup.DigestIndex(spark, fan_in=3)
    name = lambda k: hashlib.sha256(str(k).encode()).digest()
    for k in range(4):
        rows = [(100 * k + i, 50 - k, name(10 * k + i)) for i in range(10)] + [(100 * k + 50, 90 - k, name("all"))]
        index.flush(spark.createDataFrame(rows, "row long, id long, digest binary"))
    assert [len(level) for level in index.levels] == [1, 1]
    assert [h.count() for h in index.hits] == [0, 1, 1, 1]
    for run in index.runs():
        for part in run.rows.groupBy(F.spark_partition_id()).agg(F.collect_list("digest").alias("d")).collect():
            assert list(map(bytes, part["d"])) == sorted(map(bytes, part["d"]))
    asked = spark.createDataFrame([(name("all"),), (name(3),), (name(35),), (name("none"),)], "digest binary")
    got = {bytes(r["digest"]): (r["keep"]["id"], r["n"]) for r in index.lookup(asked).collect()}
    assert got == {name("all"): (87, 4), name(3): (50, 1), name(35): (47, 1)}
    runs = index.runs()
    runs[0].filter = runs[0].filter.limit(0)  # a filter that lets nothing through hides its run
    assert {bytes(r["digest"]) for r in index.lookup(asked).collect()} == {name("all"), name(35)} or {bytes(r["digest"]) for r in index.lookup(asked).collect()} == {name("all"), name(3)}
    assert index.compact().count() == 41 and index.compact().agg(F.sum("n")).first()[0] == 44


def test_licenses(spark):
    rng = random.Random(5)
    rows = [(1, "Under the MIT License; mit-license! CC  BY"), (2, None), (3, ""), (4, "GNU General Public Licence"), (5, "gnu general public license " * 3), (6, prose(rng, 3000) + " Permission is hereby granted, free of charge, to anyone obtaining a copy of this software and associated documentation files " + prose(rng, 50)), (7, "Licensed under the Apache License, Version 2.0."), (7, "Licensed under the Apache License, Version 2.0.")]
    rows += [(20 + k, " ".join(rng.choices(["licensed", "under", "the", "apache", "license", "version", "2", "0", "cc", "by", "nc", "4", "gnu", "mit", "x"], k=rng.randrange(1, 60)))) for k in range(60)]
    got = licenses.scan(table(spark, rows)).collect()
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        found = []
        for label, phrase in licenses.PHRASES.items():
            p = phrase.split()
            found += [(label, s, 1.0) for s in range(len(words) - len(p) + 1) if words[s : s + len(p)] == p]
        for label, phrase in licenses.NOTICES.items():
            p, size = set(phrase.split()), min(len(phrase.split()), len(words))
            for s in range(len(words) - size + 1) if size else ():
                share = len(p & set(words[s : s + size])) / len(p)
                if share >= 0.8 - 1e-12:
                    found.append((label, s, share))
        want.append((i, len(words), sorted(found)))
    assert sorted((r["doc_id"], r["n_words"], sorted((m["label"], m["start"], m["containment"]) for m in r["matches"])) for r in got) == sorted(want)
    assert licenses.scan(table(spark, rows).limit(0)).count() == 0


def test_license_texts_are_found_in_long_documents(spark):
    """Whole texts with some words changed, among other words; half a text is not enough."""
    rng = random.Random(8)
    rows = []
    for k, label in enumerate(("mit-text", "bsd-3-clause", "zlib", "unlicense")):
        words = licenses.NOTICES[label].split()
        for at in rng.sample(range(len(words)), len(words) // 20):
            words[at] = f"other{at}"
        rows += [(2 * k, prose(rng, 500) + " " + " ".join(words) + " " + prose(rng, 500)), (2 * k + 1, prose(rng, 300) + " " + " ".join(words[: len(words) // 2]))]
    got = {r["doc_id"]: {m["label"] for m in r["matches"]} for r in licenses.scan(table(spark, rows)).collect()}
    for k, label in enumerate(("mit-text", "bsd-3-clause", "zlib", "unlicense")):
        assert label in got[2 * k] and label not in got[2 * k + 1]


def test_warc_and_index(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://www.Example.com/a?b=1", big), (2, "https://m.example.com:8080/z", big), (3, None, None), (None, "http://[bad", big), (4, "http://e.com/\r\nX", "short"), (5, "http://e.com/", "short"), (6, "http://www.example.com/a?b=1", "é\r\n\r\nWARC/1.1\r\n" * 500), (2, "https://m.example.com:8080/z", big)]
    clash = "file string, offset long, key string, id string, row long, digest string, first long, n long, at long"
    pages = spark.createDataFrame([(*r, "x", 1, "k", "i", 7, "d", 1, 1, 1) for r in rows], f"page_id long, url string, html string, {clash}")
    index = warc.archive(spark, pages)
    index = warc.CaptureIndex.build(index.entries(), index.folder, lines=2)
    assert index.directory.count() >= 4
    got = index.read(index.entries()).collect()
    want = sorted((str(i), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "2" if i == 1 else "") for i, _, h in rows)
    assert sorted((str(r["id"]) if r["id"] else "None", r["payload_bytes"], r["payload_digest"], r["refers_to"] or "") for r in got) == sorted((w[0], *w[1:]) for w in want)
    hits = index.read(index.lookup(spark.createDataFrame([("http://example.com/a?b=1",), ("http://none.org/",), (None,)], "url string"))).collect()
    assert sorted(r["id"] for r in hits) == ["1", "3", "6"]  # a page without a URL is under the empty one
    again = index.read(index.lookup(pages, "url", "page_id")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    asked = spark.createDataFrame([("http://e.com/", 5), ("http://e.com/", 4), ("http://[bad", None), ("zzz", 9)], "url string, page_id long")
    assert sorted(str(r["id"]) for r in index.read(index.lookup(asked, "url", "page_id")).collect()) == ["5", "None"]
    assert warc.surt("http://www.Example.com/a?b=1") == "com,example)/a?b=1"
    assert index.read(warc.archive(spark, pages.limit(0)).entries()).count() == 0


def test_lookup_reads_the_blocks_that_the_directory_tells(spark, tmp_path):
    """Equal keys over many blocks; a block that the directory does not tell is not searched."""
    rows = [(f"http://h{k // 30}.org/", k, f"body {k}") for k in range(100)]
    pages = spark.createDataFrame(rows, "url string, page_id long, html string")
    index = warc.archive(spark, pages)
    index = warc.CaptureIndex.build(index.entries(), index.folder, lines=7)
    assert index.lookup(pages.select("url")).count() == 100 and index.lookup(pages, "url", "page_id").count() == 100
    assert index.lookup(pages.filter("page_id = 31"), "url", "page_id").count() == 1
    index.directory = index.directory.filter("first_key <> 'org,h1)/'")
    assert index.lookup(pages.filter("url = 'http://h1.org/'").select("url")).count() < 30


def test_archives_are_well_formed(spark):
    """Every archive begins with a warcinfo record; record ids differ, also of repeated rows and pages without an id."""
    import gzip

    rows = [(1, "u"), (1, "u"), (None, "u"), (None, "u"), (2, "u")]
    index = warc.archive(spark, spark.createDataFrame([(i, u, "x" * 1500) for i, u in rows], "page_id long, url string, html string"))
    names, files = [], {r["file"] for r in index.entries().collect()}
    for file in files:
        with gzip.open(file) as f:
            text = f.read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        names += re.findall(rb"WARC-Record-ID: (\S+)", text)
    assert len(set(names)) == len(names) == len(rows) + len(files)
    assert sorted((str(r["id"]), r["record_type"], str(r["refers_to"])) for r in index.read(index.entries()).collect()) == [("1", "revisit", "2")] * 2 + [("2", "response", "None")] + [("None", "response", "None")] * 2


def test_repair_round_trip():
    rng = np.random.default_rng(2)
    for n, vocabulary in ((0, 50), (1, 50), (5000, 12), (60_000, 300)):
        ids = (rng.zipf(1.4, n) % (vocabulary - 2) + 2).astype(np.uint32)
        ends = np.unique(np.concatenate((rng.integers(0, n + 1, 30), [n])))
        ends = np.sort(np.concatenate((ends, ends[:3])))  # empty documents
        symbols, rules, stops = token_files.compress(ids, ends, vocabulary)
        grammar = token_files.Grammar(vocabulary, rules)
        assert (grammar.expand(symbols) == ids).all()
        assert len(symbols) < len(ids) or n < 5000
        for (a, b), (x, y) in zip(zip([0, *ends], ends), zip([0, *stops], stops)):
            assert (grammar.expand(symbols[x:y]) == ids[a:b]).all()
            for low, high in ((0, b - a), (1, 3), ((b - a) // 2, b - a), (5, 5)):
                assert (grammar.part(symbols[x:y], low, min(high, b - a)) == ids[a:b][low:high]).all()


def test_repair_ends_when_no_pair_pays():
    """No pair is left that could be replaced ``least`` times; runs of one id and long repeats shrink to their logarithm."""
    rng = np.random.default_rng(4)
    for ids in (np.full(4096, 7), np.tile(rng.integers(0, 40, 64), 64), rng.integers(0, 30, 20_000)):
        ends = np.array([len(ids)])
        symbols, rules, _ = token_files.compress(ids, ends, 50, least=4, share=10**9)
        grammar = token_files.Grammar(50, rules)
        assert (grammar.expand(symbols) == ids).all()
        seen, at = Counter(), 0
        while at + 1 < len(symbols):
            pair = (int(symbols[at]), int(symbols[at + 1]))
            seen[pair] += 1
            at += 2 if pair[0] == pair[1] and at + 2 < len(symbols) and symbols[at + 2] == symbols[at] else 1
        assert not seen or max(seen.values()) < 4
    assert len(token_files.compress(np.full(4096, 7), np.array([4096]), 50, least=4)[0]) < 8


def test_token_files(spark, odd, tmp_path):
    folder = str(tmp_path)
    manifest = token_files.write_shards(table(spark, odd), WORD, folder, shard_ids=500)
    got = token_files.read_shards(manifest, folder).orderBy("start").collect()
    slow = Tokenizer.from_file(WORD)
    want = sorted((i is not None, i or 0, t or "") for i, t in odd)
    assert [r["id"] for r in got] == [str(i) if known else None for known, i, _ in want]
    at = 0
    for r, (_, _, t) in zip(got, want, strict=True):
        ids = slow.encode(t, add_special_tokens=False).ids + [1]
        assert r["start"] == at and bytes(r["ids"]) == tokens.packed(ids)
        at += len(ids)
    import pyarrow as pa

    shard = token_files.Shard(pa.OSFile(manifest.orderBy("part", "shard").first()["file"]))
    assert shard.document(0).tolist()[-1] == 1
    assert shard.part(0, 0, 1).tolist() == shard.document(0).tolist()[:1]
    assert token_files.store(table(spark, odd).limit(0), WORD).count() == 0
    assert dict(token_files.store(table(spark, odd), WORD).dtypes) == {"doc_id": "bigint", "start": "bigint", "ids": "binary"}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_quality(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert len(spark.read.parquet(f"{sf}/documents.parquet").toPandas()) == queries.op8_quality(spark, sf).count()
    held = got[got.held_out]
    assert held.held_out.size and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id)
    assert (held.predicted == held.quality).mean() >= 0.95
    assert got.score.between(0, 1).all()


def test_quality_fit_is_the_optimum_of_its_problem():
    """The hinge-loss objective at the fitted weights is that of a plain projected gradient ascent on the dual."""
    rng = np.random.default_rng(3)
    good = rng.random(60) < 0.4
    rows = [np.unique(np.concatenate((rng.integers(0, 40, 6), rng.integers(40 + 20 * g, 80 + 20 * g, 6)))).astype(np.int32) for g in good]
    p, q = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for ids, g in zip(rows, good, strict=True):
        (p if g else q)[ids] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    x = np.zeros((60, 121))
    for i, ids in enumerate(rows):
        x[i, ids] = ratio[ids] / np.linalg.norm(ratio[ids])
    x[:, 120] = 1
    y, cost = np.where(good, 1.0, -1.0), 4.0 * 60 / 2 / np.where(good, good.sum(), (~good).sum())
    objective = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    kernel = (x @ x.T) * np.outer(y, y)
    dual, step = np.zeros(60), 1 / np.linalg.eigvalsh(kernel)[-1]
    for _ in range(60_000):
        dual = np.clip(dual + step * (1 - kernel @ dual), 0, cost)
    model = quality.fit(rows, good, epochs=5000)
    weight = np.append(np.divide(model.product, ratio, out=np.zeros_like(ratio), where=ratio != 0)[:120], model.bias)
    best = objective(x.T @ (dual * y))
    assert best - 1e-6 <= objective(weight) <= best * 1.01


def test_quality_without_labels(spark, odd):
    docs = table(spark, odd)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert quality.scores(docs, model).count() == len(odd)
    assert quality.scores(docs.limit(0), model).count() == 0
    assert quality.keep(docs, model, 0.3).columns == docs.columns


@pytest.mark.parametrize(("filter_words", "hash_bits"), [(1 << 20, 64), (8, 64), (1 << 10, 9), (64, 0)])
def test_substrings(spark, odd, filter_words, hash_bits):
    got = substrings.remove_repeats(table(spark, odd), width=13, filter_words=filter_words, hash_bits=hash_bits).collect()
    first = {}
    for i, t in odd:
        words = (t or "").split()
        for k in range(len(words) - 12):
            w = tuple(words[k : k + 13])
            if i is not None:
                first[w] = min(i, first.get(w, i))
    want = []
    for i, t in odd:
        words = (t or "").split(" ") if False else re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = {p for k in range(len(words) - 12) for p in range(k, k + 13) if i is not None and first[tuple(words[k : k + 13])] < i}
        want.append((i or 0, len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone)))
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in got) == sorted(want)


def test_substrings_of_no_documents(spark, odd):
    assert substrings.remove_repeats(table(spark, odd).limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_contamination(spark, odd, broadcast_bytes):
    rng = random.Random(9)
    docs = [(i, t) for i, t in odd] + [(50, "x " + "Alpha beta-GAMMA, delta"), (51, "solo"), (52, "K kelvin ſolo É x")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(1, " ".join(words(odd[4][1])[20:45])), (2, "alpha beta gamma delta"), (10, "SOLO"), (3, None), (4, "k kelvin"), (5, prose(rng, 30)), (6, "a a a a a a a a a a"), (2, "alpha beta gamma delta")]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, words string")
    got = decontaminate.contamination(table(spark, docs), bench, broadcast_bytes=broadcast_bytes).collect()
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            wins[tuple(w[k : k + 10])].add(str(i))
    want = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        want.append((i or 0, len(w), len(hit), sorted(found)))
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"]) for r in got) == sorted(want)
    assert decontaminate.contamination(table(spark, docs).limit(0), bench).count() == 0
    assert decontaminate.contamination(table(spark, docs), bench.limit(0)).filter("n_hit > 0").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in got.select(*want.columns).collect()) == key(want.fetchall())


def test_false_spans_are_noticed(spark, odd):
    docs = table(spark, odd)
    spans = substrings.repeated_spans(docs)
    assert substrings.odd_paths(docs, spans, filter_words=1 << 10).isEmpty()
    assert not substrings.odd_paths(docs, spans.withColumn("start", F.col("start") + 1), filter_words=1 << 10).isEmpty()


def test_row_filters_keep_clashing_columns(spark):
    rows = [(i, f"text {i % 3}", f"m{i}", f"b{i}", i) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, maybe string, bits string, word long")
    assert sorted(map(tuple, common.without_ids(docs, docs.filter("doc_id > 5")).collect())) == rows[:6]
    assert sorted(map(tuple, exact_dedup.keep_first(docs).collect())) == rows[:3]
