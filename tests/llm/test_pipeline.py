"""The pipeline against a plain version of its stages, each judged on the rows that the real stage before kept."""

import re
from collections import defaultdict

import corpus_pipeline as pipeline
from massloom.llm import quality

from test_near_copies import kept


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(pipeline.STAGES)
    good = stages["quality"](spark, docs, sf)
    assert good.columns == docs.columns
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet").filter(~quality.held_out()))
    want = {r["doc_id"] for r in docs.collect() if model.score(quality.features(r["text"] or "")) >= 0.3}
    assert {r["doc_id"] for r in good.collect()} == want

    single = stages["exact_dedup"](spark, good, sf)
    groups = defaultdict(list)
    for r in good.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(min(g) for g in groups.values())

    apart = stages["near_dedup"](spark, single, sf)
    ids = sorted(r["doc_id"] for r in single.collect())
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    assert {r["doc_id"] for r in apart.collect()} == {ids[k] for k in kept([texts[i] for i in ids])}

    clean = stages["decontaminate"](spark, apart, sf)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in [words(r["text"])] for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(x) for x in wins}
    leaks = {r["doc_id"] for r in apart.collect() for w in [words(r["text"])] if any(tuple(w[k : k + n]) in wins for n in sizes for k in range(len(w) - n + 1))}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in apart.collect()} - leaks

    pieces = pipeline.run(spark, sf).toPandas()
    assert set(pieces.doc_id) == {r["doc_id"] for r in clean.collect()}
    assert (pieces.groupby("doc_id").ids.apply(lambda s: sum(map(len, s)) // 4) == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, copies without ids, clashing names, and empty tables."""
    said = " ".join(f"w{i}" for i in range(60))
    leak = " ".join(f"leak{i}" for i in range(12))
    rows = [(1, said), (2, said + "\n"), (2, said + "\n"), (None, said), (None, None), (3, ""), (None, leak), (None, "one of its own " * 9), (4, leak + " x"), (4, "another text of the same id")]
    docs = spark.createDataFrame([(i, t, None, None, None, "m", "b", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, maybe string, bits string, fp long")
    spark.createDataFrame([(7, leak), (None, None), (8, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, None), (None, 0, 0), (2, None, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    stages = dict(pipeline.STAGES)
    seen = lambda df: sorted(((-1 if r["doc_id"] is None else r["doc_id"]), (r["text"] or "").strip()) for r in df.collect())

    assert stages["quality"](spark, docs, sf).columns == docs.columns
    single = stages["exact_dedup"](spark, docs, sf)
    assert single.columns == docs.columns
    own = ("one of its own " * 9).strip()
    # A text that ends in white space is another text; equal ones keep the smallest id, null ids come last.
    assert seen(single) == sorted([(1, said), (2, said), (3, ""), (-1, leak), (-1, own), (4, leak + " x"), (4, "another text of the same id")])
    apart = stages["near_dedup"](spark, single, sf)
    assert apart.columns == docs.columns
    # The text that ends in white space has the words of document 1, and 8 of 9 shingles of one leak are the other's.
    assert seen(apart) == [r for r in seen(single) if r not in ((2, said), (-1, leak))]
    clean = stages["decontaminate"](spark, single, sf)
    assert clean.columns == docs.columns
    assert seen(clean) == [r for r in seen(single) if "leak1" not in r[1]]
    assert stages["packing"](spark, clean, sf).filter("doc_id is null").count() == 1

    none = docs.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name
