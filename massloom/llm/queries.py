"""The numbered queries over the given tables, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm import chat, collocations, decontaminate, exact_dedup, licenses, packing, quality, simhash, substrings, token_files, toxicity, variants, warc
from massloom.llm.common import read

BYTE_BPE, BYTE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(BYTE_RANKS))
    return pieces.select(
        "doc_id",
        "start",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )



#: A conversation whose texts are full of control strings, added to the table.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat.digest(chat.expand(turns.unionByName(probe)))


OP2_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as said from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
placed as (
  select *, row_number() over w as pos, count(*) over (partition by conv_id) as n,
    sum(length(replace(replace(replace(role, '\', '\s'), '<|', '<\p'), chr(10), '\n'))
      + length(replace(replace(said, '\', '\s'), '<|', '<\p')) + 24) over (w rows unbounded preceding) as upto
  from rows window w as (partition by conv_id order by turn nulls first, role, said))
select conv_id, cast(max(n) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || said || chr(10), '' order by pos)) as turns_sha256,
  cast(coalesce(sum(length(said)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(said, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(upto) filter (role = 'assistant' or pos = n) as bigint) as formatted_chars
from placed group by conv_id"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = r"""
with plain as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as said from documents)
select doc_id, min(doc_id) over (partition by said) as keep_id, count(*) over (partition by said) as group_size,
  doc_id = min(doc_id) over (partition by said) as kept, sha256(said) as text_sha256
from plain"""


QUERIES = {"op1_packing": op1_packing, "op2_chat": op2_chat, "op3_simhash": op3_simhash, "op4_exact_dedup": op4_exact_dedup}
ORACLES: dict[str, str] = {"op2_chat": OP2_SQL, "op4_exact_dedup": OP4_SQL}


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    index = warc.archive(spark, pages)
    found = index.read(index.lookup(pages, "url", "page_id"))
    kind = pages.schema["page_id"].dataType  # archives hold ids as text
    page = lambda c: F.col(c).cast(kind)
    return found.select(page("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


OP6_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body) as payload_bytes, sha1(body) as payload_digest, max(page_id) over (partition by body) as top from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
from d"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
with dw as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents),
iw as (select cast(item_id as varchar) as item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from benchmark),
sizes as (select distinct least(10, len(ws)) as k from iw where len(ws) > 0),
win as (select distinct item, k, array_to_string(ws[i:i + k - 1], ' ') as w from
  (select item, ws, least(10, len(ws)) as k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from iw where len(ws) > 0)),
dwin as (select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') as w from
  (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from dw, sizes where len(ws) >= k)),
hits as (select distinct d.doc_id, d.i, d.k, win.item from dwin d join win on d.w = win.w and d.k = win.k),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join covered using (doc_id) left join found using (doc_id)"""

QUERIES |= {"op6_warc": op6_warc, "op10_decontaminate": op10_decontaminate}
ORACLES |= {"op6_warc": OP6_SQL, "op10_decontaminate": OP10_SQL}


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["exact"])
    starts = F.transform(base, lambda m: m["start"])
    names = lambda part: F.array_join(F.array_sort(F.array_distinct(F.transform(part, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"),
    )


#: A document whose score is below is rejected.
GOOD = 0.3


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels").filter(~quality.held_out()))
    found = quality.scores(docs, model)
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


QUERIES |= {"op5_licenses": op5_licenses, "op8_quality": op8_quality}


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
w as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as win from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d where len(ws) >= 13)),
f as (select win, min(doc_id) as first from w group by win),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from w join f using (win) where first < doc_id),
placed as (select doc_id, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as word from d),
kept as (select doc_id, string_agg(word, ' ' order by p) as said, count(*) as n from placed anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(said, '')) as kept_sha256
from d left join kept using (doc_id)"""

QUERIES |= {"op9_substrings": op9_substrings}
ORACLES |= {"op9_substrings": OP9_SQL}


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.store(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES |= {"op7_token_files": op7_token_files}


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
with recursive crc as (
  select list(v order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as v from range(256) r(i))),
runs as (
  select doc_id, run, count(*) as n from
  (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run from documents) group by all),
hashed as (
  select run, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
    lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h
  from runs, crc),
w as (
  select word, sum(n)::bigint as n from
  (select case when h % 97 = 0 then run[:(h % length(run))::bigint] || run[(h % length(run))::bigint + 2:] else run end as word, n from hashed)
  where length(word) >= 5 group by word having sum(n) >= 3),
cut as (select word, n, length(word) as size, i, word[:i - 1] || word[i + 1:] as less from (select *, unnest(range(1, length(word) + 1)) as i from w)),
pairs as (
  select a.word, b.word as other, b.n as m from cut a join cut b on a.less = b.less and a.i = b.i and a.word <> b.word and a.size = b.size
  union select a.word, b.word, b.n from cut a join w b on a.less = b.word
  union select b.word, a.word, a.n from cut a join w b on a.less = b.word),
best as (select word, other, m, row_number() over (partition by word order by m desc, other) as k from pairs),
forms as (select w.word, w.n, b.other as form, b.m as form_n from w left join best b on b.word = w.word and b.k = 1 and b.m >= 2 * w.n),
chain as (select word, word as root, form as next from forms union all select c.word, f.word, f.form from chain c join forms f on f.word = c.next)
select f.word, f.form, c.root, f.n, coalesce(p.n_near, 0) as n_near, f.form_n
from forms f join chain c on c.word = f.word and c.next is null left join (select word, count(*) as n_near from pairs group by word) p on p.word = f.word"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
with pieces as (
  select row_number() over () as piece, lang, said from (select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as said from documents)),
words as (select lang, list_filter(string_split_regex(said, '[\x20\x09]+'), lambda x: x <> '') as ws from pieces),
totals as (select lang, sum(len(ws))::bigint as n from words group by lang),
grams as (select lang, k, ws[i:i + k - 1] as g from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from words, range(1, 5) r(k) where len(ws) >= k)),
f as (select lang, k, g, array_to_string(g, ' ') as phrase, count(*) as f from grams group by all having count(*) >= 30),
cand as (select lang, k, g, phrase, f as a from f where k > 1),
cuts as (select lang, phrase, a, k, g, unnest(range(1, k)) as c from cand),
scored as (
  select cuts.lang, cuts.phrase, a, x.f as l, y.f as r, cast((2000000::hugeint * a) // (x.f + y.f) as bigint) as score, c from cuts
  join f x on x.lang = cuts.lang and x.phrase = array_to_string(cuts.g[:c], ' ') join f y on y.lang = cuts.lang and y.phrase = array_to_string(cuts.g[c + 1:], ' ')),
low as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inner_parts as (select lang, array_to_string(g[i:i + m - 1], ' ') as phrase, max(a) as f from
  (select lang, g, k, a, m, unnest(range(1, k - m + 2)) as i from cand, range(2, 4) r(m) where m < k) group by all),
kept as (select low.* from low left join inner_parts p using (lang, phrase) where p.f is null or 100 * p.f < 80 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join totals using (lang) qualify rank <= 2000"""


#: A document whose score reaches it is toxic.
TOXIC = 0.5


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels").filter(~quality.held_out()))
    found = toxicity.scores(docs, model)
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


QUERIES |= {"op11_variants": op11_variants, "op12_collocations": op12_collocations, "op13_toxicity": op13_toxicity}
ORACLES |= {"op11_variants": OP11_SQL, "op12_collocations": OP12_SQL}
