"""The registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bilinear, infill, itq, license_scan, pii, quality, repeats, sharding, simhash, token_files, toxicity, word_bpe
from fleetlens.llm.common import read_table
from fleetlens.llm.decontaminate import find_contamination


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents")).drop("places")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return find_contamination(docs, benchmark).drop("runs", "items")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.embedding_groups(read_table(spark, sf_dir, "embeddings"))


def op4_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, read_table(spark, sf_dir, "labels")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"))
    return sharding.shuffle_into_shards(rows).withColumn("grown_shard", F.lit(None).cast("int"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(read_table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.round_trip(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digest=True)


def planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of each tenth document, by a hash of its id, the words behind a place repeat with a period.

    With h the id's crc32 and g = h / 10, h % 10 = 0: word i from a = g % n on becomes word a + (i - a) % p, where
    p = 1 + (n - a) / (3 + g % 8). Null ids count as no tenth.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    hit = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(hit, F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    cut = docs.select("doc_id", "text", words.alias("_w"), F.floor(h / 10).alias("_g")).withColumn("_n", F.size("_w").cast("long"))
    a = F.col("_g") % F.col("_n")
    cut = cut.withColumn("_a", F.when(F.col("_n") > 0, a).cast("int"))
    cut = cut.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")).withColumn("_rest", (F.col("_n") - F.col("_a")).cast("int"))
    unit = F.slice("_w", F.col("_a") + 1, F.col("_p"))
    again = F.slice(F.flatten(F.array_repeat(unit, F.ceil(F.col("_rest") / F.col("_p")).cast("int"))), F.lit(1), F.col("_rest"))
    text = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), again), " ")
    return cut.select("doc_id", F.when(F.col("_a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.collapse_runs(planted_repeats(read_table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    n, p = -F.col("_best.n"), F.col("_best.p")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("_best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", F.col("_best.s").alias("start"), n.alias("length"), p.alias("period"), F.floor(1000 * n / p).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(read_table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(h == 0, F.lit(False)).alias("held_out"), F.coalesce(h != 0, F.lit(False)).alias("learnt"))
    return bilinear.score_corpus(docs, F.col("learnt"), ["doc_id", "held_out"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_license_scan, op2_decontaminate, op3_embedding_dedup, op4_word_bpe, op5_toxicity, op6_quality, op7_sharding, op8_pii, op9_simhash_dedup, op10_token_files, op11_periodic_runs, op12_fill_in_middle, op13_lm_scores)
    return {f.__name__: f for f in every}


OP2_SQL = """
with words as (
  select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
  from documents
), items as (
  select item_id, row_number() over () as it, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
  from benchmark
), windows as (
  select item_id, it, i as j, m, array_to_string(w[i + 1 : i + m], ' ') as win
  from (select item_id, it, w, least(13, len(w)) as m, unnest(range(greatest(1, len(w) - 12))) as i from items where len(w) > 0)
), grams as (
  select r, i, m, array_to_string(w[i + 1 : i + m], ' ') as win
  from (select r, w, m, unnest(range(len(w) - m + 1)) as i from words, (select distinct m from windows) where len(w) >= m)
), found as (
  select g.r, g.i, g.m, w.item_id, w.it, w.j from grams g join windows w on g.m = w.m and g.win = w.win
), hits as (
  select r, count(distinct p) as n_hit from (select distinct r, unnest(range(i, i + m)) as p from found) group by r
), named as (
  select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from found group by r
), matches as (  -- windows that follow each other in a document and an item are one match
  select r, min(i) as place, count(*) + any_value(m) - 1 as n from (select *, i - row_number() over (partition by r, it, i - j, m order by i) as island from found) group by r, it, i - j, m, island
), longest as (
  select r, max(n) as n, arg_min(place, {'n': -n, 'place': place}) as place from matches group by r
)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(n.n_items, 0) as n_items,
  sha256(coalesce(n.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(w.w) as contaminated,
  cast(coalesce(l.n, 0) as bigint) as longest_match, cast(l.place as bigint) as longest_at
from words w left join hits h using (r) left join named n using (r) left join longest l using (r)
"""

OP3_SQL = """
with recursive good as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as materialized (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.9
), reach(a, b) as (
  select vec_id, vec_id from embeddings
  union
  select r.a, l.b from reach r join links l on r.b = l.a
)
select e.vec_id, coalesce(n.n, 0) as n_links, c.component_id, c.component_id = e.vec_id as kept
from embeddings e join (select a, min(b) as component_id from reach group by a) c on c.a = e.vec_id
left join (select a, count(*) as n from links group by a) n on n.a = e.vec_id
"""


#: crc32 of an id's digits: the usual bit by bit division, as DuckDB has no function for it.
CRC32_SQL = """list_reduce([4294967295::bigint] || list_transform(string_split(cast(doc_id as varchar), ''), lambda d: ascii(d)::bigint), lambda crc, byte:
    list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, case when x % 2 = 1 then 3988292384 else 0 end)))"""

OP11_SQL = f"""
with texts as (
  select row_number() over () as r, doc_id, string_split_regex(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+') as w, xor({CRC32_SQL}, 4294967295) as h
  from documents
), cut as (
  select r, doc_id, case when w = [''] then [] else w end as w, h, h // 10 as g from texts
), planted as (
  select r, doc_id, len(w) as n, unnest(w) as word, unnest(range(len(w))) as i, case when h % 10 = 0 then g % len(w) end as a, g, w from cut where len(w) > 0
), words as (
  select r, i, n, case when i >= a then w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] else word end as word from planted
), pairs as (  -- equal words a period apart; neighbours of one period are an island
  select x.r, x.i, y.i - x.i as q, x.i - row_number() over (partition by x.r, y.i - x.i order by x.i) as island
  from words x join words y on x.r = y.r and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n
), found as (
  select r, min(i) as s, count(*) + q as n, q from pairs group by r, q, island having count(*) + q >= greatest(6, 4 * q)
), runs as (
  select r, s, n, min(q) as q from found group by r, s, n
), told as (
  select r, count(*) as n_runs, arg_min(struct_pack(s := s, n := n, q := q), struct_pack(n := -n, s := s, q := q)) as best,
    string_agg(s || ',' || n || ',' || q || chr(10), '' order by s, q) as lines
  from runs group by r
), dropped as (
  select distinct r, unnest(range(s + q, s + n)) as i from runs
), kept as (
  select r, string_agg(word, ' ' order by i) as text from words anti join dropped using (r, i) group by r
)
select doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.n as length, best.q as period, 1000 * best.n // best.q as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(text, '')) as collapsed_sha256
from cut left join told using (r) left join kept using (r)
"""

OP12_SQL = """
with drawn as (
  select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), numbers as (
  select *, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from drawn
), cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from numbers
), parts as (
  select *, array_slice(text, 1, a) as p, array_slice(text, a + 1, b) as m, array_slice(text, b + 1, n) as s from cut
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256
from parts
"""


def oracle_sql() -> dict[str, str]:
    """Not here, but tested against brute force: trained models (5, 6, 13), random draws (7), tokenizers (4, 10), XXH64 (9), places of matches (8)."""
    return {"op1_license_scan": license_scan.scan_sql(), "op2_decontaminate": OP2_SQL, "op3_embedding_dedup": OP3_SQL, "op11_periodic_runs": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
