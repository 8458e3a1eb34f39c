"""Registered queries of the training-data operators, and their DuckDB SQL.

Each query applies one operator, with production parameters, to its whole
table and derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlift.llm import bpe, langid, quality, toxicity
from cartlift.llm.common import LOWER, UPPER, crc_mod, read_table
from cartlift.llm.conversations import damage_turns, repair_readout
from cartlift.llm.exact_dedup import exact_dedup
from cartlift.llm.importance import resample
from cartlift.llm.line_dedup import line_dedup
from cartlift.llm.near_dup import near_duplicates
from cartlift.llm.packing import pack
from cartlift.llm.secrets import digest_spans, scan_secrets
from cartlift.llm.substring import substring_dedup
from cartlift.llm.topk import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies up to A-Z case; the largest doc_id of each group stays."""
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest").select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256")


ORACLES["op1_exact_dedup"] = f"""
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) as text_sha256 from documents
), g as (
  select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256
)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, d.text_sha256
from d join g using (text_sha256)
"""


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document; ``owned`` spans by corpus-wide ownership."""
    return digest_spans(scan_secrets(read_table(spark, sf_dir, "documents")))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from the documents outside fold 2 of 4."""
    docs = read_table(spark, sf_dir, "documents")
    fold = crc_mod("doc_id", 4)
    model = langid.fit(docs.where(fold != 2))
    return langid.identify(docs.select("doc_id", (fold == 2).alias("held_out"), "text"), model).drop("text")


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels learnt outside fold 1 of 3."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    fold = crc_mod("doc_id", 3)
    model = quality.fit(docs.where(fold != 1), labels.where(fold != 1))
    scored = quality.score(docs.select("doc_id", (fold == 1).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels learnt outside fold 2 of 4."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    fold = crc_mod("doc_id", 4)
    model = toxicity.fit(docs.where(fold != 2), labels.where(fold != 2))
    scored = toxicity.score(docs.select("doc_id", (fold == 2).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and their decoding, as digests."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every vector whose id is divisible by 50."""
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op10_top_k"] = """
with v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score,
         row_number() over (partition by q.row order by list_dot_product(q.e, c.e) desc, c.vec_id) as rank
  from v q join v c on q.row <> c.row
  where q.vec_id % 50 = 0
)
select query_id, rank::int as rank, vec_id, score from s where rank <= 5
"""


@query
def op2_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets are 0.8 similar."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=2, percent=80)


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removing all 35-word stretches that also stand elsewhere."""
    return substring_dedup(read_table(spark, sf_dir, "documents"), window=35).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op3_substring_dedup"] = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), w as (
  select doc_id, unnest(ws) as word, unnest(range(len(ws))) as pos from d
), k as (
  select doc_id, pos, md5(string_agg(word, ' ') over follow) as seq, count(*) over follow as n
  from w window follow as (partition by doc_id order by pos rows between current row and 34 following)
), twice as (
  select seq from k where n = 35 group by seq having count(*) > 1
), hit as (
  select doc_id, pos from k where n = 35 and seq in (select seq from twice)
), gone as (
  select distinct doc_id, pos + o.i as pos from hit, (select unnest(range(35)) as i) o
), kept as (
  select w.doc_id, count(gone.pos) as n_removed,
         coalesce(string_agg(w.word, ' ' order by w.pos) filter (where gone.pos is null), '') as t
  from w left join gone on gone.doc_id = w.doc_id and gone.pos = w.pos group by w.doc_id
)
select d.doc_id, len(ws) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every conversation after the planted damage."""
    turns = read_table(spark, sf_dir, "conversations")
    return repair_readout(damage_turns(turns), turns)


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document against the benchmark's words; a tenth is drawn."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLES["op12_importance_resampling"] = rf"""
with recursive tab as (
  -- CRC-32 byte table: eight shifts of each byte value
  select list(c order by b) as t from (
    select b, list_reduce(list_prepend(b, range(8)),
                          lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select unnest(range(256)) as b))
), d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), b as (
  select regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), dw as (select doc_id, unnest(ws) as w from d
), bw as (select unnest(ws) as w from b
), words as (
  select w, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(octet_length(encode(w))),
                   lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::bigint)),
      lambda c, x: xor(c >> 8, tab.t[1 + (xor(c, x) & 255)])), 4294967295) % 10000 as bucket
  from (select w from dw union select w from bw), tab
), s as (select bucket, count(*) as s from dw join words using (w) group by bucket
), t as (select bucket, count(*) as t from bw join words using (w) group by bucket
), total as (select (select count(*) from dw)::double as ss, (select count(*) from bw)::double as tt
), gain as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (ss + 10000)
                                 / ((coalesce(s, 0) + 1)::double * (tt + 10000))))::bigint as g
  from s full join t using (bucket), total
), weighed as (
  select doc_id, count(*) as n, sum(g)::bigint as weight from dw join words using (w) join gain using (bucket) group by doc_id
), scored as (
  select d.doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0)::bigint as weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint as score
  from d left join weighed using (doc_id)
), ranked as (
  select *, row_number() over (order by score desc, doc_id) as r, count(*) over () as total from scored where n_features >= 20
)
select s.doc_id, s.n_features, s.weight, s.score, case when r <= total * 10 // 100 then r end as rank
from scored s left join ranked using (doc_id)
"""


@query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more of them share."""
    return line_dedup(read_table(spark, sf_dir, "documents"), min_chars=20, min_docs=3, keep="largest").select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op13_line_dedup"] = rf"""
with d as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents
), l as (
  select doc_id, pos, line, trim(translate(line, '{UPPER}', '{LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key
  from (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from d)
), common as (
  select key, max(doc_id) as holder from l where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), marked as (
  select l.*, coalesce(l.doc_id <> c.holder, false) as gone from l left join common c using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
