"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, fingerprints, langid, license_scan, lm_scoring, minhash, mixing, sp_codec, token_output, toxicity

#: Target weights of the mix; sources that aren't named have the weight 1.
MIX_WEIGHTS = {"src0": 3.0, "src1": 2.0}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability and perplexity of every document under a model of the corpus."""
    return lm_scoring.score(_documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses found in every document, with their coverage and place."""
    return license_scan.scan(_documents(spark, sf_dir))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, mixed to the target weights at the corpus' own number of tokens."""
    return mixing.mix(_documents(spark, sf_dir), MIX_WEIGHTS)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours, among all embeddings, of each whose id 100 divides."""
    return ann.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=ann.EVERY)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a model of the labelled ones."""
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus' token ids as seekable shards."""
    return token_output.shards(_documents(spark, sf_dir))


def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, their byte spans, and whether they decode to the text."""
    return sp_codec.encode(_documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent weighted samples of every document."""
    return fingerprints.fingerprints(_documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and its distance."""
    docs = _documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return minhash.near_duplicates(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_license_scan,
        op3_source_mixing,
        op4_nearest_neighbours,
        op5_toxicity,
        op6_token_output,
        op7_sentencepiece_codec,
        op8_fingerprints,
        op9_language_id,
        op10_minhash_near_dedup,
    )
}

WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+')"
_weight = " ".join(f"when '{s}' then {w}" for s, w in MIX_WEIGHTS.items())

ORACLE_SQL: dict[str, str] = {
    "op3_source_mixing": rf"""
with d as (
  select *, md5('{mixing.SEED}:' || coalesce(cast(doc_id as varchar), '')) as k,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda w: w <> '')) as n
  from documents),
entry as (select source, k, sum(n) as n from d group by 1, 2),
run as (select *, sum(n) over (partition by source order by k) as c from entry),
per as (select source, sum(n) as total, case when sum(n) > 0 then case source {_weight} else 1.0 end else 0 end as w from entry group by 1),
share as (select source, total, cast(floor(cast(sum(total) over () as double) * cast(w as double) / cast(sum(w) over () as double)) as bigint) as budget from per),
plan as (select source, case when total > 0 then budget // total else 0 end as epochs, budget - (case when total > 0 then budget // total else 0 end) * total as room from share),
cut as (select p.source, p.epochs, max(r.k) filter (where r.c <= p.room and p.room > 0) as cut from plan p join run r on r.source is not distinct from p.source group by 1, 2),
times as (select d.*, c.epochs + case when d.k <= c.cut then 1 else 0 end as t from d join cut c on c.source is not distinct from d.source)
select doc_id, text, lang, source, n_chars from (select *, unnest(range(cast(t as bigint))) as e from times)""",
    "op9_language_id": rf"""
with d as (select doc_id, lang, text, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g')) || ' ' as t from documents),
pos as (select doc_id, lang, t, unnest(range(1, length(t) + 1)) as i from d where length(t) > 2),
g as (
  select doc_id, lang, gram, count(*) as n from (
    select doc_id, lang, substr(t, i, 1) as gram from pos where substr(t, i, 1) <> ' '
    union all select doc_id, lang, substr(t, i, 2) from pos where i + 1 <= length(t)
    union all select doc_id, lang, substr(t, i, 3) from pos where i + 2 <= length(t))
  group by 1, 2, 3),
chosen as (
  select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by md5(cast(doc_id as varchar)), doc_id) as r
    from documents where doc_id is not null and lang is not null and text is not null) where r <= {langid.TRAINING_ROWS}),
profile as (
  select lang, gram, r - 1 as r from (
    select lang, gram, row_number() over (partition by lang order by sum(n) desc, gram) as r from g join chosen using (lang, doc_id) group by 1, 2)
  where r <= {langid.PROFILE}),
mine as (
  select doc_id, gram, r - 1 as r from (select doc_id, gram, row_number() over (partition by doc_id order by n desc, gram) as r from g) where r <= {langid.PROFILE}),
dist as (
  select m.doc_id, l.lang, sum(coalesce(abs(p.r - m.r), {langid.PROFILE})) as dist, count(*) as n
  from mine m cross join (select distinct lang from profile) l left join profile p on p.lang = l.lang and p.gram = m.gram group by 1, 2),
best as (select doc_id, lang, dist / cast({langid.PROFILE} * n as double) as share from dist qualify row_number() over (partition by doc_id order by dist, lang) = 1)
select d.doc_id, case when share <= {langid.REJECT} then b.lang end as language, coalesce(share, 1.0) as distance from d left join best b using (doc_id)""",
    "op10_minhash_near_dedup": rf"""
with recursive w as (select doc_id, {WORDS} as ws from documents),
sh as (
  select distinct doc_id, case when len(ws) < 3 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 2], ' ') end as s
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) as i from w where len(ws) > 0)),
size as (select doc_id, count(*) as n from sh group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
edge as (select a, b from shared join size x on x.doc_id = a join size y on y.doc_id = b where c >= {minhash.THRESHOLD} * (x.n + y.n - c)),
two as (select a, b from edge union select b, a from edge),
walk as (select doc_id, doc_id as r from documents union select w.doc_id, two.b from walk w join two on two.a = w.r),
grp as (select doc_id, min(r) as group_id from walk group by 1)
select doc_id, group_id, count(*) over (partition by group_id) as group_size, doc_id = group_id as keep from grp""",
}
