"""Registered queries of the pipeline operators, each with its contract's parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import ann, attribution, conversations, decontaminate, packing, quality, simhash, site_rules, suffix_tree, token_orc, toxicity, urls, whitening
from tidelog.llm.common import fold, read
from tidelog.llm.words import tokenizer_path
from tidelog.session import run_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WORD_BPE = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("op3_orc_token_ids")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_folder(spark, "tokens")
    token_orc.write_tokens(read(spark, sf_dir, "documents"), path, tokenizer_path(WORD_BPE), end_id=2)
    return token_orc.digest(spark, path)


@query("op7_simhash_vantage")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, bits=3)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
RULE_SQL = """
with rules(host, path, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as r from pages),
parts as (
  select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path, row_number() over () as n
  from rest),
fits as (
  select n, u.host || u.path as rule, u.verdict, row_number() over (partition by n order by len(string_split(u.host, '.')) desc, length(u.host) desc, length(u.path) desc, u.verdict desc) as k
  from parts p join rules u on (p.host = u.host or ends_with(p.host, '.' || u.host)) and starts_with(p.path, u.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join (select * from fits where k = 1) using (n)
"""


@query("op9_url_rules", RULE_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), capacity=2048, end_id=0, with_ids=False)


@query("op1_suffix_tree_scores")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_tree.learn_and_score(read(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 7) == 2)
    return rows.select("doc_id", F.col("mark").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op2_convolution_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), learn=fold("doc_id", 4) != 2)
    rows = toxicity.with_scores(docs, model)
    return rows.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("toxic"))


@query("op4_hierarchical_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), learn=fold("doc_id", 5) != 2)
    names = ["host", "path", "evidence", "host_rate", "path_rate", "score", "keep"]
    return rows.select("doc_id", (fold("doc_id", 5) == 2).alias("held_out"), *[F.col(f"__{n}").alias(n) for n in names])


@query("op5_section_tokens")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(read(spark, sf_dir, "documents"), fields=("source", "lang", "text"))


@query("op6_learned_partitions")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


@query("op8_string_tiling")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")


SITE_SQL = r"""
with docs as (select row_number() over () as n, doc_id, coalesce(text, '') as text,
  nullif(translate(split_part(source, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host from documents),
cut as (
  select n, doc_id, host, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, regexp_extract_all(text, '[#*$%&|<>]') as signs,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from docs),
each as (select n, unnest(words) as w, generate_subscripts(words, 1) as i from cut),
windows as (
  select n, i, w from (
    select n, i, concat_ws(' ', w, lead(w, 1) over p, lead(w, 2) over p, lead(w, 3) over p, lead(w, 4) over p) as w, lead(i, 4) over p as last from each window p as (partition by n order by i))
  where last is not null),
again as (select n, i, lag(i) over (partition by n order by i) as before from (select n, i, count(*) over (partition by n, w) as c from windows) where c > 1),
repeats as (select n, sum(least(5, coalesce(i - before, 5)))::bigint as covered from again group by n),
counts as (
  select n, doc_id, host, len(words) as n_words, length(array_to_string(words, '')) as word_chars, len(signs) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(covered, 0) as n_repeat_words, len(lines) as n_lines
  from cut left join repeats r using (n)),
rules as (
  select n, host, 'short' as rule, n_words < 10 as f from counts union all
  select n, host, 'repeats', 100 * n_repeat_words > 20 * n_words from counts union all
  select n, host, 'word_length', n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words) from counts union all
  select n, host, 'signs', 10 * n_symbols > n_words from counts union all
  select n, host, 'same_lines', 100 * n_dup_lines > 30 * n_lines from counts),
hosts as (select host, rule, count(*)::double as k, count(*) filter (f)::double as bad from rules where host is not null group by all),
sums as (select rule, sum(bad) / sum(k) as p, sum(bad * bad / k) as s, sum(k) as t, sum(k * k) as tt, count(*) as h from hosts group by rule),
spread as (select rule, p, p * (1 - p) * (t - tt / t - h + 1) as room, s - p * p * t - p * (1 - p) * (h - 1) as over from sums),
prior as (select rule, p, 1 / least(0.5, greatest(1e-6, case when room > 0 then over / room else 0 end)) - 1 as m from spread),
rates as (select host, rule, (bad + p * m) / (k + m) as rate from hosts join prior using (rule)),
verdicts as (
  select n, bool_or(f and rule in ('short', 'repeats')) as base_failed, coalesce(bool_or(rate >= 0.5), false) as host_blocked, coalesce(bool_or(f and rate >= 0.2), false) as watched
  from rules left join rates using (host, rule) group by n)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_blocked, not (base_failed or host_blocked or watched) as kept
from counts join verdicts using (n)
"""


@query("op11_site_rules", SITE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_rules.judge(read(spark, sf_dir, "documents")).drop("host", "n_lines", "failed")


@query("op12_whitened_embeddings")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), id_col="vec_id", vector_col="embedding", scale=256, components=4)


REPAIR_SQL = r"""
with recursive keys as (
  select conv_id, dense_rank() over (order by conv_id) as c, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
kinds as (
  select *, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 as kind from keys),
damaged as (
  select c, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from kinds, range(case kind when 0 then 0 when 3 then 2 else 1 end)),
placed as (select *, row_number() over (partition by c order by turn nulls first, role, text) as i from damaged),
rows as (
  select *, left(role, 1) as r, left(lag(role) over (partition by c order by i), 1) as before,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when row_number() over (partition by c, role, text order by i) > 1 then 'd'
      when right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) not in ('.', '!', '?') then 't' else '' end as fault from placed),
-- cheapest cost and edits from row i on, by the state before it: x nothing yet, s, u, a
best as (
  select c, max(i) + 1 as i, {'k': 0, 'e': ''} as x, {'k': 4, 'e': 'II'} as s, {'k': 2, 'e': 'I'} as u, {'k': 0, 'e': ''} as a from rows group by c
  union all
  select c, i, list_min([nx, {'k': 2 + nu.k, 'e': 'I' || nu.e}, {'k': 4 + na.k, 'e': 'II' || na.e}]), list_min([ns, {'k': 2 + nu.k, 'e': 'I' || nu.e}, {'k': 4 + na.k, 'e': 'II' || na.e}]),
    list_min([nu, {'k': 2 + na.k, 'e': 'I' || na.e}]), list_min([na, {'k': 2 + nu.k, 'e': 'I' || nu.e}])
  from (
    select c, i,
      list_min([dx, case when stays and r = 's' then {'k': t + s.k, 'e': 'K' || s.e} end, case when stays and r = 'u' then {'k': t + u.k, 'e': 'K' || u.e} end, case when stays then {'k': 2 + t + u.k, 'e': 'R' || u.e} end]) as nx,
      list_min([ds, case when stays and r = 'u' then {'k': t + u.k, 'e': 'K' || u.e} end, case when stays then {'k': 2 + t + u.k, 'e': 'R' || u.e} end]) as ns,
      list_min([du, case when stays and r = 'a' then {'k': t + a.k, 'e': 'K' || a.e} end, case when stays then {'k': 2 + t + a.k, 'e': 'R' || a.e} end]) as nu,
      list_min([da, case when stays and r = 'u' then {'k': t + u.k, 'e': 'K' || u.e} end, case when stays then {'k': 2 + t + u.k, 'e': 'R' || u.e} end]) as na
    from (
      select r.c, r.i, r.r, r.fault not in ('b', 'd') as stays, case r.fault when 't' then 1 else 0 end as t, x, s, u, a,
        {'k': 3 + x.k, 'e': 'D' || x.e} as dx, {'k': 3 + s.k, 'e': 'D' || s.e} as ds, {'k': 3 + u.k, 'e': 'D' || u.e} as du, {'k': 3 + a.k, 'e': 'D' || a.e} as da
      from best b join rows r on r.c = b.c and r.i = b.i - 1))),
plans as (select c, x.k::bigint as cost, x.e as audit from best where i = 1),
letters as (select c, p, audit[p] as letter, audit from (select c, audit, unnest(range(1, length(audit) + 1)) as p from plans)),
edits as (
  select *, count(*) filter (letter <> 'I') over (partition by c order by p) as i, count(*) filter (letter <> 'D') over (partition by c order by p) as o,
    count(*) filter (letter <> 'D') over (partition by c) as n from letters),
repaired as (
  select e.c, string_agg(case when letter = 'K' then r.role when (o + n) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else r.text end, chr(10) order by p) as text
  from edits e left join rows r on r.c = e.c and r.i = e.i where letter <> 'D' group by e.c),
counts as (
  select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
    count(*) filter (fault = 't') as truncated, count(*) filter (before || r not in ('su', 'ua', 'au')) as illegal from rows group by c)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(repaired.text, '')) as repaired_sha256
from (select distinct c, conv_id from keys) left join counts using (c) left join plans using (c) left join repaired using (c)
"""


@query("op13_repaired_conversations", REPAIR_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(read(spark, sf_dir, "conversations")))
