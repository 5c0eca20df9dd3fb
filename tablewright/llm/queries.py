"""Queries of this subpackage: name -> callable(spark, sf_dir), and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe_trie, collocations, decontaminate, fill_in_middle, jaccard_join, line_dedup, piece_codec, quality_cnn,
               quality_rules, sharding, substring_dedup, token_counts, toxicity)
from .common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, kept = quality_rules.passes(quality_rules.BASE), quality_rules.passes(quality_rules.STANDARD)
    return quality_rules.ledger(documents(spark, sf_dir)).select(
        "doc_id", *quality_rules.MEASURES[:5], (~base).alias("base_failed"), kept.alias("kept"),
        *quality_rules.MEASURES[5:], "failure_bits")


SQL["op1_quality_rules"] = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from d),
words as (select doc_id, unnest(ws) as a, generate_subscripts(ws, 1) as i from w),
three as (select doc_id, i, a, lead(a) over p as b, lead(a, 2) over p as c from words
          window p as (partition by doc_id order by i)),
windows as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from three where c is not null),
repeated as (select doc_id, count(distinct p) as n
             from (select doc_id, unnest([i, i + 1, i + 2]) as p from windows where n > 1) group by doc_id),
m as (select w.doc_id, cast(len(ws) as bigint) as n_words,
             cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
             cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
             cast(coalesce(r.n, 0) as bigint) as n_repeat_words,
             cast(len(ls) as bigint) as n_lines,
             cast(length(regexp_replace(t, '[^A-Z]', '', 'g')) as bigint) as n_upper,
             cast(length(regexp_replace(t, '[^a-z]', '', 'g')) as bigint) as n_lower,
             cast(length(regexp_replace(t, '[^!?]', '', 'g')) as bigint) as n_marks
      from w left join repeated r using (doc_id)),
b as (select *, cast((n_words < 50)::int | (100 * n_repeat_words > 50 * n_words)::int * 2
                     | (100 * n_symbols > 10 * n_words)::int * 4 | (n_upper > n_lower)::int * 8
                     | (100 * n_marks > 30 * n_words)::int * 16 | (100 * n_dup_lines > 60 * n_lines)::int * 32
                     | (word_chars > 40 * n_words)::int * 64 as bigint) as failure_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_bits & 3 <> 0 as base_failed,
       failure_bits & 127 = 0 as kept, n_lines, n_upper, n_lower, n_marks, failure_bits
from b
"""


@query
def op2_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir), 8)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(documents(spark, sf_dir), 13)


SQL["op3_substring_dedup"] = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
runs as (select doc_id, i, list(word) over (partition by doc_id order by i rows between current row and 12 following) as r
         from words),
windows as (select doc_id, i, md5(array_to_string(r, ' ')) as h from runs where len(r) = 13),
late as (select doc_id, i, min(doc_id) over (partition by h) < doc_id as is_late from windows),
gone as (select distinct doc_id, i + j as i from late, (select unnest(range(13)) as j) where is_late),
kept as (select words.doc_id, count(g.i) as n_removed, string_agg(word, ' ' order by words.i) filter (g.i is null) as t
         from words left join gone g on words.doc_id = g.doc_id and words.i = g.i group by words.doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)
"""


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_counts(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL["op9_line_dedup"] = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as no from d),
w as (select doc_id, no, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as ws from l),
places as (select doc_id, no, len(ws) as n, ws,
                  row_number() over (partition by line order by doc_id, no) as copy,
                  row_number() over (order by doc_id, no) as place
           from w where len(ws) > 0),
firsts as (select * from places where copy = 1 and n >= 8),
parts as (select place, ws, n, unnest(range(1, n + 2)) as i from firsts),
variants as (select place, i, md5(array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ')) as h from parts where i <= n
             union all select place, i, md5(array_to_string(ws, ' ')) from parts),
late as (select distinct place from (select place, min(place) over (partition by i, h) as e from variants) where e < place),
gone as (select doc_id, no from places where copy > 1
         union select doc_id, no from places where place in (select place from late)),
kept as (select l.doc_id, string_agg(line, chr(10) order by l.no) filter (g.no is null) as t, count(g.no) as n_removed
         from l left join gone g on l.doc_id = g.doc_id and l.no = g.no group by l.doc_id),
counted as (select doc_id, count(*) as n_lines from places group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id) left join counted using (doc_id)
"""


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_documents(documents(spark, sf_dir))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_cnn.score(docs, quality_cnn.fit(docs, table(spark, sf_dir, "labels")))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(documents(spark, sf_dir))


SQL["op11_fill_in_middle"] = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || doc_id) as h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as us,
             [cast('0x' || substr(h, 8 * i + 1, 8) as bigint) for i in range(4)] as r from d),
p as (select doc_id, t, us, len(us) as n, r, least(r[1] % (len(us) + 1), r[2] % (len(us) + 1)) as a,
             greatest(r[1] % (len(us) + 1), r[2] % (len(us) + 1)) as b,
             t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 100 as plain from u),
f as (select doc_id, t, n, case when plain then 'plain' when r[4] % 100 < 50 then 'spm' else 'psm' end as form,
             array_to_string(us[1:a], '') as pre, array_to_string(us[a + 1:b], '') as mid,
             array_to_string(us[b + 1:], '') as suf from p)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars,
       case when form <> 'plain' then length(mid) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
              else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(t) as restored_sha256
from f
"""


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.ranked(table(spark, sf_dir, "documents"))


SQL["op12_collocations"] = r"""
with d as (select coalesce(lang, 'und') as lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
starts as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
grams as (select lang, ws[i:i + k - 1] as g, k from starts, (select unnest(range(1, 6)) as k) where i + k - 1 <= len(ws)),
f as (select lang, k, g, array_to_string(g, ' ') as phrase, count(*) as a from grams group by lang, k, g),
total as (select lang, cast(sum(a) as bigint) as n from f where k = 1 group by lang),
c as (select * from f where k > 1 and a >= 100),
inside as (select lang, g[s:s + m - 1] as sub, max(a) as longer
           from (select lang, g, k, a, m, unnest(range(1, k - m + 2)) as s
                 from (select lang, g, k, a, unnest(range(2, k)) as m from c)) group by lang, sub),
kept as (select c.* from c left join inside on inside.lang = c.lang and inside.sub = c.g
         where longer is null or 100 * longer < 100 * a),
cuts as (select lang, g, phrase, a, k, unnest(range(1, k)) as c from kept),
scored as (select cuts.lang, cuts.phrase, cuts.a, cuts.c, l.a as l, r.a as r, n,
                  cast(1000 * cuts.a::hugeint * n::hugeint // (l.a::hugeint * r.a::hugeint) as bigint) as score
           from cuts join total on total.lang = cuts.lang
           join f as l on l.lang = cuts.lang and l.g = cuts.g[1:cuts.c]
           join f as r on r.lang = cuts.lang and r.g = cuts.g[cuts.c + 1:]),
best as (select *, row_number() over (partition by lang, phrase order by score, c) as b from scored),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
           from best where b = 1)
select * from ranked where rank <= 2000
"""


@query
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
