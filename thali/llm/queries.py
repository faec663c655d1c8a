"""The registered queries of the operators: each applies one operator, with
its production parameters, to its whole table."""

from __future__ import annotations

import math
import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thali.llm import bpe, chat, collocations, exact_dedup, langid, lexical, licenses, minhash, mixing, quality, sharding, simhash, suffix_tree
from thali.llm.common import literal_rows, read_table

# The white space class, as DuckDB's regex takes it.
_GAP = r"[\x20\x09-\x0D]+"

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.groups(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"), n_shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version", "moved")


@query
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(read_table(spark, sf_dir, "documents"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN).drop("ids")


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    own = literal_rows(spark, "conv_id bigint, turn bigint, role string, text string", [(-1, 0, "user", said), (-1, 1, "assistant", said)])
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.formatted(turns.unionByName(own)))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read_table(spark, sf_dir, "documents"))


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _values(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


ORACLE["op6_quality_rules"] = rf"""
with t as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_GAP}'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), windows as (
  select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select rid, w, unnest(range(1, len(w) - 1)) as i from t)
), repeated as (
  select rid, i from (select *, count(*) over (partition by rid, g) as n from windows) where n > 1
), covered as (
  select rid, count(distinct i + k) as n from repeated, (values (0), (1), (2)) o(k) group by rid
), m as (
  select t.rid, doc_id, len(w) as n_words, length(list_aggregate(list_concat([''], w), 'string_agg', '')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words,
    len(list_filter(w, lambda x: x in ({_values(sorted({f(x) for x in quality.STOP_WORDS for f in (str.lower, str.capitalize, str.upper)}))}))) as n_stop,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[-*•·‣]'))) as n_bullet,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) as n_ellipsis
  from t left join covered using (rid)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  n_words >= 50 and 100 * n_repeat_words <= 50 * n_words and word_chars >= 2 * n_words and word_chars <= 25 * n_words
    and n_symbols <= 0.3 * n_words and n_stop >= 0.04 * n_words and n_dup_lines <= 0.4 * n_lines
    and n_bullet <= 0.9 * n_lines and n_ellipsis <= 0.3 * n_lines as kept
from m
"""

ORACLE["op7_chat_format"] = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e as (
  select *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) as text_chars,
    length(regexp_replace(replace(replace(role, '&', '&amp;'), chr(10), '&nl;'), '<(\\*)\|', '<\1\\|', 'g')) as role_chars,
    lag(role) over (partition by conv_id order by turn nulls first, role, text) is distinct from role as starts
  from c
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(text_chars + case when starts then 24 + role_chars else 10 end)::bigint as formatted_chars
from e group by conv_id
"""

ORACLE["op9_exact_dedup"] = rf"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '{_GAP}', ' ', 'g') as content from documents
), g as (
  select content, min(doc_id) as keep_id, count(*) as group_size from t group by content
)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.content) as text_sha256
from t join g on t.content = g.content
"""


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _places(phrase: str) -> str:
    own = phrase.split()
    same = " and ".join(f"w[i + {k}] = '{word}'" if k else f"w[i] = '{word}'" for k, word in enumerate(own))
    return f"list_filter(range(1, len(w) + 1), lambda i: {same})"


def _license(k: int, label: str, text: str) -> tuple:
    own = licenses.template_words(text)
    return k, label, own, len(own), math.ceil(licenses.THRESHOLD * len(own) - 1e-9), int(licenses.SPAN * len(re.findall("[0-9A-Za-z]+", text)))


_LICENSES = [_license(k, label, text) for k, (label, text) in enumerate(licenses.TEMPLATES)]

ORACLE["op10_licenses"] = rf"""
with t as (
  select row_number() over () as rid, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents
), d as (
  select rid, doc_id, t, list_filter(regexp_split_to_array(t, '{_WORDS}'), lambda x: x <> '') as w from t
), p as (
  select rid, doc_id, len(w) as n_words, {", ".join(f'{_places(p)} as p{k}' for k, (p, _) in enumerate(licenses.PHRASES))} from d
), b as (
  select rid, doc_id, n_words, {" || ".join(f"p{k}" for k in range(len(licenses.PHRASES)))} as places,
    {" || ".join(f"case when len(p{k}) > 0 then ['{name}'] else [] end" for k, (_, name) in enumerate(licenses.PHRASES))} as base
  from p
), w as (
  select rid, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from d
), templates(k, label, size, need, reach) as (
  values {", ".join(f"({k}, '{label}', {size}, {need}, {reach})" for k, label, _, size, need, reach in _LICENSES)}
), own(k, word) as (
  values {", ".join(f"({k}, '{x}')" for k, _, own, *_ in _LICENSES for x in own)}
), near as (
  select rid, k, i, word, need, reach from w join own using (word) join templates using (k)
  qualify count(distinct word) over (partition by rid, k) >= need
), firsts as (
  select a.rid, a.k, a.i as first, o.word, min(o.i) as place, any_value(a.need) as need
  from near a join near o on o.rid = a.rid and o.k = a.k and o.i >= a.i and o.i < a.i + a.reach group by all
), runs as (
  select rid, k, first, max(place) as last, count(*) as n from firsts group by rid, k, first having count(*) >= any_value(need)
), least as (
  select * from runs r where not exists (
    select 1 from runs o where o.rid = r.rid and o.k = r.k and o.first > r.first and o.last <= r.last and o.n >= r.n)
), wider as (
  select a.k, b.k as wide from templates a, templates b where b.size > a.size
    and not exists (select 1 from own x where x.k = a.k and x.word not in (select y.word from own y where y.k = b.k))
), named as (
  select * from least l where not exists (
    select 1 from wider v join least o on o.k = v.wide where v.k = l.k and o.rid = l.rid and o.first <= l.first and o.last >= l.last)
), found as (
  select rid, list(distinct label) as labels, max(n / size) as best from named join templates using (k) group by rid
)
select doc_id, n_words, len(places) as n_base, list_min(places) - 1 as first_word, list_max(places) - 1 as last_word,
  array_to_string(list_sort(base), ',') as base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') as labels, coalesce(best, 0.0) as score
from b left join found using (rid)
"""


@query
def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(read_table(spark, sf_dir, "documents"), shingle=4)


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_phrases(read_table(spark, sf_dir, "documents"), longest=3, least=10, inside=50, top=2000)


_STOPS = r"[.,;:!?\x0A-\x0D]"

ORACLE["op12_collocations"] = rf"""
with t as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents
), p as (
  select lang, unnest(regexp_split_to_array(t, '{_STOPS}')) as piece from t
), s as (
  select row_number() over () as pid, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p
), o as (
  select pid, lang, unnest(w) as word, generate_subscripts(w, 1) as i from s
), grams as (
  select lang, word as w1, lead(word) over at_piece as w2, lead(word, 2) over at_piece as w3 from o window at_piece as (partition by pid order by i)
), f as (
  select lang, 1 as k, w1 as phrase, count(*) as f from grams group by all
  union all select lang, 2, w1 || ' ' || w2, count(*) from grams where w2 is not null group by all
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) from grams where w3 is not null group by all
), totals as (
  select lang, sum(f)::bigint as n from f where k = 1 group by lang
), candidates as (
  select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 10
), cuts as (
  select c.lang, c.phrase, a, j, l.f as l, r.f as r, (1000000::hugeint * a * a) // (l.f::hugeint * r.f) as s
  from candidates c join (values (1), (2)) v(j) on j < c.k
    join f l on l.lang = c.lang and l.phrase = array_to_string(w[1:j], ' ')
    join f r on r.lang = c.lang and r.phrase = array_to_string(w[j + 1:], ' ')
), best as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by s, j) = 1
), around as (
  select lang, phrase, max(a) as most from (
    select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, a from candidates where k = 3) group by all
), ranked as (
  select b.*, row_number() over (partition by b.lang order by s desc, b.a desc, b.phrase) as rank
  from best b left join around o on o.lang = b.lang and o.phrase = b.phrase where o.most is null or 100 * o.most < 50 * b.a
)
select lang, rank, phrase, a, l, r, n, s::bigint as score from ranked join totals using (lang) where rank <= 2000
"""


@query
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), top=20)


_TERMS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(table: str, key: str) -> str:
    text = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return f"select row_number() over () as rid, {key}, list_filter(regexp_split_to_array({text}, '{_TERMS}'), lambda x: x <> '') as w from {table}"


ORACLE["op13_lexical"] = rf"""
with d as ({_terms("documents", "doc_id")}
), i as ({_terms("benchmark", "item_id")}
), corpus as (
  select count(*) as docs, sum(len(w))::bigint as terms from d where len(w) > 0
), tf as (
  select rid, term, count(*) as tf from (select rid, unnest(w) as term from d) group by all
), weights as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from tf, corpus group by term
), asked as (
  select item_id, term, count(*) as times from (select item_id, unnest(w) as term from i) group by all
), scores as (
  select item_id, d.rid, any_value(d.doc_id) as doc_id,
    sum(times * weights.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.w) * docs) // terms))))::bigint as score
  from asked join weights using (term) join tf using (term) join d on d.rid = tf.rid, corpus group by all
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scores where score > 0 qualify rank <= 20
"""
