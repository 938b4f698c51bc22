"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm.bpe import token_digests
from ledgerspark.llm.chat import chat_digests
from ledgerspark.llm.common import table
from ledgerspark.llm.convtrie import prefix_trie
from ledgerspark.llm.decontaminate import contamination_report
from ledgerspark.llm.html_text import extract
from ledgerspark.llm.jaccard import jaccard_components
from ledgerspark.llm.langid import language_report
from ledgerspark.llm.lm import likelihood_report
from ledgerspark.llm.pii import pii_report
from ledgerspark.llm.topk import search
from ledgerspark.llm.urlfilter import judge, listed_keys
from ledgerspark.llm.warc import archive_report
from ledgerspark.llm.whiten import whiten

EXTRA_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]

#: Verdict, host and path of the rules of op13.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Host and path of the keys that op13 blocks where no rule fits.
LISTED_URLS = tuple((f"{name}.example.{end}", "") for name in ("cheap-pills", "spam-farm") for end in ("com", "net", "org"))


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood_report(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(table(spark, sf_dir, "pages"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(turns.unionByName(spark.createDataFrame(EXTRA_CONVERSATION, turns.schema)))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), URL_RULES, listed_keys(spark, LISTED_URLS))


LLM_QUERIES = {
    "op1_jaccard": op1_jaccard,
    "op2_likelihood": op2_likelihood,
    "op3_language": op3_language,
    "op4_pii": op4_pii,
    "op5_html": op5_html,
    "op6_bpe": op6_bpe,
    "op7_warc": op7_warc,
    "op8_topk": op8_topk,
    "op9_decontaminate": op9_decontaminate,
    "op10_chat": op10_chat,
    "op11_whiten": op11_whiten,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_urls": op13_urls,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHA1_BITS = (
    "list_aggregate(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001',"
    "'1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', sha1(payload)[i])]), 'string_agg', '')"
)
_ESCAPED = "replace(replace(replace({}, chr(92), chr(92) || chr(92)), '###', chr(92) || '###'), '</turn>', chr(92) || '</turn>')"

_WORDS = r"cast(len(list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')) as bigint)"
_CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(1, length({0}) + 1), lambda i: cast(ascii({0}[i]) as bigint))), "
    "lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"
)

#: Expected results in SQL, for the operators that SQL can express. The others are tested against brute force.
LLM_ORACLES: dict[str, str] = {
    "op1_jaccard": rf"""
with recursive words as materialized (
  select doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
sets as materialized (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                      else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end as s from words),
classes as materialized (select s, min(doc_id) as rep from sets where len(s) > 0 group by s),
tokens as materialized (select rep, len(s) as n, unnest(s) as t from classes),
pairs as materialized (
  select a.rep as x, b.rep as y from tokens a join tokens b on a.t = b.t and a.rep < b.rep and a.n * 10 >= b.n * 9 and b.n * 10 >= a.n * 9
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
links as materialized (select x, y from pairs union all select y, x from pairs),
reach as (select rep as x, rep as y from classes union select r.x, l.y from reach r join links l on l.x = r.y),
component as (select x, min(y) as c from reach group by x)
select d.doc_id, cast(len(d.s) as bigint) as n_shingles, coalesce(c.c, d.doc_id) as component_id
from sets d left join classes k on k.s = d.s and len(d.s) > 0 left join component c on c.x = k.rep""",
    "op7_warc": f"""
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, cast(strlen(payload) as bigint) as payload_bytes, min(page_id) over (partition by payload) as first, {_SHA1_BITS} as bits from p)
select page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * cast(bits[5*i+1] as int) + 8 * cast(bits[5*i+2] as int) + 4 * cast(bits[5*i+3] as int) + 2 * cast(bits[5*i+4] as int)
         + cast(bits[5*i+5] as int), 1)), 'string_agg', '') as payload_digest,
       case when first < page_id then 'revisit' else 'response' end as record_type, case when first < page_id then first end as refers_to
from d""",
    "op8_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
    "op9_decontaminate": rf"""
with texts as (
  select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
words as materialized (
  select kind, id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from texts),
windows as materialized (
  select distinct id as item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as win
  from (select id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from words where kind = 'b' and len(w) > 0)),
sizes as (select distinct n from windows),
grams as materialized (
  select id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
  from (select id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, sizes where kind = 'd' and len(w) >= n)),
found as materialized (select g.id, g.i, g.n, b.item_id from grams g join windows b on b.n = g.n and b.win = g.win),
hits as (select id, count(distinct p) as n_hit from (select id, unnest(range(i, i + n)) as p from found) group by id),
items as (select id, count(*) as n_items, string_agg(item, ',' order by item) as l
          from (select distinct id, cast(item_id as varchar) as item from found) group by id)
select w.id as doc_id, cast(len(w.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words w left join hits h on h.id = w.id left join items i on i.id = w.id where w.kind = 'd'""",
    "op10_chat": f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', chr(92) || '### Assistant: </turn> ok' union all select -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + {len('### ' + ': ' + ' </turn>') + 1}) as bigint) as formatted_chars
from turns group by conv_id""",
    "op12_prefix_trie": f"""
with own as materialized (
  select conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) order by turn nulls first) as turns,
         {_CRC32.format("cast(conv_id as varchar)")} % 4 as h
  from conversations where conv_id is not null group by conv_id),
rebuilt as materialized (
  select o.conv_id, coalesce(b.turns[1:o.h], []) || o.turns[o.h + 1:] as path
  from own o left join own b on b.conv_id = o.conv_id - o.conv_id % 20),
prefixes as materialized (select conv_id, unnest(range(0, len(path) + 1)) as depth, path from rebuilt),
members as materialized (select conv_id, depth, path[1:depth] as node, len(path) = depth as ends from prefixes),
nodes as materialized (
  select node, depth, min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as ends_sha256,
         case when depth = 0 then 0 else (count(*) - 1) * {_WORDS.format("any_value(node[depth].t)")} end as saved
  from members group by node, depth),
linked as materialized (
  select n.*, p.conv_id as parent_conv_id from nodes n left join nodes p on p.depth = n.depth - 1 and p.node = n.node[1:n.depth - 1]),
family as materialized (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from linked where depth > 0 group by 1, 2),
above as (  -- each node with all nodes over it
  select n.conv_id as low, n.depth as low_depth, m.depth, m.node from linked n, lateral (select unnest(range(0, n.depth + 1)) as depth) d
  join nodes m on m.depth = d.depth and m.node = n.node[1:d.depth]),
sums as (
  select a.node, a.depth, count(*) filter (f.n_children is null) as n_leaves, sum(l.saved) as saved_tokens
  from above a join linked l on l.conv_id = a.low and l.depth = a.low_depth
  left join family f on f.conv_id = l.conv_id and f.depth = l.depth group by 1, 2)
select l.conv_id, l.depth, l.parent_conv_id, l.n_convs, coalesce(f.n_children, 0) as n_children, s.n_leaves,
       cast(s.saved_tokens as bigint) as saved_tokens, l.ends_sha256
from linked l join sums s on s.node = l.node and s.depth = l.depth left join family f on f.conv_id = l.conv_id and f.depth = l.depth""",
    "op13_urls": rf"""
with cut as (select page_id, case when strpos(url, '://') > 0 then url[strpos(url, '://') + 3:] else '' end as rest from pages),
host as (select page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) as host from cut),
urls as (select page_id, {_LOWER.format("host")} as host, regexp_extract(rest[length(host) + 1:], '^([^?#]*)', 1) as path from host),
rules(verdict, h, p) as (values {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}),
listed(h) as (values {", ".join(f"('{h}')" for h, _ in LISTED_URLS)}),
fits as (select u.page_id, r.h || r.p as rule, r.verdict from urls u join rules r
         on (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p)),
best as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from fits group by 1)
select u.page_id, u.host, u.path, b.rule,
       coalesce(b.verdict, case when exists (select 1 from listed l where u.host = l.h or ends_with(u.host, '.' || l.h)) then 'block' else 'allow' end) as verdict
from urls u left join best b on b.page_id = u.page_id""",
}
