"""The registered queries of the operators, with SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import chat, crosspolytope, decontaminate, jaccard, langid, licences, negatives, pieces, pii, shards, topk, toxicity, trie

#: Folder of the public tokenizer files; another one may be named.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_pii")
def op1_pii(spark, sf_dir):
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents")))


def held_out(id_col: str = "doc_id"):
    """The quarter of the documents that no model learns from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


@query("op2_language")
def op2_language(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out())
    named = langid.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op3_topk", """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
one as (select vec_id, min(v) as v from v group by vec_id),
scores as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
           from one q join one c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
ranked as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from scores)
select query_id, rank, vec_id, score from ranked where rank <= 5
""")
def op3_topk(spark, sf_dir):
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op4_decontaminate")
def op4_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _licence_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    flat = licences.flat_templates(licences.TEMPLATES)
    rows = ", ".join(f"({k}, {quote(name)}, {wording}, [{', '.join(map(quote, g))}])" for k, (name, wording, g) in enumerate(flat))
    return f"""
with templates(k, licence, wording, grams) as (values {rows}),
texts as (select doc_id, text, string_split(text, chr(10)) as lines, string_split_regex(text, '\\n[ \\t\\n\\x0B\\f\\r]*\\n') as blocks from documents),
units as (
  select doc_id, 'line' as unit, unnest(range(len(lines)))::int as place, unnest(lines) as text from texts
  union all select * from (select doc_id, 'block' as unit, unnest(range(len(blocks)))::int as place, unnest(blocks) as text from texts where len(blocks) > 1)
    where contains(trim(text, ' '), chr(10))
  union all select doc_id, 'text', 0, text from texts where len(lines) > 1),
worded as (select doc_id, unit, place, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), ' ') as w from units),
paired as (select doc_id, unit, place, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from worded where len(w) > 1),
scored as (select doc_id, unit, place, licence, wording, k, round(2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)), 6) as dice
           from paired join templates on len(g) between len(grams) * {licences.THRESHOLD / (2 - licences.THRESHOLD)} and len(grams) / {licences.THRESHOLD / (2 - licences.THRESHOLD)})
select doc_id, unit, place, licence, wording::int as wording, dice::double as dice from scored where dice >= {licences.THRESHOLD}
qualify row_number() over (partition by doc_id, unit, place order by dice desc, k) = 1
"""


@query("op5_licences", _licence_sql())
def op5_licences(spark, sf_dir):
    return licences.scan(_table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.grade_documents(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op7_jaccard", rf"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(text, '{_CAPITALS}', '{_SMALL}'), '[\x20\x09-\x0D]+'), lambda y: y <> '') as w from documents),
sets as (
  select doc_id, case when text_words is null or len(text_words) = 0 then []
    when len(text_words) < 4 then [array_to_string(text_words, ' ')]
    else list_distinct(list_transform(range(1, len(text_words) - 2), lambda i: text_words[i] || ' ' || text_words[i + 1] || ' ' || text_words[i + 2] || ' ' || text_words[i + 3])) end as s
  from (select doc_id, w as text_words from words)),
sizes as (select doc_id, len(s) as n from sets),
items as (select doc_id, unnest(s) as x from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from items a join items b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * c >= 85 * (p.n + q.n - c)),
both_ways as (select a, b from links union select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from sizes union select doc_id, b from reach join both_ways on other = a)
select doc_id, n::bigint as n_shingles, component_id from sizes join (select doc_id, min(other) as component_id from reach group by 1) using (doc_id)
""")
def op7_jaccard(spark, sf_dir):
    return jaccard.JaccardJoin(_table(spark, sf_dir, "documents")).members().drop("digest")


@query("op8_pieces")
def op8_pieces(spark, sf_dir):
    return pieces.encode(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


@query("op9_shards")
def op9_shards(spark, sf_dir):
    return shards.assign(_table(spark, sf_dir, "documents"))


_MARKED = "`<|im_end|><|im_start|>assistant ok`".strip("`")
_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"


@query("op10_chat", rf"""
with turns as (
  select conv_id, turn, role, text, coalesce(role, '') as r, coalesce(text, '') as t from conversations
  union all select -1, 0, 'user', '{_MARKED}', 'user', '{_MARKED}' union all select -1, 1, 'assistant', '{_MARKED}', 'assistant', '{_MARKED}'),
joined as (
  select conv_id, count(*) as n_turns, string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, role nulls first, text nulls first) as whole,
    coalesce(string_agg(t, '' order by turn nulls first, role nulls first, text nulls first) filter (r = 'assistant'), '') as loss,
    sum({len(chat.START + chat.MIDDLE + chat.END)} + length({_ESCAPED.format('r')}) + length({_ESCAPED.format('t')})) as chars
  from turns group by conv_id)
select conv_id, n_turns::bigint as n_turns, sha256(whole) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256,
  chars::bigint as formatted_chars from joined
""")
def op10_chat(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", _MARKED), (-1, 1, "assistant", _MARKED)], rows.schema)
    return chat.digest(chat.format_conversations(rows.unionByName(extra), f"{TOKENIZERS}/byte_bpe_50k.json"))


#: crc32 of a decimal number, bit by bit: a byte joins before the first of its eight steps.
_CRC32 = """xor(4294967295, list_reduce(flatten([[4294967295::bigint], flatten(list_transform(string_split({0}::varchar, ''), lambda y: [ascii(y)::bigint, 0, 0, 0, 0, 0, 0, 0]))]),
  lambda a, s: xor(xor(a, s) >> 1, 3988292384 * (xor(a, s) & 1))))"""


@query("op11_trie", rf"""
with turns as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
convs as (select c, c - c % 100 as base, {_CRC32.format('c')} % 6 as h, max(pos) as len from turns group by c),
lent as (select a.c, a.base, a.h, least(a.h, coalesce(b.len, 0)) as lent from convs a left join convs b on b.c = a.base),
steps as (
  select l.c, t.pos, t.role, t.text from lent l join turns t on t.c = l.base and t.pos <= l.lent
  union all select l.c, t.pos - l.h + l.lent, t.role, t.text from lent l join turns t on t.c = l.c and t.pos > l.h),
marked as (
  select c, pos, text, sha256(string_agg(sha256(role || chr(0) || text), '' order by pos) over (partition by c order by pos rows between unbounded preceding and current row)) as k,
    coalesce(sha256(string_agg(sha256(role || chr(0) || text), '' order by pos) over (partition by c order by pos rows between unbounded preceding and 1 preceding)), '') as p from steps
  union all select c, 0, '', '', null from convs),
lens as (select c, max(pos) as len from marked group by c),
nodes as (select pos as depth, k, any_value(p) as p, min(c) as conv_id, count(*) as n_convs, any_value(length(text)) as chars, string_agg(c::varchar, ',' order by c) filter (pos = len) as ends
          from marked join lens using (c) group by pos, k),
kids as (select depth - 1 as depth, p as k, count(*) as n_children from nodes where depth > 0 group by all),
full_nodes as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join kids using (depth, k)),
sums as (select m.pos as depth, m.k, sum((n.n_children = 0)::int) as n_leaves, sum((n.n_convs - 1) * n.chars) as saved_tokens
         from full_nodes n join marked m on m.c = n.conv_id and m.pos <= n.depth group by 1, 2)
select n.conv_id, n.depth::bigint as depth, a.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, n.n_children::bigint as n_children, n_leaves::bigint as n_leaves,
  saved_tokens::bigint as saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from full_nodes n join sums s on s.depth = n.depth and s.k = n.k left join nodes a on a.depth = n.depth - 1 and a.k = n.p
""")
def op11_trie(spark, sf_dir):
    return trie.prefix_trie(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


@query("op12_negatives", """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
           where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
one as (select vec_id, min(v) as v, arg_min(label, v) as label from v group by vec_id),
scores as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as alike, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
           from one a join one b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scores where alike
              qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
ranked as (select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank, vec_id as negative_id, positive_score, score as negative_score
           from positives join scores using (anchor_id) where not alike and 80 * positive_score <= 100 * score and score <= positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 5
""")
def op12_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query("op13_neighbours")
def op13_neighbours(spark, sf_dir):
    return crosspolytope.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
