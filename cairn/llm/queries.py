"""The registered queries of the operators: each applies one to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import bpe, chat, compression, infill, knn, langid, lsh, pii, prefixes, tiling, toxicity, urlfilter
from cairn.llm.common import crc_mod, table
from cairn.llm.simhash import simhash_components

Query = Callable[[SparkSession, str], DataFrame]


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", knn.floored("embedding").alias("vec"))
    return knn.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    spec = bpe.read_spec(spark, public_tokenizers.path("byte_bpe_50k.json"))
    coded = bpe.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), spec)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, budget=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")


#: The key of surrogates in queries and the pipeline. A deployment passes its own, kept secret.
PII_KEY = "cairn"
#: Words after titles in so many texts are names without a title, too.
PII_LEARN = 3


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, learn=PII_LEARN)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.formatted(turns.withColumn("parts", chat.text_parts(F.col("text"))).drop("text")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, crc_mod(F.col("doc_id"), 3) != 1)
    found = langid.with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def _labelled(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """The labelled documents to learn from: id, label and lang; without those whose crc32 is held out."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col(label).alias("label")).where(crc_mod(F.col("id"), 5) > 0)
    return labels.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiling.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", F.size("tiles").alias("n_tiles"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = compression.with_quality(docs, compression.fit(docs, _labelled(spark, sf_dir, "quality")))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = docs.where(crc_mod(F.col("doc_id"), 5) > 0)
    found = toxicity.with_toxicity(docs, toxicity.fit(learn, _labelled(spark, sf_dir, "toxic")))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic")


#: The rules of the contract.
URL_RULES = [
    urlfilter.Rule("allow", "com"),
    urlfilter.Rule("block", "example.com", "/en/"),
    urlfilter.Rule("allow", "www.example.com", "/en/"),
    urlfilter.Rule("block", "net", "/es/"),
    urlfilter.Rule("block", "net", "/fr/"),
]


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", lsh.finite("embedding").alias("vec"))
    return lsh.nearest(vectors, F.col("vec_id") % 100 == 0, k=10)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=7, unit="line", percent=100, spm_percent=50)
    digests = [F.sha2(x.cast("binary"), 256).alias(name) for x, name in ((F.col("fim"), "output_sha256"), (infill.restored(F.col("form"), F.col("fim")), "restored_sha256"))]
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", *digests)


def _rebuilt(turns: DataFrame) -> DataFrame:
    """Of the contract: the first h turns of conversation c - c % 100, then c's own after its first h; h is crc32(c) % 6.

    turns and the result are as prefixes.digests makes them; a row without a digest stands for each conversation itself.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "digest")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    placed = turns.withColumn("turn", F.row_number().over(order))
    own = placed.where(F.col("turn") > h)
    convs = turns.select("conv_id").distinct().withColumns({"base": F.col("conv_id") - F.col("conv_id") % 100, "h": h})
    first = placed.where("turn <= 5 and conv_id % 100 = 0").withColumnRenamed("conv_id", "base")
    lent = convs.join(first, "base").where("turn <= h").select(own.columns)
    itself = convs.select("conv_id", F.lit(0).alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return own.unionByName(lent).unionByName(itself)


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(_rebuilt(prefixes.digests(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Query]:
    return {
        "op1_topk": op1_topk,
        "op2_bpe": op2_bpe,
        "op3_decontamination": op3_decontamination,
        "op4_quality": op4_quality,
        "op5_simhash": op5_simhash,
        "op6_pii": op6_pii,
        "op7_chat": op7_chat,
        "op8_language": op8_language,
        "op9_toxicity": op9_toxicity,
        "op10_urlfilter": op10_urlfilter,
        "op11_neighbours": op11_neighbours,
        "op12_infill": op12_infill,
        "op13_prefixes": op13_prefixes,
    }


_OP1 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)) v from embeddings
    where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, d.vec_id, cast(list_dot_product(q.v, d.v) as bigint) score from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) place from s)
select query_id, cast(place as int) rank, vec_id, score from r where place <= 5
"""

_OP7 = r"""
with t as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
    union all select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) h(conv_id, turn, role, text)),
e as (select *, length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<:]', 'xx', 'g')) + 15 n from t)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) turns_sha256,
    cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) loss_chars,
    sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn), '')) loss_sha256, cast(sum(n) as bigint) formatted_chars
from e group by conv_id
"""

_OP10 = r"""
with recursive u as (select page_id, html, coalesce(url, '') url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host from pages),
tags as (select url, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b[^>]*>')) tag from u),
links as (select url a, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1) b from tags),
named as (select url from u union select b from links where contains(b, '://')),
n as (select url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) path, regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) rest from named),
m as (select *, host || rest address, case when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%' then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/' when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/'
    when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/' when (host = 'com' or host like '%.com') and path like '/%' then 'com/' end rule from n),
e as (select x.address a, y.address b from links l join m x on x.url = l.a join m y on y.url = l.b where x.host <> '' and y.host <> '' and x.address <> y.address),
both_ways as (select a, b from e union select b, a from e),
reach(a, b) as (select a, a from both_ways union select r.a, b.b from reach r join both_ways b on b.a = r.b),
aliases as (select r.a address, bool_or(m.rule in ('com/', 'www.example.com/en/')) allow, bool_or(m.rule in ('example.com/en/', 'net/es/', 'net/fr/')) block from reach r join m on m.address = r.b group by 1)
select u.page_id, m.host, m.path, m.rule, case when m.rule in ('com/', 'www.example.com/en/') then 'allow' when m.rule is not null then 'block'
    when coalesce(al.block, false) and not coalesce(al.allow, false) then 'block' else 'allow' end verdict
from u join m on m.url = u.url left join aliases al on al.address = m.address and m.host <> ''
"""

_OP12 = r"""
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') u, sha256('7:' || doc_id) x from documents),
h as (select *, len(u) n, ('0x' || x[1:8])::bigint h1, ('0x' || x[9:16])::bigint h2, ('0x' || x[17:24])::bigint h3, ('0x' || x[25:32])::bigint h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) i, greatest(h1 % (n + 1), h2 % (n + 1)) j,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end form from h),
p as (select *, array_to_string(u[1:i], '') a, array_to_string(u[i + 1:j], '') m, array_to_string(u[j + 1:], '') z from c)
select doc_id, n, form, case when form <> 'plain' then length(a) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || z || '<M>' || m else '<S>' || z || '<P>' || a || '<M>' || m end) output_sha256, sha256(t) restored_sha256 from p
"""

_OP13 = """
with t as (select conv_id c, row_number() over (partition by conv_id order by turn nulls first) p, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') k, length(coalesce(text, '')) n
    from conversations where conv_id is not null),
ids as (select distinct c, list_transform(range(1, length(c::varchar) + 1), lambda i: ascii(substr(c::varchar, i::int, 1))) bytes from t),
h as (select c, (4294967295 - list_reduce(list_prepend(4294967295::bigint, bytes), lambda x, y:
    list_reduce(list_prepend(xor(x, y::bigint), range(8)), lambda v, i: xor(v // 2, (v % 2) * 3988292384)))) % 6 h from ids),
r as (select c, p, k, n from t join h using (c) where p > h union all select h.c, t.p, t.k, t.n from h join t on t.c = h.c - h.c % 100 where t.p <= h.h),
l as (select h.c, coalesce(list(md5(k) order by p) filter (where k is not null), []) ks, coalesce(list(n order by p) filter (where k is not null), []) ns from h left join r using (c) group by h.c),
d as (select *, unnest(range(0, len(ks) + 1)) d from l),
x as (select c, d, md5(array_to_string(ks[1:d], ',')) node, md5(array_to_string(ks[1:d - 1], ',')) parent, case when d > 0 then ns[d] else 0 end n, d = len(ks) is_end from d),
nodes as (select node, d depth, min(c) conv_id, min(parent) parent, count(*) n_convs, min(n) n, coalesce(string_agg(c::varchar, ',' order by c) filter (where is_end), '') ends from x group by node, d),
kids as (select parent, depth - 1 depth, count(*) n_children from nodes where depth > 0 group by 1, 2),
below as (select distinct a.node, a.d, b.node other, b.d other_d from x a join x b on a.c = b.c and b.d >= a.d),
sums as (select below.node, below.d depth, sum((k.n_children is null)::int) n_leaves, sum((m.n_convs - 1) * m.n) saved from below join nodes m on m.node = below.other and m.depth = below.other_d
    left join kids k on k.parent = m.node and k.depth = m.depth group by 1, 2)
select n.conv_id, n.depth, u.conv_id parent_conv_id, n.n_convs, coalesce(k.n_children, 0) n_children, s.n_leaves::bigint n_leaves, s.saved::bigint saved_tokens, sha256(n.ends) ends_sha256
from nodes n join sums s on s.node = n.node and s.depth = n.depth left join kids k on k.parent = n.node and k.depth = n.depth left join nodes u on n.depth > 0 and u.node = n.parent and u.depth = n.depth - 1
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; tests hold the others against plain versions."""
    return {"op1_topk": _OP1, "op7_chat": _OP7, "op10_urlfilter": _OP10, "op12_infill": _OP12, "op13_prefixes": _OP13}
