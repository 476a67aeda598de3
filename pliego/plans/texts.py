"""Queries on texts: normalising, searching, reading numbers and resolving names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pliego.functions import similarity, text
from pliego.plans.base import query

#: Words of names that say nothing about them.
STOP = ("THE", "AND", "FOR")


@query("""select doc_id, md5(upper(trim(regexp_replace(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g')))) norm_md5 from documents""")
def text_norm(t):
    return t("documents").select("doc_id", F.md5(text.norm(F.col("text"))).alias("norm_md5"))


@query("""select doc_id from documents where contains(lower(strip_accents(text)), 'mentre')""")
def accent_search(t):
    return t("documents").where(text.contains_folded(F.col("text"), "mentré")).select("doc_id")


@query("""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) body from pages""")
def html_text(t):
    return t("pages").select("page_id", text.html_text(F.col("html")).alias("body"))


@query("""with n as (select page_id, unnest(list_distinct([x::bigint for x in regexp_extract_all(html, '\\d+') if length(x) between 3 and 6])) number from pages)
select number, count(*) n_pages from n where number is not null group by 1""")
def regex_numbers(t):
    found = t("pages").select("page_id", F.explode(text.numbers(F.col("html"))).alias("number"))
    return found.groupBy("number").agg(F.count("*").alias("n_pages"))


@query("""select event_id, (props::json->>'k')::bigint k, coalesce((props::json->>'missing')::bigint, -1) missing from events""")
def json_path(t):
    path = lambda p: F.get_json_object("props", p).cast("long")
    return t("events").select("event_id", path("$.k").alias("k"), F.coalesce(path("$.missing"), F.lit(-1)).alias("missing"))


@query("""with p as (select p_name, min(p_partkey) id from part group by 1), k as (select id, p_name, unnest(list_distinct([x for x in regexp_extract_all(upper(p_name), '[A-Z0-9]+') if length(x) > 2 and x not in ('THE', 'AND', 'FOR')])) w from p),
c as (select w, count(*) f from k group by 1), s as (select a.id q, b.id candidate, count(*) hits, sum(1000 // f) rarity from k a join k b using (w) join c using (w) where a.id <> b.id group by 1, 2),
r as (select *, row_number() over (partition by q order by hits desc, rarity desc, candidate) rank_ from s)
select q, candidate, hits, rarity::bigint rarity, rank_ from r where rank_ <= 3""")
def token_topk(t):
    """Names by the words that they share: distinct names only, so a name's copies don't multiply pairs."""
    names = t("part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    words = names.select("id", F.explode(text.tokens(F.col("p_name"), STOP)).alias("w"))
    known = words.groupBy("w").agg(F.count("*").alias("f"))
    pairs = words.join(known, "w").select(F.col("id").alias("q"), "w", "f").join(words.select(F.col("id").alias("candidate"), "w"), "w").where("q <> candidate")
    sums = pairs.groupBy("q", "candidate").agg(F.count("*").alias("hits"), F.sum(F.expr("1000 div f")).alias("rarity"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("hits"), F.desc("rarity"), "candidate"))
    return sums.withColumn("rank_", rank.cast("long")).where("rank_ <= 3").select("q", "candidate", "hits", "rarity", "rank_")


@query()
def fuzzy_topk(t):
    """Best other name by token set ratio, among those with a word in common."""
    names = t("part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    words = names.select("id", "p_name", F.explode(text.tokens(F.col("p_name"), STOP)).alias("w"))
    pairs = words.alias("a").join(words.alias("b"), "w").where("a.id <> b.id").select(F.col("a.id").alias("q"), F.col("a.p_name").alias("x"), F.col("b.id").alias("candidate"), F.col("b.p_name").alias("y")).distinct()
    scored = pairs.withColumn("score", similarity.token_set_of("x", "y"))
    return scored.groupBy("q").agg(F.max_by(F.struct("candidate", "score"), F.struct("score", -F.col("candidate"))).alias("m")).select("q", "m.candidate", "m.score")


@query("""with d as (select doc_id, regexp_replace(lower(left(text, 60)), '\\s+', ' ', 'g') k from documents)
select doc_id, min(doc_id) over (partition by k) inherits_from, row_number() over (partition by k order by doc_id) - 1 position_ from d""")
def dedup_inherit(t):
    key = F.regexp_replace(F.lower(F.substring("text", 1, 60)), r"\s+", " ")
    w = Window.partitionBy("k")
    rows = t("documents").select("doc_id", key.alias("k"))
    return rows.select("doc_id", F.min("doc_id").over(w).alias("inherits_from"), (F.row_number().over(w.orderBy("doc_id")) - 1).cast("long").alias("position_"))


@query("""with p as (select p_partkey, p_size, p_retailprice::decimal(18,2) a, p_size % 7 d from part)
select p_partkey, cast(a as varchar) amount_text, a::decimal(18,2) amount, (select list(x) from range(p_size, p_size + d + 1) r(x)) pages from p""")
def amounts_and_pages(t):
    size = F.col("p_size")
    rows = t("part").select("p_partkey", F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("amount_text"), F.concat(size.cast("string"), F.lit("-"), (size + size % 7).cast("string")).alias("folio"))
    return rows.select("p_partkey", "amount_text", text.locale_amount(F.col("amount_text")).alias("amount"), F.transform(text.page_list(F.col("folio")), lambda x: x.cast("long")).alias("pages"))


@query("""select doc_id, sha256(text) fingerprint, sha256(lang || '|' || source) context from documents""")
def fingerprints(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"), F.sha2(F.concat_ws("|", "lang", "source"), 256).alias("context"))


@query("""with v as (select c_custkey, case c_custkey % 5 when 0 then 'Sí cumple' when 1 then 'No cumple' when 2 then 'Por verificar: no consta' when 3 then '' end s from customer)
select c_custkey, case c_custkey % 5 when 0 then 'si' when 1 then 'no' when 2 then 'pend' end verdict from v""")
def verdict_text(t):
    said = F.element_at(F.array(*map(F.lit, ["Sí cumple", "No cumple", "Por verificar: no consta", "", None])), (F.col("c_custkey") % 5 + 1).cast("int"))
    return t("customer").select("c_custkey", text.verdict(said).alias("verdict"))


@query("""with m as (select o_custkey n, o_orderkey % 4 m, max(o_totalprice) v from orders group by 1, 2) select n, m, v from m where m <> 3""")
def map_unpack(t):
    """A map with keys `n:m` (and `prof:n`, left out) back to columns."""
    key = F.when(F.col("o_orderkey") % 4 == 3, F.concat(F.lit("prof:"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(":"), (F.col("o_orderkey") % 4).cast("string")))
    each = t("orders").groupBy("o_custkey", key.alias("k")).agg(F.max("o_totalprice").alias("v"))
    maps = each.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    parts = F.split("key", ":")
    return maps.select(F.explode("m").alias("key", "v")).where(~F.col("key").startswith("prof:")).select(parts[0].cast("long").alias("n"), parts[1].cast("long").alias("m"), "v")
