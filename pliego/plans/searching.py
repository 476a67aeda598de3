"""The search for investments by code or name: candidates from the rarest words, filters, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pliego.functions import similarity
from pliego.operators import search
from pliego.plans.base import query


def _catalogue(t):
    """Names of investments: a document's segment, place and number, put together from customers."""
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    stretch = F.concat(F.lit("(TRAMO"), F.expr("c_custkey div 40"), F.lit(","))
    name = F.concat_ws(" ", F.concat("c_mktsegment", F.lit(",")), F.replace("n_name", F.lit("_"), F.lit("")), "r_name", stretch, F.concat(F.lit("LOTE"), F.col("c_custkey") % 97, F.lit(").")), F.concat(F.lit("N"), F.col("c_custkey") % 7))
    return joined.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") + 2_000_000).cast("string").alias("code"), name.alias("name"), F.col("r_name").alias("place"))


def _asked(t):
    """Every fiftieth investment's name without its segment, some as a code, some with a place."""
    rows = _catalogue(t).where("id % 50 = 0")
    words = F.split("name", " ")
    return rows.select(F.col("id").alias("q"), F.when(F.col("id") % 150 == 0, F.col("code")).otherwise(F.array_join(F.slice(words, 2, 9), " ")).alias("text"), F.when(F.col("id") % 100 == 0, F.lower("place")).alias("place"))


SEARCHED = """k as (select c_custkey id, (c_custkey + 2000000)::varchar code, c_mktsegment || ', ' || replace(n_name, '_', '') || ' ' || r_name || ' (TRAMO' || c_custkey // 40 || ', LOTE' || c_custkey % 97 || '). N' || c_custkey % 7 "name", r_name place from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
q as (select id q, case when id % 150 = 0 then code else "name"[length(split_part("name", ' ', 1)) + 2:] end "text", case when id % 100 = 0 then lower(place) end place from k where id % 50 = 0),
w as (select id, unnest(list_distinct(regexp_extract_all("name", '[A-Z0-9]{3,}'))) w from k), p as (select w, count(*) n from w group by 1),
t as (select q, w, n, row_number() over (partition by q order by n, w) o from (select q, unnest(list_distinct(regexp_extract_all("text", '[A-Z0-9]{3,}'))) w from q) join p using (w)),
u as (select q, id, min(o) o from t join w using (w) where o <= 6 and n <= 200 group by 1, 2), c as (select q, o, sum(count(*)) over (partition by q order by o) - count(*) before from u group by 1, 2)"""


@query(f"""with {SEARCHED} select u.q, u.id, u.o::bigint token from u join c on u.q = c.q and u.o = c.o where before <= 150""")
def search_candidates(t):
    """Candidates of each name from its six rarest words, without words of over 200 places, until there are over 150."""
    return search.candidates(_asked(t).select("q", "text"), _catalogue(t).select("id", "name"), "q", "id", places=200, enough=150)


@query(f"""with {SEARCHED} select q, id, true as exact_ from q join k on q."text" = k.code where q.place is null or contains(lower(k.place), q.place)""")
def search_by_code(t):
    """Queries that are the code of an investment; a filter on places still holds."""
    return search.by_code(_asked(t), _catalogue(t), "q", "id", "code", ["place"]).select("q", "id", F.lit(True).alias("exact_"))


@query("""with k as (select p_partkey id, (p_partkey * 2)::varchar code, case when p_partkey % 9 > 0 then (p_partkey * 3)::varchar else '' end snip, p_brand brand from part),
q as (select l_orderkey, l_linenumber, (l_partkey + l_suppkey)::varchar "text" from lineitem)
select l_orderkey, l_linenumber, id from q join k on "text" = code union all
select l_orderkey, l_linenumber, id from q join k on "text" = snip where "text" not in (select code from k)""")
def search_by_either_code(t):
    """Numbers that are the code of a part, or, where no part has such a code, a part's second code."""
    k = F.col("p_partkey")
    parts = t("part").select(k.alias("id"), (k * 2).cast("string").alias("code"), F.when(k % 9 > 0, (k * 3).cast("string")).otherwise("").alias("snip"))
    asked = t("lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("q"), (F.col("l_partkey") + F.col("l_suppkey")).cast("string").alias("text"))
    return search.by_code(asked, parts, "q", "id", "code", [], "snip").select("q.l_orderkey", "q.l_linenumber", "id")


@query()
def investment_search(t):
    """The whole search: the code, else the ten best names with a score of 60 or more, among many more before filters."""
    return search.search(_asked(t), _catalogue(t), "q", "id", "code", ["place"], limit=10, score=similarity.token_set_of)
