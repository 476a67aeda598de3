"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.llm import alignment, bpe, chat, counts, covertree, fingerprints, lines, mixing, neardup, quality, spelling, substring, toxicity
from pliego.llm.common import table

BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def ranks() -> tuple[bytes, str]:
    """The content of the default rank file and its pattern, read where the driver runs."""
    import public_tokenizers

    with open(public_tokenizers.path(BPE_FILE), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by turn are messages; rows of one turn are taken in order of role and text."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    # copies of a row within one turn are messages of their own
    counted = rows.unionByName(extra).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").cast("int").alias("n"))
    each = counted.select("*", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    events = each.select("conv_id", F.lit(0).alias("seq"), F.lit("message").alias("kind"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), "text", "copy").alias("turn"), "role", "text")
    return chat.digest(chat.read_back(chat.render(chat.fold(events))))


OP1_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<') body,
         replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '<', '\<'), ':', '\:') head from t
)
select conv_id, count(*) n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) loss_sha256,
       cast(sum(4 + length(head) + 2 + length(body) + 8) as bigint) formatted_chars
from e group by conv_id
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) size,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint place
  from documents
), s as (
  select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 i from d group by source
), w as (
  select *, [5, 2, 1][i % 3 + 1]::double weight from s
), r as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(2.0::double * source_size) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) lvl
  from w window before as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)
), c as (
  select *, lvl * weight >= 2.0 * source_size capped from r
), g as (
  select source, source_size, case when capped then 2.0 * source_size else max(lvl) filter (where not capped) over () * weight end target from c
), p as (
  select g.*, case when source_size > 0 then floor(target / source_size)::bigint else 0 end copies from g
), h as (
  select d.*, p.source_size, p.target, p.copies, p.target - p.copies * p.source_size budget,
         sum(size) over (partition by d.source order by place) upto, sum(size) over (partition by d.source, place) own
  from d join p on d.source is not distinct from p.source
)
select doc_id, size, source_size, target,
       size * (copies + case when upto <= budget or (upto - own <= budget and 2 * (budget - (upto - own)) > own) then 1 else 0 end)::bigint taken
from h
"""


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, pattern = ranks()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string"))
    both = bpe.decode(bpe.encode(docs, data, pattern).drop("text"), data)
    return both.select("doc_id", F.expr("cast(octet_length(token_ids) div 4 as long)").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=5, percent=85)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with three edits: words put in near a third of the text, a stretch in the middle deleted, and one near its end replaced."""
    data, pattern = ranks()
    size = F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    edits = [(size / 3, 0, " edited twice, "), (size / 2, 23, ""), (size - size / 10, 11, "don't stop")]
    made = F.array(*[F.struct(at.cast("int").alias("start"), F.lit(n).alias("length"), F.lit(x).alias("insert")) for at, n, x in edits])
    return counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text", made.alias("edits")), data, pattern)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"), width=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = r"""
with d as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents
), g as (
  select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) h from (select doc_id, w, unnest(range(1, len(w) - 48)) i from d)
), m as (
  select h, min(doc_id) first from g group by h
), gone as (
  select distinct doc_id, unnest(range(i, i + 50)) i from g join m using (h) where first < doc_id
), n as (
  select doc_id, count(*) n_removed from gone group by doc_id
), kept as (
  select t.doc_id, string_agg(t.x, ' ' order by t.i) text
  from (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) i from d) t anti join gone on t.doc_id = gone.doc_id and t.i = gone.i group by t.doc_id
)
select d.doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept.text, '')) kept_sha256
from d left join n using (doc_id) left join kept using (doc_id)
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed (lines with a word, of any size) and the hash of the text that is left."""
    found = lines.remove_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=80, least=1)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied = quality.apply(table(spark, sf_dir, "documents"))
    return applied.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ALIGNED_FILES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizers() -> tuple[Callable, bytes, Callable, bytes]:
    """The two tokenizers that are aligned and their files, read where the driver runs."""
    import public_tokenizers

    files = [Path(public_tokenizers.path(name)).read_bytes() for name in ALIGNED_FILES]
    return partial(alignment.byte_level, pattern=public_tokenizers.PATTERN), files[0], alignment.pieces, files[1]


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, first_file, second, second_file = tokenizers()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    aligned = alignment.align(docs, first, first_file, second, second_file)
    digests = aligned.select("doc_id", "a_ids", "b_ids", "n_groups", "n_links", F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
    sizes = [np.array([len(t) for t in make(data).texts], np.int64) for make, data in ((first, first_file), (second, second_file))]
    counted = alignment.with_counts(alignment.stored(digests), *sizes)
    n_a, n_b = (F.expr(f"cast(octet_length({c}) div 2 as long)").alias(n) for c, n in (("a_ids", "n_a"), ("b_ids", "n_b")))
    return counted.select("doc_id", n_a, n_b, "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_mixing, op3_byte_bpe, op4_near_duplicates, op5_token_counts, op6_substring_dedup, op7_line_dedup, op8_embedding_near_duplicates, op9_toxicity, op10_quality_rules, op11_alignment, op12_fingerprints, op13_spelling_variants)}

def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def near_copy_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the earliest near copy that they inherit from, by whole texts."""
    return neardup.inherit(table(spark, sf_dir, "documents"), width=5, percent=85)


QUERIES["pipeline"] = pipeline
QUERIES["near_copy_inherit"] = near_copy_inherit
ORACLE_SQL = {"op1_chat_formatting": OP1_SQL, "op2_mixing": OP2_SQL, "op6_substring_dedup": OP6_SQL}
