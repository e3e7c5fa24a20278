"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, language, lines, logbilinear, mixing, packing, quality, rules, simhash, spans, suffixes, trie, variants
from .common import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens packed into as few sequences as the pattern fit finds."""
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumn("piece", F.col("piece").cast("int"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles, linked at 3 or fewer differing bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 50-byte strings that start in an earlier one."""
    found = suffixes.deduplicated(_table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Target shares of the languages; sources share their language's part by size.
MIX_WEIGHTS = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as there are, drawn to the target shares of languages in at most four epochs."""
    picked = mixing.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return picked.select("doc_id", F.col("_domain").alias("domain"), "lang", "source", F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all documents under the model of those outside fold 0 of 10."""
    docs = _table(spark, sf_dir, "documents")
    scored = logbilinear.score(docs, *logbilinear.learn(docs.where(fold("doc_id", 10) != 0)))
    return scored.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels outside fold 0 of 5."""
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 or more among all vectors, and their components."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.95)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics of all documents and the verdict of the rules learned from the labels."""
    found = rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents, learned outside fold 2 of 4."""
    docs = _table(spark, sf_dir, "documents")
    labelled = docs.where(fold("doc_id", 4) != 2).select("doc_id", "text", "lang")
    model = language.train(labelled, public_tokenizers.path("piece_bpe_32k.model"))
    return language.identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document when later copies of runs of sentences of 16 words or more go."""
    cut = spans.without_repeated_spans(_table(spark, sf_dir, "documents"), run=None)
    return cut.select(
        "doc_id",
        F.col("_sentences").alias("n_sentences"),
        F.col("_removed").alias("n_removed"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes_kept"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of conversations, rebuilt with the first turns of the first conversation of their hundred."""
    rows = trie.with_borrowed_heads(trie.turns(_table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(rows).drop("node")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 7 letters or more that stand twice or more, some less a letter, with the form ten times as frequent that they vary."""
    found = variants.grouped(_table(spark, sf_dir, "documents"), least_chars=7, least_n=2, times=10, drop_one_in=31)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines of 40 code points or more that stand in 5 documents or more, but in the last of these."""
    left = lines.without_common_lines(_table(spark, sf_dir, "documents"), least_chars=40, least_docs=5)
    return left.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


QUERIES = {
    f.__name__: f for f in (
        op1_best_fit_packing, op2_simhash_near_dedup, op3_suffix_array_dedup, op4_source_mixing, op5_lm_scoring, op6_quality_classifier, op7_embedding_near_dedup, op8_quality_rules, op9_language_id, op10_substring_dedup,
        op11_prefix_trie, op12_spelling_variants, op13_line_dedup,
    )
}
def _crc32(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of the UTF-8 bytes of a text."""
    return f"""xor(4294967295, list_reduce(
      list_prepend(4294967295::bigint, list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))))"""


ORACLES = {
    "op11_prefix_trie": f"""
with turns as (
  select conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as key, length(coalesce(text, '')) as n,
    row_number() over (partition by conv_id order by turn nulls first) - 1 as pos
  from conversations
), convs as (
  select conv_id, conv_id - conv_id % 100 as base, {_crc32("conv_id::varchar")} % 6 as h from (select distinct conv_id from conversations)
), joined as (
  select c.conv_id, 0 as own, t.pos, t.key, t.n from convs c join turns t on t.conv_id = c.base and t.pos < c.h
  union all select c.conv_id, 1, t.pos, t.key, t.n from convs c join turns t on t.conv_id = c.conv_id and t.pos >= c.h
), placed as (
  select conv_id, n, row_number() over w as depth, string_agg(key, '') over w as path from joined window w as (partition by conv_id order by own, pos)
), member as (
  select conv_id, depth, path, left(path, 32 * (depth - 1)) as parent, n from placed union all select conv_id, 0, '', null, 0 from convs
), last as (
  select conv_id, max_by(path, depth) as path from member group by conv_id
), node as (
  select path, any_value(parent) as parent, any_value(depth) as depth, any_value(n) as n, min(conv_id) as conv_id, count(*) as n_convs from member group by path
), ends as (
  select path, string_agg(conv_id::varchar, ',' order by conv_id) as ids from last group by path
), children as (
  select parent as path, count(*) as k from node where parent is not null group by parent
), below as (
  select a.path, sum((d.n_convs - 1) * d.n) as saved, count(*) filter (where c.k is null) as leaves
  from node a join node d on starts_with(d.path, a.path) left join children c on c.path = d.path group by a.path
)
select v.conv_id, v.depth::bigint as depth, p.conv_id as parent_conv_id, v.n_convs, coalesce(c.k, 0) as n_children, b.leaves as n_leaves,
  b.saved::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from node v left join node p on p.path = v.parent left join children c on c.path = v.path join below b on b.path = v.path left join ends e on e.path = v.path
""",
    "op12_spelling_variants": f"""
with recursive runs as (
  select doc_id, run, count(*) as n from (
    select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00c0-\u00ff]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents
  ) where length(run) >= 7 group by all
), hashed as (
  select run, n, {_crc32("(doc_id || ':' || run)")} as h from runs
), word as (
  select word, sum(n)::bigint as n from (
    select n, case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed
  ) where length(word) >= 7 group by word having sum(n) >= 2
), place as (
  select word, n, unnest(range(1, length(word) + 1)) as i from word
), less as (
  select word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) as masked, substr(word, 1, i - 1) || substr(word, i + 1) as cut from place
), near as (
  select a.word, b.word as other, b.n as other_n from less a join less b on a.masked = b.masked and a.word <> b.word
  union select c.word, w.word, w.n from less c join word w on c.cut = w.word
  union select w.word, c.word, c.n from less c join word w on c.cut = w.word
), best as (
  select word, count(*) as n_near, min({{'less': -other_n, 'other': other}}) as first from near group by word
), form as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when -b.first.less >= 10 * w.n then b.first.other end as form,
    case when -b.first.less >= 10 * w.n then -b.first.less end as form_n
  from word w left join best b on b.word = w.word
), follow as (
  select word, word as root, form as onward from form union all select f.word, f.onward, g.form from follow f join form g on g.word = f.onward
)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from form f join (select word, root from follow where onward is null) r on r.word = f.word
""",
    "op13_line_dedup": """
with lines as (
  select doc_id, unnest(l) as line, unnest(range(len(l))) as pos
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), common as (
  select key, max(doc_id) as last from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), judged as (
  select k.doc_id, k.line, k.pos, c.last is not null and k.doc_id <> c.last as gone from keyed k left join common c on k.key = c.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
""",
}
