"""Registered queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import (
    byte_dedup,
    cover_tree,
    decontamination,
    fill_in_middle,
    language_id,
    merkle,
    quality,
    secret_scan,
    simhash,
    substring_dedup,
    token_counts,
    wavelet,
    word_table,
)
from tagweave.llm.common import importable

VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontamination.contamination(found)


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = cover_tree.embedding_links(_table(spark, sf_dir, "embeddings"))
    return links.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return counted.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(secret_scan.scan_secrets(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = word_table.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _removed() -> Column:
    """Units in the ranges ``[start, end, ...]`` of ``removed``."""
    return F.expr("aggregate(transform(removed, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")


def op7_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = byte_dedup.remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id",
        "n_bytes",
        _removed().alias("n_removed"),
        (F.size("removed") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", _removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document, by a checksum of its id, is presented with another text than the one in the manifest."""
    docs = _table(spark, sf_dir, "documents")
    text = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    others = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaf = merkle.row_digest([*others, F.col("text")])
    rows = docs.select(
        "doc_id", "source", leaf.alias("leaf"), F.when(tampered, merkle.row_digest([*others, text])).otherwise(leaf).alias("presented")
    )
    proofs = merkle.manifest(rows, "source", "doc_id", "leaf", carry=["presented"])
    proofs = proofs.withColumn("folded_root", merkle.folded("presented"))
    return proofs.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest().alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return wavelet.checksums(wavelet.token_files(docs, public_tokenizers.path(BYTE_VOCABULARY)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    return examples.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_cover_tree": op2_cover_tree,
        "op3_token_counts": op3_token_counts,
        "op4_secret_scan": op4_secret_scan,
        "op5_quality": op5_quality,
        "op6_word_table": op6_word_table,
        "op7_byte_dedup": op7_byte_dedup,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_simhash": op9_simhash,
        "op10_language": op10_language,
        "op11_merkle": op11_merkle,
        "op12_wavelet": op12_wavelet,
        "op13_fill_in_middle": op13_fill_in_middle,
        "pipeline": pipeline,
    }


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

_OP1 = f"""
with dw as materialized (
  select doc_id, coalesce({_WORDS}, []) w from documents
), bw as materialized (
  select cast(item_id as varchar) item, {_WORDS} w from benchmark
), win as materialized (
  select distinct item, least(len(w), 10) n, array_to_string(w[i:i + 9], ' ') win
  from (select item, w, unnest(range(1, greatest(2, len(w) - 8))) i from bw where len(w) > 0)
), sizes as (select distinct n from win
), hit as materialized (
  select d.doc_id, d.i, win.item, win.n from (
    select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') win
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from dw, sizes where len(w) >= n)
  ) d join win using (n, win)
), words as (
  select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by doc_id
), items as (
  select doc_id, count(*) n_items, string_agg(item, ',' order by item) s
  from (select distinct doc_id, item from hit) group by doc_id
)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join words using (doc_id) left join items using (doc_id)
"""


_OP2 = """
with recursive v as materialized (
  select vec_id, label, embedding::double[] e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), link as materialized (
  select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) as (
  select vec_id, vec_id from embeddings union select reach.a, link.b from reach join link on link.a = reach.b
), least as (select a, min(b) component_id from reach group by a)
select vec_id, coalesce(n, 0) n_links, component_id, component_id = vec_id kept
from embeddings join least on a = vec_id left join (select a, count(*) n from link group by a) n on n.a = vec_id
"""


#: Repeated windows that overlap or touch become one removed run, what lies between runs is kept.
_RUNS = """
, marked as (
  select doc_id, s, s - lag(s) over (partition by doc_id order by s) > {length} is not false fresh from again
), numbered as (
  select doc_id, s, sum(fresh::int) over (partition by doc_id order by s rows unbounded preceding) g from marked
), run as materialized (
  select doc_id, min(s) a, max(s) + {length} b from numbered group by doc_id, g
), gap as (
  select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) from_ from run
)
"""

_OP7 = (
    """
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) h from documents
), part as (
  select doc_id, b, substr(h, 2000 * b + 1, 2198) p
  from (select doc_id, h, unnest(range(0, (len(h) // 2 + 999) // 1000)) b from d)
), win as (
  select doc_id, 1000 * b + s s, hash(substr(p, 2 * s + 1, 200)) w
  from (select doc_id, b, p, unnest(range(0, least(1000, len(p) // 2 - 99))) s from part where len(p) >= 200)
), again as materialized (
  select doc_id, s from (select doc_id, s, row_number() over (partition by w order by doc_id, s) k from win) where k > 1
)"""
    + _RUNS.format(length=100)
    + """
, piece as (
  select doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' order by a) head, max(b) b,
         sum(b - a) n_removed, count(*) n_spans
  from gap join d using (doc_id) group by doc_id
)
select doc_id, cast(len(h) // 2 as bigint) n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, coalesce(n_spans, 0) n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(b, 0) + 1))) kept_sha256
from d left join piece using (doc_id)
"""
)

_OP8 = (
    """
with d as materialized (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents
), win as (
  select doc_id, s, hash(array_to_string(w[s + 1:s + 35], ' ')) v
  from (select doc_id, w, unnest(range(0, len(w) - 34)) s from d where len(w) >= 35)
), again as materialized (
  select doc_id, s from (select doc_id, s, count(*) over (partition by v) k from win) where k > 1
)"""
    + _RUNS.format(length=35)
    + """
, piece as (
  select doc_id, flatten(list(w[from_ + 1:a] order by a)) head, max(b) b, sum(b - a) n_removed
  from gap join d using (doc_id) group by doc_id
)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_removed, 0) as bigint) n_removed,
       sha256(coalesce(array_to_string(list_concat(coalesce(head, []), w[coalesce(b, 0) + 1:]), ' '), '')) kept_sha256
from d left join piece using (doc_id)
"""
)


_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"


def _leaf_sql(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return f"sha256({' || '.join(_FIELD.format(field) for field in fields)})"


def _tree_sql(name: str, base: str, starts: str) -> str:
    """All nodes over ``base`` (tree, place, digest, n), and the digests that the ``starts`` (r, tree, place, digest) lead to level by level."""
    return f"""
, {name} as materialized (
  with recursive up(tree, level, place, digest, n) as (
    select tree, 0, place, digest, n from {base}
    union all
    select tree, level + 1, place // 16, sha256(string_agg(digest, '' order by place)), count(*) over (partition by tree)
    from up where n > 1 group by tree, level, place // 16
  ) select * from up
), {name}_fold as materialized (
  with recursive fold(r, tree, level, place, digest) as (
    select r, tree, 0, place, digest from {starts}
    union all
    select f.r, f.tree, f.level + 1, f.place // 16,
           sha256(string_agg(case when u.place = f.place then f.digest else u.digest end, '' order by u.place))
    from fold f join {name} u on u.tree = f.tree and u.level = f.level and u.place // 16 = f.place // 16 and u.n > 1
    group by f.r, f.tree, f.level, f.place
  ) select * from fold
), {name}_end as materialized (
  select r, arg_max(digest, level) digest from {name}_fold group by r
), {name}_proof as materialized (
  select f.r, string_agg(u.digest, '' order by u.level, u.place) siblings
  from {name}_fold f join {name} u on u.tree = f.tree and u.level = f.level and u.place // 16 = f.place // 16 and u.place <> f.place
  group by f.r
)"""


#: The checksum of the decimal id, bit by bit: each digit is followed by seven empty steps.
_STEP = "xor(xor(crc, x) >> 1, 3988292384::ubigint * (xor(crc, x) & 1))"
_CRC32 = f"""xor(4294967295::ubigint, list_reduce(
    flatten(list_transform(split(doc_id::varchar, ''), lambda c: [ascii(c)::ubigint, 0, 0, 0, 0, 0, 0, 0])),
    lambda crc, x: {_STEP}, 4294967295::ubigint))"""

_OP11 = (
    f"""
with doc as materialized (
  select row_number() over () r, doc_id, dense_rank() over (order by source nulls first) tree, {_leaf_sql('text')} leaf,
         case when {_CRC32} % 5 = 0 then {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end other
  from documents
), placed as materialized (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 place, count(*) over (partition by tree) n,
         coalesce(other, leaf) presented from doc
)"""
    + _tree_sql(
        "low",
        "(select tree, place, leaf digest, n from placed)",
        "(select r, tree, place, presented digest from placed)",
    )
    + """
, sub as materialized (select tree, digest, count(*) over () n from low where n = 1
)"""
    + _tree_sql(
        "high",
        "(select 0 tree, tree - 1 place, digest, n from sub)",
        "(select r, 0 tree, tree - 1 place, low_end.digest from placed join low_end using (r))",
    )
    + """
select doc_id, leaf, sub.digest subroot, root.digest root,
       sha256(coalesce(a.siblings, '') || coalesce(b.siblings, '')) proof_sha256, high_end.digest folded_root,
       high_end.digest = root.digest verified
from placed join sub using (tree) join high_end using (r) left join low_proof a using (r) left join high_proof b using (r),
     (select digest from high where n = 1) root
"""
)

_OP13 = """
with d as (
  select doc_id, coalesce(text, '') t, length(coalesce(text, '')) n, sha256('1:' || coalesce(doc_id::varchar, '')) s from documents
), h as (
  select doc_id, t, n, ('0x' || s[1:8])::bigint % (n + 1) h1, ('0x' || s[9:16])::bigint % (n + 1) h2,
         ('0x' || s[17:24])::bigint % 100 h3, ('0x' || s[25:32])::bigint % 100 h4
  from d
), f as (
  select doc_id, t, n, least(h1, h2) a, greatest(h1, h2) b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 90 then 'plain'
              when h4 < 20 then 'spm' else 'psm' end form
  from h
), p as (
  select doc_id, t, n, form, a, b - a m, substring(t, 1, a) pre, substring(t, a + 1, b - a) mid, substring(t, b + 1) suf from f
)
select doc_id, n::bigint n, form, case when form <> 'plain' then a end::bigint prefix_chars,
       case when form <> 'plain' then m end::bigint middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
              else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256,
       sha256(case form when 'plain' then t else pre || mid || suf end) restored_sha256
from p
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": _OP1,
        "op2_cover_tree": _OP2,
        "op7_byte_dedup": _OP7,
        "op8_substring_dedup": _OP8,
        "op11_merkle": _OP11,
        "op13_fill_in_middle": _OP13,
    }
