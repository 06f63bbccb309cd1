"""The queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .block_naming import exact_duplicates
from .bm25_decontam import contaminated
from .common import documents, table
from .covering_simhash import hex_digits, near_duplicates
from .dac_tokens import token_ids
from .filter_audit import audit
from .flac_media import features, to_flac
from .kk_sharding import shard
from .license_scan import licences
from .merkle_manifest import folded, manifest, siblings, tampered
from .skip_chain_pii import personal_data
from .subword_quality import KEEP, held_out, score
from .suffix_dedup import remove_repeats
from .vector_packing import pack


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_bm25_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def op7_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


def op8_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(to_flac(documents(spark, sf_dir)))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = manifest(documents(spark, sf_dir), claimed=tampered())
    found = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings("path"), 256).alias("proof_sha256"), folded("path", "claimed").alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op13_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_skip_chain_pii": op2_skip_chain_pii,
    "op3_vector_packing": op3_vector_packing,
    "op4_kk_sharding": op4_kk_sharding,
    "op5_bm25_decontam": op5_bm25_decontam,
    "op6_subword_quality": op6_subword_quality,
    "op7_covering_simhash": op7_covering_simhash,
    "op8_dac_tokens": op8_dac_tokens,
    "op9_flac_media": op9_flac_media,
    "op10_license_scan": op10_license_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_filter_audit": op12_filter_audit,
    "op13_block_naming": op13_block_naming,
}

SQL: dict[str, str] = {
    "op11_merkle_manifest": """
        with recursive
        -- CRC-32 by its bits, over the digits of the id.
        rows as (
            select *, row_number() over () as row, case when doc_id is null then 1 else xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
                       lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) end as crc
            from documents),
        fields as (
            select row, lang, doc_id, coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as front,
                   n_chars, n_chars::hugeint + (crc % 7 = 0)::int as claimed_chars, coalesce(strlen(text) || ':' || text, '-') as back
            from rows),
        leaves as (
            select row, lang, doc_id, sha256(front || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') || back) as leaf,
                   sha256(front || coalesce(strlen(claimed_chars::varchar) || ':' || claimed_chars::varchar, '-') || back) as claimed
            from fields),
        -- Each lang has the number of its place among langs, nulls first.
        places as (select lang, row_number() over (order by encode(lang) nulls first) - 1 as place, n from (select lang, count(*) as n from leaves group by lang)),
        placed as (
            select leaves.*, place, n, row_number() over (partition by place order by leaves.doc_id nulls first, leaf) - 1 as idx
            from leaves join places on leaves.lang is not distinct from places.lang),
        nodes as (
            select 0 as level, place, n, idx, leaf as node from placed
            union all
            select level + 1, place, (n + 1) // 2, idx // 2, sha256(string_agg(node, '' order by idx)) from nodes where n > 1 group by level, place, n, idx // 2),
        subroots as (select place, node as subroot from nodes where n = 1),
        tops as (
            select 0 as level, (select count(*) from subroots) as n, place as idx, subroot as node from subroots
            union all
            select level + 1, (n + 1) // 2, idx // 2, sha256(string_agg(node, '' order by idx)) from tops where n > 1 group by level, n, idx // 2),
        lower_steps as (
            select p.row, s.level, p.idx >> s.level as idx, o.node as other
            from placed p join (select distinct place, level from nodes where n > 1) s on p.place = s.place
            left join nodes o on o.place = p.place and o.level = s.level and o.idx = xor(p.idx >> s.level, 1)),
        upper_steps as (
            select p.row, 1000 + s.level as level, p.place >> s.level as idx, o.node as other
            from placed p, (select distinct level from tops where n > 1) s left join tops o on o.level = s.level and o.idx = xor(p.place >> s.level, 1)),
        steps as (select *, row_number() over (partition by row order by level) as step from (select * from lower_steps union all select * from upper_steps)),
        proofs as (select row, string_agg(coalesce(other, ''), '' order by step) as others from steps group by row),
        folds as (
            select row, 0::bigint as step, claimed as node from placed
            union all
            select f.row, s.step, sha256(case when s.idx % 2 = 1 then s.other || f.node else f.node || coalesce(s.other, '') end) from folds f join steps s on s.row = f.row and s.step = f.step + 1),
        ends as (select row, arg_max(node, step) as folded_root from folds group by row),
        root as (select node as root from tops where n = 1)
        select p.doc_id, p.leaf, subroot, root, sha256(coalesce(others, '')) as proof_sha256, folded_root, folded_root = root as verified
        from placed p join subroots using (place) join ends using (row) left join proofs using (row), root
    """,
    "op12_filter_audit": r"""
        with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
        counted as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first_id from texts),
        marks as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
        flags as (
            select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, len(words) < 100 as a, 100 * len(list_distinct(words)) < 80 * len(words) as b,
                   100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d, coalesce(counted.doc_id > first_id, false) as e
            from counted left join marks on counted.doc_id = marks.doc_id),
        masks as (select part, good, toxic, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as mask from flags),
        letters as (select chr(65 + i::int) as letter, (1 << i)::int as bit from range(5) r(i)),
        orders as (
            select p.letter || q.letter || r.letter || s.letter || t.letter as filter_order from letters p, letters q, letters r, letters s, letters t
            where p.bit + q.bit + r.bit + s.bit + t.bit = 31 and (p.bit | q.bit | r.bit | s.bit | t.bit) = 31),
        steps as (
            select filter_order, step::int as step, bit, coalesce((select sum(l.bit) from letters l where instr(filter_order, l.letter) < step), 0)::int as before
            from orders, range(1, 6) r(step), letters where letter = substr(filter_order, step::int, 1)),
        cells as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from masks group by part, mask),
        counts as (
            select part, filter_order, step, bit, coalesce(sum(n) filter (mask & (before | bit) = 0), 0)::bigint as kept, coalesce(sum(n) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as removed,
                   coalesce(sum(n) filter (mask & bit <> 0 and mask & before <> 0), 0)::bigint as redundant, coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
                   coalesce(sum(good) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as good_lost, coalesce(sum(toxic) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as toxic_lost
            from cells, steps group by part, filter_order, step, bit, before)
        select * exclude (bit), (sum(removed) over (partition by part, bit))::bigint as shapley from counts
    """,
    "op13_block_naming": """
        with t as (select row_number() over () as row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents)
        select doc_id, first_value(doc_id) over g as keep_id, count(*) over (partition by text) as group_size, row = first_value(row) over g as kept, sha256(text) as text_sha256
        from t window g as (partition by text order by doc_id desc nulls last, row)
    """,
}
