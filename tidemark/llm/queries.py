"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bestfit, decontaminate, html, licenses, lm_score, neardup, negatives, packing, pii, quality, sharding, tokens, trie
from tidemark.llm.common import table, tuned


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the perplexity verdict of every document."""
    docs = table(tuned(spark), sf_dir, "documents")
    return quality.quality_rules(docs, columns=["doc_id", "lang"])


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or inherited.

    A document is the file source/lang/block/id, 64 ids to a block.  One that opens or closes with a
    licence line is a licence file: of source/lang below 100 words, of its block below 400.
    """
    docs = table(tuned(spark), sf_dir, "documents")
    lines = F.split(F.trim("text"), "\n")
    noted = F.coalesce(lines[0].rlike(licenses.CUE) | F.element_at(lines, -1).rlike(licenses.CUE), F.lit(False))
    words = F.size(F.split(F.trim("text"), r"\s+"))
    home = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")))
    block = F.concat_ws("/", home, F.expr("doc_id div 64").cast("string"))
    path = (F.when(noted & (words < 100), F.concat(home, F.lit("/LICENSE."), F.col("doc_id")))
            .when(noted & (words < 400), F.concat(block, F.lit("/LICENSE."), F.col("doc_id")))
            .otherwise(F.concat(block, F.lit("/"), F.col("doc_id"))))
    return licenses.scan_licenses(docs.withColumn("path", path), columns=["doc_id", "path"])


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal bytes."""
    docs = table(tuned(spark), sf_dir, "documents")
    return sharding.shard_documents(docs, columns=["doc_id"]).withColumn("doc_id", F.col("doc_id").cast("long"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens packed into sequences of 1024."""
    docs = table(tuned(spark), sf_dir, "documents")
    return packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract_text(table(tuned(spark), sf_dir, "pages"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    docs = table(tuned(spark), sf_dir, "documents")
    return neardup.near_duplicates(docs, columns=["doc_id"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    tuned(spark)
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of the training documents."""
    return lm_score.score_documents(table(tuned(spark), sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(tuned(spark), sf_dir, "documents")
    return pii.find_personal_data(docs, columns=["doc_id"])


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    docs = table(tuned(spark), sf_dir, "documents")
    return tokens.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in few sequences of 1024, only longer documents cut."""
    docs = table(tuned(spark), sf_dir, "documents")
    pieces = bestfit.pack_best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, with a seventh of the labels moved."""
    vectors = table(tuned(spark), sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.expr("vec_id % 100 = 0"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_license_scan, op3_sharding, op4_packing, op5_html_text, op6_near_duplicates, op7_decontamination,
    op8_lm_scores, op9_personal_data, op10_token_counts, op11_best_fit_packing,
    op12_prefix_trie, op13_hard_negatives)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op7_decontamination": f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, w, least(10, len(w)) as n from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
windows as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as win
    from (select *, unnest(generate_series(1, len(w) - n + 1)) as i from b)),
sizes as (select distinct n from b),
runs as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win
    from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, sizes where len(w) >= n)),
hits as (select doc_id, i, n, item_id from runs join windows using (n, win)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
    from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)""",
    "op12_prefix_trie": """
with crc_table as (select list(c order by i) as entries from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select cast(range as bigint) as i from range(256)))),
turns as (select conv_id, size, sym, row_number() over (partition by conv_id order by turn nulls first, sym) as pos
    from (select conv_id, turn, strlen(coalesce(text, '')) as size,
        md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as sym from conversations where conv_id is not null)),
convs as (select conv_id, conv_id - conv_id % 5 as base, n, xor(list_reduce(list_prepend(4294967295, list_transform(
        string_split(cast(conv_id as varchar), ''), lambda d: cast(ascii(d) as bigint))), lambda c, d: xor(c >> 8, entries[(xor(c, d) & 255) + 1])), 4294967295) % 9 as h
    from (select conv_id, count(*) as n from turns group by conv_id), crc_table),
rebuilt as (select c.conv_id, t.pos as depth, sym, size from convs c join turns t on t.conv_id = c.base and t.pos <= c.h
    union all
    select c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), sym, size from convs c join turns t on t.conv_id = c.conv_id and t.pos > c.h
        left join convs b on b.conv_id = c.base),
steps as (select conv_id, 0 as depth, '' as path, 0 as size from convs
    union all
    select conv_id, depth, string_agg(sym, '') over (partition by conv_id order by depth), size from rebuilt),
ends as (select path, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as digest
    from (select conv_id, max_by(path, depth) as path from steps group by conv_id) group by path),
nodes as (select path, depth, min(conv_id) as conv_id, count(*) as n_convs, max(size) as size from steps group by path, depth),
children as (select left(path, 32 * (depth - 1)) as path, count(*) as n_children from nodes where depth > 0 group by 1),
valued as (select n.*, coalesce(n_children, 0) as n_children, coalesce(digest, sha256('')) as ends_sha256
    from nodes n left join children using (path) left join ends using (path)),
below as (select u.path, sum(case when v.n_children = 0 then 1 else 0 end) as n_leaves, sum((v.n_convs - 1) * v.size) as saved_tokens
    from valued u join valued v on starts_with(v.path, u.path) group by u.path)
select v.conv_id, cast(v.depth as bigint) as depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children,
    cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, v.ends_sha256
from valued v join below using (path) left join nodes p on v.depth > 0 and p.path = left(v.path, 32 * (v.depth - 1))""",
    "op13_hard_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
    from embeddings where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as alike, cast(list_inner_product(a.q, b.q) as bigint) as score
    from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scored where alike
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
    vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not alike and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 10""",
}
