"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from . import (
    op1_license_scan,
    op2_toxicity,
    op3_ann,
    op4_near_dedup,
    op5_pii,
    op6_packing,
    op7_decontamination,
    op8_substring_dedup,
    op9_language_id,
    op10_token_counts,
    op11_hard_negatives,
    op12_mixing,
    op13_alignment,
)
from .common import held_out_bucket, ship_package, staged, table


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the folder is a parameter (TOKENIZERS_DIR)."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_matches(spark, d):
    return op1_license_scan.scan(table(spark, d, "documents").select("doc_id", "text"))


def op2_toxicity_scores(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels").select("doc_id", "toxic")
    held = held_out_bucket("doc_id", 4) == 2
    model = op2_toxicity.fit(docs.where(~held), labels.where(~held))
    return op2_toxicity.predict(op2_toxicity.score(docs, model)).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_nearest_neighbours(spark, d):
    found = op3_ann.nearest(table(spark, d, "embeddings").select("vec_id", "embedding"), lambda i: F.pmod(i, F.lit(50)) == 0, 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_near_duplicates(spark, d):
    return op4_near_dedup.near_duplicates(table(spark, d, "documents").select("doc_id", "text"), words=2)


def op5_pii_pseudonyms(spark, d):
    docs = op5_pii.pseudonymize(table(spark, d, "documents"), op5_pii.secret_key(spark), count_col="n_replaced")
    return docs.select("doc_id", "text", "n_replaced")


def op6_packing_query(spark, d):
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        source = f.read()
    return op6_packing.pack_documents(table(spark, d, "documents").select("doc_id", "text"), source)


def op7_decontamination_query(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return op7_decontamination.decontaminate(docs, table(spark, d, "benchmark").select("item_id", "text")).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_repeated_passages(spark, d):
    return op8_substring_dedup.repeated_passages(table(spark, d, "documents").select("doc_id", "text"))


def op9_language_id_query(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    held = held_out_bucket("doc_id", 3) == 1
    model = op9_language_id.fit(docs.where(~held))
    return op9_language_id.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_token_counts_query(spark, d):
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        source = f.read()
    return op10_token_counts.count_tokens(table(spark, d, "documents").select("doc_id", "text"), source)


def op11_hard_negatives_query(spark, d):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.floor(x.cast("double") * 256)))
    rows = table(spark, d, "embeddings").select("vec_id", label.alias("label"), whole.alias("vector"))
    return op11_hard_negatives.hard_negatives(rows, lambda i: i % 100 == 0)


def op12_mixing_query(spark, d):
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    docs = staged(table(spark, d, "documents").select("doc_id", "source", F.coalesce(words, F.lit(0)).cast("bigint").alias("size")), "sized")
    sizes = op12_mixing.ranked_sources(docs.groupBy("source").agg(F.sum("size").alias("size")))
    targets = staged(op12_mixing.weighted_targets(staged(sizes.withColumn("weight", F.col("rank") % 3 + 1), "weights")), "targets")
    mixed, _ = op12_mixing.mix(docs.withColumn("sources", F.array("source")), targets)
    own = targets.select(F.col("source").alias("name"), F.col("size").alias("source_size"), "target")
    return mixed.join(own, F.col("sources")[0].eqNullSafe(F.col("name"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op13_alignment_query(spark, d):
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f, open(tokenizer_path("piece_bpe_32k.model"), "rb") as g:
        source, model = f.read(), g.read()
    return op13_alignment.align(table(spark, d, "documents").select("doc_id", "text"), source, model)


_OWN = {
    "op1_license_scan": op1_license_matches,
    "op2_toxicity": op2_toxicity_scores,
    "op3_ann": op3_nearest_neighbours,
    "op4_near_dedup": op4_near_duplicates,
    "op5_pii": op5_pii_pseudonyms,
    "op6_packing": op6_packing_query,
    "op7_decontamination": op7_decontamination_query,
    "op8_substring_dedup": op8_repeated_passages,
    "op9_language_id": op9_language_id_query,
    "op10_token_counts": op10_token_counts_query,
    "op11_hard_negatives": op11_hard_negatives_query,
    "op12_mixing": op12_mixing_query,
    "op13_alignment": op13_alignment_query,
}



def _query(fn):
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES = {name: _query(fn) for name, fn in _OWN.items()}

ORACLE: dict[str, str] = {
    "op11_hard_negatives": """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   list_transform(embedding, lambda x: floor(256 * x::double)) as q
            from embeddings
            where vec_id is not null and label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select a.vec_id as anchor_id, v.vec_id, a.label = v.label as same, list_dot_product(a.q, v.q)::bigint as score
            from v as a join v on a.vec_id <> v.vec_id where a.vec_id % 100 = 0),
        positives as (
            select anchor_id, vec_id as positive_id, score as positive_score from s where same
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id)::int as rank,
               s.vec_id as negative_id, positive_score, s.score as negative_score
        from positives join s using (anchor_id)
        where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
        qualify rank <= 5""",
    "op7_decontamination": r"""
        with low as (
            select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        docs as (
            select doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from low),
        items as (
            select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from benchmark),
        windows as (
            select distinct item_id, least(10, len(w)) as n, array_to_string(w[q:q + least(10, len(w)) - 1], ' ') as phrase
            from items, unnest(range(1, greatest(1, len(w) - 9) + 1)) as u(q) where len(w) > 0),
        sizes as (select distinct n from windows),
        spots as (
            select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as phrase
            from docs, sizes, unnest(range(1, len(w) - n + 2)) as u(p)),
        found as (select doc_id, item_id, p, n from spots join windows using (n, phrase)),
        covered as (select doc_id, count(distinct p + k) as n_hit from found, unnest(range(0, n)) as u(k) group by doc_id),
        named as (
            select doc_id, count(distinct item_id) as n_items, sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) as h
            from found group by doc_id)
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               coalesce(h, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from docs left join covered using (doc_id) left join named using (doc_id)""",
}
