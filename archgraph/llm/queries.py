"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fill_middle, html_extract, line_dedup, packing, prefix_trie, quality, simhash, spm_stream, token_counts, token_output, trie_bpe, url_filter
from ._common import shared_path, table


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measure(table(spark, sf_dir, "documents"))
    return quality.rate(measured, quality.fit_measured(measured, table(spark, sf_dir, "labels")))


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"))


def op6_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokens_round(table(spark, sf_dir, "documents"))


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of its own for each run: what is measured is the encoding, not what an earlier run left.
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), shared_path(spark, "token-counts"))


def op10_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_stream.encode_documents(table(spark, sf_dir, "documents"))


def op11_lookaround_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op12_owned_suffix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_main_text, op2_quality_forest, op3_simhash_golay, op4_exact_dedup, op5_line_edit_join, op6_simple8b_tokens,
        op7_url_reputation, op8_hilbert_packing, op9_token_counts, op10_streaming_viterbi, op11_lookaround_fim, op12_owned_suffix_trie, op13_trie_bpe,
    )
}

ORACLE_SQL = {
    "op4_exact_dedup": """
        with t as (
            select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
            from documents)
        select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
            doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
        from t""",
    "op7_url_reputation": url_filter.oracle_sql(),
    "op11_lookaround_fim": fill_middle.oracle_sql(),
    "op12_owned_suffix_trie": prefix_trie.oracle_sql(),
}
