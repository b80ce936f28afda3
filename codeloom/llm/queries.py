"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from codeloom.llm import bpe, ctw, decontam, divergence, drake, fingerprint, gracededup, html, langid, neardup, pii, urlfilter, warc


def queries() -> dict:
    """name -> (spark, sf_dir) -> DataFrame."""
    return {
        "op1_warc": warc.op1_warc,
        "op2_ngram_join": neardup.op2_ngram_join,
        "op3_html_text": html.op3_html_text,
        "op4_fingerprint": fingerprint.op4_fingerprint,
        "op5_bpe": bpe.op5_bpe,
        "op6_pii": pii.op6_pii,
        "op7_language_id": langid.op7_language_id,
        "op8_url_filter": urlfilter.op8_url_filter,
        "op9_lm_score": ctw.op9_lm_score,
        "op10_decontaminate": decontam.op10_decontaminate,
        "op11_exact_dedup": gracededup.op11_exact_dedup,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_centroid_clusters": drake.op13_centroid_clusters,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {
        "op8_url_filter": urlfilter.OP8_SQL,
        "op11_exact_dedup": gracededup.OP11_SQL,
        "op12_source_divergence": divergence.OP12_SQL,
        "op13_centroid_clusters": drake.OP13_SQL,
    }
