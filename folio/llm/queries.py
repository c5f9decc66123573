"""The queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import op1_quality, op2_substring, op3_minhash, op4_bpe, op5_html, op6_suffix_tree, op7_decontaminate, op8_toxicity, op9_repair, op10_langid, op11_token_counts, op12_manifest, op13_filter_audit


def queries() -> dict:
    return {
        "op1_quality": op1_quality.query,
        "op2_substring": op2_substring.query,
        "op3_minhash": op3_minhash.query,
        "op4_bpe": op4_bpe.query,
        "op5_html": op5_html.query,
        "op6_suffix_tree": op6_suffix_tree.query,
        "op7_decontaminate": op7_decontaminate.query,
        "op8_toxicity": op8_toxicity.query,
        "op9_repair": op9_repair.query,
        "op10_langid": op10_langid.query,
        "op11_token_counts": op11_token_counts.query,
        "op12_manifest": op12_manifest.query,
        "op13_filter_audit": op13_filter_audit.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality": op1_quality.SQL,
        "op3_minhash": op3_minhash.SQL,
        "op7_decontaminate": op7_decontaminate.SQL,
        "op12_manifest": op12_manifest.SQL,
        "op13_filter_audit": op13_filter_audit.SQL,
    }
