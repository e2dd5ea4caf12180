"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from quire.llm import alignment, ball_tree, bpe_codec, exact_dedup, html_text, license_scan, line_dedup, packing, quality, simhash, source_audit, token_counts, url_filter


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_html_text": html_text.op2_html_text,
        "op3_simhash": simhash.op3_simhash,
        "op4_license_scan": license_scan.op4_license_scan,
        "op5_quality": quality.op5_quality,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_topk_search": ball_tree.op7_topk_search,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_bpe_codec": bpe_codec.op10_bpe_codec,
        "op11_alignment": alignment.op11_alignment,
        "op12_line_dedup": line_dedup.op12_line_dedup,
        "op13_source_audit": source_audit.op13_source_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": exact_dedup.OP6_SQL, "op7_topk_search": ball_tree.OP7_SQL, "op8_url_filter": url_filter.OP8_SQL, "op12_line_dedup": line_dedup.OP12_SQL, "op13_source_audit": source_audit.OP13_SQL}
