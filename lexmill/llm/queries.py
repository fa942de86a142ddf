"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from . import bpe, decision_list, decontaminate, html_density, line_dedup, prob_minhash, quality_classifier, substring_dedup, suffix_dedup, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_warc": warc.op2_warc,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_html_density": html_density.op6_html_density,
    "op7_prob_minhash": prob_minhash.op7_prob_minhash,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_quality_rules": decision_list.op10_quality_rules,
}

SQL = {**warc.SQL, **line_dedup.SQL}
