"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import bpe, brown, decontaminate, divergence, filter_audit, line_dedup, minhash, pieces, pii, quality, substring_dedup, suffix_dedup, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_warc": warc.op2_warc,
    "op3_minhash": minhash.op3_minhash,
    "op4_pii": pii.op4_pii,
    "op5_brown": brown.op5_brown,
    "op6_bpe": bpe.op6_bpe,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_quality": quality.op10_quality,
    "op11_divergence": divergence.op11_divergence,
    "op12_sentencepiece": pieces.op12_sentencepiece,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
SQL = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op3_minhash": minhash.OP3_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op8_suffix_dedup": suffix_dedup.OP8_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op10_quality": quality.OP10_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
