"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import op1_mix, op2_toxicity, op3_jaccard, op4_bpe, op5_dedup, op6_quality, op7_pii, op8_secrets, op9_language, op10_repeats, op11_spelling, op12_decontamination, op13_exponion

QUERIES = {
    "op1_mix": op1_mix.op1_mix,
    "op2_toxicity": op2_toxicity.op2_toxicity,
    "op3_jaccard_join": op3_jaccard.op3_jaccard_join,
    "op4_bpe": op4_bpe.op4_bpe,
    "op5_exact_dedup": op5_dedup.op5_exact_dedup,
    "op6_quality_rules": op6_quality.op6_quality_rules,
    "op7_pii": op7_pii.op7_pii,
    "op8_secrets": op8_secrets.op8_secrets,
    "op9_language": op9_language.op9_language,
    "op10_repeats": op10_repeats.op10_repeats,
    "op11_spelling": op11_spelling.op11_spelling,
    "op12_decontamination": op12_decontamination.op12_decontamination,
    "op13_exponion": op13_exponion.op13_exponion,
}
ORACLES = {
    "op3_jaccard_join": op3_jaccard.ORACLE,
    "op5_exact_dedup": op5_dedup.ORACLE,
    "op11_spelling": op11_spelling.ORACLE,
    "op12_decontamination": op12_decontamination.ORACLE,
    "op13_exponion": op13_exponion.ORACLE,
}
