"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from inkspan.llm.alignment import op12_token_alignment
from inkspan.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from inkspan.llm.langid import op9_language_id
from inkspan.llm.line_dedup import op10_line_dedup
from inkspan.llm.manifest import OP13_SQL, op13_merkle_manifest
from inkspan.llm.mixing import OP3_SQL, op3_mix_sources
from inkspan.llm.neural_lm import op11_neural_lm
from inkspan.llm.ngram_join import OP1_SQL, op1_ngram_jaccard_join
from inkspan.llm.packing import op5_pack_sequences
from inkspan.llm.pii import op8_personal_data
from inkspan.llm.quality_model import op7_quality_model
from inkspan.llm.quality_rules import OP6_SQL, op6_quality_rules
from inkspan.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_toxicity": op4_toxicity,
    "op5_pack_sequences": op5_pack_sequences,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_model": op7_quality_model,
    "op8_personal_data": op8_personal_data,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
    "op11_neural_lm": op11_neural_lm,
    "op12_token_alignment": op12_token_alignment,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op2_exact_dedup": OP2_SQL,
    "op3_mix_sources": OP3_SQL,
    "op6_quality_rules": OP6_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
