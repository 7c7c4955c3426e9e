"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from tessera.llm.bpe import op2_byte_bpe
from tessera.llm.decontam import op3_decontaminate
from tessera.llm.embedding import op5_embedding
from tessera.llm.langid import op8_language
from tessera.llm.line_dedup import OP1_SQL, op1_line_dedup
from tessera.llm.pii import op10_pii
from tessera.llm.pst import op9_suffix_tree_lm
from tessera.llm.quality import op6_quality
from tessera.llm.simhash import op4_simhash
from tessera.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_decontaminate": op3_decontaminate,
    "op4_simhash": op4_simhash,
    "op5_embedding": op5_embedding,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_language": op8_language,
    "op9_suffix_tree_lm": op9_suffix_tree_lm,
    "op10_pii": op10_pii,
}

ORACLE_SQL = {"op1_line_dedup": OP1_SQL}
