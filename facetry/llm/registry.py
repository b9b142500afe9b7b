"""The thin queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from facetry.llm.chat import OP7_SQL, op7_chat_formatting
from facetry.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from facetry.llm.ngram_join import OP9_SQL, op9_ngram_join
from facetry.llm.piece_codec import op2_token_counts, op8_sentencepiece
from facetry.llm.language_id import op4_language_id
from facetry.llm.lm_scoring import op1_lm_scoring
from facetry.llm.media import op5_media_columns
from facetry.llm.mixing import OP6_SQL, op6_mixing
from facetry.llm.toxicity import op3_toxicity

QUERIES = {"op1_lm_scoring": op1_lm_scoring, "op2_token_counts": op2_token_counts, "op3_toxicity": op3_toxicity, "op4_language_id": op4_language_id, "op5_media_columns": op5_media_columns, "op7_chat_formatting": op7_chat_formatting, "op8_sentencepiece": op8_sentencepiece, "op6_mixing": op6_mixing, "op9_ngram_join": op9_ngram_join, "op10_exact_dedup": op10_exact_dedup}
ORACLES = {"op7_chat_formatting": OP7_SQL, "op6_mixing": OP6_SQL, "op9_ngram_join": OP9_SQL, "op10_exact_dedup": OP10_SQL}
