"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from codeloom.llm import chat_formatting
from codeloom.llm.bpe_codec import op9_bpe_codec
from codeloom.llm.chat_formatting import op6_chat_formatting
from codeloom.llm.embedding_dedup import op3_embedding_dedup
from codeloom.llm.lm_scoring import op10_lm_scoring
from codeloom.llm.packing import op1_packing
from codeloom.llm.quality_rules import op4_quality_rules
from codeloom.llm.simhash_dedup import op7_simhash_dedup
from codeloom.llm.token_counts import op8_token_counts
from codeloom.llm.toxicity import op2_toxicity
from codeloom.llm.url_filters import op5_url_filters

QUERIES: dict[str, Callable] = {f.__name__: f for f in (op1_packing, op2_toxicity, op3_embedding_dedup, op4_quality_rules, op5_url_filters, op6_chat_formatting, op7_simhash_dedup, op8_token_counts, op9_bpe_codec, op10_lm_scoring)}
ORACLES: dict[str, str] = {"op6_chat_formatting": chat_formatting.SQL}
