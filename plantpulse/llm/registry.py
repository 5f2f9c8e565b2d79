"""The corpus operators' queries and their DuckDB statements."""

from __future__ import annotations

from plantpulse.llm.bpe import op4_bpe
from plantpulse.llm.centroid_clustering import OP11_SQL, op11_centroid_clustering
from plantpulse.llm.conversation_repair import op12_conversation_repair
from plantpulse.llm.fingerprints import op9_fingerprints
from plantpulse.llm.language_id import op1_language_id
from plantpulse.llm.line_dedup import op2_line_dedup
from plantpulse.llm.minhash import OP5_SQL, op5_minhash
from plantpulse.llm.packing import op7_packing
from plantpulse.llm.quality_classifier import op8_quality_classifier
from plantpulse.llm.quality_rules import OP6_SQL, op6_quality_rules
from plantpulse.llm.token_counts import op10_token_counts
from plantpulse.llm.toxicity import op13_toxicity
from plantpulse.llm.url_filters import OP3_SQL, op3_url_filters

QUERIES = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_url_filters, op4_bpe, op5_minhash, op6_quality_rules,
                                   op7_packing, op8_quality_classifier, op9_fingerprints, op10_token_counts,
                                   op11_centroid_clustering, op12_conversation_repair, op13_toxicity)}
ORACLE_SQL = {"op3_url_filters": OP3_SQL, "op5_minhash": OP5_SQL, "op6_quality_rules": OP6_SQL,
              "op11_centroid_clustering": OP11_SQL}
