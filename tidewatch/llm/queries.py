"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tidewatch.llm import op10_tool_calls, op11_licences, op12_prefix_trie, op13_hard_negatives, op1_decontamination, op2_minhash, op3_language, op4_html, op5_toxicity, op6_mixing, op7_language_model, op8_suffix, op9_embedding

QUERIES = {
    "op10_tool_calls": op10_tool_calls.query,
    "op11_licences": op11_licences.query,
    "op12_prefix_trie": op12_prefix_trie.query,
    "op13_hard_negatives": op13_hard_negatives.query,
    "op1_decontamination": op1_decontamination.query,
    "op2_minhash": op2_minhash.query,
    "op3_language": op3_language.query,
    "op4_html": op4_html.query,
    "op5_toxicity": op5_toxicity.query,
    "op6_mixing": op6_mixing.query,
    "op7_language_model": op7_language_model.query,
    "op8_suffix": op8_suffix.query,
    "op9_embedding": op9_embedding.query,
}
ORACLE = {
    "op6_mixing": op6_mixing.ORACLE,
    "op10_tool_calls": op10_tool_calls.ORACLE,
    "op12_prefix_trie": op12_prefix_trie.ORACLE,
    "op13_hard_negatives": op13_hard_negatives.ORACLE,
}
