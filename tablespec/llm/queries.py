"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablespec.llm import quality_rules
from tablespec.llm import mixing
from tablespec.llm import jaccard
from tablespec.llm import secrets
from tablespec.llm import language
from tablespec.llm import quality_model
from tablespec.llm import topk
from tablespec.llm import edit_sketch
from tablespec.llm import pitman_yor
from tablespec.llm import html_text
from tablespec.llm import prefix_trie
from tablespec.llm.alignment import op11_token_alignment
from tablespec.llm.packing import op8_packing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op2_mixing": mixing.op2_mixing,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op9_language_id": language.op9_language_id,
    "op3_quality_classifier": quality_model.op3_quality_classifier,
    "op1_topk_search": topk.op1_topk_search,
    "op4_lm_scoring": pitman_yor.op4_lm_scoring,
    "op7_html_extraction": html_text.op7_html_extraction,
    "op8_packing": op8_packing,
    "op11_token_alignment": op11_token_alignment,
    "op12_edit_fingerprints": edit_sketch.op12_edit_fingerprints,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op1_topk_search": topk.ORACLE,
    "op5_secret_scan": secrets.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
