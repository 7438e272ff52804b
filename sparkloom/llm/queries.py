"""The registered queries of this package and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op9_nearest_neighbours
from .filter_audit import OP11_SQL, op11_filter_audit
from .html_text import op8_html_extraction
from .jaccard_join import OP12_SQL, op12_jaccard_join
from .language_id import op5_language_id
from .language_model import op7_lm_scoring
from .lexical_search import OP13_SQL, op13_ranked_search
from .mixing import OP10_SQL, op10_source_mixing
from .packing import op4_packing
from .quality import op6_quality_rules
from .simhash import op3_simhash_near_dedup
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_packing": op4_packing,
    "op5_language_id": op5_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_html_extraction": op8_html_extraction,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_source_mixing": op10_source_mixing,
    "op11_filter_audit": op11_filter_audit,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op10_source_mixing": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_jaccard_join": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
