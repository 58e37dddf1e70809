"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .align import op13_token_alignment
from .ann import op5_vantage_point_ann
from .chat import OP4_SQL, op4_chat_format
from .codebooks import OP11_SQL, op11_dictionary_codes
from .ctw import op7_context_tree_weighting
from .decontam import op2_greedy_tiling
from .line_dedup import op1_fuzzy_line_dedup
from .packing import op9_cost_packing
from .quality import op8_quality_classifier
from .secrets import op12_secret_layers
from .simhash import op3_simhash_near_dedup
from .token_counts import op10_token_counts
from .token_files import op6_token_files


def queries() -> dict:
    return {
        "op1_fuzzy_line_dedup": op1_fuzzy_line_dedup,
        "op2_greedy_tiling": op2_greedy_tiling,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_chat_format": op4_chat_format,
        "op5_vantage_point_ann": op5_vantage_point_ann,
        "op6_token_files": op6_token_files,
        "op7_context_tree_weighting": op7_context_tree_weighting,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_cost_packing": op9_cost_packing,
        "op10_token_counts": op10_token_counts,
        "op11_dictionary_codes": op11_dictionary_codes,
        "op12_secret_layers": op12_secret_layers,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": OP4_SQL, "op11_dictionary_codes": OP11_SQL}
