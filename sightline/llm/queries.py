"""Queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .additive_search import op10_additive_search
from .language_id import op6_language_id
from .license_scan import OP4_SQL, op4_license_scan
from .ngram_join import op1_ngram_join
from .packing import op2_packing
from .quality_crf import op5_quality_crf
from .quality_rules import op8_quality_rules
from .sentence_pieces import op7_sentence_pieces
from .token_counts import op9_token_counts
from .training_order import op3_training_order

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_packing": op2_packing,
    "op3_training_order": op3_training_order,
    "op4_license_scan": op4_license_scan,
    "op5_quality_crf": op5_quality_crf,
    "op6_language_id": op6_language_id,
    "op7_sentence_pieces": op7_sentence_pieces,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_counts": op9_token_counts,
    "op10_additive_search": op10_additive_search,
}
ORACLE_SQL: dict[str, str] = {"op4_license_scan": OP4_SQL}
