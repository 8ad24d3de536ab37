"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP8_SQL, op8_chat_formatting
from .cws import op3_document_fingerprints
from .gam import op6_quality_classifier
from .hnsw import op10_approximate_nearest_neighbours
from .mixing import OP9_SQL, op9_mixing_sources
from .packing import op2_packing
from .secrets import OP1_SQL, op1_secret_scans
from .simhash import op4_simhash_near_dedup
from .token_counts import op5_token_counts
from .toxicity import op7_toxicity

OPERATORS = (
    op1_secret_scans, op2_packing, op3_document_fingerprints, op4_simhash_near_dedup, op5_token_counts,
    op6_quality_classifier, op7_toxicity, op8_chat_formatting, op9_mixing_sources, op10_approximate_nearest_neighbours,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scans": OP1_SQL, "op8_chat_formatting": OP8_SQL, "op9_mixing_sources": OP9_SQL}
