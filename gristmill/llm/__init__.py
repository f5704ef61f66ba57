"""Operators of a training-data pipeline, one module each; nothing outside this subpackage imports it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op1_bpe
from .mixing import op6_mixing
from .nearest import op9_nearest
from .ngram_join import op10_ngram_join
from .oracles import ORACLE_SQL
from .quality_classifier import op3_quality_classifier
from .quality_rules import op7_quality_rules
from .runs import op13_runs
from .secret_scans import op8_secret_scans
from .spelling import op12_spelling
from .suffix_dedup import op5_suffix_dedup
from .token_planes import op4_token_planes
from .url_filters import op2_url_filters
from .vector_dedup import op11_vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_url_filters, op3_quality_classifier, op4_token_planes, op5_suffix_dedup, op6_mixing, op7_quality_rules, op8_secret_scans, op9_nearest, op10_ngram_join, op11_vector_dedup, op12_spelling, op13_runs)}

__all__ = ["ORACLE_SQL", "QUERIES"]
