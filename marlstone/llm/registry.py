"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.decontamination import op7_decontamination
from marlstone.llm.html_extraction import op2_html_extraction
from marlstone.llm.near_dedup import op8_near_dedup
from marlstone.llm.nearest import op3_nearest_neighbours
from marlstone.llm.oracle import SQL
from marlstone.llm.packing import op1_best_fit_packing
from marlstone.llm.prefix_trie import op12_prefix_trie
from marlstone.llm.quality import op11_quality_classifier
from marlstone.llm.ranked_search import op13_ranked_search
from marlstone.llm.secrets import op6_secret_scan
from marlstone.llm.substring_dedup import op10_substring_dedup
from marlstone.llm.token_counts import op9_token_histogram
from marlstone.llm.toxicity import op4_toxicity
from marlstone.llm.url_filter import op5_url_filter

OPERATORS = (
    op1_best_fit_packing, op2_html_extraction, op3_nearest_neighbours, op4_toxicity, op5_url_filter, op6_secret_scan, op7_decontamination,
    op8_near_dedup, op9_token_histogram, op10_substring_dedup, op11_quality_classifier, op12_prefix_trie, op13_ranked_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
