"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kbflow.llm import host_quality, line_dedup, metric_tree, url_rules
from kbflow.llm.byte_bpe import op6_byte_bpe
from kbflow.llm.packing import op7_packing
from kbflow.llm.secrets import op2_secret_scan
from kbflow.llm.simhash_dedup import op1_simhash_dedup
from kbflow.llm.token_files import op5_token_files
from kbflow.llm.toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_host_quality": host_quality.op3_host_quality,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_token_files": op5_token_files,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_packing": op7_packing,
    "op8_url_rules": url_rules.op8_url_rules,
    "op9_toxicity": op9_toxicity,
    "op10_metric_tree": metric_tree.op10_metric_tree,
}
SQL: dict[str, str] = {
    "op3_host_quality": host_quality.SQL,
    "op8_url_rules": url_rules.SQL,
    "op10_metric_tree": metric_tree.SQL,
}
