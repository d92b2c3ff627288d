"""Queries of this subpackage and their DuckDB counterparts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op10_byte_bpe
from .chat import OP5_SQL, op5_chat_windows
from .decontaminate import OP2_SQL, op2_benchmark_decontamination
from .licenses import OP3_SQL, op3_license_scan
from .near_dedup import op1_minhash_near_dedup
from .quality import OP4_SQL, op4_host_quality
from .repair import op8_repair_shards
from .secrets import op6_secret_scan
from .toxicity import op9_toxicity
from .warc import op7_warc_normalise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_host_quality": op4_host_quality,
    "op5_chat_windows": op5_chat_windows,
    "op6_secret_scan": op6_secret_scan,
    "op7_warc_normalise": op7_warc_normalise,
    "op8_repair_shards": op8_repair_shards,
    "op9_toxicity": op9_toxicity,
    "op10_byte_bpe": op10_byte_bpe,
}
ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": OP2_SQL,
    "op3_license_scan": OP3_SQL,
    "op4_host_quality": OP4_SQL,
    "op5_chat_windows": OP5_SQL,
}
