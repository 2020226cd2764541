"""Queries over the driver's tables: op<N>_<name> -> callable(spark, sf_dir)."""

from __future__ import annotations

from .q_decontaminate import OP2_SQL, op2_benchmark_leaks
from .q_importance import op5_importance_resampling
from .q_licenses import OP7_SQL, op7_license_tfidf
from .q_lines import OP8_SQL, op8_site_spread
from .q_mixing import op6_entropy_mix
from .q_near_dedup import op9_odd_sketch_dedup
from .q_quality import OP1_SQL, op1_line_rules
from .q_tokens import op4_token_file
from .q_toxicity import op10_string_kernel_toxicity
from .q_urls import OP3_SQL, op3_host_reputation

QUERIES = {"op1_line_rules": op1_line_rules, "op2_benchmark_leaks": op2_benchmark_leaks, "op3_host_reputation": op3_host_reputation, "op4_token_file": op4_token_file, "op5_importance_resampling": op5_importance_resampling, "op6_entropy_mix": op6_entropy_mix, "op7_license_tfidf": op7_license_tfidf, "op8_site_spread": op8_site_spread, "op9_odd_sketch_dedup": op9_odd_sketch_dedup, "op10_string_kernel_toxicity": op10_string_kernel_toxicity}
ORACLE_SQL: dict[str, str] = {"op1_line_rules": OP1_SQL, "op2_benchmark_leaks": OP2_SQL, "op3_host_reputation": OP3_SQL, "op7_license_tfidf": OP7_SQL, "op8_site_spread": OP8_SQL}
