"""Queries of this package, by name, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm.decontaminate import op9_template_decontamination
from loomspan.llm.extraction import op4_template_extraction
from loomspan.llm.neardup import op3_hyperminhash_near_dedup
from loomspan.llm.packing import op7_cost_balanced_packing
from loomspan.llm.paragraphs import op8_line_dedup, op8_line_dedup_whole
from loomspan.llm.pii import op6_personal_data
from loomspan.llm.quality import op5_likelihood_quality
from loomspan.llm.secrets import op2_secret_ownership
from loomspan.llm.substrings import op10_suffix_array_dedup
from loomspan.llm.toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_ownership": op2_secret_ownership,
    "op3_hyperminhash_near_dedup": op3_hyperminhash_near_dedup,
    "op4_template_extraction": op4_template_extraction,
    "op5_likelihood_quality": op5_likelihood_quality,
    "op6_personal_data": op6_personal_data,
    "op7_cost_balanced_packing": op7_cost_balanced_packing,
    "op8_line_dedup": op8_line_dedup,
    "op8_line_dedup_whole": op8_line_dedup_whole,
    "op9_template_decontamination": op9_template_decontamination,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}
SQL: dict[str, str] = {}
