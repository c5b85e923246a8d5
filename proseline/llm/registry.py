"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proseline.llm.op1_language import op1_language
from proseline.llm.op7_decontaminate import op7_decontaminate
from proseline.llm.op8_embeddings import op8_embeddings
from proseline.llm.op9_suffix_dedup import op9_suffix_dedup
from proseline.llm.op2_warc import ORACLE as OP2_SQL
from proseline.llm.op2_warc import op2_warc
from proseline.llm.op10_near_dups import op10_near_dups
from proseline.llm.op3_bpe import op3_bpe
from proseline.llm.op4_quality import op4_quality
from proseline.llm.op5_pii import op5_pii
from proseline.llm.op6_token_counts import op6_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language, op2_warc, op3_bpe, op4_quality, op5_pii, op6_token_counts, op7_decontaminate, op8_embeddings, op9_suffix_dedup, op10_near_dups)}
ORACLES: dict[str, str] = {"op2_warc": OP2_SQL}
