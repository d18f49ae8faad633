"""Queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import OP10_SQL, op10_chat_format
from .collocations import OP13_SQL, op13_collocations
from .decontamination import op8_decontaminate
from .importance import OP12_SQL, op12_importance
from .licenses import OP5_SQL, op5_license_sentences
from .packing import op2_pack_best_fit
from .quality_mil import op6_quality_mil
from .quality_rules import OP1_SQL, op1_quality_rules
from .sharding import op3_shard_jump_hash
from .simhash import op9_simhash
from .suffix_dedup import op4_suffix_dedup
from .toxicity import op7_toxicity_chain
from .vector_packing import op11_vector_packing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_pack_best_fit, op3_shard_jump_hash, op4_suffix_dedup, op5_license_sentences, op6_quality_mil, op7_toxicity_chain, op8_decontaminate, op9_simhash, op10_chat_format, op11_vector_packing, op12_importance, op13_collocations)
}
SQL: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op5_license_sentences": OP5_SQL, "op10_chat_format": OP10_SQL, "op12_importance": OP12_SQL, "op13_collocations": OP13_SQL}
