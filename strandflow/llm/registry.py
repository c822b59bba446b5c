"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandflow.llm.htmltext import op5_extract_pages
from strandflow.llm.lzprint import op7_lz_fingerprints
from strandflow.llm.media import op4_progressive_jpeg
from strandflow.llm.mixing import OP6_SQL, op6_source_mix
from strandflow.llm.neardup import OP9_SQL, op9_near_duplicates
from strandflow.llm.packing import op2_pack_sequences
from strandflow.llm.pii import op8_pseudonyms
from strandflow.llm.sharding import op1_shard_documents
from strandflow.llm.toolcalls import OP3_SQL, op3_tool_calls
from strandflow.llm.toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_documents": op1_shard_documents,
    "op2_pack_sequences": op2_pack_sequences,
    "op3_tool_calls": op3_tool_calls,
    "op4_progressive_jpeg": op4_progressive_jpeg,
    "op5_extract_pages": op5_extract_pages,
    "op6_source_mix": op6_source_mix,
    "op7_lz_fingerprints": op7_lz_fingerprints,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op3_tool_calls": OP3_SQL,
    "op6_source_mix": OP6_SQL,
    "op9_near_duplicates": OP9_SQL,
}
