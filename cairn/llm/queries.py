"""The contract queries of this subpackage, by name, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.decontaminate import decontamination_query
from cairn.llm.embedding_dedup import embedding_query
from cairn.llm.html_text import html_query
from cairn.llm.language import language_query
from cairn.llm.near_dup import near_dup_query
from cairn.llm.packing import packing_query
from cairn.llm.quality import quality_query
from cairn.llm.token_store import token_store_query
from cairn.llm.toxicity import toxicity_query
from cairn.llm.warc import WARC_SQL, warc_query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": token_store_query,
        "op2_html_text": html_query,
        "op3_embedding_dedup": embedding_query,
        "op4_decontamination": decontamination_query,
        "op5_warc": warc_query,
        "op6_language": language_query,
        "op7_toxicity": toxicity_query,
        "op8_quality": quality_query,
        "op9_near_dup": near_dup_query,
        "op10_packing": packing_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": WARC_SQL}
