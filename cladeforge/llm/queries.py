"""The queries of this subpackage and their SQL, for the registry at the top of the repository."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from cladeforge.llm import ann, html, mixing, pieces, quality, simhash, suffixes, token_files, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": urls.op1_url_filters,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_nearest_neighbours": ann.op4_nearest_neighbours,
    "op5_warc": warc.op5_warc,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_token_files": token_files.op8_token_files,
    "op9_suffix_array_dedup": suffixes.op9_suffix_array_dedup,
    "op10_html_extraction": html.op10_html_extraction,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op1_url_filters": urls.ORACLE_OP1,
    "op3_quality_rules": quality.ORACLE_OP3,
    "op4_nearest_neighbours": ann.ORACLE_OP4,
    "op5_warc": warc.ORACLE_OP5,
    "op6_mix_sources": mixing.ORACLE_OP6,
}
