"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladeforge.llm.common import materialize, table
from cladeforge.llm.mixing import stage_mix
from cladeforge.llm.pieces import stage_pieces
from cladeforge.llm.quality import stage_quality
from cladeforge.llm.simhash import stage_simhash
from cladeforge.llm.suffixes import stage_suffixes
from cladeforge.sources.storage import discard, scope

STAGES = [
    ("quality rules", stage_quality),
    ("SimHash near-dedup", stage_simhash),
    ("suffix-array dedup", stage_suffixes),
    ("mixing sources to target weights", stage_mix),
    ("SentencePiece encoding and decoding", stage_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scope() as keep:  # what a stage wrote on its way goes when its result is written, and then the result before it
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep.append(docs)
        if last is not None:
            discard(last)
        last = docs
    return docs


#: SimHash, suffix and tokenizer stages can't be said in SQL; tests/llm holds the run against brute force.
ORACLE_SQL = None
