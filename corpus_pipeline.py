"""From raw documents to token ids: rules, line dedup, near-document dedup, decontamination, tokens.

Each stage gets all that its predecessor kept, written as Parquet and read again, so that a lost executor costs at most
the stage that runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigraph.llm import bpe, decontamination, line_dedup, near_dedup, quality_rules
from lexigraph.llm.runtime import staged, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules.stage),
    ("line dedup", line_dedup.stage),
    ("near dedup", near_dedup.stage),
    ("decontamination", decontamination.stage),
    ("tokens", bpe.stage),
]

#: Near dedup goes by sketches and the last stage by a tokenizer file; tests hold both against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the table documents in sf_dir: doc_id, n_tokens, ids, decoded_sha256.

    Null, empty and short texts fail the rules of the first stage; very long ones are taken whole; of copies, repeated rows
    and ties the row of the least doc_id stays (see near_dedup.stage); other columns go along until the last stage; an
    empty table gives an empty result. The result reads the last written table: call clear_staged once it is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
