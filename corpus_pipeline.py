"""The corpus pipeline: quality, near copies, benchmark leaks, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return
the columns of documents. run() writes each stage's rows to the folder that driver and executors share and
reads them again; when a stage's rows are written, its intermediate tables and the rows it read are deleted. The last stage's rows
are those read back from the token files: doc_id, start, n_tokens and ids_crc32 of each document of the final mix, a document
taken twice standing there twice.

Defined results: a null or empty text stays through quality (log weight 0, kept if that reaches the cut) and the
leak search; of all such rows one stays among near copies, in the mix it stays once, and it has one token, the end id. A null
doc_id is unlabelled, comes last among near copies and first in the token files. Of rows that repeat doc_id and text one is left after
the near copies; with other texts they are documents of their own. Very long texts are read whole. An empty table passes
through all stages empty. Other columns are kept up to the last stage, whatever their names.

SQL can't express the classifier, the mix and the tokenizer, so ORACLE_SQL is None; the tests hold each
stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fairlead.functions.tables import Scratch, load
from fairlead.llm import decontaminate, jaccard_join, mixing, quality, token_store

STAGES = [
    ("quality", quality.stage),
    ("near_copies", jaccard_join.stage),
    ("benchmark_leaks", decontaminate.stage),
    ("source_mix", mixing.stage),
    ("token_ids", token_store.stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = load(spark, sf_dir, "documents"), Scratch(spark), None
    for name, stage in STAGES:
        mark = Scratch.mark()
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        Scratch.sweep(mark)
        if before:
            scratch.free(before)
        before = name
    return docs
