"""The corpus pipeline: documents to encoded training rows in five stages.

1. quality rules: documents that the rules reject go;
2. SimHash near-dedup: one document of each group stays;
3. secret scans: found secrets are masked in the texts;
4. mixing: sources are brought to their target weights;
5. BPE encoding: token ids are added.

All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm._shared import remove_table, table, write_table
from tracewright.llm.bpe import encode_stage
from tracewright.llm.mixing import mix_stage
from tracewright.llm.quality_rules import filter_stage
from tracewright.llm.secret_scan import redact_stage
from tracewright.llm.simhash_dedup import dedup_stage

STAGES = [
    ("quality rules", filter_stage),
    ("SimHash near-dedup", dedup_stage),
    ("secret scans", redact_stage),
    ("mixing sources to target weights", mix_stage),
    ("BPE encoding and decoding", encode_stage),
]

#: Fingerprints, forests and quotas have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of sf_dir, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            path = write_table(docs, f"stage{number}")
            docs = spark.read.schema(docs.schema).parquet(path)
            if before is not None:
                remove_table(spark, before)
            before = path
    return docs
