"""Licence scans with a generalised suffix automaton of licence templates.

The templates' automaton is small and fixed; texts stream past it. Matching
statistics give the maximal passages shared with templates; passages that
follow each other in a template's order form a chain, and a chain that covers
enough of its template is a labelled span. Phrases that are labels by
themselves are found exactly, and their labels always stay.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._licenses import Scanner
from ._shared import small_batches, table

_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])
_FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
    ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN)),
]
SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,start:long,end:long,covered:double>>"
)


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner()


def _scan(texts: pa.Array) -> pa.Array:
    rows = _scanner().scan(texts.to_pylist())
    rows = [(*r[:7], [dict(zip(("label", "start", "end", "covered"), s)) for s in r[7]]) for r in rows]
    columns = list(zip(*rows)) or [()] * len(_FIELDS)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], [n for n, _ in _FIELDS])


def scan(text: Column) -> Column:
    """STRUCT of counts, labels, score and spans (words from 0, end exclusive) of a text column.

    A null or empty text has no words, no labels (empty strings), null places
    and score 0. The score is the largest share of a template that a chain covers.
    """
    return F.arrow_udf(_scan, SCHEMA)(text)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, repeated ones included; see scan for null and empty texts. Very long texts are scanned whole; no rows give no rows. Other columns aren't read."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", scan(F.col("text")).alias("s"))
    return docs.select("doc_id", "s.n_words", "s.n_base", "s.first_word", "s.last_word", "s.base_labels", "s.labels", "s.score")
