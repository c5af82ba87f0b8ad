"""BPE encoding and decoding of text columns with a public tokenizer's vocabulary."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bpe import WordEndBpe
from ._shared import small_batches, table


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordEndBpe:
    """One for each worker process; the vocabulary file is installed with the library on every machine."""
    return WordEndBpe(path)


def encode(text: Column, path: str | None = None) -> Column:
    """ARRAY<INT> of token ids; a null or empty text gives an empty array."""
    path = path or default_vocabulary()

    def ids(texts: pa.Array) -> pa.Array:
        return pa.array([list(map(int, _tokenizer(path).encode(t)[1].split())) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(ids, "array<int>")(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text that decode() of the tokenizer gives; null ids give an empty text. An id outside the vocabulary raises KeyError."""
    path = path or default_vocabulary()

    def texts(batch: pa.Array) -> pa.Array:
        return pa.array([_tokenizer(path).decode(" ".join(map(str, x or []))) for x in batch.to_pylist()], pa.string())

    return F.arrow_udf(texts, "string")(ids)


def round_trip(text: Column, path: str | None = None) -> Column:
    """STRUCT<n_tokens, ids_sha256, decoded_sha256>: the text is encoded, and the ids are decoded, without leaving the worker.

    A null or empty text has no tokens and decodes to the empty text.
    """
    path = path or default_vocabulary()

    def digests(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            n, ids = _tokenizer(path).encode(text)
            decoded = _tokenizer(path).decode(ids)
            rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        columns = list(zip(*rows)) or [(), (), ()]
        kinds = (("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()))
        return pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])

    return F.arrow_udf(digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")(text)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, repeated ones included. Null and empty texts have no tokens; very long texts are encoded whole; no rows give no rows. Other columns aren't read."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", round_trip(F.col("text")).alias("r")).select("doc_id", "r.*")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all columns of the documents, with token_ids, n_tokens and ids_sha256.

    Columns of docs with these three names are replaced. Null and empty texts
    have no ids; very long texts are encoded whole; repeated rows stay; no rows
    give no rows.
    """
    small_batches(spark)
    return docs.withColumn("token_ids", encode(F.col("text"))).withColumns(
        {
            "n_tokens": F.size("token_ids").cast("long"),
            "ids_sha256": F.sha2(F.array_join("token_ids", " "), 256),
        }
    )
