import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import bpe
from tracewright.llm._bpe import Merges, WordEndBpe

PATH = bpe.default_vocabulary()
OURS, THEIRS = WordEndBpe(PATH), Tokenizer.from_file(PATH)


def check(text):
    want = THEIRS.encode(text, add_special_tokens=False).ids
    n, ids = OURS.encode(text)
    assert ids == " ".join(map(str, want)) and n == len(want)
    assert OURS.decode(ids) == THEIRS.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize(
    "text",
    ["", " ", "Hello world's end, it'll do", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ΣΑΣ İstanbul ǅ", "é Å", "a\x1cb\x1f c\x85d\xa0e", "12345 ½ ²",
     "x<|endoftext|>y <|startoftext|>", "<|endoftext|", "!!!???...***%%%", "日本語テキスト", "😀👍🏽", " a b", "'s't 're'VE", "̀a", "x" * 5000],
)
def test_same_as_library(text):
    check(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    check(text.encode("utf-8", "ignore").decode())


def test_corpus_texts(spark):
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        check(row.text)


def slow_bpe(base, pairs, unit):
    rank = {}
    for k, p in enumerate(pairs):
        rank.setdefault(p, k)
    seq = list(map(ord, unit))
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(seq, seq[1:])) if p in rank]
        if not found:
            return seq
        k, i = min(found)
        seq[i : i + 2] = [base + k]


def test_merge_lists_by_chance():
    rng = random.Random(5)
    for _ in range(60):
        base, pairs = 3, []
        while len(pairs) < 14:
            p = (rng.randrange(base + len(pairs)), rng.randrange(base + len(pairs)))
            if p not in pairs:
                pairs.append(p)
        seen = {(k,) for k in range(base)}
        letters = [(k,) for k in range(base)]
        keep = []
        for a, b in pairs:  # as in real vocabularies each token's text is new
            if a < len(letters) and b < len(letters) and letters[a] + letters[b] not in seen:
                keep.append((a, b))
                letters.append(letters[a] + letters[b])
                seen.add(letters[-1])
        merges = Merges(base, keep)
        for _ in range(60):
            unit = "".join(chr(rng.randrange(base)) for _ in range(rng.randrange(1, 25)))
            assert merges.encode(unit) == slow_bpe(base, keep, unit)


def test_columns(spark):
    docs = spark.createDataFrame([(1, "The cat's hat"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    rows = docs.select("doc_id", bpe.encode(F.col("text")).alias("ids")).select("*", bpe.decode(F.col("ids")).alias("back")).collect()
    assert list(rows[0].ids) == THEIRS.encode("The cat's hat").ids and rows[0].back == THEIRS.decode(rows[0].ids, skip_special_tokens=False)
    assert [list(r.ids) for r in rows[1:]] == [[], [], []]
    assert docs.limit(0).select(bpe.round_trip(F.col("text"))).count() == 0


def test_query_and_stage(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = bpe.op7_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = THEIRS.encode(texts[r.doc_id], add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(THEIRS.decode(ids, skip_special_tokens=False)))
    staged = bpe.encode_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).select("doc_id", "n_tokens", "ids_sha256").collect()
    assert sorted(map(tuple, staged)) == sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in rows)
