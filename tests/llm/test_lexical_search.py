import math
import re
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import lexical_search as L

ASCII = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def slow(docs, items, k=10):
    """(item_id, rank, doc_id, score), document by document."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    size, whole = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    found = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            m = 25 + (75 * sum(c.values()) * size) // max(whole, 1)
            score = sum(n * math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, n in Counter(terms(text)).items() if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        found += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(found, key=str)


DOCS = [(i, f"Word{i % 7} common İ é{i % 3} {'tail ' * (i % 4)}x_y-z") for i in range(60)] + [(i, "same text of many, same") for i in range(100, 130)]
DOCS += [(None, "same text of many, same"), (105, "same text of many, same"), (200, None), (201, ""), (202, " .,\x00\x7f\n"), (203, "long\x00text " * 60_000), (204, "日本語 same")]
ITEMS = [(1, "SAME text"), (2, "word3 é2 É2 word3 word3"), (3, None), (4, "..."), (1, "SAME text"), (1, "tail"), (None, "日本語 long"), (5, "absent x y z"), (6, "long " * 3000)]


@pytest.fixture
def folder(spark, tmp_path):
    def write(docs, items):
        spark.createDataFrame([(d, t, "en", "s", 1, 2) for d, t in docs], "doc_id long, text string, lang string, terms string, item int, rank int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def test_odd_rows_in_several_shards(spark, folder, monkeypatch):
    monkeypatch.setattr(L, "SHARD_DOCS", 9)
    assert sorted(map(tuple, L.op12_lexical_search(spark, folder(DOCS, ITEMS)).collect()), key=str) == slow(DOCS, ITEMS)


def test_blocks_that_are_not_broadcast(spark, folder, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_BLOCKS", 0)
    monkeypatch.setattr(L, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(L, "SHARD_DOCS", 20)
    assert sorted(map(tuple, L.op12_lexical_search(spark, folder(DOCS, ITEMS)).collect()), key=str) == slow(DOCS, ITEMS)


@pytest.mark.parametrize("docs, items", [([], ITEMS), (DOCS[:3], []), ([(1, None), (2, "")], ITEMS[:2])])
def test_nothing_to_find(spark, folder, docs, items):
    assert L.op12_lexical_search(spark, folder(docs, items)).collect() == []


def test_selection_is_tie_safe():
    r = np.random.default_rng(0)
    for _ in range(200):
        scores = r.integers(0, 4, size=r.integers(1, 30))
        want = sorted((i for i in range(len(scores)) if scores[i] > 0), key=lambda i: (-scores[i], i))[:5]
        assert sorted(L._best(scores, 5)) == sorted(want)


def test_index_has_every_term(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    held = {(i, t): n for i, t, n in ((i, t, n) for i, text in DOCS for t, n in Counter(terms(text)).items())}
    rows = L.index(docs).collect()
    assert sum(len(np.frombuffer(r.docs, np.int32)) for r in rows) == sum(len(Counter(terms(t))) for _, t in DOCS)
    assert {t for r in rows for t in r.terms} == {t for _, t in held}
