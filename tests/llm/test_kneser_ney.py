from collections import Counter, defaultdict

import pytest

from tracewright.llm import kneser_ney as K


def slow_model(texts):
    """log-free textbook form: p(character | three before) as a function."""
    pad = lambda t: [K.START] * 3 + [min(ord(c), K.BEYOND) for c in t or ""] + [K.STOP]
    counts = {4: Counter(tuple(s[i : i + 4]) for s in map(pad, texts) for i in range(len(s) - 3))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts = {}
    for n, c in counts.items():
        of = Counter(c.values())
        if min(of[k] for k in (1, 2, 3, 4)):
            y = of[1] / (of[1] + 2 * of[2])
            discounts[n] = [min(max(k - (k + 1) * y * of[k + 1] / of[k], 0.0), k) for k in (1, 2, 3)]
        else:
            discounts[n] = [0.5] * 3
    after = {n: defaultdict(Counter) for n in counts}
    for n, c in counts.items():
        for g, k in c.items():
            after[n][g[:-1]][g[-1]] = k

    def p(gram, n=4):
        if n == 0:
            return 1 / 65536
        gram, low = gram[-n:], p(gram, n - 1)
        seen = after[n].get(gram[:-1])
        if not seen:
            return low
        d, total = discounts[n], sum(seen.values())
        take = lambda k: d[min(k, 3) - 1]
        k = seen.get(gram[-1], 0)
        return ((k - take(k) if k else 0) + sum(map(take, seen.values())) * low) / total

    return pad, p


@pytest.mark.parametrize("head", [1 << 18, 3])
def test_against_textbook_form(spark, monkeypatch, head):
    import math
    import zlib

    monkeypatch.setattr(K, "HEAD", head)
    words = "the cat sat on that mat and then the rat ran at a hat".split()
    rows = [(i, " ".join(words[(i * k) % len(words)] for k in range(1, 30)), "en") for i in range(40)] + [(100, None, None), (101, "", "en"), (None, "öß 😀 the", "de"), (102, "the cat", "en"), (102, "the cat", "en")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, gram int, n int")
    trusted = spark.createDataFrame([(i,) for i in [*range(30), None, 3]], "doc_id long")
    got = sorted(((r.doc_id, r.lang, r.n_symbols, r.perplexity) for r in K.perplexities(docs, trusted).collect()), key=str)
    pad, p = slow_model([t for i, t, _ in rows if i is not None and i < 30 and zlib.crc32(str(i).encode()) % K.HELD])
    want = []
    for i, t, lang in rows:
        s = pad(t)
        logs = [math.log10(p(tuple(s[k : k + 4]))) for k in range(len(s) - 3)]
        want.append((i, lang, len(logs), 10 ** (-sum(logs) / len(logs))))
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string")
    none = docs.select("doc_id").limit(0)
    row = K.classify(docs, none).first()
    assert row.kept and row.threshold is None and row.perplexity == pytest.approx(65536)
    assert K.classify(docs.limit(0), none).count() == 0


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    rows = K.op3_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    kept = lambda q: [r.kept for r in rows if labels.get(r.doc_id) == q]
    assert sum(kept(1)) > 0.97 * len(kept(1)) and sum(kept(0)) < 0.5 * len(kept(0))
