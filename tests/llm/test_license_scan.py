import random
import re

from pyspark.sql import functions as F

from tracewright.llm import _licenses as L
from tracewright.llm import license_scan


def slow_words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def slow_base(text):
    words = slow_words(text)
    places = [(i, label) for phrase, label in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None, "", "CC BY", "cc-by cc/BY ccby", "All rights\nreserved. all RIGHTS reserved reserved", "GNU General Public License", "É all Rights réserved",
    "x " * 30000 + "cc by", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", L.TEMPLATES[1][1], "noise " * 9 + L.TEMPLATES[4][1].replace("merge,", "") + " tail",
]


def test_base(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r.doc_id: r.s for r in docs.select("doc_id", license_scan.scan(F.col("text")).alias("s")).collect()}
    for i, text in enumerate(TEXTS):
        assert tuple(rows[i])[:5] == slow_base(text)
    assert rows[0].labels == "" and rows[0].score == 0
    assert rows[8].labels == "cc-by,cc-by-nc" and rows[9].labels == "mit" and rows[10].labels == "apache-2.0" and "mit" in rows[11].labels
    span = next(s for s in rows[11].spans if s.label == "mit")
    assert span.start == 9 and span.covered > 0.9
    assert docs.limit(0).select(license_scan.scan(F.col("text"))).count() == 0


def test_matching_statistics_by_brute_force():
    rng = random.Random(2)
    for _ in range(80):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(3)]
        text = [rng.randrange(4) for _ in range(40)]
        inside = lambda part: [k for k, s in enumerate(sequences) if any(s[i : i + len(part)] == part for i in range(len(s)))]
        longest = [max(n for n in range(e + 1) if n == 0 or inside(text[e - n : e])) for e in range(1, len(text) + 1)]
        want = [(e, n) for e, n in enumerate(longest, 1) if n >= L.MIN_WORDS and (e == len(text) or longest[e] != n + 1)]
        got = L.Automaton(sequences).maximal_matches(text)
        assert [(e, n) for e, n, _ in got] == want
        for e, n, ends in got:
            assert sorted(ends) == inside(text[e - n : e])
            for k, end in ends.items():
                assert end == min(i + n for i in range(len(sequences[k])) if sequences[k][i : i + n] == text[e - n : e])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = license_scan.op8_license_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert ("mit" in r.labels.split(",")) == ("Released under the MIT License" in texts[r.doc_id])


def test_an_inserted_or_replaced_word_anywhere_in_a_long_template():
    scanner = L.Scanner()
    for label, text in L.TEMPLATES:
        words = [w.decode() for w in slow_words_of(text)]
        if len(words) < 20:
            continue
        edited = [words[:k] + ["zzyzx"] + words[k + skip :] for k in range(1, len(words) - 1) for skip in (0, 1)]
        for words, row in zip(edited, scanner.scan([" ".join(w) for w in edited])):
            assert label in row[5].split(","), (label, words.index("zzyzx"))


def slow_words_of(text):
    return [w.encode() for w in slow_words(text)]


def test_chains_end_at_long_gaps_and_bridge_changed_names():
    mit = L.TEMPLATES[4][1]
    half = mit.index("modify")
    broken = [mit.replace("Software", "Library").replace("software", "library"), mit[:half] + "zz " * 30 + mit[half:], mit[:half] + "zz " * 60 + mit[half:]]
    assert [r[5] for r in L.Scanner().scan(broken)] == ["mit", "mit", ""]
    start, end = next(s[1:3] for s in L.Scanner().scan(["zz " * 7 + broken[1]])[0][7] if s[0] == "mit")
    assert (start, end) == (7, 7 + len(slow_words(broken[1])))
