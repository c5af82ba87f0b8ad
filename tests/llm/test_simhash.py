import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewright.llm import near_sets
from tracewright.llm import simhash_dedup as S
from tracewright.llm._fingerprint import simhash


def slow_simhash(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def slow_groups(prints):
    """Smallest index reachable over links of at most 4 bits, by trying all pairs."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c d", "a b c d e", "A\x0bB é É c\x1fd x", "the cat " * 300])
def test_fingerprint_equals_slow_form(text):
    assert simhash(text) == slow_simhash(text)


def near_prints(rng, centres, each, flips):
    made = []
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(each):
            x = centre
            for _ in range(rng.randrange(flips + 1)):
                x ^= 1 << rng.randrange(64)
            made.append(x)
    return sorted(set(made))


@pytest.mark.parametrize("limit", [1024, 6, 1])
def test_links_give_exact_components(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "CROWDED", limit)
    prints = near_prints(random.Random(3), 12, 25, 5)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    marked = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in S.with_groups(marked).collect()}
    assert got == dict(enumerate(slow_groups(prints)))


def test_group_of_thousands_is_linked_within_bounds(spark, monkeypatch):
    """5,000 fingerprints around one centre, most of them in crowded entries, and as many apart."""
    monkeypatch.setattr(S, "CROWDED", 64)
    rng = random.Random(8)
    prints = sorted({*near_prints(rng, 1, 5000, 6), *(rng.getrandbits(64) for _ in range(5000))})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    marked = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in S.with_groups(marked).collect()}
    left, values, want = np.arange(len(prints)), np.array(prints, np.uint64), {}
    while len(left):  # breadth-first over all pairs
        reached, group = [left[0]], [left[0]]
        left = left[1:]
        while reached:
            near = np.bitwise_count(values[left] ^ values[reached.pop()]) <= 4
            reached += left[near].tolist()
            group += left[near].tolist()
            left = left[~near]
        want |= dict.fromkeys(map(int, group), int(min(group)))
    assert got == want
    edges = S.links(marked.select("fp"))
    assert edges.count() < 70 * len(prints) and edges.join(marked, edges.b == marked.fp, "left_anti").isEmpty()


def test_documents_with_odd_rows(spark):
    rows = [(1, "a b c d e f", "x"), (2, "A b  c d e f", "y"), (3, None, "z"), (4, "", "z"), (None, "q r s t", "n"), (5, "lone", None), (5, "lone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = S.near_duplicate_groups(docs).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1), (2, 1), (3, 3), (4, 3), (None, None), (5, 5), (5, 5)], key=str)
    assert S.near_duplicate_groups(docs.limit(0)).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    rows = [(7, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "a b c d e f", "y"), (9, "other words stand here now", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in S.dedup_stage(spark, docs, "").collect()) == [2, 9]


def test_stage_with_odd_rows_and_clashing_columns(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "quite another text with the same id"), (None, "a b c d e f"), (None, "only a null id"), (5, None), (6, ""), (7, "a b c d e f")]
    names = ["fp", "fp_", "f_", "i_", "g_id", "g_fp", "row_", "id_", "k_id", "s", "n", "m", "odd", "component_id", "root", "null"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(n).alias(n) for n in names])
    out = S.dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    found = sorted(((str(r.doc_id), r.text) for r in out.collect()), key=str)
    texts = {t for _, t in found}
    assert [i for i, _ in found].count("5") == 1 and ("None", "only a null id") in found and ("6", "") not in found and ("7", "a b c d e f") not in found
    assert [i for i, _ in found if i == "1"] == ["1", "1"] and {"a b c d e f", "quite another text with the same id"} <= texts
    assert all(r[n] == n for r in out.collect() for n in names)
    assert S.dedup_stage(spark, docs.limit(0), "").count() == 0


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [slow_simhash(r.text) for r in docs]
    groups = slow_groups(prints)
    want = {(r.doc_id, f"{p:016x}", docs[g].doc_id) for r, p, g in zip(docs, prints, groups)}
    assert set(map(tuple, S.op2_simhash(spark, sf).collect())) == want


def five_word_sets(texts):
    sets = []
    for text in texts:
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return sets


def near_groups(sets):
    """Smallest index reachable over pairs of similarity 4/5 or more, by trying all pairs."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("sample", [16, 1])
def test_stage_against_all_pairs_of_edited_copies(spark, monkeypatch, sample):
    monkeypatch.setattr(near_sets, "SAMPLE", sample)
    rng = random.Random(5)
    line = " ".join(f"common{k}" for k in range(40))
    texts = ["", None, "one two", "One  two"]
    for c in range(14):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 30, 120, 200]))] + (line.split() if c % 2 else [])
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(99)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = near_groups(five_word_sets(texts))
    assert sorted(r.doc_id for r in S.dedup_stage(spark, docs, "").collect()) == sorted(set(want))
    assert len(set(want)) < len(set(slow_groups([slow_simhash(t) for t in texts])))


def test_stage_follows_chains_past_the_first_of_a_posting_list(spark):
    words = [f"w{k}" for k in range(140)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, 41, 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in S.dedup_stage(spark, docs, "").collect()] == [0]


def test_stage_on_documents_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id")
    rows = docs.select("doc_id", "text").collect()
    want = sorted({rows[g].doc_id for g in near_groups(five_word_sets([r.text for r in rows]))})
    assert sorted(r.doc_id for r in S.dedup_stage(spark, docs, sf).collect()) == want


def test_near_sets_share_an_item_and_fail_neither_sizes_nor_parities():
    rng = np.random.default_rng(4)
    draw = lambda n: np.unique(rng.integers(-(1 << 63), 1 << 63, n))
    near = 0
    for m in [*range(1, 60), *rng.integers(60, 3000, 150).tolist()]:
        core = draw(m)
        for less, more in ((0, 1), (m // 9, m // 9), (m // 5, 0), (0, m // 4)):
            a, b = core, np.union1d(core[less:], draw(more))
            shared = len(np.intersect1d(a, b))
            if 5 * shared < 4 * (len(a) + len(b) - shared) or np.array_equal(a, b):
                continue
            near += 1
            assert len(np.intersect1d(near_sets.set_items(a), near_sets.set_items(b))), (m, less, more)
            odd = [near_sets._parity(s, 1) for s in (a, b)]
            assert len(near_sets._apart(np.array([len(a), len(b)]), np.array([1, 2]), None, odd)[0]) == 1
    assert near > 400
    assert all(near_sets.n_parts(5 * m // 4) <= 2 * near_sets.n_parts(m) for m in range(1, 5000))


@pytest.mark.parametrize("block", [1024, 5])
def test_a_list_of_pairs_just_too_far_is_compared_within_tasks(spark, monkeypatch, block):
    """Copies with two edits each: most are too far from each other, and only a few of them link; no pairs of them are rows of a join."""
    monkeypatch.setattr(near_sets, "BLOCK", block)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(60):
        copy = list(words)
        for _ in range(3):
            copy[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = near_groups(five_word_sets(texts))
    assert 1 < len(set(want)) < 60
    assert sorted(r.doc_id for r in S.dedup_stage(spark, docs, "").collect()) == sorted(set(want))
    sets = near_sets.Sets(docs)
    placed = sets._posted().withColumn("group", F.col("fp"))
    possible = sets._across(placed).distinct()
    assert sets._verified(possible).count() <= possible.count() < 60 * 59 // 4


def test_pairs_by_simhash_are_candidates_and_a_common_passage_makes_no_lists(spark):
    rng = random.Random(6)
    passage = " ".join(f"common{k}" for k in range(12))
    texts = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(60)) + " " + passage for _ in range(200)]
    texts += [texts[0] + " one", texts[1] + " two"]
    sets = near_sets.Sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = S.simhash_pairs(sets.chosen.select("fp", "simhash")).collect()
    prints = {r.fp: r.simhash & (1 << 64) - 1 for r in sets.chosen.collect()}
    near = {frozenset((a, b)) for a in prints for b in prints if a != b and (prints[a] ^ prints[b]).bit_count() <= 4}
    assert near and {frozenset((r.a, r.b)) for r in found} <= near
    assert sets._posted().groupBy("s").count().where("count > 60").isEmpty()


def test_a_list_passes_on_fewer_pairs_than_it_has_members():
    n, rng = 300, np.random.default_rng(2)
    odd = [np.zeros(16, np.int64)] * n
    a, b = near_sets._apart(np.full(n, 100), np.arange(n), None, odd)
    assert len(a) == n - 1 and set(a) | set(b) == set(range(n))
    a, b = near_sets._apart(np.full(n, 100), np.arange(n) % 2, rng.integers(0, 2, n), odd)
    assert len(a) < n


@pytest.mark.parametrize("shingles", [1 << 20, 300])
def test_near_pairs_of_many_groups_leave_cells_as_a_forest(spark, monkeypatch, shingles):
    """All pairs of 60 copies are near; each text counts as a group of its own, or as one of two."""
    monkeypatch.setattr(near_sets, "BLOCK_SHINGLES", shingles)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words[:100] + [f"e{k}"] + words[100:]) for k in range(60)]
    sets = near_sets.Sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    alone = sets._posted().withColumn("group", F.col("fp"))
    pairs = sets._across(alone)
    blocks = -(-60 * 197 // shingles)
    assert pairs.count() < 60 * blocks
    assert near_sets.connected_components(pairs).groupBy("component").count().select("count").collect() == [(59,)]  # the heads are left out
    two = alone.withColumn("group", F.pmod("fp", F.lit(2)))
    assert 1 <= sets._across(two).count() <= blocks * (blocks + 1) // 2
