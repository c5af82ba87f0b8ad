import hashlib
import zlib
from collections import defaultdict

import duckdb

from tracewright.llm import prefix_trie as P

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def slow(rows, rebuild=True):
    """The trie by walking every conversation; ties of turn in order of role and text, which the rows below don't depend on."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + turns[h:] if rebuild else turns
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(totals[x][0] for x in children[node]) or 1
        totals[node] = leaves, sum(totals[x][1] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = []
    for node, of in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children[node]), *totals[node], digest))
    return sorted(out, key=str)


ROWS = [(c, t, "user" if t % 2 else None, f"turn {t} of {c // 3}" if t > 2 else "Hello 😀") for c in range(0, 240, 3) for t in range(1, 3 + c % 7)]
ROWS += [(c, t, "a", f"copy {t}") for c in range(500, 560) for t in range(5)]  # many copies
ROWS += [(101, None, "r", None), (101, None, "r", None), (101, 3, "", ""), (102, 1, "ab", "c"), (103, 1, "a", "bc"), (151, 1, "x", "y"), (None, 1, "a", "b")]
ROWS += [(1000 + k, t, "u", f"step {t}") for k in range(5) for t in range(10 + 7 * k)]  # each goes on where another ends
ROWS += [(2001, 1, "u", "long " * 50_000), (9999, 1, "u", "t")]


def run(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted(map(tuple, P.op13_prefix_trie(spark, str(tmp_path)).select(*COLUMNS).collect()), key=str)


def test_odd_rows(spark, tmp_path):
    assert run(spark, ROWS, tmp_path) == slow(ROWS)


def test_no_rows(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_trie_of_conversations_as_they_are_in_small_segments(spark, monkeypatch):
    monkeypatch.setattr(P, "SEGMENT", 4)
    monkeypatch.setattr(P, "PIECE", 16)
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, P.prefix_trie(df).select(*COLUMNS).collect()), key=str) == slow(ROWS, rebuild=False)


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = sorted(map(tuple, P.op13_prefix_trie(spark, sf).select(*COLUMNS).collect()), key=str)
    assert got == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({P.ORACLE})").fetchall(), key=str)
