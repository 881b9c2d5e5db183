"""The trie of conversations against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tollgate.llm import burst_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int, words string"


def by_dictionary(rows):
    turns = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(found)] for c, found in turns.items()}
    nodes = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 4
        whole = (*turns.get(conv - conv % 20, [])[:h], *own[h:])
        for d in range(len(whole) + 1):
            nodes.setdefault(whole[:d], ([], []))[0].append(conv)
        nodes[whole][1].append(conv)
    out = {}
    for path, (members, ends) in sorted(nodes.items(), key=lambda n: -len(n[0])):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        children, leaves, saved = out.pop(path, (0, 0, 0))
        leaves, saved = leaves or 1, saved + (len(members) - 1) * words
        above = min(nodes[path[:-1]][0]) if path else None
        ids = ",".join(map(str, sorted(ends)))
        yield min(members), len(path), above, len(members), children, leaves, saved, hashlib.sha256(ids.encode()).hexdigest()
        if path:
            c, n, s = out.get(path[:-1], (0, 0, 0))
            out[path[:-1]] = (c + 1, n + leaves, s + saved)


def awkward():
    rng = random.Random(13)
    rows = []
    for conv in [*range(40, 100), 1021, 1022, -5]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((conv, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a b c", "", None, "日本 x\x0bx"])))
    for conv in range(200, 230):  # copies, one of them longer
        rows += [(conv, t, "user", f"turn {t}") for t in range(7 + (conv == 207))]
    rows += [(300 + c, t, "user", f"long {t}" if t < 40 + c else "other") for c in (0, 20, 40) for t in range(60)]
    rows += [(None, 0, "user", "x"), (400, 1, "user", "word " * 30_000), (400, 1, "user", "again"), (400, 1, "user", "again")]
    return [(*r, "clash", 7, "clash") for r in rows]


@pytest.mark.parametrize(("segment", "container"), [(256, 256), (256, 8), (16, 3)])
def test_nodes_equal_a_dictionary(spark, monkeypatch, segment, container):
    monkeypatch.setattr(burst_trie, "SEGMENT", segment)
    monkeypatch.setattr(burst_trie, "BLOCK_IDS", 3)
    rows = awkward()
    found = burst_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3), container)
    assert found.columns == burst_trie.COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == sorted(by_dictionary(rows), key=str)


def test_no_conversation_has_no_node(spark):
    assert burst_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert burst_trie.trie(spark.createDataFrame([(None, 1, "user", "x", "", 0, "")], SCHEMA)).count() == 0


def test_sql_agrees_on_awkward_rows():
    rows = [r for r in awkward() if r[0] is None or r[0] >= 0]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    assert sorted(con.sql(burst_trie.SQL).fetchall(), key=str) == sorted(by_dictionary(rows), key=str)
