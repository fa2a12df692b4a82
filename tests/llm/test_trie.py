"""The prefix trie of conversations against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), tie, role, text))
    own = {c: [(role, text) for _, _, role, text in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h]) + tuple(turns[h:])
    members, children, leaves, saved = defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted((
        min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node],
        hashlib.sha256(",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(node)))).encode()).hexdigest())
        for node, m in members.items())


def found(df):
    return sorted(map(tuple, trie.nodes(df).select(*COLUMNS).collect()))


@pytest.mark.parametrize("group, n", [(256, 60), (3, 300), (1, 120)])
def test_nodes_match_brute_force(spark, monkeypatch, group, n):
    monkeypatch.setattr(trie, "GROUP", group)
    rng = random.Random(n)
    rows = [(None, 1, "user", "x"), (5, 0, "user", "twice"), (5, 0, "user", "twice"), (-7, None, None, None), (-7, 2, "", "é🙂" * 4000)]
    for c in rng.sample(range(-50, 900), n):
        for t in range(rng.choice([1, 2, 3, 4, 9, 40])):
            turn = rng.choice([t, None, 1]) if rng.random() < 0.1 else t
            rows.append((c, turn, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user",
                         rng.choice(["a", "b", None, "hello"]) if t else rng.choice("aaab")))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' as `{c}`" for c in ("node", "whole", "n", "ids", "above", "first")])
    assert found(df) == brute(rows)


def test_no_turns_left_and_no_rows(spark):
    rows = [(c, 0, "user", "one") for c in range(1, 40)]   # base conversation 0 is absent
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_many_members_end_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(trie, "_RUN", 3)
    rows = [(c, t, "user", "same") for c in range(-300, 300) for t in range(7)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=6), min_size=1, max_size=80))
def test_double_array_holds_its_sequences(sequences):
    sequences = [np.array(s) for s in sequences]
    t = trie.DoubleArray(sequences)
    prefixes = {tuple(s[:d + 1].tolist()): None for s in sequences for d in range(len(s))}
    for d, on, cells in t.walk(sequences):
        for i, cell in zip(on, cells):
            key = tuple(sequences[i][:d + 1].tolist())
            assert prefixes[key] in (None, cell)
            prefixes[key] = cell
    assert len(set(prefixes.values())) == len(prefixes) == sum(c >= 0 for c in t.check)
    with pytest.raises((KeyError, IndexError)):
        list(t.walk([np.array([31])]))
