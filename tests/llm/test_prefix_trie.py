"""Operator 13 against tries made one conversation after the other."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from pathloom.llm import prefix_trie as pt

TURNS = "conv_id long, turn long, role string, text string, depth long, id string"


def own(rows):
    out = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            x = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            out[c].append(((turn is not None, turn or 0, role, x), role, text))
    return {c: [t[1:] for t in sorted(v)] for c, v in out.items()}


def rebuilt(turns):
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = turns.get(base, [])[:h] + turns[c][h:]
    return out


def plain(convs):
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own_saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        saved[p] = own_saved + sum(saved[k] for k in children[p])
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in who if len(convs[c]) == len(p))
        up = members[p[:-1]][0] if p else None
        out.append((who[0], len(p), up, len(who), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def built(df):
    turns = pt.materialize(pt.own_turns(df), "test-turns")
    return sorted((tuple(r) for r in pt.trie(*pt.rebuild(turns)).select(*COLUMNS).collect()), key=str)


def check(spark, rows):
    assert built(spark.createDataFrame(rows, TURNS)) == plain(rebuilt(own(rows)))


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [
        (1, None, "user", "null first", 9, "x"), (1, 0, None, "a", 9, "x"), (1, 0, "user", None, 9, "x"), (1, 0, "user", "", 9, "x"), (1, 7, "user", "z", 9, "x"),
        (None, 1, "user", "nobody", 9, "x"), (None, None, None, None, None, None), (5, 1, "user", "hi", 1, ""), (5, 1, "user", "hi", 1, ""), (6, 1, "user", "hi", 1, ""),
        (7, -3, "a:b", "c", 1, ""), (7, 2, "a", "b:c", 1, ""), (-3, 1, "user", "hi", 1, ""), (-5, 1, "user", "hi", 1, ""), (0, 2, "user", "é" * 100_000, 1, ""), (0, 1, "user", "hi", 1, ""),
        (2**63 - 1, 1, "user", "hi", 1, ""), (-(2**63), 1, "user", "hi", 1, ""),
    ]
    check(spark, rows)


@pytest.mark.parametrize("hot", [1, 1000])
def test_families_with_common_and_long_conversations(spark, monkeypatch, hot):
    monkeypatch.setattr(pt, "BLOCK", 4)
    monkeypatch.setattr(pt, "RUN_BITS", 2)
    monkeypatch.setattr(pt, "HOT", hot)
    rows = []
    for c in range(90):
        n = 40 if c in (5, 33) else c % 12
        rows += [(c, t, "user" if t % 2 else "assistant", f"turn {t if c % 3 else t * (c % 4)}", 0, "") for t in range(n)]
    check(spark, rows)


def test_one_conversation_of_many_turns(spark):
    rows = [(3, t, "user", f"t{t % 50}", 0, "") for t in range(3000)]
    check(spark, rows)


def test_empty_table(spark):
    assert built(spark.createDataFrame([], TURNS)) == []


def test_conversations_as_they_are(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = pt.prefix_trie(df).select(*COLUMNS)
    turns = own([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(turns)
