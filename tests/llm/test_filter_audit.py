"""Operator 11 against counting one order after the other."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import filter_audit as fa

DOCS = "doc_id long, text string, source string, mask int, words string"
LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words)}
    out["C"] = 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)
    return {k for k, bad in (out | {"D": bool(re.search(r"[#$%&*|]", text))}).items() if bad}


def plain(docs, labels):
    least, good, toxic = {}, set(), set()
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, q, t in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if t == 1 else set()
    rows, total = defaultdict(lambda: [0] * 6), defaultdict(int)
    parts = {s or "" for _, _, s, *_ in docs}
    for order in map("".join, permutations("ABCDE")):
        for p in parts:
            for step in range(5):
                rows[p, order, step + 1]
        for i, text, source, *_ in docs:
            bad, p, gone = fails(text or ""), source or "", False
            if i is not None and i > least[text or ""]:
                bad = bad | {"E"}
            for step, f in enumerate(order, 1):
                r = rows[p, order, step]
                if f in bad and not gone:
                    r[1] += 1
                    total[p, f] += 1
                    r[4] += i is not None and i in good
                    r[5] += i is not None and i in toxic
                elif f in bad:
                    r[2] += 1
                r[3] += bad == {f}
                gone = gone or f in bad
                r[0] += not gone
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def audited(spark, docs, labels):
    out = fa.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), fa.text_filters())
    assert out.columns == ["part", "filter_order", "step", *fa.OUTCOMES]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_nulls_ties_repeats_and_clashing_names(spark):
    long = "word " * 80_000 + "OTHER # " * 3
    prose = " ".join(f"w{i}" for i in range(60))
    docs = [
        (1, None, "a", 7, "x"), (2, "", "a", None, None), (3, "   ", None, 1, ""), (4, prose, "a", 1, ""), (4, prose, "a", 1, ""), (5, prose, "", 1, ""),
        (6, prose, "b", 1, ""), (None, prose, "b", 1, ""), (None, prose, "b", 1, ""), (None, None, None, 1, ""), (7, long, "b", 1, ""),
        (8, long, "b", 1, ""), (-9, prose + " A#", "b", 1, ""), (10, "ÄÖ" * 40, "b", 1, ""), (11, "AB ab " * 60, "c", 1, ""), (4, "other", "c", 1, ""),
    ]
    labels = [(4, 1, None), (4, 0, 1), (6, None, 1), (None, 1, 1), (8, 1, 0), (99, 1, 1), (2, 1, 1)]
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_copies_in_hundreds_over_parts(spark):
    docs = [(i, f"same text {i % 3}" if i % 4 else f"own {i}", f"s{i % 5}", 0, "") for i in range(600)]
    labels = [(i, i % 2, i % 7 == 0) for i in range(0, 600, 2)]
    labels = [(i, q, int(t)) for i, q, t in labels]
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == set()
    assert audited(spark, [(1, "x", None, 0, "")], []) == plain([(1, "x", None, 0, "")], [])


def test_matrices():
    m = fa.matrices("ABCDE")
    assert m.kept.shape == m.shapley.shape == (32, 600)
    first = [i for i, s in enumerate(m.steps) if s == 1]
    assert (m.redundant[:, first] == 0).all()
    # Every document is removed once an order or is left after its last step.
    assert (m.removed.reshape(32, 120, 5).sum(axis=2) + m.kept[:, 4::5] == 1).all()
    assert (m.unique.sum(axis=1) == np.where(np.bitwise_count(np.arange(32)) == 1, 120, 0)).all()
    with pytest.raises(ValueError):
        fa.matrices("AA")


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "b b", None), (3, "a", None)], "k long, t string, p string")
    labels = spark.createDataFrame([], "k long, quality int, toxic int")
    out = fa.audit(docs, labels, [fa.Filter("x", F.size("words") > 1)], "y", "k", "t", "p")
    assert sorted((r.filter_order, r.step, r.kept, r.removed) for r in out.collect()) == [("xy", 1, 2, 1), ("xy", 2, 1, 1), ("yx", 1, 2, 1), ("yx", 2, 1, 1)]
