"""That operators do the whole job, against brute force."""

import re
import sys
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pathloom.llm import licenses, line_dups, near_dups, text_kernels  # noqa: E402


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_op9_finds_lines_within_a_tenth_by_edits(spark):
    """Short and long lines with a letter, a word or several letters changed."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abdeghilmnorstu"), rng.integers(2, 10)))
    lines = []
    for n in [1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 20, 27, 35] * 3:
        line = " ".join(word() for _ in range(n))
        k = int(rng.integers(len(line)))
        words = line.split(" ")
        words[int(rng.integers(n))] = "other"
        many = list(line)
        for i in rng.choice(len(line), max(len(line) // 20, 1), replace=False):
            many[i] = "q"
        lines += [line, line[:k] + "q" + line[k + 1 :], line[:k] + line[k + 1 :], " ".join(words), "".join(many)]
    lines = [x for x in dict.fromkeys(re.sub(" +", " ", x).strip() for x in lines) if x]
    near = [(a, b) for a, b in combinations(lines, 2) if abs(len(a) - len(b)) <= 0.1 * max(len(a), len(b)) and distance(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9)]
    assert len(near) > 200
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    first = {lines[r.doc_id]: r.first_doc for r in line_dups.line_groups(docs).collect()}
    assert sum(first[a] == first[b] for a, b in near) >= 0.99 * len(near)
    head = {x: x for x in lines}

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in near:
        head[top(a)] = top(b)
    assert all(top(lines[i]) == top(x) for x, i in first.items())  # nothing else is linked


def test_op7_single_shingle_templates_always_meet(spark):
    """Verbatim templates of one shingle, within texts and where they begin."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(3000):
        lead = [f"a{x}" for x in rng.integers(0, 1 << 40, i % 2 * 6)]
        rows.append((i, " ".join([*lead, "Released under the MIT License.", *(f"z{x}" for x in rng.integers(0, 1 << 40, 6))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan(docs, {"MIT": licenses.TEMPLATES["MIT"]}).collect()
    assert sorted((r.doc_id, r.first_word) for r in got) == [(i, i % 2 * 6) for i in range(3000)]


def test_op7_bands_are_independent(spark):
    """A window of two random shingles has its least in a band with chance 1/2."""
    rng = np.random.default_rng(12)
    runs = rng.integers(-(1 << 63), 1 << 63, (20_000, 2)).tolist()
    df = spark.createDataFrame([(r,) for r in runs], "s array<bigint>")
    left = [licenses.band_keys(F.col("s"), b)[0] == licenses.band_keys(F.slice("s", 1, 1), b)[0] for b in range(licenses.BANDS)]
    n = df.select(sum(x.cast("int") for x in left).alias("n")).groupBy("n").count().collect()
    share = {r["n"]: r["count"] / 20_000 for r in n}
    assert share[0] < 0.025 and share[licenses.BANDS] < 0.025  # 1/64 if independent


def test_near_dups_at_the_default_threshold(spark):
    """A pair at 0.8 whose signatures agree on fewer than 40 of 64 coordinates."""
    for seed in range(5000):
        words = [f"s{seed}w{i}" for i in range(104)]
        texts = [" ".join(words), " ".join(words[:84])]
        w = next(text_kernels.words(pa.array(texts), lower=True))
        a, b = (near_dups.shingle_set(w.hashes[w.bounds[i] : w.bounds[i + 1]], 5) for i in (0, 1))
        if 35 <= (near_dups.signature(a) == near_dups.signature(b)).sum() < 40:
            break
    else:
        raise AssertionError("no such pair")
    assert (len(a), len(b), len(np.intersect1d(a, b))) == (100, 80, 80)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in near_dups.classes(docs).collect()] == [0, 0]
    assert near_dups.matches((85, 100)) == 40 and near_dups.matches((80, 100)) == 35
