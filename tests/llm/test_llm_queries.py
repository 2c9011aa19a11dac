"""The queries against SQL or brute force on whole small tables."""

import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import assert_same, connect  # noqa: E402

from pathloom.llm import licenses, line_dups, mixing, quality_rules, registry, sharding, token_planes, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("select doc_id, text, source from documents order by doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    assert_same(registry.QUERIES[name](spark, sf), con, registry.ORACLES[name])


def test_all_queries_are_registered():
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES}) == list(range(1, 14))


def test_op3_equals_whole_text_encoding(spark, sf, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for doc_id, text, _ in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_planes.op3_token_planes(spark, sf).collect())) == want


def slow_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    hit = {k for i, g in enumerate(grams) if seen[g] > 1 for k in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_op4_statistics_and_verdict(spark, sf, con, docs):
    got = {r.doc_id: r for r in quality_rules.op4_quality_rules(spark, sf).collect()}
    for doc_id, text, _ in docs:
        r, want = got[doc_id], slow_stats(text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_op4_list_in_numpy_and_in_spark_agree_and_labels_are_met(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(docs, labels)
    assert rules
    judged = quality_rules.judge(docs.select("doc_id", "text"), rules).join(labels, "doc_id")
    rows = judged.select("kept_", "base_failed_", "quality", *[c.alias(f) for f, c in quality_rules.feature_columns().items()]).toPandas()
    x = rows[list(quality_rules.FEATURES)].to_numpy(float)
    rejected = np.zeros(len(x), bool)
    for rule in rules:
        rejected |= quality_rules.covers(rule, x)
    assert ((~rejected & ~rows["base_failed_"]) == rows["kept_"]).all()
    assert (rows["kept_"][rows["quality"] == 1]).mean() > 0.97
    assert (~rows["kept_"][rows["quality"] == 0]).mean() > 0.9


def test_op6_deviates_by_less_than_a_block(spark, sf, docs):
    units = {"=" + s: n for n, s in enumerate(sorted({d[2] for d in docs}), 1)}
    slots = mixing.edf_slots(units)
    total = sum(units.values())
    assert sorted(t for x in slots.values() for t in x) == list(range(total))
    for s, q in units.items():
        for t in range(total + 1):
            assert abs(sum(x < t for x in slots[s]) - t * q / total) < 1
    got = mixing.mix_sources(spark.read.parquet(f"{sf}/documents.parquet"), units, block=2).toPandas()
    for s, group in got.groupby("source"):
        assert sorted(group["source_rank"]) == list(range(len(group)))
        want = [slots["=" + s][(r // 2) % units["=" + s]] + (r // 2) // units["=" + s] * total for r in group["source_rank"]]
        assert want == group["slot"].tolist()
    assert len(got) == len(docs)


def test_op6_query_keeps_every_document(spark, sf, docs):
    got = mixing.op6_pfair_mix(spark, sf).toPandas()
    assert sorted(got["doc_id"]) == [d[0] for d in docs]
    assert not got.duplicated(["slot", "offset"]).any()


def test_op7_equals_brute_force(spark, docs):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = []
    sf = "/root/testdata/sf0.01"
    for doc_id, text in duckdb.execute(f"select doc_id, text from '{sf}/documents.parquet'").fetchall():
        for name, template in licenses.TEMPLATES.items():
            k = min(5, len(words(template)))
            own = runs(words(template), k)
            share = len(own & runs(words(text), k)) / len(own)
            if share >= 0.8:
                want.append((doc_id, name, round(share, 6)))
    got = licenses.op7_license_scan(spark, sf).select("doc_id", "template", "contained").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_op8_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op8_kneser_ney_toxicity(spark, sf)
    assert got.count() == 10_000
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").toPandas()
    ids = np.array([zlib.crc32(str(i).encode()) % 3 for i in rows["doc_id"]])
    assert (ids == 1).all() and rows["score"].between(0, 1).all()
    pos, neg = rows["score"][rows["toxic"] == 1], rows["score"][rows["toxic"] == 0]
    assert (pos.to_numpy()[:, None] > neg.to_numpy()[None, :]).mean() > 0.9
    assert (rows["toxic"][rows["predicted"] == 1]).mean() > 0.75


def test_op9_against_every_pair_of_lines(spark, sf, con):
    """Links are edit similarity >= 0.9; all pairs by DuckDB's levenshtein."""
    con.execute("""create table shown as select doc_id, generate_subscripts(l, 1) - 1 as line_no, unnest(l) as line from (
        select doc_id, string_split(trim(regexp_replace(lower(text), '[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', ' ', 'g')), chr(10)) as l
        from documents)""")
    con.execute("create table spelled as select doc_id, line_no, trim(line) as line from shown where trim(line) <> ''")
    near = con.execute("""with x as (select distinct line, length(line) as n from spelled where length(line) < 700)
        select a.line, b.line from x a join x b on a.line < b.line and abs(a.n - b.n) <= 0.1 * greatest(a.n, b.n)
        where levenshtein(a.line, b.line) <= 0.1 * greatest(a.n, b.n)""").fetchall()
    got = {(r.doc_id, r.line_no): (r.first_doc, r.first_line, r.kept) for r in line_dups.op9_fuzzy_lines(spark, sf).collect()}
    rows = con.execute("select doc_id, line_no, line from spelled").fetchall()
    assert {r[:2] for r in rows} == set(got)
    first = {line: got[(d, k)][:2] for d, k, line in rows}
    assert all(first[line] == got[(d, k)][:2] for d, k, line in rows)
    assert all(kept == ((d, k) == (a, b)) for (d, k), (a, b, kept) in got.items())
    assert len(near) > 20 and sum(first[a] == first[b] for a, b in near) >= 0.97 * len(near)
    head = {line: line for line in first}

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in near:
        head[top(a)] = top(b)
    spelled = {(d, k): line for d, k, line in rows}
    assert all(top(line) == top(spelled[f]) for line, f in first.items() if len(line) < 700 and len(spelled[f]) < 700)


def test_op9_block_keys_meet_within_the_distance():
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(300):
        a = int(rng.integers(0, 1 << line_dups.BITS))
        flips = rng.choice(line_dups.BITS, int(rng.integers(0, line_dups.DISTANCE + 1)), replace=False)
        rows.append((a, a ^ sum(1 << int(x) for x in flips)))
    a, b = np.array(rows).T
    for lines in (10, 1 << 21, 1 << 36):
        n = line_dups.blocks_for(lines)
        assert (n - line_dups.DISTANCE) * line_dups.BITS // n >= np.log2(lines) + line_dups.SPARE
        assert (line_dups.block_keys(a, n) == line_dups.block_keys(b, n)).any(axis=0).all()


def test_op10_law_and_slots(spark, sf, docs):
    got = sharding.op10_rendezvous_shards(spark, sf).toPandas().set_index("doc_id")
    moved = got[got["shard"] != got["grown_shard"]]
    assert (moved["grown_shard"] == 8).all() and 0 < len(moved) < 2 * len(docs) / 9
    for _, group in got.groupby("shard"):
        assert sorted(group["slot"]) == list(range(len(group)))
    for doc_id, text, _ in docs:
        raw = (text or "").encode()
        assert (got.loc[doc_id, "size"], got.loc[doc_id, "text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))


def test_op10_weights_are_met(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    share = rows.select(sharding.rendezvous(F.col("k"), [1.0, 3.0]).alias("s")).agg(F.avg("s")).first()[0]
    assert abs(share - 0.75) < 0.02
