"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pathloom.llm import (  # noqa: E402
    decontaminate, licenses, line_dups, mixing, near_dups, quality_rules, repeats, sharding, spark_tools, text_kernels, token_planes, toxicity,
)

LONG = " ".join(f"w{i}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 1),
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 1),
    (2, None, None, None, None),
    (None, "a text without an id that is long enough to be kept by any rule of these", "en", "a", 1),
    (None, "a text without an id that is long enough to be kept by any rule of these", "en", "a", 1),
    (None, None, None, "b", None),
    (3, "", "en", "b", 0),
    (4, " \t\n \r\n", "en", "", 0),
    (5, LONG, "en", "b", len(LONG)),
    (6, LONG + " tail", "en", "b", len(LONG)),
    (7, "Ünïcode   and 　 spaces  twice\n\n\nlines end <|endoftext|> 😀", "xx", "b", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, None), (None, "Without AN id"), (3, ""), (1, "without an ID")],
        "item_id long, text string",
    )


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (5, 0, 1), (5, 1, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")


def clash(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df


def test_decontamination(docs, empty, items, spark):
    got = {(r.doc_id, r.text): r for r in decontaminate.find(docs, items).collect()}
    one = got[(1, ROWS[0][1])]
    assert one.hit_words == list(range(1, 14)) and one.item_ids == ["1"]
    span = one.spans[0]
    assert ROWS[0][1][span.start_char : span.end_char].startswith("two") and ROWS[0][1].endswith("fourteen")
    assert got[(None, ROWS[3][1])].item_ids == ["1", "null"]
    assert got[(2, None)].n_words == 0 and got[(2, None)].spans == []
    kept = decontaminate.decontaminate(clash(docs, "n_words", "spans"), items)
    assert {r.n_words for r in kept.collect()} == {"mine"} and kept.where("doc_id = 1").count() == 0
    assert kept.columns == [*docs.columns, "n_words", "spans"]
    assert decontaminate.find(empty, items).count() == 0
    assert decontaminate.find(docs, items.limit(0)).where("size(item_ids) > 0").count() == 0


def test_spans_are_the_words_of_the_original(spark):
    text = "Çà et là — 'Ünï 13 CôTé', voilà 😀 the Ünï 13 CôTÉ"
    docs = spark.createDataFrame([(1, text), (2, "ünï 13"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", "Ünï, 13"), ("b", "13"), ("c", "ÜnÏ 13"), ("d", "ÜNï 13 côté"), ("e", "Ünï 13 CôTé")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.find(docs, items).collect()}
    shown = sorted((s.item_id, text[s.start_char : s.end_char]) for s in got[1].spans)
    assert shown == [("a", "Ünï 13"), ("a", "Ünï 13"), ("b", "13"), ("b", "13"), ("d", "Ünï 13 CôTé"), ("e", "Ünï 13 CôTé")]
    assert got[2].item_ids == ["b"] and got[3].item_ids == []


def test_decontamination_in_blocks_is_the_same(docs, items, monkeypatch):
    want = sorted(map(str, decontaminate.find(docs, items, spans=False).collect()))
    monkeypatch.setattr(decontaminate, "MAX_BLOCK_BYTES", 20)
    assert sorted(map(str, decontaminate.find(docs, items, spans=False).collect())) == want


def test_near_dups(docs, empty, spark):
    got = near_dups.classes(docs).collect()
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[5].component_id == by_id[6].component_id == 5
    assert by_id[2].component_id == 2 and by_id[2].n_shingles == 0
    kept = near_dups.keep_first(clash(docs, "kept_id", "shard", "rep"))
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert [x for none, x in ids if not none] == [1, 2, 3, 4, 5, 7] and sum(none for none, _ in ids) == 3
    assert near_dups.classes(empty).count() == 0 and near_dups.keep_first(empty).count() == 0


def test_near_dups_of_one_id_with_several_texts(spark):
    rows = [(1, "one text of some words here", "a"), (1, "quite another text with other words", "b"), (1, "one text of some words here", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_row string")
    kept = {tuple(map(tuple, near_dups.keep_first(docs.repartition(n)).collect())) for n in (1, 3)}
    assert len(kept) == 1 and len(kept.pop()) == 1


def test_near_dups_dense_clusters_in_blocks(spark, monkeypatch):
    """Many copies with edits around the threshold, against all pairs."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(90):
        words = list(base)
        for k in rng.choice(120, int(rng.integers(1, 7)), replace=False):
            words[k] = f"x{i}y{k}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(118)} for t in texts]
    head = list(range(90))
    for i in range(90):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = head[i], head[j]
                head = [min(a, b) if h in (a, b) else h for h in head]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for settings in ({}, {"PAIRS_A_POSTING": -1, "BLOCK": 16}, {"PAIRS_A_POSTING": 0, "STAR_ROUNDS": 0, "BLOCK": 16}):
        for name, value in settings.items():
            monkeypatch.setattr(near_dups, name, value)
        got = {r.doc_id: r.component_id for r in near_dups.classes(docs, size=3, limit=(85, 100)).collect()}
        assert [got[i] for i in range(90)] == head


def test_token_planes(docs, empty, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    spec = Path(path).read_text()
    chunks = token_planes.write_chunks(clash(docs, "chunk", "ids"), spec, 2)
    index = token_planes.write_index(chunks)
    got = token_planes.read_documents(chunks, index).orderBy("start").collect()
    assert [r.doc_id for r in got][:3] == [None, None, None] and len(got) == len(ROWS)
    t = Tokenizer.from_file(path)
    for doc_id, text, *_ in ROWS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert any((r.doc_id, r.n_tokens, r.ids_crc32) == (doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in got)
    ends = [r.start + r.n_tokens for r in got]
    assert [r.start for r in got] == [0, *ends[:-1]]
    assert index.agg(F.sum("n_ids"), F.sum("n_docs")).first()[:] == (ends[-1], len(ROWS))
    none = token_planes.write_chunks(empty, spec, 2)
    assert token_planes.read_documents(none, token_planes.write_index(none)).count() == 0


def morse(first, other, rounds):
    """Words that sums of powers modulo 2**64 can't tell apart: Thue and Morse's."""
    a, b = first, other
    for _ in range(rounds):
        a, b = a + b, b + a
    return a, b


def test_morse_words_are_told_apart(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    pair = morse("a", "b", 10)
    w = next(text_kernels.words(pa.array(pair)))
    assert w.hashes[0] != w.hashes[1]
    a, b = morse(["xa"], ["yb"], 10)
    texts = [f"one {pair[0]} two", f"one {pair[1]} two", " ".join(a), " ".join(b)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in near_dups.classes(docs, size=3).orderBy("doc_id").collect()][:2] == [0, 1]
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    chunks = token_planes.write_chunks(docs, Path(path).read_text(), 2)
    got = {r.doc_id: r.ids_crc32 for r in token_planes.read_documents(chunks, token_planes.write_index(chunks)).collect()}
    for i, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert got[i] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(text_kernels, "_hash_blocks", lambda blocks, inner, n, sizes: np.full(len(n), 7, np.uint64))
    encoder = token_planes.PieceEncoder(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(), 2)
    texts = ["some words of which", "each has one hash", "", "some some"]
    ids, counts = encoder.encode(next(text_kernels.words(pa.array(texts), stops=True)))
    want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("n", [0, 1, 7, 100, 4096, 10_001])
def test_planes_round_trip(bits, n):
    for top in (1, 2, 50_000, 1 << 20, 1 << 32):
        ids = np.random.default_rng(n).integers(0, top, n, np.uint64).astype(np.uint32)
        assert (token_planes.unpack(token_planes.pack(ids, bits, 4096)) == ids).all()
    with pytest.raises(ValueError):
        token_planes.pack(np.zeros(1, np.uint32), 3)
    with pytest.raises(ValueError):
        token_planes.unpack(b"x" * 64)


def test_pieces_are_forgotten_and_learned_again(monkeypatch):
    import public_tokenizers

    spec = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    texts = [f"some words, {i} and.\nmore of them.. {i * 7}, it's. é. x," for i in range(300)]
    want = token_planes.PieceEncoder(spec, 2).tokenizer
    monkeypatch.setattr(token_planes, "PIECES", 200)
    monkeypatch.setattr(text_kernels, "SLICE_BYTES", 500)
    encoder, got = token_planes.PieceEncoder(spec, 2), []
    encoder.uses = np.zeros(200 + 504, np.int32)
    for w in text_kernels.words(pa.array(texts), stops=True):
        ids, counts = encoder.encode(w)
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [[*want.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_quality_rules(docs, empty, labels):
    rules = quality_rules.fit(docs, labels)
    kept = quality_rules.keep_good(clash(docs, "stats_", "kept_"), labels)
    assert kept.columns == [*docs.columns, "stats_", "kept_"]
    assert kept.where("doc_id in (2, 3, 4)").count() == 0 and kept.where("doc_id = 1").count() == 2
    assert quality_rules.judge(empty, rules).count() == 0
    assert quality_rules.fit(docs, labels.limit(0)) == []
    assert quality_rules.keep_good(docs, labels.limit(0)).where("doc_id = 5").count() == 1


def test_repeats(docs, empty, spark):
    got = sorted((r.doc_id, r.first_word, r.end_word) for r in repeats.passages(clash(docs, "place", "doc")).collect())
    assert got == [(5, 0, 30_000), (6, 0, 30_000)]
    assert repeats.passages(empty).count() == 0
    signed = [(-5, LONG), (-6, LONG), (None, LONG + " b"), (None, LONG + " a")]
    found = repeats.passages(spark.createDataFrame(signed, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == [(False, -6), (False, -5), (True, 0), (True, 0)]
    own = [(1, " ".join(["again"] * 200)), (2, " ".join(f"u{i}" for i in range(49)))]
    assert repeats.passages(spark.createDataFrame(own, "doc_id long, text string")).count() == 0


def test_repeats_of_exactly_fifty_words_and_one_less(spark):
    passage = [f"p{i}" for i in range(50)]
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(20 * i)] + passage + [f"z{i}x{k}" for k in range(30)])) for i in range(4)]
    rows.append((9, " ".join(passage[:49] + ["else"] * 60)))
    got = sorted((r.doc_id, r.first_word, r.end_word) for r in repeats.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(i, 20 * i, 20 * i + 50) for i in range(4)]


def test_mixing(docs, empty):
    names = ("slot", "source_key", "g_", "b_", "bucket", "plan_source", "plan_slots", "plan_own", "n")
    got = mixing.mix_sources(clash(docs, *names)).collect()
    assert len(got) == len(ROWS) and {r.source_key for r in got} == {"mine"}
    assert len({(r.slot, r.offset) for r in got}) == len(ROWS)
    assert mixing.mix_sources(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"=a": 1})


def test_small_sources_share_units(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    rows = [(100 * k + i, "t", f"s{k}") for k in range(8) for i in range(4 * k + 1)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=1).collect()
    assert len(got) == len(rows) and len({r.slot for r in got}) == len(rows)
    units = mixing.temperature_units({f"=s{k}": 4 * k + 1 for k in (5, 6, 7)}, others=sum((4 * k + 1) ** 0.5 for k in range(5)))
    slots = mixing.edf_slots(units)
    small = sorted(r.slot for r in got if r.source in ("s0", "s1", "s2", "s3", "s4"))
    assert small == slots[mixing.OTHERS][: len(small)]


def test_licenses(docs, empty, spark):
    rows = spark.createDataFrame([(1, "x Released under the MIT License. y"), (1, "Released under the MIT License."), (2, "MIT License"), (3, None)], "doc_id long, text string")
    got = licenses.scan(clash(rows, "template", "doc_row")).collect()
    assert sorted((r.doc_id, r.template, r.first_word) for r in got) == [(1, "MIT", 0), (1, "MIT", 1)]
    assert licenses.scan(docs).count() == 0 and licenses.scan(empty).count() == 0
    short = licenses.scan(rows, {"two": "mit license", "none": "--", "long": "a b c d e f g h"}).collect()
    assert sorted((r.doc_id, r.template) for r in short) == [(1, "two"), (1, "two"), (2, "two")]
    assert licenses.scan(rows, {}).count() == 0


def test_licenses_with_edits(spark):
    words = licenses.TEMPLATES["MIT text"].split()
    words[20] = "other"
    docs = spark.createDataFrame([(1, "before " + " ".join(words) + " after"), (2, " ".join(words[:25]))], "doc_id long, text string")
    assert [(r.doc_id, r.template) for r in licenses.scan(docs).collect()] == [(1, "MIT text")]


def test_toxicity(docs, empty, labels):
    scorer = toxicity.fit(docs, labels)
    got = toxicity.score_documents(clash(docs, "score"), scorer).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(empty, scorer).count() == 0
    assert {r.score for r in toxicity.score_documents(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


def test_toxicity_never_learns_from_held_out_labels(spark):
    rows = [(i, f"some ordinary words {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    scores = []
    for value in (0, 1):
        labels = spark.createDataFrame([(i, value if held(i) else 0) for i, _ in rows], "doc_id long, toxic int")
        scores.append(sorted(r.score for r in toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()))
    assert scores[0] == scores[1] and set(scores[0]) == {0.0}


def test_kneser_ney_scores_equal_plain_python(spark):
    """Evidence of words against dictionaries of counts, by the definition."""
    texts = {0: "aba abc cab bca abcab", 1: "bad bed bid abd badbad"}
    corpus = "aba abc cab bad bed other words badly aba bade"
    docs = spark.createDataFrame([(corpus,), (None,), (texts[0],), (texts[1],)], "text string")
    counted = toxicity._counted(spark.createDataFrame([(t, y) for y, t in texts.items()], "text string, label int"))
    orders = toxicity.Models.class_orders(counted)
    models = toxicity.Models.build(orders, toxicity._reached(toxicity.shared_grams(docs), [x[2] for x in orders[: toxicity.SHARED - 1]]))

    def grams(words, longest):
        out = {}
        for word in words:
            letters = "^" + word + "^"
            for i in range(1, len(letters)):
                g = letters[max(0, i - longest + 1) : i + 1]
                out[g] = out.get(g, 0) + 1
        return out

    def by_order(full, longest, lowest):
        tables, above = {}, {}
        for k in range(longest, lowest - 1, -1):
            now = {g: n for g, n in full.items() if len(g) == k}
            for g in above:
                now[g[1:]] = now.get(g[1:], 0) + 1
            tables[k] = above = now
        return tables

    def mixed(table, g, below):
        own = {x: n for x, n in table.items() if x[:-1] == g[:-1]}
        once, twice = (sum(n == k for n in table.values()) for k in (1, 2))
        d = min(0.95, once / (once + 2 * twice)) if once else 0.5
        total = sum(own.values())
        if not total:
            return below
        return max(own.get(g, 0) - d, 0) / total + sum(min(n, d) for n in own.values()) / total * below

    words = " ".join([corpus, *texts.values()]).split()
    shared = by_order(grams(words, toxicity.SHARED), toxicity.SHARED, 3)
    pairs = {}
    for g, n in grams(words, toxicity.SHARED).items():
        pairs[g[-2:]] = pairs.get(g[-2:], 0) + n
    classes = {y: by_order(grams(t.split(), toxicity.ORDER), toxicity.ORDER, 2) for y, t in texts.items()}

    def loglik(word, y):
        letters, total = "^" + word + "^", 0.0
        for i in range(1, len(letters)):
            g = letters[max(0, i - toxicity.ORDER + 1) : i + 1]
            row = sum(n for x, n in pairs.items() if x[0] == g[-2])
            both = p = (pairs.get(g[-2:], 0) + 0.01) / (row + 2.56)
            for k in range(2, len(g) + 1):
                if 2 < k <= toxicity.SHARED:
                    both = mixed(shared[k], g[-k:], both)
                p = mixed(classes[y][k], g[-k:], both if k <= toxicity.SHARED else p)
            total += np.log(p)
        return total

    asked = ["aba", "abc", "bad", "bed", "badly", "cabbad", "ab", "b", "abdabc"]
    w = next(text_kernels.words(pa.array([" ".join(asked)]), lower=True, between=text_kernels.MARKS))
    got = models.evidence(w, np.arange(len(asked)))
    assert np.allclose(got, [loglik(x, 1) - loglik(x, 0) for x in asked], atol=1e-4)


def test_lines(docs, empty, spark):
    rows = [(1, "Same line here\n\n--\nsame LINE, here"), (1, "same line here"), (None, "same line here"), (2, None), (3, "")]
    got = line_dups.line_groups(clash(spark.createDataFrame(rows, "doc_id long, text string"), "line", "bits")).collect()
    assert len(got) == 4 and sum(r.kept for r in got) == 1
    assert {(r.first_doc, r.first_line) for r in got} == {(1, 0)}
    assert line_dups.line_groups(empty).count() == 0 and line_dups.line_groups(docs).count() > 0


def test_lines_are_dropped_from_documents(spark, empty):
    rows = [(1, "Same line here\n--\n\nsame LINE, here\nmore"), (4, "same line here"), (None, "another"), (2, None), (2, None), (3, "")]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string"), "line_row", "lines_gone")
    got = line_dups.drop_repeated_lines(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, [r.text for r in got.collect()])) == sorted(["Same line here\n--\n\nmore", "", "another", "None", "None", ""])
    assert line_dups.drop_repeated_lines(empty).count() == 0


def test_line_simhash():
    words = [f"w{i}word" for i in range(12)]
    lines = line_dups.Lines([" ".join(words), " ".join(words[::-1] + words[:3])])
    hashes = [int(h) for h in lines.words[:12]]
    got, same = (int(x) for x in lines.simhash())
    assert got == same == sum(1 << k for k in range(line_dups.BITS) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_line_spelling_and_distance():
    texts = ["Same, LINE \u2014 here\n\n--\n\u00dcber  \u4e2d\u6587\U0001f600!", "", "\n", "x\ty"]
    owner, line_no, lines = line_dups.spelled(texts)
    assert list(zip(owner, line_no, lines.to_pylist())) == [(0, 0, "same line here"), (0, 3, "\u00fcber \u4e2d\u6587\U0001f600"), (3, 0, "x y")]
    rng = np.random.default_rng(4)
    for _ in range(2000):
        a, b = ("".join(rng.choice(list("ab"), rng.integers(0, 9))) for _ in "ab")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert [line_dups.within(a, b, k) for k in range(9)] == [row[-1] <= k for k in range(9)]


def test_sharding(docs, empty, tmp_path, spark):
    got = sharding.shard_documents(clash(docs, "shard", "bucket", "g_", "b_", "bucket_group"), [1.0, 2.0, 1.0])
    rows = got.collect()
    assert len(rows) == len(ROWS) and {r.bucket for r in rows} == {"mine"}
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_documents(empty, [1.0]).count() == 0
    sharding.write_shards(got, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ROWS)
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit("x"), [0.0])


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    got = dict(spark_tools.components(spark.createDataFrame([*path, *star, (7, 7)], "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}}
    assert spark_tools.components(spark.createDataFrame([], "a long, b long")).count() == 0
