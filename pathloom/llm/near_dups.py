"""Operator 2: MinHash near-duplicates by an inverted join on signature
coordinates.

1. One pass over the texts gives each document its shingle set's size, a
   128-bit fingerprint of the whole set and a signature of COORDINATES minima.
   Documents with equal sizes and fingerprints become one representative (with
   10**10 sets, the chance that any two unlike ones have one is 2e-19).
2. Representatives are posted under each (coordinate, value) pair.  Pairs that
   occur once can't collide and fall away in the count; a representative with
   fewer than MATCHES pairs left can't match anyone.  Of the m left, in
   ascending order of frequency, only the first m - MATCHES + 1 are kept: two
   signatures that agree on MATCHES coordinates share one of these (prefix).
   The long lists are the ones skipped; their collisions are counted from the
   signatures of a candidate pair instead.
3. A list names candidates.  While its lists would give many pairs, a round
   only pairs their members with a few leaders, others each round; confirmed
   links join groups, and only pairs across groups are still of interest, so
   large groups of near copies close without being paired up.  When rounds no
   longer help, what is left is checked exactly: lists that overlap form a
   cluster; a cluster with few pairs is joined by list; one with many is dealt
   into blocks, and each pair of blocks is compared in a task of its own, which
   emits one link for two groups at most and no pairs.
4. A candidate that agrees on MATCHES coordinates is confirmed on the full
   sets of 64-bit shingle hashes, and confirmed links give the components.  The
   same two tests decide in every round and in the blocks, so which links there
   are doesn't depend on a cluster's size.

MATCHES stands for ``matches(limit)``: of the pairs at the threshold itself no
more than MISSED agree on fewer coordinates.  At 0.85 these are 40 of 64 (a
chance of 2.4e-6), at 0.8 they are 35 (1.2e-6).

Defined cases: texts without words, null texts: an empty set, no links; rows
with equal sets are one class, repeated rows among them; a null doc_id takes
part but names a class only if no other row does, and is kept only then; an
empty table gives an empty result; extra columns aren't read by ``classes`` and
pass through ``keep_first``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm import text_kernels as tk
from pathloom.llm.spark_tools import components, fresh, materialize

COORDINATES = 64
#: Chance at most that a pair at the threshold agrees on too few coordinates.
MISSED = 2.5e-6
#: Leaders of a list in a round (two for each hash), and rounds at most.
LEADER_HASHES = 3
STAR_ROUNDS = 4
#: A round has to do away with this share of the pairs, or it is the last.
STAR_GAIN = 0.2
#: Pairs across groups are joined up to so many a posting, beyond in blocks of about BLOCK rows.
PAIRS_A_POSTING = 2
BLOCK = 384
#: References to representatives' texts that may be broadcast (some 40 MB); more
#: are joined by a shuffle.
BROADCAST_REFS = 400_000

_draw = np.random.default_rng(20240611)
_XOR = _draw.integers(0, 1 << 32, (COORDINATES, 1), np.uint32)
_ODD = _draw.integers(0, 1 << 32, (COORDINATES, 1), np.uint32) | np.uint32(1)
_EACH = np.arange(COORDINATES)
_PRINT = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))


def matches(limit: tuple[int, int]) -> int:
    """Coordinates that a pair has to agree on for this threshold."""
    p, below = limit[0] / limit[1], 0.0
    for k in range(COORDINATES):
        below += math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if below > MISSED:
            return max(k, 1)
    return COORDINATES


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingle hashes of a document, sorted; fewer words than ``size``
    are one shingle, no words are none."""
    if 0 < len(hashes) < size:
        return tk.shingles(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return _distinct(tk.shingles(hashes, size))


def _distinct(hashes: np.ndarray) -> np.ndarray:
    hashes = np.sort(hashes)
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    return hashes[new]


def _sets_of(w: tk.Words, size: int) -> Iterator[np.ndarray]:
    """The shingle set of each text of a slice."""
    every = tk.shingles(w.hashes, size)
    for start, stop in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        whole = stop - start >= size
        yield _distinct(every[start : stop - size + 1]) if whole else shingle_set(w.hashes[start:stop], size)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Of a set, for each coordinate, the shingle whose upper half has the least
    value under that coordinate's permutation: its lower half.  The minima
    themselves crowd near zero, so with millions of sets unlike ones would meet
    under them; lower halves are spread over all 32 bits."""
    upper, lower = (shingles >> np.uint64(32)).astype(np.uint32), shingles.astype(np.uint32)
    least, out = np.full(COORDINATES, np.iinfo(np.uint32).max), np.full(COORDINATES, lower[0])
    for at in range(0, len(upper), 1024):
        values = upper[at : at + 1024] ^ _XOR
        values *= _ODD
        place = values.argmin(axis=1)
        found = values[_EACH, place]
        less = found < least
        least, out = np.where(less, found, least), np.where(less, lower[at : at + 1024][place], out)
    return out.astype(np.uint32).view(np.int32)


def fingerprint(shingles: np.ndarray) -> list[int]:
    """128 bits that depend on the set alone."""
    parts = np.array([tk.mix(shingles ^ p).sum(dtype=np.uint64) for p in _PRINT])
    return tk.mix(parts + np.uint64(len(shingles))).view(np.int64).tolist()


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, ref, n_shingles, fp1, fp2, sig of docs(doc_id, ref, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes, prints = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
            sigs = np.zeros((n, COORDINATES), np.int32)
            for w in tk.words(batch.column(2), lower=True):
                for i, have in enumerate(_sets_of(w, size)):
                    if len(have):
                        row = w.first_row + i
                        sizes[row], sigs[row], prints[row] = len(have), signature(have), fingerprint(have)
            offsets = pa.array(np.arange(0, (n + 1) * COORDINATES, COORDINATES, dtype=np.int32))
            new = [sizes, prints[:, 0], prints[:, 1]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *map(pa.array, new), pa.ListArray.from_arrays(offsets, pa.array(sigs.ravel()))],
                names=["doc_id", "ref", "n_shingles", "fp1", "fp2", "sig"],
            )

    return docs.mapInArrow(run, "doc_id bigint, ref string, n_shingles bigint, fp1 bigint, fp2 bigint, sig array<int>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """rep, shingles (64-bit hashes) of docs(rep, fp1, fp2, text), of the texts
    with these fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, *prints = (batch.column(i).to_pylist() for i in range(3))
            for w in tk.words(batch.column(3), lower=True):
                reps, sets = [], []
                for i, have in enumerate(_sets_of(w, size)):
                    row = w.first_row + i
                    if fingerprint(have) == [prints[0][row], prints[1][row]]:
                        reps.append(asked[row])
                        sets.append(have)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), lists], names=["rep", "shingles"])

    return docs.mapInArrow(run, "rep bigint, shingles array<bigint>")


def _prefixes(reps: DataFrame, least: int) -> DataFrame:
    """(list_key, rep, n_shingles): the postings under the prefixes."""
    key = F.shiftleft(F.col("c").cast("long"), 32) + F.col("v")
    pairs = reps.select("rep", F.posexplode("sig").alias("c", "v")).select("rep", key.alias("list_key")).repartition("list_key")
    # A representative is in a list once.  Both columns are read here, so that counting and joining read one shuffle.
    counts = pairs.groupBy("list_key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    kept = pairs.join(counts.where("lo <> hi").select("list_key", "n").hint("shuffle_hash"), "list_key")
    by_rep = W.partitionBy("rep")
    ranked = kept.select(
        "rep",
        "list_key",
        F.row_number().over(by_rep.orderBy("n", "list_key")).alias("r"),
        F.count(F.lit(1)).over(by_rep).alias("m"),
    )
    first = ranked.where(F.col("r") <= F.col("m") - (least - 1)).select("list_key", "rep")
    return first.join(reps.select("rep", "n_shingles"), "rep").select("list_key", "rep", "n_shingles")


def _agree(a: Column, b: Column) -> Column:
    """Coordinates on which two signatures collide."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _confirm(pairs: DataFrame, full: DataFrame, limit: tuple[int, int]) -> DataFrame:
    """The pairs(a, b) that agree on MATCHES coordinates and are linked; full
    has rep, sig and shingles."""
    sides = [full.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab"]
    near = pairs.join(sides[0], "a").join(sides[1], "b").where(_agree(F.col("sig_a"), F.col("sig_b")) >= matches(limit))
    near = near.select("a", "b")
    sets = [full.select(F.col("rep").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab"]
    both = near.join(sets[1], "b").join(sets[0], "a").select(
        "a",
        "b",
        F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("common"),
        (F.size("set_a") + F.size("set_b")).cast("long").alias("total"),
    )
    return both.where(F.col("common") * limit[1] >= (F.col("total") - F.col("common")) * limit[0]).select("a", "b")


def _grouped(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """list_key, rep, n_shingles, grp of the lists that hold several groups."""
    named = postings.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "list_key", "rep", "n_shingles", F.coalesce("root", "rep").alias("grp")
    )
    open_ = named.groupBy("list_key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi")
    return named.join(open_.select("list_key"), "list_key")


def _pairs_left(lists: DataFrame) -> int:
    """Pairs across groups in all lists, those in several lists counted again."""
    sizes = lists.groupBy("list_key", "grp").agg(F.count(F.lit(1)).cast("double").alias("n"))
    each = sizes.groupBy("list_key").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return int(each.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0)


def _sized(a: str, b: str, limit: tuple[int, int]) -> Column:
    """Whether two sets of these sizes can be linked at all."""
    return F.least(a, b) * limit[1] >= F.greatest(a, b) * limit[0]


def _star_pairs(lists: DataFrame, number: int, limit: tuple[int, int]) -> DataFrame:
    """Each representative with the leaders, in other groups, of one of its
    lists: the longest, among equals another one each round."""
    sizes = lists.groupBy("list_key").agg(F.count(F.lit(1)).alias("n"))
    longest = W.partitionBy("rep").orderBy(F.desc("n"), F.xxhash64("list_key", F.lit(number)))
    one = lists.join(sizes, "list_key").withColumn("r", F.row_number().over(longest)).where("r = 1")
    leaders = []
    for k in range(LEADER_HASHES):
        draw = F.struct(F.xxhash64("rep", F.lit(number), F.lit(k)).alias("h"), "rep", "grp", "n_shingles")
        leaders += [F.min(draw), F.max(draw)]
    led = one.groupBy("list_key").agg(F.array_distinct(F.array(*leaders)).alias("leaders"))
    both = one.join(led.select("list_key", F.explode("leaders").alias("lead")), "list_key")
    far = both.where((F.col("grp") != F.col("lead.grp")) & _sized("n_shingles", "lead.n_shingles", limit))
    return far.select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b"))


def _all_pairs(lists: DataFrame, limit: tuple[int, int]) -> DataFrame:
    """Every pair across groups within a list."""
    sides = [lists.select("list_key", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "n_shingles", "grp")]) for x in "ab"]
    far = (F.col("grp_a") < F.col("grp_b")) & _sized("n_shingles_a", "n_shingles_b", limit)
    return sides[0].join(sides[1], "list_key").where(far).select(
        F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")
    )


def _compare_blocks(limit: tuple[int, int]):
    """An applyInArrow function over (side, rep, grp, sig, shingles) of two blocks
    (sides 0 and 1, or one block of side 0): a link for two groups at most."""
    num, den = limit
    least = matches(limit)

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        table, side = table.take(pa.array(order)), side[order]
        reps, grps = table["rep"].to_numpy(), table["grp"].to_numpy()
        lists = table["shingles"].combine_chunks()
        sigs = table["sig"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        _, column, seen = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(reps)), sizes)
        useful = seen[column] > 1  # a shingle of one set is in no intersection
        row, column = row[useful], column[useful]
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        one, two = (side == 0), (side == 1) if side[-1] else (side == 0)
        common = np.zeros((int(one.sum()), int(two.sum())))
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, [low, low + 4096])
            held = np.zeros((len(reps), 4096), np.float32)
            held[row[a:b], column[a:b] - low] = 1
            common += held[one] @ held[two].T
        total = sizes[one][:, None] + sizes[two][None, :] - common
        linked = (den * common >= num * total) & (grps[one][:, None] != grps[two][None, :])
        i, j = np.nonzero(linked)
        agree = np.concatenate([(sigs[one][i[k : k + 65536]] == sigs[two][j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)] or [i])
        i, j = i[agree >= least], j[agree >= least]
        codes = np.stack([np.minimum(grps[one][i], grps[two][j]), np.maximum(grps[one][i], grps[two][j])])
        _, first = np.unique(codes, axis=1, return_index=True)
        return pa.table({"a": reps[one][i[first]], "b": reps[two][j[first]]})

    return run


def _small(df: DataFrame, label: str) -> DataFrame:
    """``df`` written, and broadcast if it has few rows, so that a join with it
    needn't bring a large cluster together."""
    out = materialize(df, label)
    return F.broadcast(out) if out.count() <= BROADCAST_REFS else out


def _block_links(members: DataFrame, full: DataFrame, limit: tuple[int, int]) -> DataFrame:
    """Links across the groups of each cluster; members(cluster, rep, grp)."""
    sizes = members.groupBy("cluster", "grp").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("cluster").agg(
        F.max_by("grp", F.struct("n", "grp")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all")
    )
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    placed = members.join(_small(whole, "near-cluster-sizes"), "cluster").select(
        "cluster",
        "rep",
        "grp",
        (F.col("grp") == F.col("main")).alias("of_main"),
        blocks(F.col("n_main")).alias("mains"),
        F.greatest(blocks(F.col("n_all") - F.col("n_main")), F.lit(1)).alias("others"),
    )
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("of_main"), F.col("mains")).otherwise(F.col("others")))
    placed = placed.withColumn("mine", mine.cast("int"))
    # The main group meets the other blocks; those meet the main blocks, themselves and each other.
    each = lambda n: F.sequence(F.lit(0), n - 1)
    task = lambda i, j, main, side: F.struct(i.alias("i"), j.alias("j"), F.lit(main).alias("m"), side.alias("side"))
    me, zero, last = F.col("mine"), F.lit(0), F.lit(1)
    main_tasks = F.transform(each(F.col("others")), lambda k: task(k, me, True, last))
    other_tasks = F.concat(
        F.transform(each(F.col("mains")), lambda k: task(me, k, True, zero)),
        F.transform(
            each(F.col("others")),
            lambda k: task(F.least(me, k), F.greatest(me, k), False, F.when(me > k, last).otherwise(zero)),
        ),
    )
    dealt = placed.join(full.select("rep", "sig", "shingles"), "rep").select(
        "cluster", "rep", "grp", "sig", "shingles", F.explode(F.when(F.col("of_main"), main_tasks).otherwise(other_tasks)).alias("t")
    )
    rows = dealt.select("cluster", "t.i", "t.j", "t.m", "t.side", "rep", "grp", "sig", "shingles")
    return rows.groupBy("cluster", "i", "j", "m").applyInArrow(_compare_blocks(limit), "a bigint, b bigint")


def _rest_links(lists: DataFrame, tried: DataFrame, full: DataFrame, limit: tuple[int, int]) -> DataFrame:
    """All links across groups between members of a common list."""
    heads = lists.groupBy("list_key").agg(F.min("rep").alias("head"))
    edges = lists.join(heads, "list_key").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    clusters = components(edges, "near-clusters").withColumnRenamed("node", "rep")
    named = lists.join(clusters, "rep", "left").withColumn("cluster", F.coalesce("root", "rep")).drop("root")
    named = materialize(named, "near-clustered")
    sizes = named.groupBy("cluster", "list_key", "grp").agg(F.count(F.lit(1)).cast("double").alias("n"))
    each = sizes.groupBy("cluster", "list_key").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    load = each.groupBy("cluster").agg(
        F.sum("s").alias("postings"), F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs")
    )
    dense = _small(load.where(F.col("pairs") > F.col("postings") * PAIRS_A_POSTING).select("cluster"), "near-dense")
    sparse = named.join(dense, "cluster", "left_anti")
    pairs = _all_pairs(sparse, limit).distinct().join(tried, ["a", "b"], "left_anti")
    members = materialize(named.join(dense, "cluster").select("cluster", "rep", "grp").distinct(), "near-members")
    return _confirm(materialize(pairs, "near-candidates"), full, limit).union(_block_links(members, full, limit))


def classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, limit: tuple[int, int] = (80, 100)
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; shingles of ``size`` words,
    links at intersection / union >= limit[0] / limit[1].  Also ``set_id``,
    equal for equal sets."""
    ref = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("t"), F.md5(text)))  # finds a text again
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), ref.alias("ref"), F.col(text).alias("text"))
    rows = materialize(_sketches(texts, size), "near-sketches")
    filled = rows.where("n_shingles > 0")
    one = filled.groupBy("fp1", "fp2").agg(
        F.min("doc_id").alias("first_id"),
        F.min("ref").alias("first_ref"),
        F.count(F.lit(1)).alias("copies"),
        F.any_value("n_shingles").alias("n_shingles"),
        F.any_value("sig").alias("sig"),
    )
    # A number each; the written table keeps them.
    reps = materialize(one.withColumn("rep", F.monotonically_increasing_id()), "near-representatives")
    postings = materialize(_prefixes(reps, matches(limit)), "near-postings")
    shared = postings.groupBy("list_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("list_key")
    postings = materialize(postings.join(shared, "list_key"), "near-lists")

    # The full sets of the representatives in a list, from one of their texts.
    asked = reps.join(postings.select("rep").distinct(), "rep", "left_semi").select("rep", "fp1", "fp2", "first_ref", "sig")
    asked = materialize(asked, "near-asked")
    refs = asked.select("rep", "fp1", "fp2", F.col("first_ref").alias("ref"))
    refs = F.broadcast(refs) if refs.count() <= BROADCAST_REFS else refs
    found = _sets(texts.join(refs, "ref").select("rep", "fp1", "fp2", "text"), size).groupBy("rep").agg(
        F.any_value("shingles").alias("shingles")
    )
    full = materialize(asked.join(found, "rep").select("rep", "sig", "shingles"), "near-sets")

    empty = postings.select(F.col("rep").alias("node"), F.col("rep").alias("root")).limit(0)
    groups, links = empty, postings.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    tried = links
    few, before = PAIRS_A_POSTING * postings.count(), float("inf")
    for number in range(STAR_ROUNDS + 1):
        lists = materialize(_grouped(postings, groups), "near-open-lists")
        pairs_left = _pairs_left(lists)
        last = number == STAR_ROUNDS or pairs_left <= few or pairs_left > (1 - STAR_GAIN) * before
        before = pairs_left
        if last:
            found = _rest_links(lists, tried, full, limit)
        else:
            pairs = _star_pairs(lists, number, limit).distinct().join(tried, ["a", "b"], "left_anti")
            pairs = materialize(pairs, "near-candidates")
            found, tried = _confirm(pairs, full, limit), tried.union(pairs)
        links = materialize(links.union(found), "near-links")
        groups = components(links, "near-components")
        if last:
            break

    # Names: the smallest doc_id of each class; lone representatives name themselves.
    rooted = reps.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", "fp1", "fp2", "first_id", "copies", F.coalesce("root", "rep").alias("root")
    )
    joined = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("n")).where("n > 1")
    names = rooted.join(joined, "root").select("fp1", "fp2", "component_id", F.lit(True).alias("in_class"))
    return rows.join(names, ["fp1", "fp2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("in_class") & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.xxhash64("fp1", "fp2").alias("set_id"),
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, limit: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id;
    of several rows of that id the one whose text and other columns have the
    least hash stays, and rows with a null id stay if their class has no other."""
    mine, least = fresh("kept_id", docs), fresh("kept_row", docs)
    found = classes(docs, key, text, size, limit)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(mine)).distinct()
    stay = docs.join(kept, F.col(key).cast("long").eqNullSafe(F.col(mine)), "left_semi")
    hashed = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = stay.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row, F.xxhash64(*[f"`{c}`" for c in hashed])).alias(least)).select(f"{least}.*")
    return one.unionByName(stay.where(F.col(key).isNull()))


def op2_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class at three words and 85 in 100."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs, size=3, limit=(85, 100)).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


OP2_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 2), ' ')) AS g
    FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
fp AS (SELECT doc_id, md5(string_agg(g, ',' ORDER BY g)) AS f FROM s GROUP BY doc_id),
rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY f) AS rep FROM fp),
rs AS (SELECT s.doc_id, g FROM s JOIN rep ON s.doc_id = rep.doc_id AND rep.doc_id = rep.rep),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM rs x JOIN rs y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (
    SELECT a, b FROM i JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 85 * (na.n + nb.n - c)
    UNION SELECT doc_id, rep FROM rep WHERE doc_id <> rep),
either AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, x.b FROM reach r JOIN either x ON r.b = x.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON d.doc_id = c.doc_id
"""
