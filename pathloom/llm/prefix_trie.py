"""Operator 13: the trie of conversation prefixes, rolled up by pointer jumping.

Each distinct sequence of first turns is a node, known by its depth and a
128-bit digest: the xor of the hashes of its turns, each hashed with its
position.  An xor can be added up from any pieces, so a long conversation is
cut into blocks of BLOCK turns, and a node's parent is its digest without its
last turn's hash: edges are keyed by digests and no path is walked.

Leaves and savings of whole subtrees then come from doubling rounds.  After
round k a node knows the sums of its descendants less than 2 ** k below it and
points to its ancestor 2 ** k above; one more round adds what pointers bring
and lets each pointer leap to its target's target.  A trie of depth d takes
log2(d) rounds, each a written table.  Targets that more than a thousandth of
all nodes point to are at most a thousand, and are broadcast; others are
joined.

The hash over a node's members is one stream in order of ids.  Members are
listed in runs of ids first, and the runs of a node pass through its task in
order, a batch at a time: that task's memory is bounded, its time isn't.

Defined cases: rows without a conversation are left out; a null turn comes
first, equal turns go by role and then SHA-256 of role and text (many rows of
one turn of one conversation are numbered by one task); null roles and texts
are empty; repeated rows are turns of their own; texts of any length are
hashed whole; an empty table has no root; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.spark_tools import HOT, join_hot, materialize

#: Turns of a conversation that one task puts in order.
BLOCK = 1024
#: Ids in a run of a node's members: 2 ** RUN_BITS at most.
RUN_BITS = 12
#: The conversation that one takes its first turns from, and how many at most.
FAMILY, MOST_TAKEN = 5, 8

NO_MEMBERS = hashlib.sha256().hexdigest()


def own_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, pos (from 1), digest (SHA-256 of role and text), bytes (of the text)."""
    who, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"),
        F.col(turn).cast("long").alias("turn"),
        who.alias("role"),
        F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256).alias("hex"),
        F.octet_length(said).cast("long").alias("bytes"),
    )
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    within = W.partitionBy("c", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "hex")
    before = W.partitionBy("c").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("c", "block").agg(F.count(F.lit(1)).alias("n"))
    bases = counts.select("c", "block", F.sum("n").over(before).alias("base")).where("base > 0")
    numbered = rows.withColumn("k", F.row_number().over(within)).join(bases, ["c", "block"], "left")
    pos = F.col("k") + F.coalesce("base", F.lit(0))
    return numbered.select("c", pos.cast("long").alias("pos"), F.unhex("hex").alias("digest"), "bytes")


def _base(c: Column) -> Column:
    return c - c % F.lit(FAMILY)


def _taken(c: Column) -> Column:
    """Turns that conversation c takes from its family's first, at most."""
    return F.crc32(c.cast("string").cast("binary")) % F.lit(MOST_TAKEN + 1)


def _beside(own: DataFrame, convs: DataFrame, columns: list[str]) -> DataFrame:
    """``own`` with columns of its conversations (c, n, ...).  A conversation's
    row is there once for each block of its turns, so a long one isn't one task's."""
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK)))
    rows = own.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK))
    return rows.join(convs.select("c", *columns, blocks.alias("block")), ["c", "block"]).drop("block")


def rebuild(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) with each conversation's first h turns those of
    its family's first one: (c, pos, digest, bytes, length) and (c, length)."""
    sizes = own.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.select(F.col("c").alias("base"), F.col("n").alias("n_base"))
    h = _taken(F.col("c"))
    convs = sizes.withColumn("base", _base(F.col("c"))).join(bases, "base", "left").select("c", "n", h.alias("h"), F.least(h, F.coalesce("n_base", F.lit(0))).alias("took"))
    convs = convs.select("*", (F.col("took") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    rest = _beside(own.where(F.col("pos") > h), convs, ["h", "took", "length"])
    rest = rest.select("c", (F.col("took") + F.col("pos") - F.col("h")).alias("pos"), "digest", "bytes", "length")
    family = F.explode(F.sequence(F.lit(1 - FAMILY), F.lit(FAMILY - 1)))
    near = own.where((F.col("pos") <= MOST_TAKEN) & (_base(F.col("c")) == F.col("c"))).withColumnRenamed("c", "base")
    near = near.select("*", family.alias("step")).withColumn("c", F.try_add("base", "step")).where("c is not null")
    near = near.where((_base(F.col("c")) == F.col("base")) & (F.col("pos") <= h))
    taken = near.join(convs.select("c", "length"), "c").select("c", "pos", "digest", "bytes", "length")
    return rest.unionByName(taken), convs.select("c", "length")


def _key(a: Column, b: Column) -> Column:
    """16 bytes of two longs."""
    return F.unhex(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (a, b)]))


def memberships(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """c, id, parent, depth, bytes, ends: a row for each prefix of each
    conversation, the empty one too."""
    rows = turns.select("*", *[F.xxhash64(F.lit(i), "pos", "digest").alias(f"x{i}") for i in (1, 2)], F.floor((F.col("pos") - 1) / BLOCK).alias("block"))
    within = W.partitionBy("c", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("c").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("c", "block").agg(*[F.bit_xor(f"x{i}").alias(f"t{i}") for i in (1, 2)])
    bases = totals.select("c", "block", *[F.bit_xor(f"t{i}").over(before).alias(f"b{i}") for i in (1, 2)]).where("block > 0")
    summed = rows.select("*", *[F.bit_xor(f"x{i}").over(within).alias(f"p{i}") for i in (1, 2)]).join(bases, ["c", "block"], "left")
    at = [F.col(f"p{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))) for i in (1, 2)]
    up = [a.bitwiseXOR(F.col(f"x{i}")) for i, a in enumerate(at, 1)]
    below = summed.select("c", _key(*at).alias("id"), _key(*up).alias("parent"), F.col("pos").alias("depth"), "bytes", (F.col("pos") == F.col("length")).alias("ends"))
    nothing = F.lit(0).cast("long")
    root = convs.select("c", _key(nothing, nothing).alias("id"), F.lit(None).cast("binary").alias("parent"), nothing.alias("depth"), nothing.alias("bytes"), (F.col("length") == 0).alias("ends"))
    return below.unionByName(root)


def member_hashes(ended: DataFrame) -> DataFrame:
    """id, ends_sha256 of (id, c): each node's ids in order, joined by commas."""
    runs = ended.groupBy("id", F.shiftright("c", RUN_BITS).alias("run")).agg(F.sort_array(F.collect_list("c")).alias("ids"))
    listed = runs.select("id", "run", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[bytes] = []
        found: list[str] = []
        now, sha = None, None
        for batch in batches:
            for name, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name == now:
                    sha.update(b",")
                else:
                    if sha is not None:
                        names.append(now)
                        found.append(sha.hexdigest())
                    now, sha = name, hashlib.sha256()
                sha.update(ids.encode())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found, pa.string())], ["id", "ends_sha256"])
                names, found = [], []
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["id", "ends_sha256"])

    return listed.repartition("id").sortWithinPartitions("id", "run").mapInArrow(stream, "id binary, ends_sha256 string")


def roll_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """id and the columns ``sums`` of ``nodes`` (id, parent, depth, ...; a
    table), added up over subtrees.  Rounds carry nothing else."""
    size, deepest = nodes.agg(F.count(F.lit(1)), F.max("depth")).first()
    state, rounds = nodes.select("id", F.col("parent").alias("jump"), *sums), (deepest or 0).bit_length()
    for k in range(rounds):
        brought = state.where("jump is not null").groupBy("jump").agg(*[F.sum(c).alias(f"more_{c}") for c in sums], F.count(F.lit(1)).alias("n"))
        out = state.join(brought.drop("n").withColumnRenamed("jump", "id"), "id", "left")
        added = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums]
        if k == rounds - 1:
            return out.select("id", *added)
        hot = brought.where(F.col("n") > size // HOT).select("jump")
        targets = state.where("jump is not null").select("id", F.col("jump").alias("next_jump"))
        leapt = join_hot(out.select("id", "jump", *added), "jump", targets, "id", hot, F.col("id"))
        state = materialize(leapt.select("id", F.col("next_jump").alias("jump"), *sums), f"trie-{k + 1}")
    return state.drop("jump")


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` (a table) with parent_conv_id and n_children."""
    children = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    hot = children.where(F.col("n_children") > nodes.count() // HOT).select("parent")
    named = join_hot(nodes, "parent", nodes.select("id", F.col("conv_id").alias("parent_conv_id")), "id", hot, F.col("id"))
    counted = named.join(children.withColumnRenamed("parent", "id"), "id", "left")
    return counted.withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of conversations given by (c, pos, digest, bytes, length) and
    (c, length): id, parent, conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = materialize(memberships(turns, convs), "trie-rows")
    found = rows.groupBy("id", "parent", "depth", "bytes").agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    nodes = materialize(with_parents(materialize(found, "trie-nodes")), "trie-0")
    counts = nodes.select("id", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    done = nodes.join(roll_up(counts, ["n_leaves", "saved_tokens"]), "id").join(member_hashes(rows.where("ends").select("id", "c")), "id", "left")
    names = ["id", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return done.select(*names, F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, **names: str) -> DataFrame:
    """The trie of conversations as they are; ``names`` of columns as in own_turns."""
    own = materialize(own_turns(conversations, **names), "trie-turns")
    convs = own.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    turns = _beside(own, convs.withColumn("length", F.col("n")), ["length"])
    return trie(turns, convs.withColumnRenamed("n", "length"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt with the first turns of their families."""
    own = materialize(own_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-turns")
    return trie(*rebuild(own)).drop("id", "parent")


def _oracle() -> str:
    """SQL for the query; the checksum is folded over the id's bytes."""
    steps, last = "", "k0"
    for i in range(1, 9):
        steps += f", k{i} AS (SELECT i, xor(v >> 1, (v & 1) * 3988292384) AS v FROM {last})"
        last = f"k{i}"
    return f"""
WITH k0 AS (SELECT i, i AS v FROM range(256) AS t(i)){steps},
crc AS (SELECT list(v ORDER BY i) AS v FROM {last}),
t0 AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t1 AS (SELECT *, sha256(strlen(role) || ':' || role || text) AS x FROM t0),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, x) AS pos, x, strlen(text) AS bytes FROM t1),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
b AS (SELECT c, n, list_transform(regexp_extract_all(hex(encode(CAST(c AS VARCHAR))), '..'), lambda y: ('0x' || y)::BIGINT) AS b FROM n),
h AS (SELECT c, c - c % 5 AS base, xor(list_reduce(b, lambda s, y: xor(s >> 8, v[(xor(s, y) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h FROM b, crc),
r AS (SELECT h.c, pos, x, bytes FROM h JOIN t ON t.c = h.base AND pos <= h
  UNION ALL SELECT h.c, least(h, coalesce(n, 0)) + pos - h, x, bytes FROM h JOIN t USING (c) LEFT JOIN n ON n.c = h.base WHERE pos > h),
p AS (SELECT c, pos AS depth, string_agg(x, '') OVER (PARTITION BY c ORDER BY pos) AS path, bytes, pos = count(*) OVER (PARTITION BY c) AS ends FROM r
  UNION ALL SELECT c, 0, '', 0, c NOT IN (SELECT c FROM r) FROM h),
v AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY path, depth),
w AS (SELECT v.*, u.conv_id AS parent_conv_id FROM v LEFT JOIN v u ON v.depth > 0 AND u.path = left(v.path, length(v.path) - 64)),
k AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1),
y AS (SELECT w.*, coalesce(n_children, 0) AS n_children FROM w LEFT JOIN k USING (path)),
z AS (SELECT p.path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM y JOIN p ON p.c = y.conv_id AND p.depth <= y.depth GROUP BY p.path)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM y JOIN z USING (path)
"""


OP13_SQL = _oracle()
