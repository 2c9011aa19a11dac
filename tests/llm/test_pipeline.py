"""The pipeline's stages against brute force."""

import hashlib

import corpus_pipeline
from pathloom.llm import mixing, sharding
from pyspark.sql import functions as F


def test_shards_follow_the_mixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("slot", F.lit("mine"))
    mixed = corpus_pipeline.mixture(spark, docs, sf)
    assert mixed.columns == [*docs.columns, *corpus_pipeline.MIX]
    rows = docs.collect()
    by_source = {}
    for r in rows:
        by_source.setdefault("=" + r.source, []).append(r.doc_id)
    units = mixing.temperature_units({s: len(ids) for s, ids in by_source.items()})
    slots, total, place = mixing.edf_slots(units), sum(units.values()), {}
    for s, ids in by_source.items():
        ids.sort(key=lambda i: (hashlib.md5(str(i).encode()).hexdigest()[:3], i))
        for rank, i in enumerate(ids):
            block = rank // mixing.BLOCK
            place[i] = (block // units[s] * total + slots[s][block % units[s]], rank % mixing.BLOCK)
    assert {r.doc_id: (r.mix_slot, r.mix_offset) for r in mixed.collect()} == place

    got = corpus_pipeline.shards(spark, mixed, sf)
    shard = {r.doc_id: r.s for r in docs.select("doc_id", sharding.rendezvous(sharding.record_key(), [1.0] * 8).alias("s")).collect()}
    want = {}
    for n in range(8):
        for k, i in enumerate(sorted((i for i in shard if shard[i] == n), key=place.get)):
            want[i] = (n, k)
    assert {r.doc_id: (r.shard, r.slot) for r in got.collect()} == want and len(want) == len(rows)


def test_an_empty_table_has_no_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert corpus_pipeline.shards(spark, corpus_pipeline.mixture(spark, docs, sf), sf).count() == 0
