"""Sharding: law, slots, bytes and defined cases."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from tabfold.llm.sharding import shard_documents


def test_law_slots_and_whole_rows(spark, documents):
    docs = documents.withColumn("Slot", F.lit("mine"))
    out = shard_documents(docs, bucket_bytes=50_000).collect()
    rows = {r.doc_id: r for r in documents.collect()}
    assert sorted(r.doc_id for r in out) == sorted(rows)
    for k in range(8):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    for r in out:
        t = rows[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.text, r.Slot_in) == (len(t) + 1, zlib.crc32(t), rows[r.doc_id].text, "mine")
        assert r.grown_shard in (r.shard, 8)
    grown = {r.doc_id: r.shard for r in shard_documents(docs, 9).collect()}
    assert grown == {r.doc_id: r.grown_shard for r in out}
    again = {r.doc_id: (r.shard, r.slot) for r in shard_documents(docs.repartition(7), bucket_bytes=50_000).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in out}
    by_slot = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert by_slot != sorted(by_slot) and any(a > b for a, b in zip(by_slot[:20], by_slot[1:20]))


def test_edge_cases(spark):
    rows = [(None, None, {"a": 1}), (None, "", {"a": 2}), (3, "x", None), (3, "x", None), (3, "é" * 70_000, None)] + [(None, f"t{i}", None) for i in range(300)]
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>"), bucket_bytes=1_000)
    got = out.collect()
    assert len(got) == len(rows)
    assert sorted(Counter(r.size for r in got).items())[0] == (1, 2)
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert len({r.bucket for r in got if r.doc_id is None}) > 5  # one key spreads over buckets
    assert shard_documents(out.select("doc_id", "text").where("false")).count() == 0
