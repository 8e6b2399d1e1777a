"""The partitioned store, ingestion by batches, and rate limits in event time."""

import os
import random

import pytest
from pyspark.sql import functions as F

from passagemill.operators import chunking, cleaning
from passagemill.sources import store
from passagemill.streaming import ingest, rates

POINT = "point_id long, tenant_id string, project_id string, document_id long, position long, text string, ingested_at long"


def rows_of(df):
    return sorted(map(tuple, df.select("tenant_id", "point_id", "document_id", "text").collect()))


def point(k, tenant, document=None, text="x", at=0):
    return (k, tenant, f"p{k % 3}", k // 5 if document is None else document, k, text, at)


def files(path):
    return {os.path.join(at, n): os.stat(os.path.join(at, n)).st_mtime_ns for at, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_an_upsert_touches_its_tenants_alone(spark, tmp_path):
    path = str(tmp_path / "points")
    first = [point(k, "abc"[k % 3]) for k in range(60)]
    store.upsert_points(spark, path, spark.createDataFrame(first, POINT))
    assert rows_of(store.read_store(spark, path)) == sorted((t, k, d, x) for k, t, _, d, _, x, _ in first)
    before = files(path)
    new = [point(3, "a", text="new", at=2), point(3, "a", text="old", at=1), point(999, "a"), point(7, "d")]
    for _ in range(2):
        store.upsert_points(spark, path, spark.createDataFrame(new, POINT))
        expected = {(t, k): (t, k, d, x) for k, t, _, d, _, x, _ in first} | {("a", 3): ("a", 3, 0, "new"), ("a", 999): ("a", 999, 199, "x"), ("d", 7): ("d", 7, 1, "x")}
        assert rows_of(store.read_store(spark, path)) == sorted(expected.values())
    after = files(path)
    same = {f for f in before if "tenant_id=b" in f or "tenant_id=c" in f}
    assert same and all(after.get(f) == before[f] for f in same) and not {f for f in before if "tenant_id=a" in f} & set(after)


def test_deleted_documents_leave_and_empty_folders_go(spark, tmp_path):
    path = str(tmp_path / "points")
    store.upsert_points(spark, path, spark.createDataFrame([point(k, "a b/c" if k < 5 else "z") for k in range(20)], POINT))
    gone = spark.createDataFrame([("a b/c", 0), ("z", 2), ("none", 1)], "tenant_id string, document_id long")
    for _ in range(2):
        store.delete_documents(spark, path, gone)
        assert {r.point_id for r in store.read_store(spark, path).collect()} == set(range(5, 10)) | set(range(15, 20))
    fresh = spark.createDataFrame([point(500, "z", 1), point(501, "z", 1)], POINT)
    store.replace_documents(spark, path, fresh)
    assert {r.point_id for r in store.read_store(spark, path).collect()} == set(range(15, 20)) | {500, 501}
    with pytest.raises(Exception, match="without tenant_id"):
        store.write_store(spark.createDataFrame([point(1, None)], POINT), path)


def test_folders_are_pruned(spark, tmp_path):
    path = str(tmp_path / "points")
    store.upsert_points(spark, path, spark.createDataFrame([point(k, "abcdefgh"[k % 8]) for k in range(80)], POINT))
    gone = spark.createDataFrame([("b", 1)], "tenant_id string, point_id long")
    touched = store.touched_rows(store.read_store(spark, path), gone, "tenant_id")
    assert "dynamicpruning" in touched._jdf.queryExecution().executedPlan().toString()
    assert {r.tenant_id for r in touched.collect()} == {"b"}
    one = store.read_store(spark, path).where("tenant_id = 'c' and project_id = 'p1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in one and "PushedFilters: [IsNotNull(project_id), EqualTo(project_id,p1)]" in one


PAGE = "doc_id long, ord int, page int, text string, n_pages int"


def long_text(k):
    """A text whose lines stand on no other page."""
    rng = random.Random(k)
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(40)) + "."


def page(doc, k, n, text=None):
    return (doc, k, k + 1, long_text(f"{doc}-{k}") if text is None else text, n)


def chunk_rows(df):
    return sorted((r.doc_id, r.chunk_seq, r.page, r.text) for r in df.collect())


def test_documents_are_held_until_they_are_whole(spark, tmp_path):
    out = str(tmp_path / "out")
    types = spark.createDataFrame([(1, "autre"), (2, "CCTP"), (3, "autre"), (4, "plan")], "doc_id long, type string")
    batches = [
        [page(1, 0, 4), page(2, 0, 1), page(3, 0, 1, "  ")],
        [page(1, 2, 4), page(4, 0, 1), page(1, 2, 4), page(1, 3, 4)],
        [page(1, 1, 4), page(5, 0, 2)],
    ]
    status = lambda: {r.doc_id: r.status for r in ingest.ingested_status(spark, out).collect()}
    run = lambda k: ingest.ingest_batch(spark, spark.createDataFrame(batches[k], PAGE), k, types, out)
    run(0)
    assert status() == {1: "processing", 2: "ready", 3: "error"}
    run(1)
    assert status() == {1: "processing", 2: "ready", 3: "error", 4: "ready"}
    run(2)
    once = chunk_rows(ingest.ingested_chunks(spark, out))
    assert status() == {1: "ready", 2: "ready", 3: "error", 4: "ready", 5: "processing"}
    run(2)
    assert chunk_rows(ingest.ingested_chunks(spark, out)) == once and status()[1] == "ready"
    # The document that came in three batches has the chunks of one that came whole.
    whole = spark.createDataFrame([page(1, k, 4)[:4] for k in range(4)], "doc_id long, ord int, page int, text string")
    assert [r for r in once if r[0] == 1] == chunk_rows(chunking.chunk_documents(cleaning.clean_pages(whole), types))
    # A new version replaces the old one, also by nothing.
    ingest.ingest_batch(spark, spark.createDataFrame([page(2, 0, 1, ""), page(1, 0, 1)], PAGE), 3, types, out)
    assert {r[0] for r in chunk_rows(ingest.ingested_chunks(spark, out))} == {1, 4} and status()[2] == "error" and status()[5] == "processing"


def test_a_stream_of_pages(spark, tmp_path):
    for name, rows in (("a", [page(1, 0, 2), page(2, 0, 1)]), ("b", [page(1, 1, 2)])):
        spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        types = spark.createDataFrame([(1, "autre"), (2, "autre")], "doc_id long, type string")
        stream = spark.readStream.schema(PAGE).parquet(str(tmp_path / "in"))
        ingest.ingest(stream, types, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        found = {r.doc_id: (r.status, r.batch) for r in ingest.ingested_status(spark, str(tmp_path / "out")).collect()}
        assert found == ({1: ("processing", 0), 2: ("ready", 0)} if name == "a" else {1: ("ready", 1), 2: ("ready", 0)})


EVENT = "key string, seq long, ts string"


def at(second):
    return f"2024-01-01 00:{second // 60:02d}:{second % 60:02d}"


def test_limits_of_a_stream_are_those_of_a_table(spark, tmp_path):
    spark.conf.set(rates.STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rng = random.Random(3)
        events = [(f"k{rng.randrange(4)}", k, rng.randrange(0, 200)) for k in range(60)]
        events.sort(key=lambda e: (e[2] // 20, rng.random()))  # out of order, by 20 seconds at most
        late = [("k0", 900, 5), ("k9", 901, 5)]
        batches = [events[:20], events[20:45], events[45:], [("end", 1000, 1000)], late]
        for k, batch in enumerate(batches):
            rows = spark.createDataFrame([(key, seq, at(t)) for key, seq, t in batch], EVENT).withColumn("ts", F.to_timestamp("ts"))
            rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("key string, seq long, ts timestamp").parquet(str(tmp_path / "in"))
            verdicts = rates.fixed_window_stream(stream, 2, 20.0, "25 seconds")
            path = str(tmp_path / "out")
            verdicts.writeStream.format("parquet").option("path", path).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        whole = spark.createDataFrame([(key, seq, at(t)) for key, seq, t in events], EVENT).withColumn("ts", F.to_timestamp("ts"))
        found = sorted(map(tuple, spark.read.parquet(path).collect()))
        assert found == sorted(map(tuple, rates.fixed_window(whole, 2, 20.0).collect()))
        assert any(not r[2] for r in found)
        # All keys but the one whose window is still open are forgotten.
        state = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "c"))
        assert state.count() == 0
    finally:
        spark.conf.unset(rates.STATE_STORE)
