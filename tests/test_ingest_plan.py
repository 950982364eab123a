"""Chunks get their vectors without a join."""

from plumbline import ingest


def test_vectors_are_set_beside_the_chunks(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat. " * 9), (2, "a dog ran"), (3, ""), (4, None)], "doc_id long, text string")
    embedder, chunking = ingest.TfidfEmbedder(50), ingest.Chunking("fixed", 60, 10)
    own = ingest.embedded_chunks(docs, embedder, chunking)
    plan = own._jdf.queryExecution().toString()
    assert "Join" not in plan and own.columns == [*chunking.apply(docs).columns, "vector"]
    chunks = chunking.apply(docs)
    alone = embedder.embed(chunks.selectExpr("chunk_id id", "chunk text"))
    assert {r["chunk_id"]: r["vector"] for r in own.collect()} == {r["id"]: r["vector"] for r in alone.collect()}
    assert own.count() == chunks.count()
