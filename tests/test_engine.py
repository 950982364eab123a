"""Tables, the engine, files, text and streams."""

import io
import json
import math
import zipfile

import pytest

from plumbline import cli
from plumbline import ingest as ingest_lib
from plumbline.engine import Engine
from plumbline.errors import ParsingError, StorageError, ValidationError
from plumbline.functions import text, validation
from plumbline.operators import table
from plumbline.sources import documents, files
from plumbline.streaming import ingest
from pyspark.sql import functions as F


def test_table_life(spark, tmp_path):
    t = table.VectorTable(spark, str(tmp_path / "t"))
    assert t.read().count() == 0 and t.get("a") is None
    rows = spark.createDataFrame([("a", [1.0, 0.0], '{"x":1}'), ("b", [0.0, 1.0], None), ("c:/ d", [1.0, 1.0], "{}")], table.SCHEMA)
    assert [r["id"] for r in t.insert(rows).collect()] == ["a", "b", "c:/ d"]
    changes = spark.createDataFrame([("a", None, None), ("b", [2.0, 2.0], '{"y":2}'), ("zz", [9.0, 9.0], None)], table.SCHEMA)
    assert {r["id"]: r["updated"] for r in t.update(changes).collect()} == {"a": True, "b": True, "zz": False}
    assert t.get("a") == {"id": "a", "vector": [1.0, 0.0], "metadata": None} and t.get("b")["metadata"] == {"y": 2}
    page, cursor, more = t.page(2)
    assert [r["id"] for r in page.collect()] == ["a", "b"] and cursor == "b" and more
    page, cursor, more = t.page(2, "b")
    assert [r["id"] for r in page.collect()] == ["c:/ d"] and not more
    assert [r["id"] for r in t.page(2, "unknown")[0].collect()] == ["a", "b"]
    assert t.page(2, "c:/ d")[0].count() == 0
    assert not t.delete(["a", "nope"]) and t.delete(["b"]) and list(t.stream_ids()) == ["c:/ d"]
    assert t.stats().first().asDict() == {"vectors": 1, "bytes": 18, "min_dimensions": 2, "max_dimensions": 2}
    drawn = [r["id"] for r in t.insert(spark.createDataFrame([([5.0, 5.0],)], "vector array<double>")).collect()]
    assert len(drawn) == 1 and t.get(drawn[0])["vector"] == [5.0, 5.0]


def test_writers_that_meet(spark, tmp_path):
    """Of two writers that start from the same version one fails, and nothing is lost."""
    one, two = (table.VectorTable(spark, str(tmp_path / "t")) for _ in range(2))
    row = lambda i: spark.createDataFrame([(i, [1.0], None)], table.SCHEMA)
    one.insert(row("a"))
    now = one.version()
    stale = table.upsert(one.read(now), row("c"))
    two.insert(row("b"))
    with pytest.raises(StorageError):
        one.commit(stale, now)
    assert list(one.stream_ids()) == ["a", "b"] and one.version() == 2 and one.read(1).count() == 1
    one.insert(row("c"))
    assert list(two.stream_ids()) == ["a", "b", "c"] and two.disk_stats()["version"] == 3 and two.disk_stats()["bytes"] > 0


def test_layers_are_merged(spark, tmp_path):
    """Many small changes against a dictionary, past the number of layers that a version may have."""
    t, want = table.VectorTable(spark, str(tmp_path / "t")), {}
    for step in range(table.MAX_LAYERS + 4):
        if step % 4 == 3:
            assert t.delete([f"r{step - 1}", "r0"]) == ("r0" in want)
            want.pop(f"r{step - 1}"), want.pop("r0", None)
        elif step % 4 == 2:
            t.insert(spark.createDataFrame([(f"r{step}", [float(step)], None)], table.SCHEMA))
            t.update(spark.createDataFrame([("r1", [100.0 + step], "{}")], table.SCHEMA))
            want |= {f"r{step}": [float(step)], "r1": [100.0 + step]}
        else:
            t.insert(spark.createDataFrame([(f"r{step}", [float(step)], None), ("both", [float(step)], None)], table.SCHEMA))
            want |= {f"r{step}": [float(step)], "both": [float(step)]}
        assert t.disk_stats()["layers"] <= table.MAX_LAYERS
    assert {r["id"]: list(r["vector"]) for r in t.read().collect()} == want


def test_hybrid_cache(spark, tmp_path):
    t = table.VectorTable(spark, str(tmp_path / "t"), "hybrid")
    t.insert(spark.createDataFrame([("a", [1.0], None)], table.SCHEMA))
    assert t.cache_stats() == {"hits": 0, "misses": 0, "hit_rate": 0.0, "cached": False}
    assert t.preload() == 1 and t.get("a") and t.get("a")
    assert t.cache_stats() == {"hits": 2, "misses": 1, "hit_rate": 2 / 3, "cached": True}
    t.forget()
    small = table.VectorTable(spark, t.path, "hybrid", cache_bytes=1)
    assert small.get("a") and not small.cache_stats()["cached"]


def test_rules_hold_at_the_engine(spark, tmp_path):
    path = str(tmp_path / "db")
    Engine(spark, path).insert_batch([[1.0, 2.0]], [{"k": "v"}], ["a"])
    again = Engine(spark, path)  # the dimensions are the table's, not those of the new rows
    for bad in (dict(vectors=[[1.0, 2.0, 3.0]]), dict(vectors=[[1.0, 2.0]], ids=[" "]), dict(vectors=[[1.0, 2.0]], metadata=[{"x" * 300: 1}]), dict(vectors=[]), dict(vectors=[[1.0, 2.0]] * 2, ids=["x"]), dict(vectors=[[1.0, 2.0]] * 2, ids=["x", "x"]), dict(vectors=[[1.0, 2.0]] * 1001)):
        with pytest.raises(ValidationError):
            again.insert_batch(**bad)
    with pytest.raises(ValidationError):
        again.update(spark.createDataFrame([("a", [1.0])], "id string, vector array<double>"))
    assert again.table.version() == 1 and again.search([1.0, 2.0], 1)[0]["similarity"] > 0.999


def test_documents_go_in_and_are_found(spark, tmp_path):
    texts = {"ai.txt": "Neural networks learn from data. Machine learning models need training.", "db.txt": "Databases store rows in tables. An index makes queries fast.", "cook.html": "<p>Boil the pasta in salted water.</p>"}
    (tmp_path / "in").mkdir()
    for name, t in texts.items():
        (tmp_path / "in" / name).write_text(t)
    (tmp_path / "in" / "bad.docx").write_text("no archive")
    db, embedder = Engine(spark, str(tmp_path / "db")), ingest_lib.TfidfEmbedder(200)
    done = {r["filename"]: (r["chunks"], r["error"] is None) for r in ingest_lib.ingest_files(spark, db, str(tmp_path / "in"), embedder, ingest_lib.Chunking("fixed", 400, 0)).collect()}
    assert done == {"ai.txt": (1, True), "db.txt": (1, True), "cook.html": (1, True), "bad.docx": (0, False)}
    assert isinstance(embedder, ingest_lib.Embedder) and embedder.dimensions == db.get(list(db.table.stream_ids())[0])["vector"].__len__()
    asked = spark.createDataFrame([("q1", "training of neural networks"), ("q2", "an index for queries")], "id string, text string")
    best = {r["query_id"]: r["chunk"] for r in ingest_lib.answer(db, embedder, asked, 1).collect()}
    assert best == {"q1": texts["ai.txt"], "q2": texts["db.txt"]}
    for strategy, overlap in (("sentence", 1), ("paragraph", 0)):
        got = ingest_lib.Chunking(strategy, 100, overlap).apply(spark.createDataFrame([(1, "One two three. Four five six.")], "doc_id long, text string")).first()
        assert got["strategy"] == strategy and got["max_size"] == 100 and got["chunk_size"] == len(got["chunk"])
    with pytest.raises(ValidationError):
        ingest_lib.TfidfEmbedder().embed(asked)


def test_offset_pages(spark):
    df = spark.range(50)
    assert [r["id"] for r in table.offset_page(df, 2, 20).collect()] == list(range(20, 40))
    assert table.offset_page(df, 1, 1000).count() == 50 and table.offset_page(df, 9, 20).count() == 0
    with pytest.raises(ValidationError):
        table.keyset_page(df, 0)


@pytest.mark.parametrize("kind,options", [("flat", {}), ("hnsw", {"ef_search": 20}), ("ivf", {"num_clusters": 3, "num_probes": 3}), ("lsh", {"num_bits": 2}), ("annoy", {"search_k": 1000})])
def test_engine_finds_what_was_put_in(spark, tmp_path, kind, options):
    from plumbline.config import index_config

    db = Engine(spark, str(tmp_path / "db"), index_config(kind, **options), "hybrid")
    assert db.search([1.0, 0.0, 0.0], 3) == []
    vectors = [[math.cos(i / 7), math.sin(i / 7), 0.1 * (i % 3)] for i in range(30)]
    ids = db.insert(db.frame(vectors, [{"n": i} for i in range(30)], [f"v{i:02d}" for i in range(30)]))
    assert ids.count() == 30
    for probe in (0, 17):
        best = db.search(vectors[probe], 2)[0]
        assert best["id"] == f"v{probe:02d}" and best["distance"] < 1e-6 and json.loads(best["metadata"]) == {"n": probe}
    db.delete(["v17"])
    assert all(r["id"] != "v17" for r in db.search(vectors[17], 3))
    assert db.stats()["storage"]["vectors"] == 29
    only = db.search(vectors[0], 3, "get_json_object(metadata, '$.n') > 20")
    assert all(json.loads(r["metadata"])["n"] > 20 for r in only)
    with pytest.raises(ValidationError):
        db.insert(db.frame([[1.0, 2.0]]))
    db.close()


def test_validation(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [0.0, 0.0])], "id int, vector array<double>")
    assert {r["id"]: r["problem"] for r in validation.problems(rows, 2, allow_zero=False).collect()} == {2: "null", 3: "empty", 4: "not finite", 5: "wrong length", 6: "zero"}
    meta = spark.createDataFrame([({"a": "b"},), ({" ": "b"},), ({"a": None},), ({"a": "x" * 10_001},), (None,)], "m map<string,string>")
    assert [r[0] for r in meta.select(validation.metadata_problem(F.col("m"))).collect()] == [None, "bad key", "null value", "long value", None]
    assert validation.check_name("my-db_1") and validation.check_k(1000)
    for f, x in ((validation.check_name, "-x-"), (validation.check_name, "ab"), (validation.check_k, 0), (validation.check_id, "  "), (validation.check_dimensions, 10_001)):
        with pytest.raises(ValidationError):
            f(x)


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, -2.5], '{"k":"v","n":"1"}'), ("b", [0.0, 3.0], None)], table.SCHEMA)
    files.write_json(rows, str(tmp_path / "j"))
    got = {r["id"]: (r["vector"], r["metadata"]) for r in files.read_json_lines(spark, str(tmp_path / "j")).collect()}
    assert got == {"a": ([1.0, -2.5], {"k": "v", "n": "1"}), "b": ([0.0, 3.0], None)}
    files.write_csv(rows, str(tmp_path / "c"))
    assert {r["id"]: (r["vector"], r["metadata"]) for r in files.read_export(spark, str(tmp_path / "c")).collect()} == got
    (tmp_path / "in.csv").write_text("vector,label\n1,2,k=v\n3,4,junk\n")
    assert [(r["vector"], r["metadata"]) for r in files.read_csv(spark, str(tmp_path / "in.csv")).collect()] == [([1.0, 2.0], {"k": "v"}), ([3.0, 4.0], None)]
    (tmp_path / "q.txt").write_text("# queries\n[1, 2]\n\n3,4\n")
    assert [r["vector"] for r in files.read_queries(spark, str(tmp_path / "q.txt")).orderBy("id").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    (tmp_path / "u.txt").write_text('a,[1,2],{"x":"y"}\nb,[3,4]\n')
    assert [(r["id"], r["vector"], r["metadata"]) for r in files.read_updates(spark, str(tmp_path / "u.txt")).collect()] == [("a", [1.0, 2.0], {"x": "y"}), ("b", [3.0, 4.0], None)]
    (tmp_path / "body.json").write_text('{"vectors": [{"vector": [1, 2], "id": "z"}, {"vector": [3, 4], "metadata": {"m": "n"}}]}')
    assert [(r["id"], r["vector"]) for r in files.read_import_body(spark, str(tmp_path / "body.json")).collect()] == [("z", [1.0, 2.0]), (None, [3.0, 4.0])]
    files.save_snapshot(rows, str(tmp_path / "s"), {"v": 1}, True)
    back, state = files.load_snapshot(spark, str(tmp_path / "s"))
    assert back.count() == 2 and state == {"v": 1} and files.snapshot_stats(spark, str(tmp_path / "s")).first()["rows"] == 2
    assert files.parse_vector("[1, 2]") == [1.0, 2.0]
    with pytest.raises(ParsingError):
        files.parse_vector("1,x")


def test_documents(spark, tmp_path):
    page = documents.parse_html('<html lang="en"><head><title>T</title><meta name="author" content="A"></head><body><nav>no</nav><h1>Hi</h1><p>a<b>b</b></p><script>x()</script><a href="#">l</a><img src="i"></body></html>')
    assert page["text"] == "Hi ab l" and page["title"] == "T" and page["h1"] == ["Hi"] and (page["links"], page["images"], page["language"]) == (1, 1, "en") and page["meta"] == {"author": "A"}
    assert documents.parse_html(None)["text"] == ""
    w = 'xmlns:w="w"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:document>")
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.txt").write_text("plain")
    (tmp_path / "c.xyz").write_text("?")
    about = {r["filename"]: r["metadata"] for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert about["b.txt"] == {"characters": "5", "words": "1", "lines": "1", "type": "txt"} and about["c.xyz"] is None
    got = {r["filename"]: (r["text"], r["error"] is None) for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("One\nTwo", True), "b.txt": ("plain", True), "c.xyz": (None, False)}


def test_chunks(spark):
    got = text.sentence_chunks("Dr. Who met Mr. X. They talked. Then left!", 30, 0)
    assert [c[0] for c in got] == ["Dr. Who met Mr. X.They talked.", "Then left!"]
    assert [c[0] for c in text.sentence_chunks("A b c d. E f g h. I j k l.", 20, 1)] == ["A b c d.E f g h.", "E f g h.I j k l."]
    assert [c[0] for c in text.paragraph_chunks("First paragraph.\n\nSecond paragraph.\n\nno\n\nThird paragraph.", 35)] == ["First paragraph.\n\nSecond paragraph.", "Third paragraph."]
    assert text.paragraph_chunks("short") == [] and text.sentence_chunks("") == []
    df = spark.createDataFrame([(1, "x" * 1000), (2, ""), (3, None), (4, "abc")], "doc_id int, text string")
    fixed = text.chunk_fixed(df, 500, 50).orderBy("doc_id", "chunk_index").collect()
    assert [(r["doc_id"], r["start"], r["end"]) for r in fixed] == [(1, 0, 500), (1, 450, 950), (1, 900, 1000), (4, 0, 3)]
    with pytest.raises(ValidationError):
        text.chunk_fixed(df, 10, 10)
    assert text.chunk_sentences(df).count() == 2


def test_tokens_and_retrieval(spark):
    df = spark.createDataFrame([(1, "--Foo bar_baz!"), (2, "..."), (3, ""), (4, None), (5, "é x")], "doc_id int, text string")
    assert [r[0] for r in df.orderBy("doc_id").select(text.tokenize(F.col("text"))).collect()] == [["", "foo", "bar", "baz"], [], [""], None, ["", "x"]]
    assert [tuple(r) for r in text.text_counts(df.where("doc_id < 5")).orderBy("doc_id").collect()] == [(1, 14, 2, 1), (2, 3, 1, 1), (3, 0, 0, 0), (4, 0, 0, 0)]
    docs = spark.createDataFrame([(1, "cats and dogs are pets"), (2, "birds are pets too"), (3, "databases store rows")], "doc_id int, text string")
    vocab = text.tfidf_vocabulary(docs)
    assert {r["term"]: round(r["idf"], 6) for r in vocab.collect()}["pets"] == round(math.log(3 / 2), 6)
    weights = text.tfidf_weights(docs, vocab)
    assert all(abs(r["s"] - 1) < 1e-9 for r in weights.groupBy("doc").agg(F.sum(F.col("weight") ** 2).alias("s")).collect())
    q = spark.createDataFrame([(0, "which databases have rows")], "item_id int, text string")
    assert text.retrieve(docs, q, 1, 100, 10).first()["chunk_id"] == "3_0"


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"id": "a", "vector": [1, 2]}\n{"id": "b", "vector": [3, 4]}\n{"id": null, "vector": [0, 0]}\n')
    stream = spark.readStream.schema("id string, vector array<double>, metadata string").json(str(source))
    t = table.VectorTable(spark, str(tmp_path / "t"))
    ingest.ingest(stream, t, str(tmp_path / "cp")).awaitTermination()
    (source / "2.json").write_text('{"id": "b", "vector": [5, 6]}\n')
    ingest.ingest(stream, t, str(tmp_path / "cp")).awaitTermination()
    assert {r["id"]: r["vector"] for r in t.read().collect()} == {"a": [1.0, 2.0], "b": [5.0, 6.0]}
    events = spark.sql("select timestamp'2024-01-01 00:00:10' ts, 1 user_id, 'error' event_type, 2.0D value union all select timestamp'2024-01-01 00:00:20', 1, 'error', 4.0D")
    r = ingest.windowed_figures(events).first()
    assert (r["requests"], r["failures"], r["avg_latency"]) == (2, 2, 3.0) and ingest.rate_limited(events, 1).first()["refused"] == 1
    paths = spark.createDataFrame([("/db/12/v/0b0e7c5e-1f9a-4b7e-9d59-0d1c2b3a4f50/x",), ("/v1/7",)], "p string")
    assert [x[0] for x in paths.select(ingest.endpoint(F.col("p"))).collect()] == ["/db/:id/v/:id/x", "/v1/:id"]


def test_command_line(spark, tmp_path):
    db = str(tmp_path / "db")

    def run(*argv):
        out = io.StringIO()
        code = cli.run(spark, [db, *argv], out)
        return code, out.getvalue()

    assert run("init", "--metric", "euclidean")[0] == 0
    assert run("insert", "1,0", "--id", "a", "--meta", "n=3")[1].strip() == "a"
    assert run("insert", "[0,1]", "--id", "b")[0] == 0
    assert "a" in run("search", "1,0", "-k", "1")[1]
    assert json.loads(run("get", "a")[1])["metadata"] == {"n": 3} and run("get", "zz")[0] == 1
    assert "a" in run("list")[1] and run("delete", "b")[1].strip() == "deleted"
    assert run("search", "1,x")[0] == 2
    assert run("export", str(tmp_path / "out.json"))[0] == 0 and run("stats")[0] == 0
