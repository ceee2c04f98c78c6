import json

from millrace.operators import embedding, pages
from millrace.sources import files


def test_pages_round_trip(spark, tmp_path):
    given = [{"page_num": 2, "source_pdf": "a", "text": "x\ny", "char_count": 3, "type": "text"}, {"page_num": 1, "text": "第一节", "type": "table", "table_index": 1}]
    (tmp_path / "p.json").write_text(json.dumps(given, ensure_ascii=False, indent=1))
    got = files.read_pages(spark, str(tmp_path / "p.json")).orderBy("seq").collect()
    assert [(r.seq, r.page_num, r.text, r.table_index) for r in got] == [(0, 2, "x\ny", None), (1, 1, "第一节", 1)]


def test_jsonl(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a", "text": "t", "page_start": 1}\n\n   \n{"chunk_id": \n[1]\n{"chunk_id": "b"}\n')
    good, counts = files.read_jsonl(spark, str(tmp_path / "c.jsonl"))
    assert sorted(r.chunk_id for r in good.collect()) == ["a", "b"]
    assert {r.status: r["count"] for r in counts.collect()} == {"good": 2, "blank": 2, "bad": 2}
    files.write_jsonl(good, str(tmp_path / "out"))
    again, _ = files.read_jsonl(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, good.collect()))


def test_collection_modes(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = lambda *x: spark.createDataFrame(list(x), "kb_name string, chunk_id string")
    files.write_collection(rows(("a", "1"), ("b", "1")), path)
    files.write_collection(rows(("a", "2")), path)
    assert files.read_collection(spark, path).count() == 3
    files.write_collection(rows(("a", "3")), path, "replace")
    assert sorted((r.kb_name, r.chunk_id) for r in files.read_collection(spark, path).collect()) == [("a", "3"), ("b", "1")]
    files.write_collection(rows(("c", "1")), path, "rebuild")
    assert files.read_collection(spark, path, "c").count() == files.read_collection(spark, path).count() == 1


def test_layout_text(spark):
    page = [("title", {"title_content": [{"content": "T"}]}), ("page_footer", {"content": "no"}), ("list", {"list_items": [{"item_content": [{"content": "a"}, {"content": "b"}]}]}), ("table", {"html": "<t>"}), ("table", {}), ("image", {"content": "x"})]
    doc = spark.createDataFrame([("k", "s", [[(t, json.dumps(c)) for t, c in page], [("page_number", "{}")], []])], "kb_name string, source_pdf string, pages array<array<struct<type:string,content:string>>>")
    assert [(r.page_num, r.text, r.char_count) for r in pages.layout_pages(doc).collect()] == [(1, "T\na b\n<t>", 9)]
    assert tuple(pages.layout_stats(doc).first())[2:] == (3, 7, 2)


def test_encoding_resumes(spark):
    chunks = spark.createDataFrame([("k", f"c{i}", f"word{i} and more") for i in range(50)] + [("k", "e", "")], "kb_name string, chunk_id string, text string")
    whole = embedding.encode_chunks(chunks, embedding.hashing_encoder(16), 16, batch=7)
    first = whole.where("chunk_id < 'c2'")
    rest = embedding.encode_chunks(embedding.pending_chunks(chunks, first), embedding.hashing_encoder(16), 16)
    as_set = lambda df: {(r.chunk_id, tuple(r.embedding)) for r in df.collect()}
    assert as_set(first.unionByName(rest)) == as_set(whole)
    norms = [sum(x * x for x in r.embedding) for r in whole.collect()]
    assert all(abs(n - 1) < 1e-5 or n == 0 for n in norms)
    assert whole.first().type == "text" and "text" not in whole.columns


def test_wrong_dimension_fails(spark):
    chunks = spark.createDataFrame([("k", "c", "t")], "kb_name string, chunk_id string, text string")
    try:
        embedding.encode_chunks(chunks, embedding.hashing_encoder(8), 16).collect()
    except Exception as e:
        assert "dimension 16" in str(e)
    else:
        raise AssertionError
