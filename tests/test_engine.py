import io
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tessera import engine
from tessera.functions import code, embedding, extract, pdf, queries, stemming
from tessera.functions.chunking import Splitter
from tessera.operators import fts, ranking, rerank, vector
from tessera.operators.filters import SearchFilter
from tessera.operators.index import Index
from tessera.operators.search import SearchOptions, hybrid_search
from tessera.plans.ingest import ingest
from tessera.sources import ignore
from tessera.sources.store import CHUNKS, DOCUMENTS, Store
from tessera.streaming import live

DOCS = "doc_id long, path string, collection string, language string, file_type string, text string, age long"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rows = [
        (1, "a/x.txt", "c", "en", "txt", "alpha beta", 0),
        (2, "a/y.txt", "c", "en", "txt", "alpha", 0),
        (3, "b/z.md", "d", "de", "md", "Running naïve foo_bar runners", 0),
        (4, "b/z.md", "d", "de", "md", "foo x bar " + "filler " * 20 + "beta gamma alpha", 0),
        (5, "b/n.md", "", None, None, None, None),
        (6, "b/e.md", "d", "fr", "md", "", 0),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.6, 0.8]), (4, [0.0, 0.0])], "doc_id long, v array<double>")
    return docs, vectors, Index.build(docs, str(tmp_path_factory.mktemp("index")))


def ids(df):
    return [r["doc_id"] for r in df.collect()]


def test_index_holds_stems_and_is_read_again(spark, small):
    docs, _, index = small
    again = Index.open(spark, index.folder)
    assert again == index and index.n_docs == 6
    terms = {(r["doc_id"], r["term"]): (r["tf"], r["positions"]) for r in index.postings(spark).collect()}
    assert terms[3, "run"] == (1, [1]) and terms[3, "naiv"] == (1, [2]) and terms[3, "foo"][1] == [3] and terms[3, "runner"] == (1, [5])
    plan = index.postings(spark).where("term = 'run'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,run)" in plan
    assert index.diagnostics(spark).first()["in_step"]


def test_index_sync_equals_building_anew(spark, small, tmp_path):
    docs, _, _ = small
    old = Index.build(docs, str(tmp_path / "a"))
    new_docs = docs.where("doc_id <> 2").withColumn("text", F.when(F.col("doc_id") == 1, "gamma gamma").otherwise(F.col("text")))
    changed = spark.createDataFrame([(1,), (2,)], "doc_id long")
    synced, anew = old.sync(new_docs, changed), Index.build(new_docs, str(tmp_path / "b"))
    rows = lambda i: sorted(map(tuple, i.postings(spark).select("doc_id", "term", "tf", "dl").collect()))
    assert rows(synced) == rows(anew) and (synced.n_docs, synced.avgdl) == (anew.n_docs, anew.avgdl)


def test_matching_by_stems_phrases_prefixes(spark, small):
    _, _, index = small
    found = lambda q: sorted(ids(fts.scored(index, spark, fts.compile_query(q))))
    assert found("runs") == [3] and found("naive") == [3] and found('"foo bar"') == [3]
    assert 4 not in [i for i in found('"foo bar"')] and found("foo_bar") == [3, 4]
    assert found("") == found("?!") == found('""') == []
    near = {r["doc_id"]: r["near_score"] for r in fts.scored(index, spark, fts.compile_query("alpha beta")).collect()}
    assert near[1] is not None and near[4] is not None and near[2] is None
    far = fts.scored(index, spark, fts.compile_query("foo gamma")).where("near_score is not null")
    assert far.count() == 0


def test_a_full_and_leg_ends_the_search(spark, small):
    _, _, index = small
    q = fts.compile_query("alpha beta")
    assert {r["doc_id"]: r["kw_rank"] for r in fts.keyword_ranks(index, spark, q, 2).collect()}.keys() == {1, 4}
    every = {r["doc_id"]: r["kw_rank"] for r in fts.keyword_ranks(index, spark, q, 10).collect()}
    assert every.keys() == {1, 2, 4} and every[2] > every[4] > 0


def test_hybrid_search(spark, small):
    docs, vectors, index = small
    got = hybrid_search(docs, vectors, index, "alpha beta", [1.0, 0.0], SearchOptions(2)).collect()
    assert len(got) == 2 and got[0]["doc_id"] == 1
    # an empty query leaves the vectors, a missing vector the keywords
    assert ids(hybrid_search(docs, vectors, index, "", [1.0, 0.0], SearchOptions(2))) == [2, 3]
    assert set(ids(hybrid_search(docs, vectors, index, "alpha", None, SearchOptions(5)))) == {1, 2, 4}
    assert ids(hybrid_search(docs, vectors, index, "", None)) == []
    # one row of each path first
    both = ids(hybrid_search(docs, vectors, index, "foo bar", None, SearchOptions(1)))
    assert len(both) == 1
    where = SearchFilter(languages=("de",))
    assert set(ids(hybrid_search(docs, vectors, index, "alpha", [1.0, 0.0], SearchOptions(5), where))) == {3, 4}
    assert 2 in ids(hybrid_search(docs, vectors, index, "alpha", [1.0, 0.0], SearchOptions(5, filter_scope="keyword"), where))
    named = vectors.join(docs.select("doc_id", "path"), "doc_id")
    doc_vectors = vector.doc_vectors(named, "path", "doc_id")
    near = hybrid_search(docs, named, index, "", [1.0, 0.0], SearchOptions(5, doc_filter=1), doc_vectors=doc_vectors)
    assert ids(near) == [2]
    assert ids(hybrid_search(docs, named, index, "", [1.0, 0.0], SearchOptions(2, doc_filter=1), doc_vectors=doc_vectors.limit(0))) == [2, 3]
    # bounded jobs: the text column isn't read
    plan = hybrid_search(docs, vectors, index, "alpha", [1.0, 0.0])._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan


def test_weight_overrides():
    assert ranking.override(0.7, 1.4) == (0.7, 1.4) and ranking.override(0.7, 1.4, 1.4) == (1.4, 2.8)
    assert ranking.override(1.0, 1.0, 2.0, 4.0) == (4.0, 4.0)


def test_rerankers(spark, small):
    docs, vectors, index = small
    assert rerank.parse_scores("say [0.5, 2, -1] x", 4) == [0.5, 1.0, 0.0, 0.5]
    assert rerank.parse_scores("none", 2) == rerank.parse_scores('["a"]', 2) == [0.5, 0.5]
    rows = docs.where("doc_id <= 3").select("doc_id", "path", "text", (F.lit(1.0) / F.col("doc_id")).alias("score"))
    turned = rerank.cross_encoder("q", lambda _, texts: str([1.0 if "naïve" in t else 0.0 for t in texts]), weight=0.9)(rows)
    assert ids(turned)[0] == 3
    tail = rerank.cross_encoder("q", lambda _, texts: str([0.1, 0.9]), top=2)(rows)
    assert ids(tail) == [2, 1, 3] and tail.collect()[2]["score"] == pytest.approx(1 / 3)

    def fails(query, texts):
        raise RuntimeError

    assert ids(rerank.cross_encoder("q", fails)(rows)) == [1, 2, 3]
    got = hybrid_search(docs, vectors, index, "alpha", [1.0, 0.0], SearchOptions(3), reranker=rerank.cross_encoder("q", lambda _, t: str([len(x) / 100 for x in t])))
    assert got.columns == ["doc_id", "path", "score"] and got.count() == 3
    with pytest.raises(ValueError):
        rerank.profile("other")
    assert rerank.profile() == rerank.PROFILES["balanced"]
    none = rerank.spread_over_paths(rows.limit(1), F.lit("a/x.txt"), 1)
    assert ids(none) == [1]  # nothing is new: all are kept


def test_engine_operations(spark, small):
    docs, vectors, index = small
    calls = []

    def embed(texts):
        calls.append(texts)
        return [[1.0, 0.0] for _ in texts]

    e = engine.Engine(docs, vectors, index, embedding.QueryCache(embed), "/w")
    assert ids(e.search(" alpha  beta "))[0] == 1 and e.search("alpha", 1).count() == 1
    assert ids(e.search("alpha beta", threshold=0.99)) == [] and set(ids(e.search("alpha", path="/w/b/", limit=5))) == {3, 4}
    assert set(ids(e.search("alpha", limit=5, language="de, fr"))) <= {3, 4, 6}
    for bad in ("", "  "):
        with pytest.raises(ValueError):
            e.search(bad)
    with pytest.raises(ValueError):
        e.search("a", path="../x")
    total, shown, rows = e.list_sources(2)
    assert (total, shown, ids(rows)) == (6, 2, [1, 2])
    assert e.index_status().first()["state"] == "ready"
    assert ids(e.find_similar(1, 2)) == [3, 2] and e.find_similar(99).count() == 0
    assert [tuple(r) for r in e.list_collections().collect()] == [("c", 2), ("d", 3)]
    assert ids(e.drill_down(1, 3)) and e.drill_down(1, 3).columns == ["position", "doc_id", "path", "score"]
    for bad in (0, -1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            e.find_similar(bad)
    summary = e.summarize_matches("alpha").collect()
    assert summary[0]["position"] == 1 and len({r["path"] for r in summary}) == len(summary)
    gone, rest = e.delete_collection("d")
    assert gone == 3 and rest.list_collections().count() == 1 and rest.index_status().first()["state"] == "ready"
    assert [engine.bounded(x, 5, 50) for x in (None, 0, float("nan"), 7.9, 99)] == [5, 5, 5, 7, 50]
    assert len(engine.query_text("x" * 5000)) == 4000
    assert ignore.search_prefix("/w", "/w/a/b/") == "a/b/" and ignore.search_prefix("/w", ".") == ""
    cut = engine.within_budget(spark.createDataFrame([(1, "x" * 50), (2, "y" * 50), (3, "z")], "id int, text string"), "id", 10, 30, 70)
    assert [(r["id"], len(r["snippet"])) for r in cut.collect()] == [(1, 30)]


def test_query_cache_and_limits():
    now = [0.0]
    calls = []

    def embed(texts):
        calls.append(texts[0])
        if texts[0] == "bad":
            raise RuntimeError
        return [[float(len(calls))]]

    c = embedding.QueryCache(embed, "m", size=2, failures=2, pause=30, clock=lambda: now[0])
    assert c.get("a  b") == c.get(" a b") == [1.0]
    c.get("x")
    c.get("y")
    assert c.get("a b") == [4.0]  # it had been dropped
    for _ in range(2):
        with pytest.raises(RuntimeError):
            c.get("bad")
    with pytest.raises(embedding.BreakerOpen):
        c.get("new")
    now[0] = 31
    assert c.get("new")
    r = embedding.RateLimiter(2, 1, 3, clock=lambda: now[0])
    assert [r.delay() for _ in range(4)] == [0, 0, 1, 2]


def test_providers_retry_and_halve():
    waits, tried = [], []

    def flaky(texts):
        tried.append(len(texts))
        if len(tried) < 3:
            raise OSError
        return [[0.0] for _ in texts]

    assert embedding.with_retries(flaky, sleep=waits.append)(["a"]) == [[0.0]] and waits == [0.5, 1.0]

    def narrow(texts):
        if len(texts) > 1 or len(texts[0]) > 5:
            raise embedding.TooLongError
        return [[float(len(t))] for t in texts]

    assert embedding.with_retries(narrow)(["ab", "abcdefgh", "c"]) == [[2.0], [4.0], [1.0]]

    def broken(texts):
        raise embedding.PermanentError

    with pytest.raises(embedding.PermanentError):
        embedding.with_retries(broken)(["a"])
    assert embedding.summaries(["a b", "c d"], lambda s, u: "one\ntwo") == ["one", "two"]
    assert embedding.summaries(["a b", "c d"], lambda s, u: "x" if "\0" not in u else "only one") == ["x", "x"]
    assert embedding.summaries(["y" * 300], lambda s, u: 1 / 0) == ["y" * 200]


def make_pdf(pages):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] >>" % b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages)))]
    for i, content in enumerate(pages):
        packed = zlib.compress(content)
        objects += [b"<< /Type /Page /Contents %d 0 R >>" % (4 + 2 * i), b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(packed), packed)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in enumerate(objects, 1))


def test_pdf_pages():
    data = make_pdf([b"BT /F1 12 Tf (Hello \\(you\\)) Tj 0 -14 Td [(Wo) -20 (rld) -300 (again)] TJ T* (next) ' ET", b"", b"BT <4869> Tj (cut o"])
    assert extract.extract("a.PDF", data) == ("[Page 1]\nHello (you)\nWorld again\nnext\n\n[Page 3]\nHi", None)
    assert pdf.pdf_text(make_pdf([b""]), lambda d: "read") == "read"
    with pytest.raises(pdf.OCRError):
        pdf.pdf_text(make_pdf([b""]), lambda d: 1 / 0)
    assert extract.extract("b.pdf", b"junk")[1] == "ValueError" and extract.extract("c.pdf", data + b"<< /Encrypt 9 0 R >>")[1] == "encrypted"


def archive(parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return data.getvalue()


def test_office_files():
    cell = lambda t: f"<tc><p><r><t>{t}</t></r></p></tc>"
    doc = archive({"word/document.xml": f"<document><body><p><r><t>Head</t></r></p><tbl><tr>{cell('a')}{cell('b')}</tr></tbl></body></document>", "word/header1.xml": "<hdr><p><r><t>top</t></r></p></hdr>"})
    assert extract.extract("a.docx", doc)[0] == "[Document]\nHead\na | b\n\n[Header 1]\ntop"
    rel = lambda *pairs: "<Relationships>" + "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in pairs) + "</Relationships>"
    ns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    slide = lambda t, kind="body": f'<sld><sp><nvPr><ph type="{kind}"/></nvPr><p><r><t>{t}</t></r></p></sp></sld>'
    ppt = archive({"ppt/presentation.xml": f'<p {ns}><sldId r:id="r2"/><sldId r:id="r1"/></p>', "ppt/_rels/presentation.xml.rels": rel(("r1", "slides/slide1.xml"), ("r2", "slides/slide2.xml")), "ppt/slides/slide1.xml": slide("one"), "ppt/slides/slide2.xml": slide("two"), "ppt/notesSlides/notesSlide1.xml": "<n>" + slide("said") + slide("7", "sldNum") + "</n>"})
    assert extract.extract("a.pptx", ppt)[0] == "[Slide 2]\ntwo\n\n[Slide 1]\none\n[Notes]\nsaid"
    book = archive({"xl/workbook.xml": f'<w {ns}><sheet name="B" r:id="r2"/><sheet name="A" r:id="r1"/><sheet name="Bad" r:id="r3"/></w>', "xl/_rels/workbook.xml.rels": rel(("r1", "worksheets/sheet1.xml"), ("r2", "worksheets/sheet2.xml"), ("r3", "worksheets/sheet3.xml")), "xl/sharedStrings.xml": "<sst><si><t>hi</t></si></sst>", "xl/worksheets/sheet1.xml": '<s><c r="A1" t="s"><v>0</v></c><c r="B1" t="b"><v>1</v></c></s>', "xl/worksheets/sheet2.xml": '<s><c r="C3"><f>1+1</f><v>2</v></c></s>', "xl/worksheets/sheet3.xml": "<s><"})
    assert extract.extract("a.xlsx", book)[0] == "[Sheet B]\nC3 = 1+1 -> 2\n\n[Sheet A]\nA1: hi\nB1: TRUE"
    assert extract.extract("big.docx", bytes(1))[1] is not None


def test_python_strategy_and_empty_texts():
    r = code.Registry()
    r.register(code.PYTHON)
    got = r.split("import os\n\n@d\ndef f():\n    pass\n\nx = 1\n", "a.py", Splitter(4, 0.0))
    assert [c for c, _, _ in got] == ["import os\n\n@d\ndef f():\n    pass", "import os\n\nx = 1"]
    assert r.split("def (", "a.py")[0][0] == "def (" and r.split(None, "a.py") == r.split(" ", None) == []
    assert r.get("x/y.GO").name == "go" and r.get("a.b/c").name == "generic"
    long = "def f():\n" + "    y = 1\n" * 200
    parts = r.split(long + "x = 2\n", "a.py", Splitter(20, 0.0))
    assert all("def f():" in c for c, _, _ in parts[:-1])


def test_ingest_of_a_folder(spark, tmp_path):
    root = tmp_path / "tree"
    for name, text in {"a.txt": "Alpha beta gamma", "sub/b.md": "# T\n\nsome text", "sub/copy.md": "# T\n\nsome text", ".git/x": "hidden", ".gitignore": "*.log\n", "x.log": "gone", "sub/.gitignore": "skip/\n", "sub/skip/c.txt": "gone", "bad.docx": "no zip", "empty.txt": "", "sub/__init__.py": "x = 1"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    store = Store(spark, str(tmp_path / "store"))
    asked = spark.sparkContext.accumulator(0)

    def embed(texts):
        asked.add(len(texts))
        return embedding.hash_embedder(8)(texts)

    run = lambda: ingest(spark, str(root), store, embed, "hash", 8)
    first = run()
    assert first == {"indexed": 4, "chunks": 4, "deleted": 0, "failed": 1}
    paths = {r["path"]: r["doc_id"] for r in store.documents.collect()}
    assert paths.keys() == {"a.txt", "sub/b.md", "sub/copy.md", "sub/__init__.py"} and store.chunks.count() == 4
    assert [(r["path"], r["error"], r["attempts"]) for r in store.quarantine.collect()] == [("bad.docx", "BadZipFile", 1)]
    before = asked.value
    (root / "a.txt").write_text("Alpha beta gamma delta")
    (root / "sub/new.md").write_text("# T\n\nsome text")
    (root / "sub/b.md").unlink()
    second = run()
    assert (second["indexed"], second["deleted"], second["failed"]) == (2, 1, 0)  # the failed file is in quarantine
    assert asked.value - before == 1  # the new file's content is in the cache
    now = {r["path"]: r["doc_id"] for r in store.documents.collect()}
    assert now.keys() == {"a.txt", "sub/copy.md", "sub/new.md", "sub/__init__.py"} and now["a.txt"] == paths["a.txt"]
    assert {r["doc_id"] for r in store.chunks.collect()} == set(now.values())
    store.rename("a.txt", "z.txt")
    store.delete(F.col("path").startswith("sub/"))
    assert [r["path"] for r in store.documents.collect()] == ["z.txt"] and store.chunks.count() == 1
    store.release(F.col("path") == "bad.docx")
    assert store.quarantine.count() == 0
    assert not store.ensure_model("hash", 8, True) and store.ensure_model("other", 8, True)
    assert store.documents.count() == store.chunks.count() == 0
    store.vacuum("documents")
    assert len(store._versions("documents")) == 1
    assert store.documents.schema.names == spark.createDataFrame([], DOCUMENTS).schema.names and store.chunks.schema.names == spark.createDataFrame([], CHUNKS).schema.names


def test_stream_of_file_events(spark, tmp_path):
    """Events come as files; each micro-batch applies the latest state of each path."""
    (tmp_path / "in").mkdir()
    state: dict[str, str] = {}
    schema = "path string, ts timestamp, op string, id long"

    def feed(name, rows):
        spark.createDataFrame(rows, "path string, ts string, op string, id long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def apply(batch, _):
        for r in batch.collect():
            if r["op"] == "remove":
                state.pop(r["path"], None)
            else:
                state[r["path"]] = r["op"]

    def drain():
        events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        live.apply_stream(events, "path", "ts", "id", apply, f"{tmp_path}/check").awaitTermination(60)

    feed("1", [("a", "2024-01-01 00:00:00", "create", 1), ("a", "2024-01-01 00:00:01", "write", 2), ("b", "2024-01-01 00:00:00", "create", 3)])
    drain()
    assert state == {"a": "write", "b": "create"}
    feed("2", [("a", "2024-01-01 00:00:05", "remove", 4), ("c", "2024-01-01 00:00:05", "create", 5)])
    drain()
    assert state == {"b": "create", "c": "create"}


def test_debounce_as_a_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", "create"), ("a", "2024-01-01 00:00:00.3", "write"), ("a", "2024-01-01 00:00:09", "remove"), ("z", "2024-01-01 01:00:00", "create")]
    spark.createDataFrame(rows, "path string, ts string, op string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("path string, ts timestamp, op string").parquet(f"{tmp_path}/in")
    query = live.debounce(events, "path", "ts", "op").writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {(r["path"], r["op"], r["n"]) for r in spark.table("debounced").collect()}
    assert got <= {("a", "write", 2), ("a", "remove", 1), ("z", "create", 1)} and ("a", "write", 2) in got


def test_states_and_guards():
    s = live.IndexState()
    s.move("indexing")
    assert not s.servable
    s.move("degraded", " slow ")
    assert s.servable and s.message == "slow"
    with pytest.raises(ValueError):
        s.move("starting")
    runs = []
    guard = live.Resync(lambda: runs.append(1) if len(runs) else (runs.append(0), guard.request(), guard.request()))
    guard.request()
    assert runs == [0, 1] and not guard.running
    done = []
    m = live.Maintenance({"flush": (120, lambda: done.append("f")), "check": (300, lambda: done.append("c"))})
    assert [m.tick(t) for t in (0, 119, 120, 300)] == [[], [], ["flush"], ["flush", "check"]]


def test_column_functions(spark):
    rows = spark.createDataFrame([("one two  three", "A/B.Tar.GZ"), (None, None), ("", "x.d/noext")], "t string, p string")
    got = rows.select(queries.last_words(F.col("t"), 2), queries.extension(F.col("p")), queries.one_line(F.col("t"), 6), queries.signature(F.col("t"))).collect()
    assert tuple(got[0]) == ("two three", ".gz", "one...", "one two  three") and got[1][1] is None and tuple(got[2])[:2] == ("", "")
    assert stemming.stems("Foo_bar's running") == ["foo", "bar", "s", "run"]


def test_projections_are_kept(spark, tmp_path):
    m = vector.projection_matrix(3, 5)
    vector.save_projection(spark, f"{tmp_path}/p", m)
    assert (vector.load_projection(spark, f"{tmp_path}/p") == m).all() and (vector.projection_matrix(3, 5) == m).all()
    rows = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0, 0.0],), ([1.0],), (None,)], "v array<double>").select(vector.project(F.col("v"), m).alias("c")).collect()
    assert len(rows[0]["c"]["codes"]) == 3 and {0, 255} <= set(rows[0]["c"]["codes"]) and rows[1]["c"]["codes"] is None


def test_search_time_is_bounded_by_candidates(spark, small):
    docs, vectors, index = small
    began = time.time()
    hybrid_search(docs, vectors, index, "alpha beta", [1.0, 0.0]).collect()
    assert time.time() - began < 60
