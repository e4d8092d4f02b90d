import io
import json
import zipfile

from tessera.functions.chunking import Splitter, sentences
from tessera.functions.extract import extract, html_text, looks_binary
from tessera.operators import fts, ranking
from tessera.sources.patterns import glob_regex
from tessera.streaming import live


def test_queries_and_oracles_register():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_compile_query():
    q = fts.compile_query("hello world")
    assert q.parts == ("hello", "world", "world*") and q.near == "NEAR(hello world, 10)"
    assert fts.compile_query('"exact match" other').parts == ('"exact match"', "other", "other*")
    assert fts.compile_query("hello hello").bare == ("hello",)
    assert fts.split_identifier("getUserName") == ["get", "user", "name"]
    assert fts.compile_query("").units == []


def test_weights():
    assert ranking.weights("getUser") == (1.5, 0.6)
    assert ranking.weights("word") == (1.2, 0.9)
    assert ranking.weights("how to update the config") == (0.7, 1.4)


def test_sentences():
    assert len(sentences("Dr. Smith went home. He slept.")) == 2
    assert len(sentences("Version 3.14 is out. Use it.")) == 2
    assert len(sentences("Hello! How are you? I am fine.")) == 3


def test_chunks_overlap_and_keep_headings():
    text = "# Introduction\n\n" + "one two three four five six.\n\n" * 6
    chunks = Splitter(12, 0.0).split(text)
    assert len(chunks) >= 2 and all("Introduction" in c for c, _, _ in chunks)
    words = " ".join(f"w{i}" for i in range(1000))
    parts = Splitter(100, 0.15).split(words)
    assert parts[0][0].split()[-15:] == parts[1][0].split()[:15]
    assert Splitter().split(None) == [] == Splitter().split(" ")


def test_globs():
    import re

    assert re.search(glob_regex("*.py"), "a/b.py") and re.search(glob_regex("**/b.py"), "a/c/b.py")
    assert not re.search(glob_regex("src/**/x.py"), "lib/x.py")


def test_readers():
    assert html_text("<p>a<script>x</script></p><td>b</td>").startswith("a")
    assert looks_binary(b"a\0b") and not looks_binary(b"plain")
    cell = {"cell_type": "code", "source": ["x"], "outputs": [{"text": ["1"]}, {"text": ["1"]}]}
    assert extract("n.ipynb", json.dumps({"cells": [cell]}).encode())[0] == "[Code Cell 1]\nx\n[Output]\n1"
    assert extract("a.rtf", rb"{\rtf1{\fonttbl x}Hi\par \u228?b}")[0] == "Hi\näb"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:body></w:document>')
    assert extract("a.docx", data.getvalue())[0] == "[Document]\nHello"
    assert extract("a.docx", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")[1] == "encrypted"
    assert extract("a.bin", b"x") == ("", None)


def test_debounce_and_latest(spark):
    e = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00', 'write', 1), (1, timestamp'2024-01-01 00:00:00.3', 'remove', 2), (1, timestamp'2024-01-01 00:00:09', 'create', 3) t(path, ts, op, id)")
    got = sorted((r["n"], r["op"]) for r in live.debounce(e, "path", "ts", "op").collect())
    assert got == [(1, "create"), (2, "remove")]
    assert live.latest(e, "path", "ts", "id").first()["op"] == "create"
