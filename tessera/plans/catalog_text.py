"""Texts, files and codecs as queries: over the tables where SQL can follow, over small fixtures with literal results elsewhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import code, queries, stemming
from ..functions.chunking import Splitter, sentence_array
from ..functions.embedding import embed_chunks, hash_embedder
from ..functions.extract import extract_column, html_column
from ..operators import fts, vector
from ..sources import ignore
from ..sources.patterns import path_filter
from ..sources.tables import corpus, table, vectors
from .registry import V, literal_rows, query, sql_values


@query()
def chunk_documents(spark, sf):
    """Chunks of 128 words with an overlap of 15 % of every document."""
    docs = table(spark, sf, "documents").select("doc_id", F.explode(Splitter(128).column(F.col("text"))).alias("c"))
    return docs.select("doc_id", "c.chunk_index", "c.heading", "c.content")


@query()
def sentence_split(spark, sf):
    """Sentences of every document."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(sentence_array("text")).alias("position", "sentence"))


@query()
def html_extract(spark, sf):
    """Text of every page by the reader of files."""
    return table(spark, sf, "pages").select("page_id", html_column("html").alias("text"))


_SENTENCES = [
    ("Dr. Smith went to the store. He bought milk.", ["Dr. Smith went to the store.", "He bought milk."]),
    ("The U.S. is large. It has many states.", ["The U.S. is large.", "It has many states."]),
    ("Version 3.14 was released. It fixed bugs.", ["Version 3.14 was released.", "It fixed bugs."]),
    ("Hello! How are you? I am fine.", ["Hello!", "How are you?", "I am fine."]),
    ("Wait... then go. On Jan. 5 it ended", ["Wait...", "then go.", "On Jan. 5 it ended"]),
    ("", []),
]


@query(sql_values([(i, p, s) for i, (_, out) in enumerate(_SENTENCES) for p, s in enumerate(out)], "id, position, sentence"))
def sentence_cases(spark, sf):
    """Sentences of texts with abbreviations, initials, numbers and ellipses."""
    rows = literal_rows(spark, [(i, t) for i, (t, _) in enumerate(_SENTENCES)], "id int, text string")
    return rows.select("id", F.posexplode(sentence_array("text")).alias("position", "sentence"))


_CHUNKS = [
    ("# Intro\n\none two three\n\nfour five six\n\nseven eight nine", 8, [("# Intro\n\none two three\n\nfour five six", "## Intro"), ("## Intro\n\nseven eight nine", "## Intro")]),
    ("# A\n\n## B\n\nx y z", 20, [("# A\n\n## B\n\nx y z", "A > B")]),
    ("```\na b\n\nc d\n```\n\ne f", 6, [("```\na b\n\nc d\n```", ""), ("e f", "")]),
    ("a b c d e f g", 3, [("a b c", ""), ("d e f", ""), ("g", "")]),
    ("one\r\n\r\ntwo", 5, [("one\n\ntwo", "")]),
    (" \n ", 5, []),
]


@query(sql_values([(i, k, c, h) for i, (_, _, out) in enumerate(_CHUNKS) for k, (c, h) in enumerate(out)], "id, chunk_index, content, heading"))
def chunk_cases(spark, sf):
    """Headings, fences, paragraphs and words packed to a size, without overlap."""
    parts = []
    for i, (t, size, _) in enumerate(_CHUNKS):
        rows = literal_rows(spark, [(i, t)], "id int, text string")
        parts.append(rows.select("id", F.explode(Splitter(size, 0.0).column(F.col("text"))).alias("c")).select("id", "c.chunk_index", "c.content", "c.heading"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_GO = 'package main\n\nimport "fmt"\n\n// F greets\nfunc F() {\n\tfmt.Println("}")\n}\n\ntype T struct {\n\ta int\n}\n'
_CODE = [
    ("a/main.go", _GO, 10, ['package main\n\nimport "fmt"\n\nfunc F() {\n\tfmt.Println("}")\n}', 'package main\n\nimport "fmt"\n\ntype T struct {\n\ta int\n}']),
    ("a/bad.go", "package main\n\nfunc F() {", 50, ["package main\n\nfunc F() {"]),
    ("b.py", "import os\n\ndef f():\n    return 1\n\nclass A:\n    x = 1\n", 6, ["def f():\n    return 1", "class A:\n    x = 1"]),
    ("b.rs", "pub fn a() {}\nfn b() {}\n", 50, ["pub fn a() {}\n\nfn b() {}"]),
    ("c.java", "public class A {}", 50, ["public class A {}"]),
    ("d.txt", "def f():\n  pass\n", 50, ["def f():\n  pass"]),
]


@query(sql_values([(p, k, c) for p, _, _, out in _CODE for k, c in enumerate(out)], "path, chunk_index, content"))
def code_chunks(spark, sf):
    """Source files chunked by the strategy of their path."""
    parts = []
    for path, text, size, _ in _CODE:
        rows = literal_rows(spark, [(path, text)], "path string, text string")
        parts.append(rows.select("path", F.explode(code.Registry().column(F.col("text"), F.col("path"), Splitter(size, 0.0))).alias("c")).select("path", "c.chunk_index", "c.content"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(sql_values([("aaaa bbbb. cccc dddd", 14, "aaaa bbbb.", 11), ("aaaa bbbb cccc", 12, "aaaa bbbb", 10), ("abcdefghij", 4, "abcd", 4), ("short", 10, "short", 5), ("a. bcdefghijkl", 8, "a. bcdef", 8), ("p one\n\np two", 10, "p one", 7)], "text, most, part, used"))
def boundary_cuts(spark, sf):
    """Starts of texts that end at a boundary."""
    rows = [("aaaa bbbb. cccc dddd", 14), ("aaaa bbbb cccc", 12), ("abcdefghij", 4), ("short", 10), ("a. bcdefghijkl", 8), ("p one\n\np two", 10)]
    return literal_rows(spark, [(t, n, *code.cut_at_boundary(t, n)) for t, n in rows], "text string, most int, part string, used int")


@query("SELECT doc_id, count(*) AS parts, max(length(part)) <= 4000 AS within FROM (SELECT doc_id, unnest(range(greatest(1, length(text) // 4000))) AS k, '' AS part FROM documents WHERE length(text) <= 4000 AND trim(text, E' \\t\\n\\r') <> '') GROUP BY doc_id")
def embedding_budget(spark, sf):
    """Documents that fit the embedder's budget are one part."""
    short = table(spark, sf, "documents").where(F.length("text") <= code.MAX_INPUT)
    chunks = code.Registry().column(F.col("text"), F.lit("a.txt"), Splitter(100_000, 0.0), code.MAX_INPUT)
    parts = short.select("doc_id", F.explode(chunks).alias("c"))
    return parts.groupBy("doc_id").agg(F.count("*").alias("parts"), (F.max(F.length("c.content")) <= code.MAX_INPUT).alias("within"))


@query("SELECT doc_id, CASE WHEN lang = '' THEN text ELSE lang || chr(10) || chr(10) || text END AS input FROM documents")
def embed_inputs(spark, sf):
    """Headings (here languages) before contents."""
    return corpus(spark, sf).select("doc_id", F.when(F.col("language") == "", F.col("text")).otherwise(F.concat_ws("\n\n", "language", "text")).alias("input"))


@query("SELECT count(*) AS n, 16::INT AS dims, count(DISTINCT text) <= count(*) AS repeated FROM documents")
def embedded_chunks(spark, sf):
    """Every document embedded in batches by the deterministic embedder: equal contents have equal vectors."""
    docs = table(spark, sf, "documents").select("doc_id", F.lit("").alias("heading"), F.col("text").alias("content"))
    done = embed_chunks(docs, hash_embedder(16))
    same = done.groupBy("content").agg(F.countDistinct("v").alias("kinds"), F.count("*").alias("n"), F.max(F.size("v")).alias("dims"))
    return same.agg(F.sum("n").alias("n"), F.max("dims").alias("dims"), (F.max("kinds") == 1).alias("repeated"))


@query(r"SELECT doc_id, array_to_string(([x FOR x IN string_split_regex(text, '\s+') IF x <> ''])[-5:], ' ') AS tail FROM documents")
def last_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", queries.last_words(F.col("text"), 5).alias("tail"))


@query(r"SELECT doc_id, length(text) AS runes, len([x FOR x IN string_split_regex(text, '\s+') IF x <> '']) AS words FROM documents")
def word_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("runes"), F.size(queries.fields(F.col("text"))).cast("long").alias("words"))


@query(r"SELECT doc_id, CASE WHEN length(l) > 120 THEN substr(l, 1, 120) || '...' ELSE l END AS signature, CASE WHEN length(f) <= 40 THEN f ELSE substr(f, 1, 37) || '...' END AS log_line FROM (SELECT doc_id, trim(regexp_extract(text, '^\s*(\S[^\n]*)', 1)) AS l, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)")
def text_lines(spark, sf):
    """First lines and log lines."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", queries.signature(t).alias("signature"), queries.one_line(t, 40).alias("log_line"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%.1f MB', n / 1048576.0) END AS size FROM (SELECT doc_id, doc_id * doc_id * 7 AS n FROM documents WHERE doc_id < 1000)")
def human_sizes(spark, sf):
    return table(spark, sf, "documents").where("doc_id < 1000").select("doc_id", queries.human_bytes(F.col("doc_id") * F.col("doc_id") * 7).alias("size"))


@query("SELECT page_id, lower(regexp_extract(url, '(\\.[^./]*)$', 1)) AS ext FROM pages")
def extensions(spark, sf):
    return table(spark, sf, "pages").select("page_id", queries.extension(F.col("url")).alias("ext"))


_STEMS = [("Running", "run"), ("naïve", "naiv"), ("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("controlling", "control"), ("Straße", "straß"), ("ÇA", "ca"), ("œuvre", "œuvr"), ("x²", "x²"), ("日本語", "日本語"), ("at", "at")]


@query(sql_values(_STEMS, "word, stem"))
def porter_stems(spark, sf):
    return literal_rows(spark, [(w, stemming.porter(stemming.fold(w))) for w, _ in _STEMS], "word string, stem string")


_COMPILED = [
    ("hello world", "hello AND world AND world*", "hello OR world OR world*", "NEAR(hello world, 10)"),
    ("a b c", "a AND b AND c AND c*", "a OR b OR c OR c*", "NEAR(a b c, 10)"),
    ("hello hello", "hello AND hello*", "hello OR hello*", ""),
    ('"exact match" other', '"exact match" AND other AND other*', '"exact match" OR other OR other*', ""),
    ('"exact match" other word', '"exact match" AND other AND word AND word*', '"exact match" OR other OR word OR word*', "NEAR(other word, 10)"),
    ("getUserName", '"getusername" AND get AND getusername AND getusername* AND name AND user', '"getusername" OR get OR getusername OR getusername* OR name OR user', ""),
    ("parse_config", '"parse_config" AND config AND parse AND parse_config AND parse_config*', '"parse_config" OR config OR parse OR parse_config OR parse_config*', ""),
    ('"this AND that"', '"this that"', '"this that"', ""),
    ("", "", "", ""),
]


@query(sql_values(_COMPILED, "query, all_of, any_of, near"))
def compiled_queries(spark, sf):
    """Queries in their AND, OR and NEAR forms."""
    rows = [(q, c.all_of, c.any_of, c.near) for q, *_ in _COMPILED for c in [fts.compile_query(q)]]
    return literal_rows(spark, rows, "query string, all_of string, any_of string, near string")


_GLOBS = [("src/a.go", True), ("src/b/c.py", True), ("vendor/x.go", False), ("src/vendor/x.go", False), ("README.md", False), ("docs/a.go", True)]


@query(sql_values(_GLOBS, "path, kept"))
def glob_filter(spark, sf):
    """Includes first, then excludes."""
    rows = literal_rows(spark, [(p,) for p, _ in _GLOBS], "path string")
    return rows.select("path", path_filter(F.col("path"), ["*.go", "src/**"], ["vendor/**", "**/vendor/**"]).alias("kept"))


_RULES = {"": "*.log\n!keep.log\nbuild/\n/only_root.txt\n# note\n\ndocs/**/draft", "sub": "secret.txt\n!build/"}
_IGNORED = [("a.log", True), ("keep.log", False), ("sub/x.log", True), ("build/a.txt", True), ("sub/build/a.txt", True), ("builds/a.txt", False), ("only_root.txt", True), ("sub/only_root.txt", False), ("sub/secret.txt", True), ("secret.txt", False), ("docs/a/b/draft", True), ("docs/draft", True), ("sub/deep/secret.txt", True), ("sub/keep.log", False)]


@query(sql_values(_IGNORED, "path, ignored"))
def ignore_rules(spark, sf):
    """Root and nested ignore files."""
    rows = literal_rows(spark, [(p,) for p, _ in _IGNORED], "path string")
    return rows.select("path", ignore.ignored(F.col("path"), _RULES).alias("ignored"))


_PATHS = [("/w/a/b.txt", "a/b.txt", False, False), ("/w", None, False, False), ("/w/../x", None, False, False), ("/other/a", None, False, False), ("/w//a/./b", "a/b", False, False), ("/w/.git/config", ".git/config", True, False), ("/w/.env", ".env", False, False), ("/w/index.db.log", "index.db.log", False, True), ("/w/index.db.log.3", "index.db.log.3", False, True), ("/w/index.db.log.old", "index.db.log.old", False, False)]


@query(sql_values(_PATHS, "path, key, hidden, companion"))
def document_keys(spark, sf):
    """Paths relative to a root, hidden folders and companion logs."""
    rows = literal_rows(spark, [(p,) for p, *_ in _PATHS], "path string")
    key = ignore.document_key("/w", F.col("path"))
    return rows.select("path", key.alias("key"), F.coalesce(ignore.hidden_folder(key), F.lit(False)).alias("hidden"), ignore.companion_log(F.col("path"), "/w/index.db").alias("companion"))


_FILES = [("a.txt", b"plain\ntext", "plain\ntext", None), ("Makefile", b"all:", "all:", None), ("b.txt", b"bin\0ary", "", None), ("c.html", b"<p>a<script>x</script></p><p>b</p>", "a\nb", None), ("d.docx", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "", "encrypted"), ("e.rtf", rb"{\rtf1 Hi\par there}", "Hi\nthere", None), ("f.xyz", b"x", "", None)]


@query(sql_values([(p, t, e) for p, _, t, e in _FILES], "path, text, error"))
def file_texts(spark, sf):
    """Files by the reader of their extension."""
    rows = literal_rows(spark, [(p, bytearray(b)) for p, b, *_ in _FILES], "path string, content binary")
    return rows.select("path", extract_column(F.col("path"), F.col("content")).alias("x")).select("path", "x.text", "x.error")


# --- codecs and projections ---


@query("SELECT vec_id AS doc_id, len(embedding) * 4 AS bytes, true AS same FROM embeddings")
def float32_roundtrip(spark, sf):
    """Vectors as little-endian bytes and back."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<float>").alias("v"))
    b = e.withColumn("b", vector.float32_encode("v"))
    return b.select("doc_id", F.length("b").cast("long").alias("bytes"), (vector.float32_decode("b") == F.col("v")).alias("same"))


@query(f"WITH {V}, c AS (SELECT doc_id, v, list_min(v) AS low, (list_max(v) - list_min(v)) / 255 AS scale FROM v) SELECT doc_id, list_sum([round((x - low) / scale) FOR x IN v])::BIGINT AS total, array_to_string([round((x - low) / scale)::INT FOR x IN v], ' ') AS codes FROM c")
def int8_codes(spark, sf):
    c = vectors(spark, sf).select("doc_id", vector.int8_codes(F.col("v"))["codes"].alias("c"))
    return c.select("doc_id", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_join(F.col("c").cast("array<string>"), " ").alias("codes"))


@query(f"WITH {V}, q AS (SELECT v AS q FROM v WHERE doc_id = 7) SELECT doc_id, round(1 - list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))), 6) AS distance FROM v, q")
def cosine_distances(spark, sf):
    v = vectors(spark, sf)
    q = F.array(*(F.lit(x) for x in v.where("doc_id = 7").first()["v"]))
    return v.select("doc_id", vector.rounded(vector.cosine_distance(F.col("v"), q), 6).alias("distance"))


_M = vector.projection_matrix(4, 64)


@query(f"WITH {V}, m AS (SELECT {[[float(x) for x in row] for row in _M]}::DOUBLE[][] AS m), p AS (SELECT doc_id, [list_inner_product(v, r) FOR r IN m] AS p FROM v, m), u AS (SELECT doc_id, [x / sqrt(list_inner_product(p, p)) FOR x IN p] AS p FROM p), c AS (SELECT doc_id, p, list_min(p) AS low, (list_max(p) - list_min(p)) / 255 AS scale FROM u) SELECT doc_id, round(low, 6) AS low, round(scale, 8) AS scale FROM c")
def random_projection(spark, sf):
    """Vectors projected to four dimensions with a fixed seed."""
    c = vectors(spark, sf).select("doc_id", vector.project(F.col("v"), np.array(_M)).alias("c"))
    return c.select("doc_id", vector.rounded(F.col("c.low"), 6).alias("low"), F.round("c.scale", 8).alias("scale"))


@query(f"WITH {V}, q AS (SELECT v AS q FROM v WHERE doc_id = 7) SELECT doc_id, round(list_inner_product(v, q), 6) AS score FROM v, q WHERE (SELECT count(*) FROM v) <= 100000 ORDER BY score DESC, doc_id LIMIT 3")
def capped_search(spark, sf):
    """Brute force where there are few enough vectors."""
    v = vectors(spark, sf)
    return vector.capped_brute_force(v, v.where("doc_id = 7").select(F.col("v").alias("q")), 3, 100_000)
