"""Which files of a tree are documents: hidden folders, ignore files, default excludes, companion logs and keys."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .patterns import path_filter

#: Version control, dependencies, build output, editors, system files, compiled files, temporary files, coverage.
DEFAULT_EXCLUDES = """.git .git/** .svn/** .hg/** node_modules/** vendor/** **/vendor/** dist/** build/** target/** out/** bin/** .idea/** .vscode/**
*.swp *.swo *~ .DS_Store Thumbs.db *.pyc *.pyo __pycache__/** *.class *.o *.so *.dylib tmp/** temp/** .quarantine .quarantine/** coverage/** .coverage htmlcov/**""".split()


def rule_regex(line: str) -> tuple[str, bool] | None:
    """(regular expression over relative paths, whether it un-ignores) of a line of an ignore file; None for blanks and comments.

    A leading slash anchors the rule at its folder, a trailing one asks for a folder; what lies below a match is matched.
    """
    line = line.rstrip("\r\n")
    line = line.rstrip() if not line.endswith("\\ ") else line
    if not line or line[0] == "#":
        return None
    negated = line[0] == "!"
    body = line[negated:].removeprefix("\\")
    anchored = body.startswith("/")
    folder = body.endswith("/")
    body = body.strip("/")
    if not body:
        return None
    out, i = "", 0
    while i < len(body):
        if body.startswith("/**/", i):
            out, i = out + "/(?:.+/)?", i + 4
        elif body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$", negated


def ignored(path: Column, rules: dict[str, str]) -> Column:
    """Whether the ignore files (folder -> content; '' is the root) ignore a path. In a file the last rule that fits decides; any file
    that ignores the path is enough, a deeper one can't undo it."""
    out = F.lit(False)
    for folder, content in rules.items():
        prefix = f"{folder}/" if folder else ""
        rel = F.substring(path, len(prefix) + 1, 1 << 30)
        verdict = F.lit(False)
        for rule in map(rule_regex, content.split("\n")):
            if rule:
                verdict = F.when(rel.rlike(rule[0]), not rule[1]).otherwise(verdict)
        out |= (path.startswith(prefix) & verdict) if prefix else verdict
    return out


def companion_log(path: Column, db_path: str) -> Column:
    """The log of a database file, and its rotated parts with a number."""
    return path.rlike(f"^{re.escape(posixpath.normpath(db_path))}\\.log(\\.[0-9]+)?$")


def hidden_folder(path: Column) -> Column:
    """A folder on the path begins with a dot; a file's own name may."""
    return path.rlike(r"(^|/)\.[^/]*/")


def document_key(root: str, path: Column) -> Column:
    """The path relative to root, normalised; null for the root itself and for what lies outside."""
    base = posixpath.normpath(root).rstrip("/") + "/"
    clean = F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), r"/{2,}", "/")
    inside = clean.startswith(base) & (F.length(clean) > len(base)) & ~clean.rlike(r"(^|/)\.\.(/|$)")
    return F.when(inside, F.regexp_replace(F.substring(clean, len(base) + 1, 1 << 30), r"/$", ""))


def search_prefix(root: str, raw: str) -> str:
    """A search's path relative to root; a trailing slash stays. Paths outside of root are an error."""
    raw = raw.strip()
    if not raw:
        return ""
    path = posixpath.relpath(raw, root) if raw.startswith("/") else raw
    path = posixpath.normpath(path.replace("\\", "/"))
    if path == ".":
        return ""
    if path == ".." or path.startswith("../"):
        raise ValueError(f"search path {raw!r} is outside of the indexed folder")
    return path + "/" if raw[-1] in "/\\" else path


def _unlisted(spark: SparkSession, root: str, depth: int) -> DataFrame:
    """Files whose names begin with a dot or an underscore, down to a depth: Spark's readers pass over them.

    Their names come from globs, one for each level; contents are read by the executors.
    """
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for k in range(depth + 1):
        for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/" + "*/" * k + "[._]*")) or []:
            if f.isFile():
                rows.append((f.getPath().toString(), f.getModificationTime() / 1000.0, f.getLen()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, uri in enumerate(batch.column("uri").to_pylist()):
                files, path = pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
                with files.open_input_stream(path) as stream:
                    yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, 1) for c in ("uri", "at", "length")] + [pa.array([stream.read()], pa.binary())], names=["uri", "at", "length", "content"])

    names = spark.createDataFrame(rows, "uri string, at double, length long")
    found = names.mapInArrow(read, "uri string, at double, length long, content binary")
    return found.select(_plain(F.col("uri")).alias("full"), F.timestamp_millis(F.round(F.col("at") * 1000).cast("long")).alias("modificationTime"), "length", "content")


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/*", "/")


def scan(spark: SparkSession, root: str, include: list[str] = [], exclude: list[str] = [], db_path: str = "") -> DataFrame:  # noqa: B006
    """(path, modified_at, length, hash, content) of the documents under root, by key.

    Ignore files are read first (they are few); paths are then filtered before any content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(_plain(F.col("path")).alias("full"), "modificationTime", "length", "content")
    depth = files.select(F.max(F.size(F.split(F.substring("full", len(root.rstrip("/")) + 2, 1 << 30), "/")))).first()[0] or 1
    others = _unlisted(spark, root, depth)
    keyed = files.unionByName(others).withColumn("key", document_key(root, F.col("full"))).where("key is not null").where(~hidden_folder(F.col("key")))
    named = others.withColumn("key", document_key(root, F.col("full"))).where(F.col("key").rlike(r"(^|/)\.gitignore$") & ~hidden_folder(F.col("key")))
    rules = {r["key"].rpartition("/")[0]: bytes(r["content"]).decode("utf-8", "replace") for r in named.select("key", "content").toLocalIterator()}
    kept = keyed.where(~ignored(F.col("key"), rules))
    if include or exclude:
        kept = kept.where(path_filter(F.col("key"), include, exclude))
    if db_path:
        kept = kept.where(~companion_log(F.col("full"), db_path))
    return kept.select(F.col("key").alias("path"), F.col("modificationTime").alias("modified_at"), "length", F.sha2("content", 256).alias("hash"), "content")
