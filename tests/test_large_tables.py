"""Queries on rows that only large tables hold, against their SQL."""

import duckdb

from tessera.plans.catalog import ORACLES, QUERIES


def oracle(name, folder, *tables):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    return c.sql(ORACLES[name]).fetchall()


def exact(rows):
    return sorted(repr(tuple(r)) for r in rows)


def test_what_rounds_to_zero_keeps_its_sign(spark, tmp_path):
    v = [[0.5, -2e-7, 2e-7, -0.5], [-3e-8, 0.25, -0.0, 1.0], [0.0, 0.1, -4e-7, -0.9]]
    rows = spark.createDataFrame([(i, x, i % 2) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("normalize_vectors", "doc_centroids"):
        got = exact(QUERIES[name](spark, str(tmp_path)).collect())
        assert got == exact(oracle(name, tmp_path, "embeddings")) and any("-0.0" in r for r in got)


def test_pairs_to_link_a_group_of_near_copies_grow_with_it(spark, monkeypatch):
    import random

    from tessera.llm import jaccard

    draw = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(f"x{draw.randrange(10**6)}" if draw.random() < 0.01 else w for w in base) for _ in range(120)]
    texts += [" ".join(f"{w}{k}" for w in base) for k in range(20)]
    half = base[:150] + [f"h{i}" for i in range(50)]  # like the others, and like the next
    texts += [" ".join(half), " ".join(half[60:] + [f"g{i}" for i in range(40)]), " ".join(f"y{i}" for i in range(90))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    verified, whole = [], jaccard._verify

    def counted(pairs, *rest, **options):
        verified.append(pairs.count())
        return whole(pairs, *rest, **options)

    monkeypatch.setattr(jaccard, "_verify", counted)
    kept = {r["doc_id"] for r in jaccard.drop_near_duplicates(docs).collect()}
    assert sum(verified) < 10 * len(texts)
    verified.clear()
    members, pairs = jaccard.join_sets(docs)
    grouped, least = jaccard._grouped(members, jaccard.components(pairs))
    assert kept == {r["one"] for r in least.collect()} == {0, *range(120, 140), 142}
    assert sum(verified) > 40 * len(texts)


def test_postings_are_sorted_in_bounded_blocks_without_a_shuffle(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame

    from tessera.operators import index

    texts = ["b a b", "", "c", "a " * 30, "a d", None, "ponies c"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "words": [t and t.strip() for t in texts]})
    blocks = list(index._blocks([batch, batch], 60))
    assert len(blocks) > 4 and pa.concat_tables(blocks).to_pylist() == batch.to_pylist() * 2
    assert all(b.num_rows == 1 or sum(len(w or "") for w in b["words"].to_pylist()) <= 60 for b in blocks)
    rows = [r for b in index._inverted(pa.Table.from_batches([batch.slice(0, 1), batch.slice(2, 1)])) for r in b.to_pylist()]
    assert [(r["term"], r["doc_id"], r["tf"], r["dl"], r["positions"]) for r in rows] == [("a", 0, 1, 3, [2]), ("b", 0, 2, 3, [1, 3]), ("c", 2, 1, 1, [1])]

    def refuse(*_):
        raise AssertionError("the postings are shuffled")

    monkeypatch.setattr(DataFrame, "repartitionByRange", refuse)
    docs = spark.createDataFrame([(i, f"Alpha{'!' * i} naïve_{i % 3}") for i in range(40)], "doc_id long, text string")
    built = index.Index.build(docs, str(tmp_path / "index"))
    found = built.postings(spark).groupBy("term").count().collect()
    assert built.avgdl == 3 and {r["term"]: r["count"] for r in found} == {"alpha": 40, "naiv": 40, "0": 14, "1": 13, "2": 13}


def test_texts_are_not_shuffled_for_summaries(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["summarize_matches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_texts_are_objects_slice_by_slice(spark):
    import pyarrow as pa

    from tessera.functions import chunking, code, embedding

    texts = ["A b. C d.", None, "", "x y. " * 300_000, "e. f", *["g h. I j."] * 50]
    seen = []
    got = chunking.in_slices(lambda part: seen.append(part) or [[t] for t in part], pa.list_(pa.string()), pa.array(texts))
    assert got.to_pylist() == [[t] for t in texts] and len(seen) == 1
    wide = pa.array(["z" * 1_000_000] * 30)
    assert [b - a for a, b in chunking.text_bounds(wide)] == [4] * 7 + [2] and not list(chunking.text_bounds(wide.slice(0, 0)))
    assert [b - a for a, b in chunking.text_bounds(pa.array(["z" * 9_000_000, "a", None]))] == [1, 2]

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    splitter = chunking.Splitter(1000, 0.0)
    columns = [chunking.sentence_array("text"), splitter.column(docs.text), code.Registry().column(docs.text, docs.text.substr(1, 3), splitter, 400)]
    for row in docs.select("text", *(c.alias(f"c{i}") for i, c in enumerate(columns))).collect():
        t = row["text"]
        assert row["c0"] == (chunking.sentences(t) if t else [])
        assert [tuple(c) for c in row["c1"]] == splitter.split(t)
        assert [tuple(c) for c in row["c2"]] == code.to_budget(code.Registry().split(t, t and t[:3], splitter), 400)
    rows = docs.select("doc_id", docs.text.substr(1, 20).alias("content"))
    done = embedding.embed_chunks(rows, embedding.hash_embedder(8))
    assert done.columns == ["doc_id", "content", "v"] and "MapInArrow" in done._jdf.queryExecution().executedPlan().toString()
    for row in done.collect():
        assert row["v"] == embedding.hash_embedder(8)([row["content"] or ""])[0]
