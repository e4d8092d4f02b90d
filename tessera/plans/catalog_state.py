"""Stored state and events as queries: quarantine, caches, retries, resyncs, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vector
from ..sources.store import plan_embeddings, quarantined, without_orphans
from ..sources.tables import corpus, table, vectors
from ..streaming import live
from .ingest import changes
from .registry import D, V, query

_CENTROID = "p AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY label) AS n FROM v), w AS (SELECT label, v, CASE WHEN p = n - 1 AND n > 2 THEN 1.2::DOUBLE WHEN p = 0 AND n > 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN n > 4 THEN 1 + 0.3::DOUBLE * (1 - 2 * abs(p / (n - 1) - 0.5)) ELSE 1 END AS w FROM p), f AS (SELECT label, w, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM w), g AS (SELECT label, dim, sum(x * w) / sum(w) AS x FROM f GROUP BY ALL), h AS (SELECT label, list(x ORDER BY dim) AS v FROM g GROUP BY label), u AS (SELECT label, [x / sqrt(list_inner_product(v, v)) FOR x IN v] AS v FROM h), c AS (SELECT label, v, list_min(v) AS low, (list_max(v) - list_min(v)) / 255 AS scale FROM u), k AS (SELECT label, [round((x - low) / scale) * scale + low FOR x IN v] AS v FROM c)"


def _doc_vectors(spark, sf):
    return vector.doc_vectors(vectors(spark, sf), "label", "doc_id").select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("path"), "codes")


@query(f"WITH {V}, {_CENTROID}, q AS (SELECT v AS q FROM v WHERE doc_id = 7) SELECT 'label_' || label AS path, round(list_inner_product(v, q), 6) AS score FROM k, q ORDER BY score DESC, path LIMIT 4")
def top_documents(spark, sf):
    """Documents (here labels) whose stored vectors are nearest to a query."""
    q = vectors(spark, sf).where("doc_id = 7").first()["v"]
    return vector.top_documents(_doc_vectors(spark, sf), q, 4)


@query(f"WITH {V}, {_CENTROID}, q AS (SELECT v AS q FROM v WHERE doc_id = 7), top AS (SELECT label FROM k, q ORDER BY round(list_inner_product(v, q), 6) DESC, 'label_' || label LIMIT 2) SELECT doc_id, round(list_inner_product(v, q), 6) AS score FROM v, q WHERE label IN (SELECT label FROM top) ORDER BY score DESC, doc_id LIMIT 10")
def doc_filter(spark, sf):
    """Vector search within the documents of the nearest document vectors."""
    v = vectors(spark, sf)
    q = v.where("doc_id = 7")
    near = vector.top_documents(_doc_vectors(spark, sf), q.first()["v"], 2)
    kept = v.withColumn("path", F.concat(F.lit("label_"), F.col("label").cast("string"))).join(F.broadcast(near.select("path")), "path", "left_semi")  # two rows
    return vector.top_by_dot(kept, q.select(F.col("v").alias("q")), 10)


@query("WITH n AS (SELECT doc_id, source, sha256(text) AS h FROM documents WHERE doc_id % 2 = 1), own AS (SELECT DISTINCT source, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 0), c AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0) SELECT doc_id, CASE WHEN own.h IS NOT NULL THEN 'stored' WHEN c.h IS NOT NULL THEN 'cached' ELSE 'embed' END AS origin FROM n LEFT JOIN own USING (source, h) LEFT JOIN c USING (h)")
def embedding_plan(spark, sf):
    """New chunks against those of their document (here the collection) and the cache of all contents."""
    c = corpus(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.xxhash64("collection").alias("doc_id"), F.sha2("text", 256).alias("content_hash"), F.array(F.lit(0.0)).alias("v"))
    old = c.where("chunk_id % 2 = 0")
    done = plan_embeddings(c.where("chunk_id % 2 = 1"), old.where("chunk_id % 3 = 0"), old.select("content_hash", "v"))
    return done.select(F.col("chunk_id").alias("doc_id"), "origin")


@query("SELECT sha256(text) AS content_hash, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1")
def dedup_cache(spark, sf):
    """The cache of contents after those of a third of the documents were taken out."""
    c = corpus(spark, sf).select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return c.where("doc_id % 3 <> 0").groupBy("content_hash").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT 'u' || user_id AS path, event_type AS error, ts, event_id FROM events WHERE value < 20) SELECT path, arg_max(error, (ts, error)) AS error, count(*)::INT AS attempts, max(ts) AS created_at FROM e GROUP BY path")
def quarantine_list(spark, sf):
    """The quarantine after two batches of failures."""
    e = table(spark, sf, "events").where("value < 20").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("error"), F.col("ts").alias("created_at"), "event_id")
    none = spark.createDataFrame([], "path string, error string, attempts int, created_at timestamp")
    first = quarantined(none, e.where("event_id % 2 = 0").drop("event_id"))
    return quarantined(first, e.where("event_id % 2 = 1").drop("event_id"))


@query(f"WITH {D}, s AS (SELECT path, sha256(text) AS h FROM d WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0), k AS (SELECT path, sha256(CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE text END) AS h FROM d WHERE doc_id % 2 = 0) SELECT coalesce(s.path, k.path) AS path, CASE WHEN s.h IS NULL THEN 'delete' WHEN k.h IS NULL OR k.h <> s.h THEN 'index' ELSE 'keep' END AS action FROM s FULL JOIN k USING (path)")
def ingest_plan(spark, sf):
    """What an ingest does with each path: some files are gone, some quarantined, some have changed."""
    c = corpus(spark, sf)
    seen = c.where("doc_id % 5 <> 0").select("path", F.sha2("text", 256).alias("hash"))
    known = c.where("doc_id % 2 = 0").select("path", F.sha2(F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("text")), 256).alias("hash"))
    return changes(seen, known, c.where("doc_id % 7 = 0").select("path"))


@query("SELECT vec_id AS doc_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_cleanup(spark, sf):
    """Chunks whose document is left after all but English ones were deleted."""
    docs = table(spark, sf, "documents").where("lang = 'en'")
    return without_orphans(vectors(spark, sf).select("doc_id", "label"), docs)


# --- events ---


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 'ignore' WHEN 'view' THEN 'quarantine' ELSE 'retry' END AS action, count(*) AS n FROM events GROUP BY ALL")
def error_classes(spark, sf):
    """What happens after each class of error: clicks stand for cancellations, views for files that are too large."""
    error = F.when(F.col("event_type") == "click", "canceled").when(F.col("event_type") == "view", "too_large").otherwise(F.col("event_type"))
    return table(spark, sf, "events").groupBy("event_type", live.error_action(error).alias("action")).agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT user_id, max(ts) AS v FROM events GROUP BY user_id), s AS (SELECT user_id, 1 + user_id % 3 AS n, CASE WHEN user_id % 5 = 0 THEN TIMESTAMP '2000-01-01' WHEN user_id % 7 = 0 THEN TIMESTAMP '2999-01-01' ELSE v END AS v0 FROM l WHERE user_id % 2 = 0), j AS (SELECT l.user_id, l.v, CASE WHEN v0 IS NULL OR v > v0 THEN 1 ELSE n + 1 END AS attempts, v < v0 AS stale FROM l LEFT JOIN s USING (user_id)) SELECT user_id, attempts::INT AS attempts, CASE WHEN user_id % 11 = 0 THEN 'quarantine' WHEN stale THEN 'stale' WHEN attempts <= 3 THEN 'scheduled' ELSE 'gave_up' END AS outcome, CASE WHEN NOT (user_id % 11 = 0) AND NOT coalesce(stale, false) AND attempts <= 3 THEN (attempts * 2)::BIGINT END AS delay FROM j")
def retry_schedule(spark, sf):
    """One failure of each user after earlier ones: newer versions begin anew, older ones are stale."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("version"))
    failures = e.withColumn("error", F.when(F.col("user_id") % 11 == 0, "permanent").otherwise("io"))
    version = F.when(F.col("user_id") % 5 == 0, F.lit("2000-01-01").cast("timestamp")).when(F.col("user_id") % 7 == 0, F.lit("2999-01-01").cast("timestamp")).otherwise(F.col("version"))
    state = e.where("user_id % 2 = 0").select("user_id", (1 + F.col("user_id") % 3).cast("int").alias("attempts"), version.alias("version"))
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    out = live.schedule_retries(failures, "user_id", "version", "error", state, now)
    return out.select("user_id", "attempts", "outcome", (F.unix_timestamp("due") - F.unix_timestamp(now)).alias("delay"))


@query("WITH e AS (SELECT ts, CASE WHEN event_id % 500 = 0 THEN 'sub/.gitignore' ELSE 'f' || user_id END AS path FROM events), r AS (SELECT ts, CASE WHEN ts < lag(ts) OVER (ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM e WHERE path LIKE '%.gitignore'), s AS (SELECT ts, sum(fresh) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM r), m AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS began, count(*) AS n FROM e GROUP BY 1) SELECT min(ts) AS began, 'rules' AS reason FROM s GROUP BY s UNION ALL SELECT began, 'overflow' AS reason FROM m WHERE n > 12")
def resync_requests(spark, sf):
    """When all files must be compared: rule files changed, or more events came in an hour than the buffer holds."""
    e = table(spark, sf, "events").select("ts", F.when(F.col("event_id") % 500 == 0, "sub/.gitignore").otherwise(F.concat(F.lit("f"), F.col("user_id").cast("string"))).alias("path"))
    return live.resync_needed(e, "path", "ts", 12, "1 hour")


@query("WITH l AS (SELECT user_id, max(ts) AS known FROM events WHERE event_id % 2 = 0 GROUP BY user_id) SELECT event_id FROM events LEFT JOIN l USING (user_id) WHERE event_id % 2 = 1 AND (known IS NULL OR ts >= known)")
def fresh_results(spark, sf):
    """Results that aren't older than what is known of their key."""
    e = table(spark, sf, "events")
    return live.not_older(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), "user_id", "ts").select("event_id")


_SEVERITY = ["healthy", "degraded", "unhealthy", "unknown"]


@query("SELECT doc_id % 50 AS component, ['healthy', 'degraded', 'unhealthy', 'unknown'][max(CASE WHEN quality IS NULL OR toxic IS NULL THEN 3 WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END) + 1] AS status FROM labels GROUP BY 1")
def worst_status(spark, sf):
    """The worst of the states of each component's checks."""
    level = F.when(F.col("quality").isNull() | F.col("toxic").isNull(), 3).when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    names = F.array(*map(F.lit, _SEVERITY))
    return table(spark, sf, "labels").groupBy((F.col("doc_id") % 50).alias("component")).agg(F.max(level).alias("l")).select("component", F.get(names, F.col("l")).alias("status"))


@query("SELECT 'documents' AS checked, CASE WHEN (SELECT count(*) FROM documents) > 0 THEN 'healthy' ELSE 'unhealthy' END AS status UNION ALL SELECT 'embeddings', CASE WHEN (SELECT count(DISTINCT len(embedding)) FROM embeddings) = 1 THEN 'healthy' ELSE 'degraded' END UNION ALL SELECT 'vectors', CASE WHEN (SELECT count(*) FROM embeddings) >= (SELECT count(*) FROM documents) THEN 'healthy' ELSE 'degraded' END UNION ALL SELECT 'overall', CASE WHEN (SELECT count(*) FROM documents) = 0 THEN 'unhealthy' WHEN (SELECT count(DISTINCT len(embedding)) FROM embeddings) <> 1 OR (SELECT count(*) FROM embeddings) < (SELECT count(*) FROM documents) THEN 'degraded' ELSE 'healthy' END")
def health_checks(spark, sf):
    """Whether tables can be read, vectors have one length, and each document has one; and the worst of these."""
    d = table(spark, sf, "documents").agg(F.count("*").alias("d"))
    e = table(spark, sf, "embeddings").agg(F.count("*").alias("e"), F.countDistinct(F.size("embedding")).alias("sizes"))
    level = [("documents", F.when(F.col("d") > 0, 0).otherwise(2)), ("embeddings", F.when(F.col("sizes") == 1, 0).otherwise(1)), ("vectors", F.when(F.col("e") >= F.col("d"), 0).otherwise(1))]
    worst = ("overall", F.greatest(*(x for _, x in level)))
    names = F.array(*map(F.lit, _SEVERITY))
    one = d.crossJoin(e).select(F.explode(F.array(*(F.struct(F.lit(n).alias("checked"), F.get(names, x).alias("status")) for n, x in [*level, worst]))).alias("r"))
    return one.select("r.checked", "r.status")
