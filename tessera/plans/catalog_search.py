"""Keyword, hybrid and ranked search as queries; their SQL is written over a table of stems and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..engine import match_summary
from ..functions import queries as text
from ..functions.stemming import TOKEN, stem_sql
from ..operators import fts, ranking, rerank, vector
from ..operators.filters import SearchFilter
from ..operators.index import index_of
from ..operators.search import SearchOptions
from ..operators.search import hybrid_search as hybrid
from ..sources.tables import corpus, table, vectors
from .registry import D, V, query

S = f"tk AS (SELECT doc_id, unnest(k) AS term, generate_subscripts(k, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS k FROM documents)), voc AS (SELECT DISTINCT term AS w FROM tk), {stem_sql()}, t AS (SELECT doc_id, pos, stem FROM tk JOIN st USING (term)), dl AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY doc_id), cs AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS nd, (SELECT count(*) FROM t) / (SELECT count(*) FROM documents)::DOUBLE AS avgdl)"


def index(spark, sf):
    return index_of(spark, sf, table(spark, sf, "documents"))


@query(f"WITH {S} SELECT stem AS term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY stem")
def token_stats(spark, sf):
    """Frequencies of every stem, from the index."""
    return index(spark, sf).postings(spark).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query(f"WITH {S} SELECT nd::BIGINT AS n_docs, (SELECT count(DISTINCT doc_id) FROM t) AS with_terms, (SELECT count(*) FROM (SELECT DISTINCT doc_id, stem FROM t)) AS postings, (SELECT count(*) FROM t) AS n_tokens, true AS in_step FROM cs")
def index_diagnostics(spark, sf):
    return index(spark, sf).diagnostics(spark)


def occurrences(unit: fts.Unit) -> str:
    """SQL of (doc_id, pos) where a unit begins."""
    test = lambda a, i: f"starts_with({a}.stem, '{unit.stems[i]}')" if unit.prefix and i + 1 == len(unit.stems) else f"{a}.stem = '{unit.stems[i]}'"
    joins = "".join(f" JOIN t t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.pos = t0.pos + {i} AND {test(f't{i}', i)}" for i in range(1, len(unit.stems)))
    return f"SELECT t0.doc_id, t0.pos FROM t t0{joins} WHERE {test('t0', 0)}"


def _bm25(tf: str, n: str) -> str:
    idf = f"ln((nd - {n} + 0.5) / ({n} + 0.5))"
    return f"(CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END) * {tf} * 2.2::DOUBLE / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"


def match_sql(words: str, limit: int = 100) -> str:
    """CTEs to b(doc_id, score, n_hit) and kw(doc_id, kw_rank) of a query."""
    q = fts.compile_query(words)
    units, near = q.units, q.near_units
    out = [f"o{i} AS ({occurrences(u)}), f{i} AS (SELECT doc_id, count(*) AS tf FROM o{i} GROUP BY doc_id), n{i} AS (SELECT count(*)::DOUBLE AS n FROM f{i})" for i, u in enumerate(units)]
    names = range(len(units))
    terms = " + ".join(_bm25(f"coalesce(f{i}.tf, 0)", f"(SELECT n FROM n{i})") for i in names)
    joins = "".join(f" LEFT JOIN f{i} USING (doc_id)" for i in names)
    hits = " + ".join(f"(f{i}.tf IS NOT NULL)::INT" for i in names)
    out.append(f"b AS (SELECT doc_id, round({terms}, 10) AS score, {hits} AS n_hit FROM dl{joins}, cs WHERE {hits} > 0)")
    at = [next(i for i, u in enumerate(units) if u.stems == x.stems and not u.prefix) for x in near]
    if near:
        # windows of 12 tokens that begin at an occurrence and hold one of every bare token; then the occurrences inside of any
        all_starts = " UNION ".join(f"SELECT doc_id, pos FROM o{i}" for i in at)
        holds = " AND ".join(f"EXISTS (SELECT 1 FROM o{i} WHERE o{i}.doc_id = a.doc_id AND o{i}.pos BETWEEN a.pos AND a.pos + 11)" for i in at)
        out.append(f"w AS (SELECT a.doc_id, a.pos FROM ({all_starts}) a WHERE {holds})")
        out += [f"i{k} AS (SELECT doc_id, count(*) AS tf FROM o{i} WHERE EXISTS (SELECT 1 FROM w WHERE w.doc_id = o{i}.doc_id AND o{i}.pos BETWEEN w.pos AND w.pos + 11) GROUP BY doc_id)" for k, i in enumerate(at)]
        score = " + ".join(_bm25(f"i{k}.tf", f"(SELECT n FROM n{i})") for k, i in enumerate(at))
        out.append(f"ne AS (SELECT doc_id, round({score}, 10) AS score FROM i0{''.join(f' JOIN i{k} USING (doc_id)' for k in range(1, len(at)))} JOIN dl USING (doc_id), cs)")
    else:
        out.append("ne AS (SELECT doc_id, score FROM b WHERE false)")
    rank = "row_number() OVER (ORDER BY score DESC, doc_id) AS r"
    out.append(f"la AS (SELECT doc_id, {rank} FROM b WHERE n_hit = {len(units)} QUALIFY r <= {limit}), na AS (SELECT count(*) AS n FROM la), lo AS (SELECT doc_id, {rank} FROM b QUALIFY r <= {limit}), no AS (SELECT count(*) AS n FROM lo), ln AS (SELECT doc_id, {rank} FROM ne QUALIFY r <= {limit})")
    # a full AND leg ends the search
    out.append(f"kw AS (SELECT doc_id, min(r)::INT AS kw_rank FROM (SELECT doc_id, r FROM la UNION ALL SELECT doc_id, r + (SELECT n FROM na) FROM lo WHERE {len(units) > 1} AND (SELECT n FROM na) < {limit} UNION ALL SELECT doc_id, r + (SELECT n FROM na) + (SELECT n FROM no) FROM ln WHERE (SELECT n FROM na) < {limit}) GROUP BY doc_id)")
    return ", ".join(out)


TERMS, COMMON, PHRASE, CLOSE = "ertion thinhe", "the of", '"of the" heEdha', "tion with"


def _scored(spark, sf, words):
    return fts.scored(index(spark, sf), spark, fts.compile_query(words))


@query(f"WITH {S}, {match_sql(TERMS)} SELECT doc_id FROM b WHERE n_hit = 3")
def fts_and(spark, sf):
    return _scored(spark, sf, TERMS).where("n_hit = 3").select("doc_id")


@query(f"WITH {S}, {match_sql(TERMS)} SELECT doc_id FROM b")
def fts_or(spark, sf):
    return _scored(spark, sf, TERMS).select("doc_id")


@query(f"WITH {S} SELECT doc_id, count(*) AS n FROM t WHERE starts_with(stem, 'thon') GROUP BY doc_id")
def fts_prefix(spark, sf):
    p = index(spark, sf).postings(spark).where(F.col("term").startswith("thon"))
    return p.groupBy("doc_id").agg(F.sum("tf").alias("n"))


@query(f"WITH {S} SELECT a.doc_id, count(*) AS n FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.stem = 'of' AND b.stem = 'the' GROUP BY a.doc_id")
def fts_phrase(spark, sf):
    return fts.matched(index(spark, sf), spark, fts.compile_query('"of the"')).select("doc_id", F.col("tf")[0].cast("long").alias("n"))


@query(f"WITH {S}, {match_sql(CLOSE)} SELECT doc_id, score FROM ne")
def fts_near(spark, sf):
    """Documents in which the words are within ten tokens, scored by the occurrences that are."""
    return _scored(spark, sf, CLOSE).where("near_score is not null").select("doc_id", F.col("near_score").alias("score"))


@query(f"WITH {S}, {match_sql(TERMS)} SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf):
    """The 20 best documents by BM25 over stems."""
    return _scored(spark, sf, TERMS).orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", "score")


@query(f"WITH {S}, {match_sql(PHRASE)} SELECT doc_id, score, n_hit FROM b")
def bm25_phrase(spark, sf):
    """All matches of a phrase, an identifier and its parts."""
    return _scored(spark, sf, PHRASE).select("doc_id", "score", "n_hit")


@query(f"WITH {S}, {match_sql(TERMS)} SELECT doc_id, kw_rank FROM kw")
def keyword_ranks(spark, sf):
    """Ranks over the AND, OR and NEAR legs."""
    return fts.keyword_ranks(index(spark, sf), spark, fts.compile_query(TERMS), 100).select("doc_id", "kw_rank")


@query(f"WITH {S}, {match_sql(COMMON, 50)} SELECT doc_id, kw_rank FROM kw")
def keyword_ranks_full(spark, sf):
    """Ranks where the AND leg is full: the others are left out."""
    return fts.keyword_ranks(index(spark, sf), spark, fts.compile_query(COMMON), 50).select("doc_id", "kw_rank")


_Q = "q AS (SELECT v AS q FROM v WHERE doc_id = 7)"


def hybrid_sql(words: str, limit: int, keep: str = "true", vector_keep: str | None = None, threshold: float = 0.0, weights: tuple[float, float] | None = None) -> str:
    """A SELECT's CTEs to res(doc_id, path, score, text): `keep` restricts the legs."""
    kw, vec = weights or ranking.weights(words)
    candidates = max(50, 20 * limit)
    bare = fts.compile_query(words).bare
    hit = " OR ".join(f"contains(lower(path), '{w}')" for w in bare)
    m = match_sql(words, candidates).replace(" FROM b WHERE n_hit", f" FROM b JOIN d USING (doc_id) WHERE {keep} AND n_hit").replace("FROM b QUALIFY", f"FROM b JOIN d USING (doc_id) WHERE {keep} QUALIFY").replace("FROM ne QUALIFY", f"FROM ne JOIN d USING (doc_id) WHERE {keep} QUALIFY")
    return f"""{D}, {V}, {_Q}, {S}, {m}, sc AS (SELECT doc_id, round(list_inner_product(v, q), 6) AS sim FROM v JOIN d USING (doc_id), q WHERE {vector_keep or keep}),
pool AS (SELECT doc_id, kw_rank, coalesce(sim, 0) AS sim FROM kw LEFT JOIN sc USING (doc_id) UNION ALL (SELECT doc_id, 0, sim FROM sc WHERE doc_id NOT IN (SELECT doc_id FROM kw) ORDER BY sim DESC, doc_id LIMIT {limit})),
rk AS (SELECT *, row_number() OVER (ORDER BY sim DESC, kw_rank, doc_id) AS vec_rank FROM pool),
fl AS (SELECT max((kw_rank > 0)::INT) AS hk, max((kw_rank = 0 OR sim <> 0)::INT) AS hv FROM rk),
fu AS (SELECT doc_id, path, text, round(({vec}::DOUBLE / (60 + vec_rank) + CASE WHEN kw_rank > 0 THEN {kw}::DOUBLE / (60 + kw_rank) ELSE 0 END + 0.3::DOUBLE * exp(-0.693::DOUBLE * greatest(age, 0) / 604800) / 61 + CASE WHEN {hit} THEN 1.0::DOUBLE / 61 ELSE 0 END) / (({kw} * hk + {vec} * hv + 1.3::DOUBLE) / 61), 6) AS score FROM rk JOIN d USING (doc_id), fl),
dv AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, doc_id) AS nth FROM fu), res AS (SELECT doc_id, path, score, text FROM dv ORDER BY (nth > 1), score DESC, doc_id LIMIT {limit}), rest AS (SELECT * FROM res WHERE score >= {threshold})"""


def _query_vector(spark, sf):
    return vectors(spark, sf).where("doc_id = 7").first()["v"]


@query(f"WITH {hybrid_sql(TERMS, 5)} SELECT doc_id, path, score FROM rest")
def hybrid_search(spark, sf):
    """Keyword and vector search, fused, boosted, normalised and made diverse."""
    return hybrid(corpus(spark, sf), vectors(spark, sf), index(spark, sf), TERMS, _query_vector(spark, sf))


@query(f"WITH {hybrid_sql(TERMS, 10, 'language IN (' + repr('en') + ', ' + repr('de') + ')', threshold=0.4)} SELECT doc_id, path, score FROM rest")
def hybrid_filtered(spark, sf):
    """Hybrid search in two languages, with a least score."""
    return hybrid(corpus(spark, sf), vectors(spark, sf), index(spark, sf), TERMS, _query_vector(spark, sf), SearchOptions(10, 0.4), SearchFilter(languages=("en", "de")))


@query(f"WITH {hybrid_sql(TERMS, 10, 'language = ' + repr('fr'), 'true')} SELECT doc_id, path, score FROM rest")
def hybrid_keyword_scope(spark, sf):
    """The filter holds for the keyword leg only."""
    return hybrid(corpus(spark, sf), vectors(spark, sf), index(spark, sf), TERMS, _query_vector(spark, sf), SearchOptions(10, filter_scope="keyword"), SearchFilter(languages=("fr",)))


@query(f"WITH {hybrid_sql(TERMS, 8, weights=(2.0, 2.0))} SELECT doc_id, path, score FROM rest")
def hybrid_weights(spark, sf):
    """The keyword weight is overridden, and the vector weight keeps its ratio."""
    return hybrid(corpus(spark, sf), vectors(spark, sf), index(spark, sf), TERMS, _query_vector(spark, sf), SearchOptions(8, keyword_weight=2.0))


@query(f"WITH {hybrid_sql(TERMS, 20)}, m AS (SELECT path, text, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM rest) SELECT row_number() OVER (ORDER BY min(r))::INT AS position, path, CASE WHEN min(r) <= 5 THEN CASE WHEN length(trim(any_value(text), E' \\t\\n\\r')) > 200 THEN substr(trim(any_value(text), E' \\t\\n\\r'), 1, 200) || '...' ELSE trim(any_value(text), E' \\t\\n\\r') END END AS excerpt FROM m GROUP BY path")
def summarize_matches(spark, sf):
    """Documents of the best 20 matches in order, with excerpts of the first five."""
    found = hybrid(corpus(spark, sf), vectors(spark, sf), index(spark, sf), TERMS, _query_vector(spark, sf), SearchOptions(20))
    # at most 20 rows: the texts aren't shuffled for them
    return match_summary(corpus(spark, sf).select("doc_id", "text").join(F.broadcast(found), "doc_id"))


# --- what changes the order ---

_RANKS = "r AS (SELECT doc_id, path, (doc_id % 7)::INT AS kw_rank, (doc_id % 11)::INT AS vec_rank, age FROM d)"


def _ranks(spark, sf):
    return corpus(spark, sf).select("doc_id", "path", (F.col("doc_id") % 7).cast("int").alias("kw_rank"), (F.col("doc_id") % 11).cast("int").alias("vec_rank"), "age")


@query(f"WITH {D}, {_RANKS} SELECT doc_id, round(CASE WHEN kw_rank > 0 THEN 1.3::DOUBLE / (60 + kw_rank) ELSE 0 END + CASE WHEN vec_rank > 0 THEN 0.8::DOUBLE / (60 + vec_rank) ELSE 0 END + 0.3::DOUBLE * exp(-0.693::DOUBLE * greatest(age, 0) / 604800) / 61 + CASE WHEN contains(lower(path), 'src1') OR contains(lower(path), '/de/') THEN 1.0::DOUBLE / 61 ELSE 0 END + CASE WHEN ends_with(path, '.txt') THEN 0.5::DOUBLE ELSE 0.1 END / 61, 9) AS score FROM r")
def signal_scores(spark, sf):
    """The sum of all signals under the profile for code, with one for file types added."""
    signals = rerank.Signals()
    signals.register("file_type", rerank.file_type_signal({".txt": 0.5}, 0.1))
    return _ranks(spark, sf).select("doc_id", F.round(signals.score(rerank.profile("code"), ["src1", "/de/"]), 9).alias("score"))


@query(f"WITH {D}, top AS (SELECT doc_id, path, round(1.0::DOUBLE / (1 + doc_id % 97), 6) AS score FROM d ORDER BY score DESC, doc_id LIMIT 30), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r, CASE WHEN row_number() OVER (ORDER BY score DESC, doc_id) <= 20 THEN (length(path) % 5) / 4.0::DOUBLE END AS m FROM top), b AS (SELECT doc_id, path, r, m, CASE WHEN m IS NULL THEN score ELSE round(0.5 * score / max(CASE WHEN m IS NOT NULL THEN score END) OVER () + 0.5 * m / max(m) OVER (), 9) END AS score FROM r) SELECT row_number() OVER (ORDER BY (m IS NULL), CASE WHEN m IS NULL THEN 0 ELSE -score END, r)::INT AS position, doc_id, score FROM b")
def rerank_blend(spark, sf):
    """The first 20 of 30 results reordered by a model's scores (here lengths of paths), the others after them."""
    base = corpus(spark, sf).select("doc_id", "path", F.round(1.0 / (1 + F.col("doc_id") % 97), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(30)
    base = base.withColumn("text", F.col("path"))
    done = rerank.cross_encoder("q", lambda _, texts: str([(len(t) % 5) / 4 for t in texts]))(base)
    return done.select(F.expr("row_number() over (order by monotonically_increasing_id())").alias("position"), "doc_id", "score")


@query(f"WITH {V}, {_Q}, s AS (SELECT doc_id, 'label_' || label AS path, round(list_inner_product(v, q), 6) AS score FROM v, q WHERE doc_id <> 7 ORDER BY score DESC, doc_id LIMIT 12), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM s), RECURSIVE_DUMMY AS (SELECT 1), w(r, seen, kept, took) AS (SELECT 0::BIGINT, ['label_' || (SELECT label FROM v WHERE doc_id = 7)], 0, false UNION ALL SELECT o.r, CASE WHEN NOT list_contains(seen, path) OR kept < 6 THEN list_append(seen, path) ELSE seen END, kept + (NOT list_contains(seen, path) OR kept < 6)::INT, (NOT list_contains(seen, path) OR kept < 6) FROM w JOIN o ON o.r = w.r + 1) SELECT (row_number() OVER (ORDER BY r) - 1)::INT AS position, doc_id, path, score FROM o JOIN w USING (r) WHERE took".replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_DUMMY AS (SELECT 1), ", ""))
def drill_down(spark, sf):
    """Twelve neighbours of a chunk, from documents (here labels) not seen before, or among the first six kept."""
    v = vectors(spark, sf)
    near = vector.top_by_dot(v.where("doc_id <> 7"), v.where("doc_id = 7").select(F.col("v").alias("q")), 12)
    named = v.select("doc_id", F.concat(F.lit("label_"), F.col("label").cast("string")).alias("path")).join(F.broadcast(near), "doc_id")
    seed = v.where("doc_id = 7").first()["label"]
    return rerank.spread_over_paths(named, F.lit(f"label_{seed}"), 12)


@query("SELECT doc_id, doc_id - doc_id % 10 AS parent_id, CASE WHEN p.text IS NULL THEN NULL WHEN length(p.text) > 500 THEN substr(p.text, 1, 500) || '...' ELSE p.text END AS parent_text FROM documents d LEFT JOIN (SELECT doc_id AS pid, text FROM documents WHERE doc_id % 20 = 0) p ON p.pid = d.doc_id - d.doc_id % 10".replace("SELECT doc_id, doc_id - doc_id % 10", "SELECT d.doc_id, d.doc_id - d.doc_id % 10", 1))
def parent_enrichment(spark, sf):
    """Every tenth chunk is the parent of those after it; half of the parents exist."""
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", (F.col("doc_id") - F.col("doc_id") % 10).alias("parent_id"))
    return rerank.with_parents(rows, docs.where("doc_id % 20 = 0").select("doc_id", "text")).select("doc_id", "parent_id", "parent_text")


# --- queries as data ---

_F = r"f AS (SELECT conv_id, turn, text, [x FOR x IN string_split_regex(text, '\s+') IF x <> ''] AS w FROM conversations WHERE text IS NOT NULL), i AS (SELECT *, len(w) AS n, len([x FOR x IN w IF (regexp_matches(x, '\p{Lu}') AND regexp_matches(x, '\p{Ll}')) OR contains(x, '_') OR contains(x, '.')]) AS ids FROM f)"
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.FILE_TYPES.items()) + "}"
_PLACE = ", ".join(f"CASE WHEN p{k} <> '' AND NOT contains(p{k}, ' ') THEN p{k} END" for k in range(len(text.PLACES)))
_AFTER = ", ".join(rf"regexp_replace(regexp_replace(trim(regexp_extract(text, '(?is)^.* {p} (.*)$', 1)), '\.$', ''), ',$', '') AS p{k}" for k, p in enumerate(text.PLACES))


@query(rf"WITH {_F}, p AS (SELECT *, {_AFTER} FROM i) SELECT conv_id, turn, CASE WHEN n = 0 THEN 'search' WHEN n <= 2 AND ids = n THEN 'definition' WHEN n >= 4 AND ids < n // 2 THEN 'search' WHEN ids > n // 2 THEN 'reference' ELSE 'exploration' END AS intent, n > 0 AND ((n <= 2 AND ids = n) OR (NOT (n >= 4 AND ids < n // 2) AND ids > n // 2)) AS is_identifier, array_to_string(list_distinct([{_MAP}[lower(regexp_replace(regexp_replace(x, ',$', ''), '\.$', ''))] FOR x IN w IF {_MAP}[lower(regexp_replace(regexp_replace(x, ',$', ''), '\.$', ''))] IS NOT NULL]).list_sort(), ' ') AS file_types, coalesce({_PLACE}, '') AS path_prefix FROM p")
def query_analysis(spark, sf):
    """Intent, file types and path of every conversation turn, as if it were a query."""
    a = text.analysis(F.col("text"))
    rows = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", a.alias("a"))
    return rows.select("conv_id", "turn", "a.intent", "a.is_identifier", F.array_join(F.sort_array("a.file_types"), " ").alias("file_types"), "a.path_prefix")


_SYN = "MAP {" + ", ".join(f"'{k}': [{', '.join(map(repr, v))}]" for k, v in text.SYNONYMS.items()) + "}"


@query(rf"WITH {_F} SELECT conv_id, turn, 1 + len(flatten([{_SYN}[lower(x)] FOR x IN w IF {_SYN}[lower(x)] IS NOT NULL])) AS n, array_to_string(flatten([{_SYN}[lower(x)] FOR x IN w IF {_SYN}[lower(x)] IS NOT NULL]), ';') AS more FROM i")
def synonym_expansion(spark, sf):
    """Synonyms of the words of every conversation turn."""
    rows = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", text.expansions(F.col("text")).alias("e"))
    return rows.select("conv_id", "turn", F.size("e").cast("long").alias("n"), F.array_join(F.slice("e", 2, 1000), ";").alias("more"))


_W = r"w AS (SELECT conv_id, turn, string_split_regex(trim(text, E' \t\n\r'), '[ \t\n\r]+') AS w FROM conversations WHERE text IS NOT NULL), c AS (SELECT conv_id, turn, len(w) AS n, len([x FOR x IN w IF regexp_matches(x, '[a-z][A-Z]') OR (contains(x, '_') AND x <> '_') OR contains(x, '.')]) AS ids FROM w)"


@query(f"WITH {_W} SELECT conv_id, turn, CASE WHEN n <= 2 AND ids = n THEN 1.5 WHEN n = 1 THEN 1.2 WHEN ids > n // 2 THEN 1.3 WHEN n >= 4 THEN 0.7 ELSE 1.0 END::DOUBLE AS kw, CASE WHEN n <= 2 AND ids = n THEN 0.6 WHEN n = 1 THEN 0.9 WHEN ids > n // 2 THEN 0.8 WHEN n >= 4 THEN 1.4 ELSE 1.0 END::DOUBLE AS vec FROM c")
def query_weights(spark, sf):
    """Adaptive weights of every conversation turn, as if it were a query."""
    words = F.split(F.regexp_replace("text", r"^[ \t\n\r]+|[ \t\n\r]+$", ""), r"[ \t\n\r]+")
    c = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", words.alias("w"))
    is_id = lambda x: x.rlike("[a-z][A-Z]") | (x.contains("_") & (x != "_")) | x.contains(".")
    n, ids = F.size("w"), F.size(F.filter("w", is_id))

    def pick(*values: float):
        return F.when((n <= 2) & (ids == n), values[0]).when(n == 1, values[1]).when(ids > F.floor(n / 2), values[2]).when(n >= 4, values[3]).otherwise(1.0)

    return c.select("conv_id", "turn", pick(1.5, 1.2, 1.3, 0.7).alias("kw"), pick(0.6, 0.9, 0.8, 1.4).alias("vec"))
