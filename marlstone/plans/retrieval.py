"""Vector, keyword and hybrid retrieval over the document and embedding tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.german import STOP_WORDS, stem_sql
from ..operators import retrieval as R
from ..operators import text_index, vector_index
from ..scratch import Tables
from ..session import table
from .registry import query

K = 10
TERMS = ("the", "tion", "and")
ANY_TERMS = ("ering", "thing", "schaft", "heit", "tion")
_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_SIM = (
    "SELECT vec_id, round(" + _DOT.format(a="embedding", b="q") + " / (sqrt(" + _DOT.format(a="embedding", b="embedding")
    + ") * sqrt(" + _DOT.format(a="q", b="q") + ")), 9) AS sim FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
)
_VEC = f"SELECT vec_id AS id, sim, row_number() OVER (ORDER BY sim DESC, vec_id) AS vrank FROM ({_SIM}) QUALIFY vrank <= {{n}}"
_KEY = (
    f"SELECT doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS krank FROM (SELECT doc_id, "
    + " + ".join(f"len(list_filter(toks, lambda x: x = '{t}'))" for t in TERMS)
    + f" AS score, toks FROM (SELECT doc_id, {_TOK} AS toks FROM documents)) WHERE "
    + " AND ".join(f"list_contains(toks, '{t}')" for t in TERMS)
    + " QUALIFY krank <= {n}"
)


def _query_vector(spark, sf_dir):
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row and row[0] else []


@query(f"SELECT vec_id, round(sim, 6) AS similarity, CAST(row_number() OVER (ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM ({_SIM}) QUALIFY rank <= {K}")
def vector_topk(spark, sf_dir):
    top = R.vector_ranked(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), K)
    return top.select(F.col("id").alias("vec_id"), F.round("sim", 6).alias("similarity"), F.col("vrank").alias("rank"))


_ALL = (
    "SELECT query_id, vec_id, round(" + _DOT.format(a="embedding", b="q") + " / (sqrt(" + _DOT.format(a="embedding", b="embedding")
    + ") * sqrt(" + _DOT.format(a="q", b="q") + ")), 9) AS sim FROM embeddings, (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0)"
)


@query(f"SELECT query_id, vec_id, round(sim, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM ({_ALL}) QUALIFY rank <= {K}")
def vector_topk_whole(spark, sf_dir):
    """W1, T3, T4, R1 to R4 for every query: all rows whose id is divisible by 20, against all rows."""
    top = _vectors_of_all(spark, sf_dir, K)
    return top.select("query_id", F.col("id").alias("vec_id"), F.round("sim", 6).alias("similarity"), F.col("vrank").alias("rank"))


def _vectors_of_all(spark, sf_dir, k):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vector_index.InvertedFile(v, Tables(spark, "vectors")).nearest(v.where("id % 20 = 0"), k)


def _texts_of_all(spark, sf_dir, k):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    questions = text_index.first_terms(docs.where("doc_id % 20 = 0"), "doc_id", "text")
    return text_index.open_index(docs).all_of(questions, k)


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: Stems and places of all words, and for every question its texts with density and rank.
_STEMMED = f"""w0 AS MATERIALIZED (SELECT doc_id AS key, {_TOK} AS toks FROM documents),
w AS (SELECT key, dl, word, pos FROM (SELECT key, len(toks) AS dl, unnest(toks) AS word, unnest(range(1, len(toks) + 1)) AS pos FROM w0) WHERE word NOT IN ({_STOP})),
{stem_sql("word", "w", "term")},
post AS MATERIALIZED (SELECT key, dl, term, pos, length(word) AS letters FROM w JOIN stems USING (word) WHERE term <> '')"""
_SLOTS = ", ".join(f"max(CASE WHEN slot = {i} THEN {{c}} END) OVER s AS {{c}}{i}" for i in range(3))
_ASKED = f"""{_STEMMED},
q0 AS (SELECT key AS query_id, term, min(pos) AS begins FROM post WHERE key % 20 = 0 AND letters >= 5 GROUP BY ALL),
q1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY begins) - 1 AS slot FROM q0 QUALIFY slot < 3),
q AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n_terms FROM q1),
h0 AS (SELECT query_id, key, slot, n_terms, pos, count(*) OVER (PARTITION BY query_id, key, slot) AS one FROM q JOIN post USING (term)),
g AS (SELECT query_id, key FROM h0 GROUP BY ALL HAVING count(DISTINCT slot) = max(n_terms)),
h AS (SELECT h0.*, row_number() OVER (PARTITION BY query_id, key ORDER BY pos) AS i FROM h0 JOIN g USING (query_id, key)),
l AS (SELECT *, {_SLOTS.format(c="pos")}, {_SLOTS.format(c="i")} FROM h WINDOW s AS (PARTITION BY query_id, key ORDER BY pos ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, CASE WHEN (pos0 IS NOT NULL)::INT + (pos1 IS NOT NULL)::INT + (pos2 IS NOT NULL)::INT = n_terms THEN least(pos0, pos1, pos2) END AS a, least(i0, i1, i2) AS ai FROM l),
c AS (SELECT *, lag(a) OVER (PARTITION BY query_id, key ORDER BY pos) AS b FROM f),
d AS (SELECT query_id, key, round(sum(0.1::DOUBLE / (1.0::DOUBLE + (pos - a) - (i - ai))), 6) AS density FROM c WHERE a IS NOT NULL AND (b IS NULL OR a > b) GROUP BY query_id, key),
texts AS (SELECT query_id, key AS id, density, row_number() OVER (PARTITION BY query_id ORDER BY density DESC, key) AS krank FROM d QUALIFY krank <= @n),
vecs AS (SELECT query_id, vec_id AS id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS vrank FROM ({_ALL}) QUALIFY vrank <= @m)"""


def _asked(n: int, m: int) -> str:
    return _ASKED.replace("@n", str(n)).replace("@m", str(m))


@query(f"WITH {_asked(K, 1)} SELECT query_id, id AS doc_id, density, CAST(krank AS INTEGER) AS rank FROM texts")
def fulltext_topk(spark, sf_dir):
    """German full-text search by stems over the stored index, for every text whose id is divisible by 20 as a
    question (its first three stems of words of five letters or more), against all texts."""
    return _texts_of_all(spark, sf_dir, K).select("query_id", F.col("key").alias("doc_id"), "density", "rank")


STEMS = ("konzert", "thing", "schaft", "ering", "tion")


@query(f"""WITH {_STEMMED}, c AS (SELECT count(*) AS n, sum(len({_TOK}))::DOUBLE / count(*)::DOUBLE AS avg FROM documents),
asked AS (SELECT unnest([{", ".join(f"'{t}'" for t in STEMS)}]) AS term),
tf AS (SELECT key, term, dl, count(*) AS tf FROM post JOIN asked USING (term) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT key AS doc_id, round(-sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg))), 6) AS bm25
FROM tf JOIN df USING (term), c GROUP BY key ORDER BY bm25, key LIMIT {2 * K}""")
def bm25_stems(spark, sf_dir):
    """Any of some stems by BM25, from the stored index."""
    index = text_index.open_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return index.any_of(STEMS, 2 * K).withColumnRenamed("key", "doc_id")


@query(f"""WITH {_asked(2 * K, 2 * K)},
j AS (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.id, t.id) AS id, coalesce(v.sim, 0.0) AS sim,
  round(coalesce(1.0::DOUBLE / (60 + vrank), 0) + coalesce(1.0::DOUBLE / (60 + krank), 0), 9) AS rrf FROM vecs v FULL JOIN texts t ON v.query_id = t.query_id AND v.id = t.id)
SELECT query_id, j.id, round(sim, 6) AS similarity, rrf AS rrf_score, d.source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, j.id) AS INTEGER) AS rank
FROM j JOIN documents d ON d.doc_id = j.id QUALIFY rank <= {K}""")
def hybrid_rrf_whole(spark, sf_dir):
    """J1, T6, R10, R11 for every query: vectors and stemmed full text, fused by reciprocal rank."""
    docs = table(spark, sf_dir, "documents")
    v, t = _vectors_of_all(spark, sf_dir, 2 * K), _texts_of_all(spark, sf_dir, 2 * K).select("query_id", F.col("key").alias("id"), F.col("rank").alias("krank"))
    return R.fused(v, t, docs.select(F.col("doc_id").alias("id"), "source"), K).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rrf_score", "source", "rank")


@query(f"""WITH {_asked(2 * K, K)},
a AS (SELECT query_id, v.id, 0 AS side, vrank AS rk, substr(text, 1, 120) AS pre FROM vecs v JOIN documents d ON d.doc_id = v.id
      UNION ALL SELECT query_id, t.id, 1, krank, substr(text, 1, 120) FROM texts t JOIN documents d ON d.doc_id = t.id),
u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, pre ORDER BY side, rk) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, side ORDER BY rk) AS n FROM u),
z AS (SELECT *, CASE WHEN side = 0 AND n <= {K // 2} THEN 0 WHEN side = 1 THEN 1 ELSE 2 END AS tier FROM r)
SELECT query_id, id, side, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, rk, id) AS INTEGER) AS position FROM z QUALIFY position <= {K}""")
def archive_quota_hybrid_whole(spark, sf_dir):
    """J2, U8, U11 for every query: half from vectors, the rest from full text, then vectors again."""
    docs = table(spark, sf_dir, "documents")
    v = _vectors_of_all(spark, sf_dir, K).select("query_id", "id", F.lit(0).alias("side"), F.col("vrank").alias("rk"))
    t = _texts_of_all(spark, sf_dir, 2 * K).select("query_id", F.col("key").alias("id"), F.lit(1).alias("side"), F.col("rank").alias("rk"))
    return R.by_quota(v.unionByName(t), docs.select(F.col("doc_id").alias("id"), F.substring("text", 1, 120).alias("_pre")), K)


@query(f"SELECT id AS doc_id, CAST(score AS BIGINT) AS score, CAST(krank AS INTEGER) AS rank FROM ({_KEY.replace("{n}", str(K))})")
def keyword_topk(spark, sf_dir):
    return R.keyword_ranked(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS, K).select(F.col("id").alias("doc_id"), "score", F.col("krank").alias("rank"))


@query(f"""
WITH v AS ({_VEC.format(n=2 * K)}), t AS ({_KEY.replace("{n}", str(2 * K))}),
j AS (SELECT coalesce(v.id, t.id) AS id, coalesce(v.sim, 0.0) AS sim,
       round(coalesce(1.0::DOUBLE / (60 + vrank), 0) + coalesce(1.0::DOUBLE / (60 + krank), 0), 9) AS rrf FROM v FULL JOIN t ON v.id = t.id)
SELECT j.id, round(sim, 6) AS similarity, rrf AS rrf_score, d.source FROM j JOIN documents d ON d.doc_id = j.id ORDER BY rrf DESC, j.id LIMIT {K}""")
def hybrid_rrf(spark, sf_dir):
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    fused = R.hybrid_search(docs, vectors, _query_vector(spark, sf_dir), TERMS, K)
    return fused.select("id", F.round("similarity", 6).alias("similarity"), F.round("rrf_score", 9).alias("rrf_score"), "source")


@query(f"""
WITH v AS ({_VEC.format(n=K)}), t AS ({_KEY.replace("{n}", str(2 * K))}),
a AS (SELECT v.id, 0 AS side, vrank AS rk, substr(text, 1, 120) AS pre FROM v JOIN documents d ON d.doc_id = v.id
      UNION ALL SELECT t.id, 1, krank, substr(text, 1, 120) FROM t JOIN documents d ON d.doc_id = t.id),
u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY pre ORDER BY side, rk) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY rk) AS n FROM u),
q AS (SELECT *, CASE WHEN side = 0 AND n <= {K // 2} THEN 0 WHEN side = 1 THEN 1 ELSE 2 END AS tier FROM r)
SELECT id, side, CAST(row_number() OVER (ORDER BY tier, rk, id) AS INTEGER) AS position FROM q QUALIFY position <= {K}""")
def archive_quota_hybrid(spark, sf_dir):
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return R.quota_hybrid(docs, vectors, _query_vector(spark, sf_dir), TERMS, K)


_IN = ", ".join(f"'{t}'" for t in ANY_TERMS)


@query(f"""
WITH w AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents),
dl AS (SELECT doc_id, len({_TOK}) AS dl FROM documents),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN ({_IN}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT tf.doc_id, round(-sum(greatest(ln((n.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf.tf * 2.2::DOUBLE
        / (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / n.avgdl))), 6) AS bm25 FROM tf JOIN df USING (term) JOIN dl USING (doc_id), n GROUP BY tf.doc_id)
SELECT doc_id, bm25 FROM s ORDER BY bm25, doc_id LIMIT {2 * K}""")
def bm25_topk(spark, sf_dir):
    return R.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ANY_TERMS).orderBy("bm25", "doc_id").limit(2 * K)


@query(f"""SELECT conv_id, turn, nullif(array_to_string(list_transform(list_slice(list_filter({_TOK}, lambda w: length(w) >= 3 AND w NOT IN ({", ".join(f"'{w}'" for w in R.STOP_WORDS)})), 1, 12),
lambda w: '"' || w || '"'), ' OR '), '') AS any_terms FROM conversations""")
def question_terms(spark, sf_dir):
    """Every message as a search for any of its terms."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.any_terms_query(F.col("text")).alias("any_terms"))


_LAST = ", ".join(f"max(CASE WHEN term = '{t}' THEN {{c}} END) OVER w AS {{c}}{n}" for n, t in enumerate(TERMS))


@query(f"""WITH t AS (SELECT doc_id, {_TOK} AS toks FROM documents),
p AS (SELECT doc_id, unnest(toks) AS term, unnest(range(1, len(toks) + 1)) AS pos FROM t WHERE len(list_distinct(list_filter(toks, lambda x: x IN {TERMS}))) = {len(TERMS)}),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM p WHERE term IN {TERMS}),
l AS (SELECT *, {_LAST.format(c="pos")}, {_LAST.format(c="i")} FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, CASE WHEN pos0 IS NOT NULL AND pos1 IS NOT NULL AND pos2 IS NOT NULL THEN least(pos0, pos1, pos2) END AS a, least(i0, i1, i2) AS ai FROM l),
c AS (SELECT *, lag(a) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM f)
SELECT doc_id, round(sum(0.1::DOUBLE / (1.0::DOUBLE + (pos - a) - (i - ai))), 6) AS density, count(*) AS covers FROM c WHERE a IS NOT NULL AND (b IS NULL OR a > b) GROUP BY doc_id""")
def cover_density_rank(spark, sf_dir):
    """Texts with all terms by how close together these stand."""
    return R.cover_density(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)


_MEM = "SELECT label AS owner, vec_id, CASE WHEN label % 5 <> 0 THEN embedding END AS v FROM embeddings WHERE label IS NOT NULL"
_MEM_SIM = _DOT.format(a="v", b="q") + " / (sqrt(" + _DOT.format(a="v", b="v") + ") * sqrt(" + _DOT.format(a="q", b="q") + "))"


@query(f"""WITH m AS ({_MEM}), n AS (SELECT owner, count(*) AS n, count(v) AS e FROM m GROUP BY owner),
s AS (SELECT m.owner, vec_id, n, e, CASE WHEN v IS NOT NULL THEN round({_MEM_SIM}, 9) END AS sim FROM m JOIN n ON n.owner = m.owner, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY sim DESC NULLS LAST, vec_id) AS near, row_number() OVER (PARTITION BY owner ORDER BY vec_id DESC) AS late FROM s)
SELECT owner, vec_id, CASE WHEN n <= 50 THEN 'all' WHEN e > 0 THEN 'near' ELSE 'newest' END AS how, CAST(CASE WHEN n <= 50 THEN NULL WHEN e > 0 THEN near ELSE late END AS INTEGER) AS place
FROM r WHERE n <= 50 OR (e > 0 AND sim IS NOT NULL AND near <= {K}) OR (e = 0 AND late <= {K})""")
def memory_recall(spark, sf_dir):
    """Memories of each owner; the bound is 50 here instead of 300, so that all three ways occur."""
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    m = e.select(F.col("label").alias("owner"), "vec_id", F.when(F.col("label") % 5 != 0, F.col("embedding")).alias("v"))
    return R.recall(m, "owner", "vec_id", "v", _query_vector(spark, sf_dir), K, 50)


@query(f"""WITH m AS ({_MEM}), n AS (SELECT owner, count(*) AS n, count(v) AS e FROM m GROUP BY owner),
asks AS (SELECT vec_id AS query_id, label AS owner, embedding AS q FROM embeddings WHERE vec_id % 20 = 0 AND label IS NOT NULL),
s AS (SELECT query_id, m.owner, vec_id, n, e, CASE WHEN v IS NOT NULL THEN round({_MEM_SIM}, 9) END AS sim FROM asks JOIN m ON m.owner = asks.owner JOIN n ON n.owner = m.owner),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC NULLS LAST, vec_id) AS near, row_number() OVER (PARTITION BY query_id ORDER BY vec_id DESC) AS late FROM s)
SELECT query_id, owner, vec_id, CASE WHEN n <= 300 THEN 'all' WHEN e > 0 THEN 'near' ELSE 'newest' END AS how, CAST(CASE WHEN n <= 300 THEN NULL WHEN e > 0 THEN near ELSE late END AS INTEGER) AS place
FROM r WHERE n <= 300 OR (e > 0 AND sim IS NOT NULL AND near <= {K}) OR (e = 0 AND late <= {K})""")
def memory_recall_whole(spark, sf_dir):
    """R12 for every query: each row whose id is divisible by 20 asks the memories of its own owner."""
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    m = e.select(F.col("label").alias("owner"), F.col("vec_id").alias("id"), F.when(F.col("label") % 5 != 0, F.col("embedding")).alias("v"))
    asks = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), F.col("label").alias("owner"), F.col("embedding").alias("v"))
    return R.recall_all(m, asks, K, Tables(spark, "recall")).select("query_id", "owner", F.col("id").alias("vec_id"), "how", "place")
