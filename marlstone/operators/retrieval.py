"""Ranking operators: exact vector search, keyword search, BM25 and their fusion."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, tokens
from ..scratch import Tables
from .vector_index import Lists, first_k


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def unit(v: Column) -> Column:
    """The vector at length 1; null where its norm is 0."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def _ranked(df: DataFrame, order: list[Column], k: int, name: str) -> DataFrame:
    """The first ``k`` rows with their rank. The limit runs per task before the single-row-set window."""
    return df.orderBy(*order).limit(k).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def vector_ranked(vectors: DataFrame, key: str, vector: str, q: list[float], k: int) -> DataFrame:
    """(id, sim, vrank) of the ``k`` nearest by cosine; null vectors are left out, ties go by id."""
    vectors, probe = vectors if q else vectors.limit(0), F.array(*map(F.lit, q)).cast("array<double>")
    scored = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.round(cosine(F.col(vector), probe), 9).alias("sim"))
    return _ranked(scored, [F.desc("sim"), F.col("id")], k, "vrank")


def _holds(text: Column, term: str) -> Column:
    """Whether a term is among a text's tokens, without making them; a search stops at the first."""
    edge = TOKEN.rstrip("+")
    return F.lower(text).rlike(f"(?<!{edge}){re.escape(term)}(?!{edge})")


def keyword_ranked(docs: DataFrame, key: str, text: str, terms, k: int) -> DataFrame:
    """(id, score, krank) of texts that hold all terms, by how often they do; a text is split into tokens once."""
    wanted = F.array(*map(F.lit, terms))
    found = docs.where(reduce(lambda x, y: x & y, (_holds(F.col(text), term) for term in terms), F.lit(True)))
    scored = found.select(F.col(key).alias("id"), F.size(F.filter(tokens(F.col(text)), lambda x: F.array_contains(wanted, x))).cast("long").alias("score"))
    return _ranked(scored, [F.desc("score"), F.col("id")], k, "krank")


def hybrid_search(docs: DataFrame, vectors: DataFrame, q: list[float], terms, k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of both searches, each asked for twice ``k``: id, similarity, rrf_score and the document.

    Both sides are at most 2k rows, so the full join and the lookup of the documents broadcast them.
    Documents found by keywords only have similarity 0.
    """
    v = vector_ranked(vectors, "vec_id", "embedding", q, 2 * k)
    t = keyword_ranked(docs, "doc_id", "text", terms, 2 * k)
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(r)), F.lit(0.0))
    fused = v.join(t, "id", "full_outer").select("id", F.coalesce("sim", F.lit(0.0)).alias("similarity"), F.round(part("vrank") + part("krank"), 9).alias("rrf_score"))
    found = docs.withColumnRenamed("doc_id", "id").join(F.broadcast(fused), "id")
    return found.orderBy(F.desc("rrf_score"), "id").limit(k)


def quota_hybrid(docs: DataFrame, vectors: DataFrame, q: list[float], terms, k: int) -> DataFrame:
    """Half from vectors, the rest from keywords, then vectors again; hits with equal first 120 characters once."""
    v = vector_ranked(vectors, "vec_id", "embedding", q, k).select("id", F.lit(0).alias("side"), F.col("vrank").alias("rk"))
    t = keyword_ranked(docs, "doc_id", "text", terms, 2 * k).select("id", F.lit(1).alias("side"), F.col("krank").alias("rk"))
    hits = docs.select(F.col("doc_id").alias("id"), F.substring("text", 1, 120).alias("_pre")).join(F.broadcast(v.unionByName(t)), "id")
    once = hits.withColumn("_n", F.row_number().over(Window.partitionBy("_pre").orderBy("side", "rk"))).where("_n = 1")
    nth = once.withColumn("_n", F.row_number().over(Window.partitionBy("side").orderBy("rk")))
    tier = F.when((F.col("side") == 0) & (F.col("_n") <= max(1, k // 2)), 0).when(F.col("side") == 1, 1).otherwise(2)
    order = [tier, F.col("rk"), F.col("id")]
    return _ranked(nth, order, k, "position").select("id", "side", "position")


def bm25(docs: DataFrame, key: str, text: str, terms, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, bm25) for texts with any of the terms; smaller is better.

    Only rows of wanted terms are ever exploded; lengths and frequencies are counted in the same pass, and
    the corpus figures (one row, one row per term) are broadcast.
    """
    wanted = F.array(*map(F.lit, terms))
    t = docs.select(F.col(key), tokens(F.col(text)).alias("_t")).select(key, F.size("_t").alias("_dl"), F.filter("_t", lambda x: F.array_contains(wanted, x)).alias("_hits"))
    corpus = t.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"))
    tf = t.select(key, "_dl", F.explode("_hits").alias("term")).groupBy(key, "_dl", "term").agg(F.count("*").alias("_tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("_df"))
    scored = tf.join(F.broadcast(df), "term").join(F.broadcast(corpus))
    idf = F.greatest(F.ln((F.col("_n") - F.col("_df") + F.lit(0.5)) / (F.col("_df") + F.lit(0.5))), F.lit(1e-6))
    weight = idf * F.col("_tf") * F.lit(k1 + 1) / (F.col("_tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("_dl") / F.col("_avg")))
    return scored.groupBy(key).agg(F.round(-F.sum(weight), 6).alias("bm25"))


# Words that a search for any term leaves out.
STOP_WORDS = (
    "der", "die", "das", "und", "oder", "aber", "ist", "sind", "war", "waren", "ein", "eine", "einen", "einem", "eines", "den", "dem", "des", "im", "in",
    "an", "auf", "fuer", "für", "mit", "von", "zu", "zum", "zur", "bei", "aus", "wie", "was", "wer", "wann", "wo", "warum", "welche", "welcher", "welches",
    "ich", "du", "er", "sie", "es", "wir", "ihr", "mir", "mich", "dir", "dich", "hab", "habe", "hatte", "haben", "hat", "kann", "koennen", "können",
    "nicht", "noch", "schon", "auch", "mal", "denn", "doch", "nur", "so",
)


def any_terms_query(question: Column, most: int = 12) -> Column:
    """The first terms of a question, quoted and joined by OR; null if only short words and stop words are left."""
    kept = F.filter(tokens(question), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))
    return F.nullif(F.array_join(F.transform(F.slice(kept, 1, most), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR "), F.lit(""))


def cover_density(docs: DataFrame, key: str, text: str, terms) -> DataFrame:
    """(key, density, covers) of texts with all terms: each shortest passage with all of them counts 0.1 over one
    more than its other words. Only places of wanted terms are shuffled, and only of texts that hold all."""
    every = F.array(*map(F.lit, terms))
    placed = F.transform(tokens(F.col(text)), lambda w, i: F.struct(w.alias("term"), (i + 1).cast("long").alias("pos")))
    hits = docs.select(key, F.filter(placed, lambda x: F.array_contains(every, x["term"])).alias("_h"))
    whole = hits.where(F.size(F.array_intersect(every, F.transform("_h", lambda x: x["term"]))) == len(set(terms)))
    at = whole.select(key, F.posexplode("_h").alias("_i", "_x")).select(key, F.col("_i").cast("long").alias("i"), "_x.term", "_x.pos")
    seen = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("term") == t, F.struct("i", "pos"))).over(seen) for t in terms]
    opened = at.withColumn("_from", F.when(reduce(lambda a, b: a & b, (x.isNotNull() for x in last)), F.least(*last)))
    moved = opened.withColumn("_before", F.lag("_from").over(Window.partitionBy(key).orderBy("i")))
    covers = moved.where(F.col("_from").isNotNull() & (F.col("_before").isNull() | (F.col("_from.i") > F.col("_before.i"))))
    others = (F.col("pos") - F.col("_from.pos")) - (F.col("i") - F.col("_from.i"))
    return covers.groupBy(key).agg(F.round(F.sum(F.lit(0.1) / (F.lit(1.0) + others)), 6).alias("density"), F.count("*").alias("covers"))


def recall(memories: DataFrame, owner: str, key: str, vector: str, q: list[float], k: int, whole: int = 300) -> DataFrame:
    """(owner, key, how, place): all memories of an owner of at most ``whole``; else the ``k`` nearest of those with a
    vector; else the ``k`` newest. Places are cut per task before the shuffle, so large owners do no harm."""
    probe = F.array(*map(F.lit, q)).cast("array<double>")
    n = memories.groupBy(owner).agg(F.count("*").alias("_n"), F.count(vector).alias("_v"))
    m = memories.select(owner, key, F.when(F.col(vector).isNotNull(), F.round(cosine(F.col(vector), probe), 9)).alias("_sim")).join(n, owner)
    few = m.where(F.col("_n") <= whole).select(owner, key, F.lit("all").alias("how"), F.lit(None).cast("int").alias("place"))
    near = m.where((F.col("_n") > whole) & F.col("_sim").isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("_sim"), key)))
    newest = m.where((F.col("_n") > whole) & (F.col("_v") == 0)).withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(key))))
    first = lambda df, how: df.where(F.col("place") <= k).select(owner, key, F.lit(how).alias("how"), "place")
    return few.unionByName(first(near, "near")).unionByName(first(newest, "newest"))


def fused(v: DataFrame, t: DataFrame, docs: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion for many queries: ``v`` (query_id, id, sim, vrank) and ``t`` (query_id, id, krank), each cut
    to a number of rows a query, and ``docs`` (id and what the result shows)."""
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(r)), F.lit(0.0))
    both = v.join(t, ["query_id", "id"], "full_outer").select("query_id", "id", F.coalesce("sim", F.lit(0.0)).alias("similarity"), F.round(part("vrank") + part("krank"), 9).alias("rrf_score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "id"))
    return both.join(docs, "id").withColumn("rank", rank).where(F.col("rank") <= k)


def by_quota(hits: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """For many queries: half from side 0, the rest from side 1, then side 0 again; hits whose texts begin alike once.

    ``hits``: query_id, id, side, rk (rank within the side), a bounded number a query; ``docs``: id and ``_pre``.
    """
    met = hits.join(docs, "id")
    once = met.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_pre").orderBy("side", "rk"))).where("_n = 1")
    nth = once.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "side").orderBy("rk")))
    tier = F.when((F.col("side") == 0) & (F.col("_n") <= max(1, k // 2)), 0).when(F.col("side") == 1, 1).otherwise(2)
    placed = nth.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(tier, "rk", "id")))
    return placed.where(F.col("position") <= k).select("query_id", "id", "side", "position")


def recall_all(memories: DataFrame, asks: DataFrame, k: int, tables: Tables, whole: int = 300) -> DataFrame:
    """(query_id, owner, id, how, place): ``recall`` for many queries, each asking one owner.

    ``memories``: owner long, id, v (or null); ``asks``: id, owner, v. Owners with more than ``whole`` memories are
    searched in blocks of vectors; of owners without vectors the newest are found once and shared by their queries.
    """
    n = memories.groupBy("owner").agg(F.count("*").alias("_n"), F.count("v").alias("_v"))
    asked = asks.join(n, "owner").select(F.col("id").alias("query_id"), "owner", "v", "_n", "_v")
    few = asked.where(F.col("_n") <= whole).select("query_id", "owner").join(memories.join(n.where(F.col("_n") <= whole).select("owner"), "owner", "left_semi").select("owner", "id"), "owner")
    large = n.where((F.col("_n") > whole) & (F.col("_v") > 0)).select("owner")
    lists = Lists(memories.join(large, "owner", "left_semi").select(F.col("owner").alias("list"), "id", "v"), tables)
    near = first_k(lists.nearest(asked.where((F.col("_n") > whole) & (F.col("_v") > 0)).select(F.col("owner").alias("list"), F.col("query_id").alias("id"), "v"), k), k)
    near = near.join(asked.select("query_id", "owner"), "query_id")
    silent = n.where((F.col("_n") > whole) & (F.col("_v") == 0)).select("owner")
    late = memories.join(silent, "owner", "left_semi").select("owner", "id").withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("id")))).where(F.col("place") <= k)
    newest = asked.select("query_id", "owner").join(late, "owner")
    shape = lambda df, how, place: df.select("query_id", "owner", "id", F.lit(how).alias("how"), place.cast("int").alias("place"))
    return shape(few, "all", F.lit(None)).unionByName(shape(near, "near", F.col("vrank"))).unionByName(shape(newest, "newest", F.col("place")))
