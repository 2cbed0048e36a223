"""Full-text search over a stored inverted index of German stems.

``build`` writes ``texts`` (key, dl, terms, places of each), a row per text, ``terms`` (term, df) and ``corpus`` (n, total
length). The first search for a few terms adds ``postings`` (term, key, tf, dl, positions), in folders by a hash of the term and
sorted by term inside each file, so that it opens few files and skips most of each; each task writes those of its own rows, so
none is moved. Positions count all words; stop words have no postings. A search of many questions reads ``texts``, as all
that a question asks of a text stands in one row there; neither search reads the text itself. ``open_index`` builds once per
version of the source's files and session folder.

Null and empty texts have no postings but count as texts of length 0. Keys are taken to be unique; of rows that repeat a
key each has its own postings.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.german import STOP_WORDS, stem, with_stem
from ..functions.text import TOKEN, tokens
from ..scratch import Tables, kept

#: Folders of the postings.
BUCKETS = 32
#: Most terms of a question.
MOST = 12


def _bucket(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def words_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, dl (words of the text), pos (from 1), word, for all words that no search leaves out."""
    t = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("_t")).select("key", F.size("_t").cast("long").alias("dl"), F.posexplode("_t").alias("pos", "word"))
    return t.where(~F.col("word").isin(*STOP_WORDS)).withColumn("pos", F.col("pos") + 1)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, t: all words of a text) as one row per text and stem; words met before by this worker, in any task, are not stemmed again."""
    memo = _stemmed
    for batch in batches:
        ends = np.cumsum(batch.column("t").value_lengths().to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(ends // _TOGETHER, prepend=0)).tolist()
        for first, last in zip([0, *cuts], [*cuts, batch.num_rows]):
            part = batch.slice(first, last - first)
            lengths = part.column("t").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            coded = part.column("t").flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            if len(memo) > _MEMO:
                memo.clear()
                memo.update(dict.fromkeys(STOP_WORDS, ""))
            for w in words:
                if w not in memo:
                    memo[w] = stem(w)
            stems = sorted({memo[w] for w in words} - {""})
            number = {x: i for i, x in enumerate(stems)}
            of = np.array([number.get(memo[w], -1) for w in words], np.int64)[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
            text = np.repeat(np.arange(len(lengths)), lengths)
            pos = np.arange(len(of)) - (np.cumsum(lengths) - lengths)[text] + 1
            kept = np.flatnonzero(of >= 0)
            place = text[kept] * max(1, len(stems)) + of[kept]
            order = np.argsort(place, kind="stable")
            place = place[order]
            starts = np.flatnonzero(np.diff(place, prepend=-1))
            which, at = place[starts] % max(1, len(stems)), place[starts] // max(1, len(stems))
            positions = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(place)].astype(np.int32)), pa.array(pos[kept][order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()).take(pa.array(which)), part.column("key").take(pa.array(at)), pa.array(lengths[at]), positions], ["term", "key", "dl", "positions"])


#: Words looked at together, and words remembered by a worker.
_TOGETHER, _MEMO = 400_000, 500_000
_TEXTS = "dl long, terms array<string>, places array<array<int>>"
_stemmed = dict.fromkeys(STOP_WORDS, "")


def _rows_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, t: all words of a text) as one row per text: its stems in order, and where each stands."""
    for whole in batches:
        ends = np.cumsum(whole.column("t").value_lengths().to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(ends // _TOGETHER, prepend=0)).tolist()
        for first, last in zip([0, *cuts], [*cuts, whole.num_rows]):
            batch = whole.slice(first, last - first)
            if not batch.num_rows:
                continue
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("t")], ["key", "t"])  # keys may repeat or be null
            found = pa.Table.from_batches(list(_postings(iter([numbered])))).combine_chunks()
            text = found.column("key").to_numpy()
            order = np.argsort(text, kind="stable")
            offsets = np.r_[0, np.cumsum(np.bincount(text, minlength=batch.num_rows))].astype(np.int32)
            positions = found.column("positions").combine_chunks().take(pa.array(order))
            terms = found.column("term").combine_chunks().take(pa.array(order))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (terms, positions)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("t").value_lengths().cast(pa.int64()), *lists], ["key", "dl", "terms", "places"])


def build(docs: DataFrame, key: str, text: str, tables: Tables) -> None:
    """One reading of the texts; only terms with their counts are moved."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("t"))
    texts = tables.save(rows.mapInArrow(_rows_of_texts, f"key {kind}, {_TEXTS}"), "texts")
    tables.save(texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    tables.save(texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total")), "corpus")
    tables.save(docs.select(F.col(key).alias("key")).limit(0), "keys")  # the type of keys


def _add_postings(texts: DataFrame, tables: Tables) -> None:
    each = texts.select("key", "dl", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("places").alias("positions"))))
    placed = each.select("term", "key", F.size("positions").alias("tf"), "dl", "positions", _bucket(F.col("term")).alias("bucket"))
    tables.save(placed.sortWithinPartitions("bucket", "term", "key"), "postings", ["bucket"])


class TextIndex:
    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{base}/{name}")
        self.terms, self.corpus = read("002-terms", "term string, df long"), read("003-corpus", "n long, total long")
        self.kind = spark.read.parquet(f"{base}/004-keys").schema["key"].dataType.simpleString()
        self.texts = read("001-texts", f"key {self.kind}, {_TEXTS}")

    @cached_property
    def postings(self) -> DataFrame:
        """Made of the rows of texts when first asked for, and kept."""
        base = kept(self.texts, "postings", lambda tables: _add_postings(self.texts, tables))
        return self.spark.read.schema(f"term string, key {self.kind}, tf int, dl long, positions array<int>, bucket int").parquet(f"{base}/001-postings")

    def of_terms(self, terms) -> DataFrame:
        """Postings of given terms: only their folders are opened."""
        buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
        return self.postings.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms))

    def any_of(self, terms, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(key, bm25) of the ``k`` best texts with any of the terms (stems); smaller is better, ties go by key."""
        found = self.of_terms(terms).select("term", "key", "tf", "dl")
        df = self.terms.where(F.col("term").isin(*terms))
        size = self.corpus.select("n", F.try_divide(F.col("total"), F.col("n")).alias("avg"))  # one row
        scored = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(size))  # a row per asked term
        idf = F.greatest(F.ln((F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))), F.lit(1e-6))
        weight = idf * F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avg")))
        return scored.groupBy("key").agg(F.round(-F.sum(weight), 6).alias("bm25")).orderBy("bm25", "key").limit(k)

    def all_of(self, questions: DataFrame, k: int) -> DataFrame:
        """(query_id, key, density, rank): for each question the ``k`` best texts that hold all of its terms.

        ``questions``: query_id, term, without repeats and at most ``MOST`` terms each. The rank is cover density: each
        shortest passage with all terms counts 0.1 over one more than its other words; ties go by key.

        Questions with the same terms are one. ``_SETS`` of them at a time go to all tasks, which read the rows of texts, and
        find and rank the passages there; only the first ``k`` of a task are moved.
        """
        tables = Tables(self.spark, "search")
        asked = tables.save(questions.select("query_id", "term").join(self.terms, "term", "left"), "asked")
        of_query = F.array_sort(F.collect_list(F.struct("df", "term")))
        whole = asked.groupBy("query_id").agg(of_query.alias("terms"), (F.count("df") == F.count("*")).alias("_all")).where("_all").drop("_all")
        whole = tables.save(whole, "whole")
        sets = tables.save(whole.select("terms").distinct().withColumn("set", F.monotonically_increasing_id()), "sets")
        blocks, found = -(-sets.count() // _SETS), None
        for block in range(blocks):
            best = self._best(sets.where(F.pmod(F.xxhash64("set"), F.lit(blocks)) == block), k)
            best = tables.save(best, "best")
            found = best if found is None else found.unionByName(best)
        if found is None:
            found = self._best(sets.limit(0), k)
        return whole.join(sets, "terms").join(found, "set").select("query_id", "key", "density", "rank")

    def _best(self, sets: DataFrame, k: int) -> DataFrame:
        """(set, key, density, rank) for sets (set, terms with df), of a bounded number."""
        rows = sets.collect()
        number = {t: i for i, t in enumerate(sorted({t["term"] for r in rows for t in r["terms"]}))}
        slots = np.full((len(rows), MOST), -1, np.int64)
        for at, r in zip(slots, rows):
            at[: len(r["terms"])] = [number[t["term"]] for t in r["terms"]]
        given = self.spark.sparkContext.broadcast((np.array([r["set"] for r in rows], np.int64), slots, list(number)))
        dense = self.texts.select("key", "terms", "places").mapInArrow(_passages(given), f"set long, key {self.kind}, density double").withColumn("density", F.round("density", 6))
        rank = F.row_number().over(Window.partitionBy("set").orderBy(F.desc("density"), "key"))
        return dense.withColumn("rank", rank).where(F.col("rank") <= k)


#: Questions that go to all tasks, and rows that a task looks at together.
_SETS, _ROWS = 50_000, 1_000_000


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Consecutive slices of about ``_ROWS`` in sum, of one at least."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, _ROWS + (ends[first - 1] if first else 0), "right")))
        yield slice(first, last)
        first = last


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as its size."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _passages(given):
    """Rows (key, terms, places) to (set, key, density)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, slots, asked = given.value
        asked = pa.array(asked, pa.string())
        for whole in batches:
            counts = whole.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            for some in _slices(counts):
                batch = whole.slice(some.start, some.stop - some.start)
                n_texts = batch.num_rows
                number = pc.fill_null(pc.index_in(batch.column("terms").flatten(), value_set=asked), -1).to_numpy().astype(np.int64)
                hit = np.flatnonzero(number >= 0)
                if not len(hit):
                    continue
                lists = batch.column("places").flatten().take(pa.array(hit))
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                code = number[hit] * n_texts + np.repeat(np.arange(n_texts), counts[some])[hit]
                order = np.argsort(code)  # a term stands in a row once
                code, sizes, starts = code[order], sizes[order], (np.cumsum(sizes) - sizes)[order]
                places = lists.flatten().to_numpy()
                begin, end = np.searchsorted(code, slots[:, 0] * n_texts), np.searchsorted(code, (slots[:, 0] + 1) * n_texts)
                for part in _slices(end - begin):
                    of = np.repeat(np.arange(part.start, part.stop), (end - begin)[part])
                    at = _ranges(begin[part], (end - begin)[part])[:, None]
                    for slot in range(1, int((slots[part] >= 0).sum(axis=1).max())):
                        want = slots[of, slot]
                        seek = want * n_texts + code[at[:, 0]] % n_texts
                        there = np.minimum(np.searchsorted(code, seek), len(code) - 1)
                        ok = (want < 0) | (code[there] == seek)
                        at, of = np.column_stack([at, np.where(want < 0, -1, there)])[ok], of[ok]
                    held = np.where(at >= 0, sizes[at], 0)
                    for few in _slices(held.sum(axis=1)):
                        keys = batch.column("key").take(pa.array(code[at[few, 0]] % n_texts))
                        yield pa.RecordBatch.from_arrays([pa.array(names[of[few]]), keys, pa.array(_density(places, starts, at[few], held[few]))], ["set", "key", "density"])

    return run


def _density(places: np.ndarray, starts: np.ndarray, at: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Cover density of each row of ``at``, which names the places of each of its terms."""
    n_terms, width = (at >= 0).sum(axis=1), at.shape[1]
    pos = places[_ranges(starts[at.ravel()], held.ravel())]
    row, slot = np.repeat(np.arange(len(at)), held.sum(axis=1)), np.repeat(np.tile(np.arange(width), len(at)), held.ravel())
    order = np.lexsort((slot, pos, row))
    row, slot, pos, i = row[order], slot[order], pos[order].astype(np.int64), np.arange(len(order))
    begins = np.searchsorted(row, np.arange(len(at)))[row]
    from_ = i.copy()
    for s in range(width):
        last = np.maximum.accumulate(np.where(slot == s, i, -1))
        last[last < begins] = -1
        from_ = np.where(s < n_terms[row], np.minimum(from_, last), from_)
    new = np.r_[True, (row[1:] != row[:-1]) | (from_[1:] > from_[:-1])] if len(i) else np.zeros(0, bool)
    covers = (from_ >= 0) & new
    others = (pos - pos[from_]) - (i - from_)
    return np.bincount(row[covers], 0.1 / (1.0 + others[covers]), len(at))


def cover_density(places: DataFrame, by: list[str], most: int) -> DataFrame:
    """Density of covers from rows (by, slot of the term, n_terms, pos)."""
    w = Window.partitionBy(*by).orderBy("pos", "slot")
    numbered = places.withColumn("i", F.row_number().over(w))
    last = [F.max(F.when(F.col("slot") == s, F.struct("pos", "i"))).over(w.rowsBetween(Window.unboundedPreceding, 0)) for s in range(most)]
    seen = reduce(lambda a, b: a + b, (F.col(f"_l{s}").isNotNull().cast("int") for s in range(most)))
    at = numbered.withColumns({f"_l{s}": x for s, x in enumerate(last)})
    at = at.withColumn("_from", F.when(seen == F.col("n_terms"), F.least(*(F.col(f"_l{s}") for s in range(most)))))
    moved = at.withColumn("_before", F.lag("_from").over(w))
    covers = moved.where(F.col("_from").isNotNull() & (F.col("_before").isNull() | (F.col("_from.i") > F.col("_before.i"))))
    others = (F.col("pos") - F.col("_from.pos")) - (F.col("i") - F.col("_from.i"))
    return covers.groupBy(*by).agg(F.round(F.sum(F.lit(0.1) / (F.lit(1.0) + others)), 6).alias("density"))


def open_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> TextIndex:
    base = kept(docs, f"texts-{key}-{text}", lambda tables: build(docs, key, text, tables))
    return TextIndex(docs.sparkSession, base)


def first_terms(docs: DataFrame, key: str, text: str, n: int = 3, letters: int = 5) -> DataFrame:
    """(query_id, term): each text as a question, its first ``n`` different stems of words of ``letters`` letters or more."""
    stems = with_stem(words_of(docs, key, text).where(F.length("word") >= letters), "word", "term")
    first = stems.groupBy("key", "term").agg(F.min("pos").alias("pos"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("pos"))
    return first.withColumn("_n", nth).where(F.col("_n") <= n).select(F.col("key").alias("query_id"), "term")
