"""What both classifiers share: which labelled rows are learnt from, and texts as word codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(text, y) of at most ``max_rows`` labelled documents that are not held out.

    The bound is the documented parameter of the classifiers. Rows are taken in the order of a hash of the
    id; a document labelled twice counts once, as the larger label. The sample's ids are a table of bounded
    size, so they are broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y")


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the code of every word of all texts in order, and the text that each is in."""
    words = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    if "" in distinct:
        real = codes != distinct.index("")
        codes, doc = codes[real], doc[real]
    return distinct, codes, doc
