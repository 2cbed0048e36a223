import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlstone.llm import packing, token_files, tokens

TOKENIZER = Tokenizer.from_file(tokens.vocabulary_path())


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("aAéÉß'.,!<|>1 \n\t́ΣİÑ中", max_size=30)), max_size=5))
def test_words_encode_like_texts(texts):
    ids, counts = tokens.encoder(tokens.vocabulary_path()).encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [plain(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 300)), max_size=3000), st.integers(1, 1500))
def test_segments_round_trip(ids, first):
    a = np.array(ids, np.uint32)
    data = token_files.encode_segment(a, block=256)
    assert (token_files.decode_segment(data) == a).all()
    assert (token_files.decode_segment(data, first, 70) == a[first : first + 70]).all()


def test_files_on_odd_rows(spark, scratch, odd_docs):
    files = token_files.write_files(odd_docs, scratch, segment_ids=500)
    got = sorted(token_files.read_digests(files).collect(), key=lambda r: r["start"])
    want = sorted(odd_docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (key, text) in zip(got, want, strict=True):
        ids = np.array([*plain(text), 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (key, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.read_digests(token_files.write_files(odd_docs.limit(0), scratch)).count() == 0


def test_fullest_is_the_best_subset():
    rng = np.random.default_rng(5)
    for _ in range(200):
        counts = Counter(rng.integers(1, 40, 7).tolist())
        room = int(rng.integers(1, 120))
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = packing.fullest(room, sorted(counts, reverse=True), dict(counts))
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= room) and all(k <= counts[n] for n, k in got.items())


@pytest.mark.parametrize("capacity", [7, 64, 4096])
def test_packing(spark, scratch, odd_docs, capacity):
    got = packing.pack(odd_docs, scratch, capacity=capacity, with_ids=True).collect()
    want = Counter()
    for key, text in odd_docs.select("doc_id", "text").collect():
        ids = [*plain(text), 1]
        want.update((key, i, i * capacity, tuple(ids[i * capacity : (i + 1) * capacity])) for i in range(-(-len(ids) // capacity)))
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in got) == want
    bins = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.1 * -(-sum(r["length"] for r in got) // capacity) + 1
    assert packing.pack(odd_docs.limit(0), scratch).count() == 0
