"""Packed vectors, missing JSON files and missing tables."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException

from marlstone.session import table
from marlstone.sources.files import json_or_empty, packed_vectors


def test_packed_vectors(spark, tmp_path):
    want = np.arange(5000 * 8, dtype="<f4").reshape(5000, 8) / 7
    (tmp_path / "a.bin").write_bytes(want.tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    got = packed_vectors(spark, str(tmp_path), 8).orderBy("row").collect()
    assert [r.row for r in got] == list(range(5000))
    assert np.array_equal(np.array([r.vector for r in got], "<f4"), want)


def test_packed_vectors_cut_inside_a_row(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\0" * 36)
    with pytest.raises(Exception, match="no whole rows"):
        packed_vectors(spark, str(tmp_path), 8).collect()


def test_json_or_empty(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "x",\n "n": 3}')
    assert [tuple(r) for r in json_or_empty(spark, str(tmp_path / "a.json"), "name string, n long").collect()] == [("x", 3)]
    none = json_or_empty(spark, str(tmp_path / "none.json"), "name string, n long")
    assert none.columns == ["name", "n"] and none.count() == 0


def test_missing_table_fails(spark, tmp_path):
    """A path that is not there is an error, not an empty table."""
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        table(spark, str(tmp_path), "orders")
