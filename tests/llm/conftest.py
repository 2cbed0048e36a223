import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture
def scratch(spark):
    from marlstone.llm.shared import Scratch

    return Scratch(spark, "test")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and a clashing extra column."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "a b c d e f g h " * 4, "en", "s", 1, 9), (2, None, "en", "s", None, 9), (3, "", None, None, 0, None), (4, " \n\t ", "en", "s", 1, 1),
        (5, long, "en", "s", 1, 1), (6, "The cat and the dog sat on a mat by the sea with us.\nThe cat and the dog sat.", "en", "t", 1, 1),
        (6, "The cat and the dog sat on a mat by the sea with us.\nThe cat and the dog sat.", "en", "t", 1, 1), (None, "no id here", "en", "s", 1, 1), (8, "Ünïcode ß 中文 🙂 <|endoftext|>", "de", "u", 1, 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long")
