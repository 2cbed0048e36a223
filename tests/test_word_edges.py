"""Word edges, blanks and lower case in message rules, as SQL takes them."""

import duckdb
import pytest

from marlstone.functions import rules
from marlstone.functions import text as T
from marlstone.plans import extraction
from marlstone.plans.registry import SQL
from pyspark.sql import functions as F

TEXTS = [
    "Jaóta ueezrr que", "jaä", "ja, gut so", "ok gut", " ja weiter", " abc　", "baue\x0bden server", "baue\tden server", "DATEİ baue", "nop!", "noé", "gut_so!", "supeR\nx", None, "",
    " todo: x", "oK dann", "erstelle code", "Jacoí de",
]


@pytest.mark.parametrize("turn", [0, 2, 5, None])
def test_task_messages_as_sql(spark, tmp_path, turn):
    rows = [(i, turn, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in extraction.task_messages(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert got == sorted(con.execute(SQL["task_messages"]).fetchall())


def test_edges(spark):
    df = spark.createDataFrame([("Jaóta ueezrr",), ("ja gut",)], "t string")
    assert [r[0] for r in df.select(rules.worth_keeping(F.col("t"))).collect()] == [False, False]
    key = spark.createDataFrame([("äsk-abcdefgh1",), ("ask-abcdefgh1",)], "t string")
    assert [r[0] for r in key.select(T.redact_keys(F.col("t"))).collect()] == ["ä[KEY REMOVED]", "ask-abcdefgh1"]
