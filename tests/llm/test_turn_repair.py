"""Structure repair against a search over all edits, and the query against a plain version."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
from pyspark.sql import functions as F

from marlstone.llm import turn_repair
from marlstone.llm.queries import queries

LEGAL = re.compile(r"(s?(ua)+)?")


def searched(kinds, fixed, truncated):
    """Least (cost, audit) over all edit strings, by trying every edit at every turn."""
    n = len(kinds)
    nexts = {"^": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def go(i, last):
        found = [(0, "")] if i == n and last in "^a" else []
        for c in nexts[last]:
            if c != "s" and (last, c) != ("^", "a"):
                found.append(((go2 := inserted(i, c))[0] + 3, "I" + go2[1]))
        if i < n:
            cost, audit = go(i + 1, last)
            found.append((cost + 4, "D" + audit))
            if not fixed[i]:
                for c in nexts[last]:
                    same = "sua?"[kinds[i]] == c
                    if same or c != "s":
                        cost, audit = go(i + 1, c)
                        found.append((cost + 3 * truncated[i] + 3 * (not same), ("K" if same else "R") + audit))
        return min(found)

    @lru_cache(None)
    def inserted(i, last):
        """After an insertion: an edit of the turn, one more insertion at most twice in a row, or the end."""
        found = [(0, "")] if i == n and last == "a" else []
        if last == "u":
            cost, audit = inserted(i, "a")
            found.append((cost + 3, "I" + audit))
        if i < n:
            cost, audit = go(i + 1, last)
            found.append((cost + 4, "D" + audit))
            if not fixed[i]:
                for c in nexts[last]:
                    same = "sua?"[kinds[i]] == c
                    cost, audit = go(i + 1, c)
                    found.append((cost + 3 * truncated[i] + 3 * (not same), ("K" if same else "R") + audit))
        return min(found)

    return go(0, "^")


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(5)
    for _ in range(4000):
        n = rng.randrange(9)
        kinds = [rng.choice((0, 1, 1, 2, 2, 3)) for _ in range(n)]
        fixed = [rng.random() < 0.2 for _ in range(n)]
        truncated = [rng.random() < 0.3 for _ in range(n)]
        cost, steps = turn_repair.best_edits(kinds, fixed, truncated)
        ops = list(turn_repair.edits(n, steps))
        roles = "".join("sua?"[kinds[i]] if op == "K" else role[0] for op, i, role in ops if op != "D")
        assert LEGAL.fullmatch(roles)
        assert (cost, "".join(op for op, _, _ in ops)) == searched(tuple(kinds), tuple(fixed), tuple(truncated)), (kinds, fixed, truncated)


def plain(rows):
    """conv_id: the contract's columns, from (conv_id, turn, role, text)."""
    out = {}
    for c in {r[0] for r in rows}:
        kept = []
        for _, t, role, text in (r for r in rows if r[0] == c):
            role, text = " " if role is None else role, " " if text is None else text
            f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
            kept += [(t, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        kinds = ["sua".find(r[:1]) if r[:1] else -1 for _, r, _ in kept]
        kinds = [3 if k < 0 else k for k in kinds]
        blank = [not re.search(r"[^\x20\x09-\x0D]", x) for _, _, x in kept]
        twice = [not blank[i] and kept[i][1:] in [k[1:] for k in kept[:i]] for i in range(len(kept))]
        cut = [not blank[i] and not twice[i] and re.findall(r"[^\x20\x09-\x0D]", kept[i][2])[-1] not in ".!?" for i in range(len(kept))]
        cost, audit = searched(tuple(kinds), tuple(a or b for a, b in zip(blank, twice)), tuple(cut))
        odd = (len(re.sub("D", "", audit)) % 2)
        lines, at = [], 0
        for op in audit:
            name = ["user", "assistant"][(len(lines) - odd) % 2]
            if op == "I":
                lines.append(f"{name}:")
                continue
            if op in "KR":
                lines.append(f"{kept[at][1] if op == 'K' else name}:{kept[at][2]}")
            at += 1
        turns = [t for t, _, _ in kept if t is not None]
        illegal = sum((r[1][:1] + s[1][:1]) not in ("su", "ua", "au") for r, s in zip(kept, kept[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, sum(blank), sum(twice), sum(cut), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def same(df, rows):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = df.collect()
    assert df.columns == ["conv_id", *names] and all(kind == "bigint" for c, kind in df.dtypes if c not in ("audit", "repaired_sha256"))
    assert len(got) == len({r["conv_id"] for r in got})
    assert {r["conv_id"]: tuple(r[c] for c in names) for r in got} == plain(rows)


def test_query_is_the_plain_version(spark):
    rows = duckdb.sql("SELECT conv_id, turn, role, text FROM read_parquet('/root/testdata/sf0.01/conversations.parquet')").fetchall()
    same(queries()["op12_turn_repair"](spark, "/root/testdata/sf0.01"), rows)


def test_odd_rows(spark, scratch):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "umpire"]
    texts = ["a.", "b", "", " \n", None, "Wie?", "a.", "x" * 100_000, "last. \t"]
    rows = [(c if c < 60 else None, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in range(62) for _ in range(rng.randrange(1, 7))]
    rows += [(70, 9, "user", "same")] * 4
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit(1)).withColumn("rid", F.lit("clash"))
    same(turn_repair.digest(df, scratch), rows)
    assert turn_repair.digest(df.limit(0), scratch).count() == 0
    fixed = turn_repair.repair(df, scratch).turns.collect()
    said = {}
    for r in sorted(fixed, key=lambda r: (r["nameless"], r["conv_id"], r["seq"])):
        said[r["nameless"], r["conv_id"]] = said.get((r["nameless"], r["conv_id"]), "") + r["role"][:1]
    assert said and all(LEGAL.fullmatch(x) for x in said.values())


def test_long_conversation_in_linear_time():
    n = 50_000
    cost, steps = turn_repair.best_edits([1, 2, 2, 1, 3] * (n // 5), [i % 7 == 0 for i in range(n)], [i % 3 == 0 for i in range(n)])
    assert cost > 0 and len(list(turn_repair.edits(n, steps))) >= n
