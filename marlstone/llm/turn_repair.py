"""Conversation structure repair by dynamic programming over the turns that stay.

A conversation's turns, by turn number (nulls first, ties by role and text), are edited at the lowest cost into one
whose role initials match ``(s?(ua)+)?``: a turn is kept (0), given the role user or assistant (``REROLE``) or deleted
(``DELETE``), and empty user or assistant turns are inserted (``INSERT``). Blank turns, and turns whose role and text
came before, must go; a turn that stays without closing mark costs ``OPEN`` more.

The program runs over retained turns only, from the last to the first: the best rest behind a retained turn of role r
is a next retained turn of role q, the deletions in between, which are a difference of prefix sums, and the insertions
that the pair (r, q) needs. A running minimum per role q of (prefix sum at that turn + best rest from it) prices all
gaps at once, so a conversation of n turns takes O(n) steps. Of equal costs the least audit, the string of the edits'
initials, wins: it begins with the longest run of D, so the farther next turn, then has more I, then K before R, then
the lesser rest, of which each turn holds the order among its roles. The roles of the output follow from the audit.

Rows are written once with an id; a narrow row per turn (no text) goes to the task of its conversation, and texts go
there once more, in order, for the digest only. A task holds some bytes a turn of one conversation at a time, as its
audit is one value of the result, and of texts a batch. Nulls: a null role or text is one space, turns without number
come first, rows without conversation id are one conversation without id. Empty texts are blank. Repeated rows are
duplicates of the first. An empty table gives an empty result. Texts of any length are streamed. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, Scratch, sorted_groups

DELETE, REROLE, INSERT, OPEN = 4, 3, 3, 3
ROLES = ("system", "user", "assistant")
#: Insertions between two roles (0 system, 1 user, 2 assistant), from the start (3), and to the end (column 3).
_GAPS = ((None, "", "u", "ua"), (None, "a", "", "a"), (None, "", "u", ""), ("", "", "u", ""))
_NAMES = {"u": "user", "a": "assistant"}
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: One row per edit (op not null), and one per conversation (op null).
EDITS = "nameless boolean, conv_id long, seq long, op string, rid long, role string, audit string, " + ", ".join(f"{c} long" for c in _COUNTS)

Step = tuple[int, int, int]


def best_edits(kinds: list[int], fixed: list[bool], truncated: list[bool]) -> tuple[int, list[Step]]:
    """Cost and the retained turns in order as (turn, role, 1 if its role is new); turns in ``fixed`` must go.

    ``kinds``: 0 to 2 as in ``ROLES``, 3 for other roles. At a turn and role, ``to`` and ``as_`` are the next retained
    turn (n: none) and its role; ``rank`` orders the turn's roles by their audit from there.
    """
    n = len(kinds)
    to, as_, rank = ([array("q", bytes(8 * n)) for _ in range(3)] for _ in range(3))
    best: list[tuple[int, int] | None] = [None, None, None]  # per role: prefix sum of deletions up to a turn + best from it, and the turn

    def follow(role: int, done: int) -> tuple[int, int, int]:
        """Cheapest rest behind ``done`` turns: cost, next turn, its role."""
        gap = _GAPS[role]
        found = (DELETE * n + INSERT * len(gap[3]), n, 3)
        for q in range(3):
            if best[q] is None or gap[q] is None:
                continue
            cost, j = best[q][0] + INSERT * len(gap[q]), best[q][1]
            if cost < found[0] or cost == found[0] and less(role, j, q, found[1], found[2]):
                found = (cost, j, q)
        return found[0] - DELETE * done, found[1], found[2]

    def less(role: int, j: int, q: int, other: int, r: int) -> bool:
        """Whether the audit that goes on with turn j as q comes before the one with ``other`` as r."""
        if j != other:
            return j > other
        k, m = len(_GAPS[role][q]), len(_GAPS[role][r])
        return k > m if k != m else rank[q][j] < rank[r][j]

    for i in range(n - 1, -1, -1):
        if fixed[i]:
            continue
        own = OPEN * truncated[i]
        here = []
        for role in (0, 1, 2):
            new = kinds[i] != role
            if new and role == 0:
                continue
            rest, to[role][i], as_[role][i] = follow(role, i + 1)
            here.append((role, new, own + REROLE * new + rest))
        order = here[:1]
        for x in here[1:]:
            at = 0
            while at < len(order) and not _before(x, order[at], i, n, to, as_, less):
                at += 1
            order.insert(at, x)
        for at, (role, _, _) in enumerate(order):
            rank[role][i] = at
        for role, _, cost in here:
            if best[role] is None or cost + DELETE * i < best[role][0]:  # of equal ones the farther stays
                best[role] = (cost + DELETE * i, i)
    cost, j, role = follow(3, 0)
    steps = []
    while j < n:
        steps.append((j, role, int(kinds[j] != role)))
        j, role = to[role][j], as_[role][j]
    return cost, steps


def _before(x: tuple, y: tuple, i: int, n: int, to, as_, less) -> bool:
    """Order of two roles of turn i by their audits from it on."""
    if x[1] != y[1]:
        return not x[1]
    jx, qx, jy, qy = to[x[0]][i], as_[x[0]][i], to[y[0]][i], as_[y[0]][i]
    k, m = len(_GAPS[x[0]][qx]), len(_GAPS[y[0]][qy])
    if jx != jy:
        return jx > jy
    if jx == n or k != m:
        return k < m if jx == n else k > m
    return less(x[0], jx, qx, jy, qy)


def edits(n: int, steps: list[Step]) -> Iterator[tuple[str, int | None, str | None]]:
    """The edits in order: initial, turn (none for insertions), new role (for R and I). Deletions of a gap come first."""
    at, role = 0, 3
    for j, q, new in [*steps, (n, 3, 0)]:
        for i in range(at, j):
            yield "D", i, None
        for c in _GAPS[role][q]:
            yield "I", None, _NAMES[c]
        if j < n:
            yield ("R", j, ROLES[q]) if new else ("K", j, None)
        at, role = j + 1, q


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("nameless", pa.bool_()), ("conv_id", pa.int64()), ("seq", pa.int64()), ("op", pa.string()), ("rid", pa.int64()), ("role", pa.string()), ("audit", pa.string()), *((c, pa.int64()) for c in _COUNTS)])
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        out.clear()
        return batch

    for group in sorted_groups(batches, ["nameless", "conv_id"]):
        kinds, blank, truncated, turns, digests, rids = (group.column(c).to_pylist() for c in ("kind", "blank", "truncated", "turn", "digest", "rid"))
        conv, nameless, seen, fixed, n = group.column("conv_id")[0].as_py(), group.column("nameless")[0].as_py(), set(), [], len(kinds)
        counts = dict.fromkeys(_COUNTS, 0)
        for i in range(n):
            twice = not blank[i] and digests[i] in seen
            seen.add(digests[i])
            truncated[i] = truncated[i] and not blank[i] and not twice
            fixed.append(blank[i] or twice)
            counts["blank"] += blank[i]
            counts["duplicate"] += twice
            counts["truncated"] += truncated[i]
            counts["illegal"] += i > 0 and (kinds[i - 1], kinds[i]) not in ((0, 1), (1, 2), (2, 1))
        numbered = [t for t in turns if t is not None]
        if numbered:
            counts["gaps"] = min(numbered[-1] - numbered[0] + 1 - len(set(numbered)), 2**63 - 1)
        counts["cost"], steps = best_edits(kinds, fixed, truncated)
        audit = []
        for seq, (op, i, role) in enumerate(edits(n, steps)):
            audit.append(op)
            out.append((nameless, conv, seq, op, None if i is None else rids[i], role, None, *[None] * len(_COUNTS)))
            if len(out) >= 20_000:
                yield flush()
        out.append((nameless, conv, None, None, None, None, "".join(audit), *counts.values()))
    if out:
        yield flush()


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come in order."""
    open_, digest = None, None
    for b in batches:
        done = {"nameless": [], "conv_id": [], "repaired_sha256": []}
        for key, head, text in zip(zip(b.column("nameless").to_pylist(), b.column("conv_id").to_pylist()), b.column("head").to_pylist(), b.column("text")):
            if key != open_:
                if digest is not None:
                    for c, v in zip(done, (*open_, digest.hexdigest())):
                        done[c].append(v)
                open_, digest = key, hashlib.sha256(head.encode())
            else:
                digest.update(b"\n" + head.encode())
            digest.update(text.as_py().encode())
        yield pa.RecordBatch.from_pydict(done, schema=_HASHED)
    if digest is not None:
        yield pa.RecordBatch.from_pydict({"nameless": [open_[0]], "conv_id": [open_[1]], "repaired_sha256": [digest.hexdigest()]}, schema=_HASHED)


_HASHED = pa.schema([("nameless", pa.bool_()), ("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(" "))


class Repaired:
    """What ``repair`` gives: ``summary`` (a row per conversation) and ``turns`` (a row per turn of the repaired ones)."""

    def __init__(self, rows: DataFrame, edits_: DataFrame):
        self.rows, self.edits = rows, edits_
        self.summary = edits_.where("op is null").select("nameless", "conv_id", *_COUNTS, "audit")

    @property
    def turns(self) -> DataFrame:
        """nameless, conv_id (0 where nameless), seq (place in the audit), op, role, text."""
        ops = self.edits.where("op in ('K', 'R', 'I')").select("nameless", "conv_id", "seq", "op", "rid", F.col("role").alias("_new")).repartition("nameless", "conv_id")
        texts = self.rows.select("nameless", "conv_id", "rid", "role", "text").repartition("nameless", "conv_id")
        met = ops.join(texts, ["nameless", "conv_id", "rid"], "left")
        return met.select("nameless", "conv_id", "seq", "op", F.coalesce("_new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def digests(self) -> DataFrame:
        """``summary`` with repaired_sha256, of the lines ``role:text``."""
        lines = self.turns.select("nameless", "conv_id", "seq", F.concat("role", F.lit(":")).alias("head"), "text")
        hashed = lines.repartition("nameless", "conv_id").sortWithinPartitions("nameless", "conv_id", "seq").drop("seq").mapInArrow(_hash_lines, "nameless boolean, conv_id long, repaired_sha256 string")
        out = self.summary.join(hashed, ["nameless", "conv_id"], "left")
        return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))


def repair(messages: DataFrame, scratch: Scratch) -> Repaired:
    rows = messages.select(F.col("conv_id").isNull().alias("nameless"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv_id"), F.col("turn").cast("long").alias("turn"), _filled("role").alias("role"), _filled("text").alias("text"))
    rows = scratch.save(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    initial, ended = F.substring("role", 1, 1), F.rtrim("text", F.lit(BLANKS))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    flags = (kind.alias("kind"), (ended == "").alias("blank"), (~F.substring(ended, -1, 1).isin(".", "!", "?")).alias("truncated"))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("digest")
    placed = rows.select("nameless", "conv_id", "turn", "rid", "role", "text", *flags, digest).repartition("nameless", "conv_id")
    placed = placed.sortWithinPartitions("nameless", "conv_id", F.col("turn").asc_nulls_first(), "role", "text").drop("role", "text")
    return Repaired(rows, scratch.save(placed.mapInArrow(_repair, EDITS), "edits"))


def damaged(messages: DataFrame) -> DataFrame:
    """Conversations with faults, by the CRC-32 of ``conv_id:turn`` (a null is one space) modulo 20: 0 drops a turn, 1
    empties it, 2 takes its closing marks, 3 repeats it, 4 makes it a user's."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = messages.select("conv_id", "turn", _filled("role").alias("role"), _filled("text").alias("text"), fault.alias("_f")).where("_f <> 0")
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_f") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def digest(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """Every conversation of ``messages`` after damage and repair; those that lost all rows have zeros."""
    found = repair(damaged(messages), scratch).digests()
    every = messages.select(F.col("conv_id").isNull().alias("nameless"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv_id")).distinct()
    out = every.join(found, ["nameless", "conv_id"], "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS]
    return out.select(F.when(~F.col("nameless"), F.col("conv_id")).alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
