"""Conversation repair against a plain search over all edits, and long conversations in blocks."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from sightline.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            yield from [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows, kinds):
    """All audits row by row, the least (cost, audit) of each written text of role initials kept: no items, no agenda."""
    live = {"": (0, "", [])}

    def fits(initials):
        return re.fullmatch("s?(ua)*u?", initials) is not None

    def keep(found, initials, weight):
        if fits(initials) and (initials not in found or weight[:2] < found[initials][:2]):
            found[initials] = weight

    def with_inserts(found):
        out = dict(found)
        for initials, (cost, audit, lines) in found.items():
            for more in (("u",), ("a",), ("u", "a"), ("a", "u")):
                new, own = initials, list(lines)
                for m in more:
                    new += m
                    own.append({"u": "user:", "a": "assistant:"}[m])
                keep(out, new, (cost + 3 * len(more), audit + "I" * len(more), own))
        return out

    for (_, _, role, text), kind in zip(rows, kinds, strict=True):
        found = {}
        for initials, (cost, audit, lines) in with_inserts(live).items():
            keep(found, initials, (cost + 4, audit + "D", lines))
            if kind not in ("blank", "duplicate"):
                more = 3 * (kind == "truncated")
                if role[:1] in ("s", "u", "a"):
                    keep(found, initials + role[:1], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                for other in ("user", "assistant"):
                    keep(found, initials + other[0], (cost + 3 + more, audit + "R", [*lines, f"{other}:{text}"]))
        live = found
    goals = [w for initials, w in with_inserts(live).items() if re.fullmatch("(s?(ua)+)?", initials)]
    return min(goals, key=lambda w: w[:2])


def brute(rows, damaging=True):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    after = list(damage(rows)) if damaging else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in after if r[0] == conv], key=key)
        kinds, turns = faults(own), {r[1] for r in own if r[1] is not None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, lines = plain_repair(own, kinds)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def conversations(rng, n, longest, first=0):
    roles = ["user", "assistant", "assistant", "user", "system", "tool", "", None, "u2", "sys", "Assistant"]
    texts = ["Yes.", "No!", "So what?", "cut off", "", None, " \n\t", "done. ", "é", "x\x85", "Yes."]
    out = []
    for conv in range(first, first + n):
        turn = 0
        for _ in range(rng.randint(0, longest)):
            turn += rng.choice([1, 1, 1, 0, 3])
            out.append((conv, rng.choice([turn, turn, turn, turn, None]), rng.choice(roles), rng.choice(texts)))
        for role in ["system", "user", "assistant", "user", "assistant"][rng.randint(0, 1) :]:
            turn += 1
            out.append((conv, turn, role, f"Turn {turn} of {conv}."))
    return out


def test_damaged_conversations(spark):
    rng = random.Random(3)
    rows = conversations(rng, 120, 7) + [(None, None, None, None), (None, 1, "user", "a."), (10**12, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.lit(1))
    for name in ("at", "block", "kind", "copies", "_key", "letters", "cost"):
        df = df.withColumn(name, F.lit("clash"))
    assert got(repair.repair_damaged(df)) == brute(rows)


def test_repeated_rows_and_no_damage(spark):
    rng = random.Random(5)
    rows = [r for r in conversations(rng, 40, 5) for _ in range(rng.choice([1, 1, 1, 2, 9]))]
    assert got(repair.repair(spark.createDataFrame(rows, SCHEMA))) == brute(rows, False)


@pytest.mark.parametrize("bits, together", [(0, 2), (1, 2), (2, 3)])
def test_blocks_of_long_conversations(spark, monkeypatch, bits, together):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    monkeypatch.setattr(repair, "TOGETHER", together)
    rows = conversations(random.Random(bits), 25, 30)
    assert got(repair.repair_damaged(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_lost_and_empty(spark):
    lost = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = got(repair.repair_damaged(spark.createDataFrame([(lost, 0, "user", "Gone.")], SCHEMA)))
    assert found == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_conversation(spark):
    """60,000 turns of one conversation, dealt over tasks; a missing answer every hundred turns."""
    n = 60_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Turn "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    rows = rows.filter("turn % 100 <> 51").union(rows.filter("turn = 7"))
    started = time.time()
    row = got(repair.repair(rows))[0]
    gone = n // 100
    lines = ["assistant:" if k % 100 == 51 else f"{'user' if k % 2 == 0 else 'assistant'}:Turn {k}." for k in range(n)]
    audit = "".join("I" if k % 100 == 51 else "KD" if k == 7 else "K" for k in range(n))
    assert row == (1, gone, 0, 1, 0, gone + 1, 3 * gone + 4, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert time.time() - started < 120
