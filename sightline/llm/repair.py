"""Repair of conversation structure by Knuth's lightest-derivation agenda.

A repaired conversation is an optional system turn and then user and assistant turns in pairs, or nothing. A repair is a
derivation over the rows in order: an item (rows read, role written last) is deduced from another by one edit, whose
weight is its cost and its initial. Weights are compared as (cost, audit); every edit adds to both, so the functions are
superior and an item is final when it leaves the agenda first. Two repairs of equal cost never have one audit as the
prefix of the other (they read the same rows, and more inserts cost more), so comparing before an edit or after it is the
same, also where two derivations are put end to end.

That lets a long conversation be cut: each block of rows derives its lightest repair from every item that may come before
to every item after it, and a conversation derives its goal from the repairs of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import all_salts, id_key, salted
from sightline.session import materialize

#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What was written last: nothing, a system row, a user row, an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: A repair may end after these.
GOALS = (NOTHING, ASSISTANT)
#: Rows of a block as a power of two, and blocks put together at a time.
BLOCK_BITS, TOGETHER = 8, 64
#: Pairs of neighbouring role initials that are in order.
LEGAL = ("su", "ua", "au")

_WHITE = " \t\n\x0b\x0c\r"


def next_role(state: int) -> int:
    return ASSISTANT if state == USER else USER


def row_edits(initial: str, must_go: bool, truncated: bool, repeats: int):
    """(from, cost, letters, to) for each edit of a row; `repeats` further copies of it are deleted right behind."""
    cost, letters = DELETE * repeats, "D" * repeats
    out = [(s, DELETE + cost, "D" + letters, s) for s in range(4)]
    if not must_go:
        cost += TRUNCATED if truncated else 0
        if initial == "s":
            out.append((NOTHING, cost, "K" + letters, SYSTEM))
        for s in range(4):
            to = next_role(s)
            if initial == ("a" if to == ASSISTANT else "u"):
                out.append((s, cost, "K" + letters, to))
            out.append((s, REROLE + cost, "R" + letters, to))
    return out


def lightest(steps: list, inserts: bool, start: int = NOTHING, goals: tuple = (NOTHING, SYSTEM, USER, ASSISTANT), first: bool = False) -> dict:
    """{state: (cost, audit)} of the lightest derivations over `steps`, each a dict of state to (cost, letters, state); `first` stops at the first goal."""
    import heapq

    final, found, n = set(), {}, len(steps)
    agenda = [(0, "", 0, start)]
    while agenda:
        cost, audit, at, state = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == n and state in goals:
            found[state] = (cost, audit)
            if first or len(found) == len(goals):
                break
        if inserts and (at, to := next_role(state)) not in final:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", at, to))
        if at < n:
            for more, letters, to in steps[at].get(state, ()):
                if (at + 1, to) not in final:
                    heapq.heappush(agenda, (cost + more, audit + letters, at + 1, to))
    return found


def block_repairs(rows: list) -> list:
    """Lightest repairs of a block from each state to each: a list of 16 (cost, audit) or None. rows: (initial, must_go, truncated, repeats)."""
    steps = []
    for row in rows:
        step: dict = {}
        for s, cost, letters, to in row_edits(*row):
            step.setdefault(s, []).append((cost, letters, to))
        steps.append(step)
    return [x.get(to) for s in range(4) for x in (lightest(steps, True, s),) for to in range(4)]


def block_steps(blocks: list) -> list:
    """A block's repairs as edits of one step."""
    return [{s: [(*b[4 * s + to], to) for to in range(4) if b[4 * s + to]] for s in range(4)} for b in blocks]


def together(blocks: list) -> list:
    """Lightest repairs of neighbouring blocks as one block."""
    steps = block_steps(blocks)
    return [x.get(to) for s in range(4) for x in (lightest(steps, False, s),) for to in range(4)]


class Chain:
    """Blocks of one conversation as they come; put together TOGETHER at a time, so that each audit is copied once a level."""

    def __init__(self) -> None:
        self.levels: list[list] = []

    def add(self, block: list, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(block)
        if len(self.levels[level]) == TOGETHER:
            whole, self.levels[level] = together(self.levels[level]), []
            self.add(whole, level + 1)

    def goal(self) -> tuple[int, str]:
        """Cost and audit of the whole conversation: the weight of the first goal item that is final."""
        steps = block_steps([b for level in reversed(self.levels) for b in level])
        return next(iter(lightest(steps, False, NOTHING, GOALS, True).values()))


def slices(audit: str, sizes: list) -> Iterator:
    """(letters, written before) for blocks of so many rows: an insert goes with the row behind it, those at the end with the last."""
    at = written = 0
    for k, size in enumerate(sizes):
        end = at
        while size:
            size -= audit[end] != "I"
            end += 1
        if k == len(sizes) - 1:
            end = len(audit)
        yield audit[at:end], written
        written += end - at - audit.count("D", at, end)
        at = end


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with nulls of role and text as one space, damaged by the crc32 of `conv_id:turn` modulo 20, and `copies` of each.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 sets its role to user.
    """
    space = F.lit(" ")
    hit = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])) % 20
    text = F.coalesce("text", space)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), text.alias("text"), hit.alias("_hit")).filter("_hit <> 0")
    text = F.when(F.col("_hit") == 1, F.lit("")).when(F.col("_hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_hit") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_hit") == 3, 2).otherwise(1).cast("long").alias("copies"))


def ordered(rows: DataFrame, salts: int = 16) -> DataFrame:
    """Distinct rows in order: conv_id, turn, role, text, copies, kind (of the first copy), initial, at (the place in the whole table), block.

    Rows of a conversation go by turn (nulls first), role and text. Rows are dealt by ranges of that order, so a long
    conversation goes over many tasks; `at` never changes once written.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("_end", F.substring(F.rtrim("text", F.lit(_WHITE)), -1, 1)).withColumn("_digest", F.sha2("text", 256))
    rows = materialize(rows.withColumn("_key", id_key(F.col("conv_id"))), "damaged")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    key = ["_key", "role", "_digest"]
    seen = rows.filter("_end <> ''").groupBy(*key).agg(F.min(place).alias("_first"), F.count("*").alias("_times")).filter("_times > 1").drop("_times")
    seen = all_salts(seen, salts).withColumnsRenamed({c: f"{c}2" for c in [*key, "_salt"]})
    left = salted(rows, F.xxhash64("turn"), salts)
    on = F.col("_salt") == F.col("_salt2")
    for c in key:
        on = on & (F.col(c) == F.col(f"{c}2"))
    again = F.coalesce(place > F.col("_first"), F.lit(False))
    kind = F.when(F.col("_end") == "", "blank").when(again, "duplicate").when(~F.col("_end").isin(".", "!", "?"), "truncated").otherwise("")
    told = left.join(seen, on, "left").select("conv_id", "turn", "role", "text", "copies", kind.alias("kind"), F.substring("role", 1, 1).alias("initial"))
    told = materialize(told, "told")
    dealt = told.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    placed = dealt.withColumn("at", F.monotonically_increasing_id())
    return materialize(placed.withColumn("block", F.shiftright("at", BLOCK_BITS)), "placed")


def _by_key(batches: Iterator, key: tuple, columns: list) -> Iterator:
    """(key, rows) of neighbouring rows with one key, as an iterator that must be read before the next."""
    from itertools import groupby

    def rows():
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                yield from zip(*(some[c].to_pylist() for c in columns), strict=True)

    return groupby(rows(), key=lambda row: row[: len(key)])


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_BLOCK = "conv_id {id}, block long, at long, rows long, head string, tail string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"
_FOUND = "conv_id {id}, at long, letters string, written long, odd boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _batch(rows: list, like, schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "{id}": like}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], _names(schema))


def _typed(batches: Iterator, kept: dict) -> Iterator:
    """Passes batches on and keeps the type of the conversation's id."""
    for batch in batches:
        kept["type"] = batch.schema.field("conv_id").type
        yield batch


def _given(rows: Iterator, kept: dict, schema: str, n: int = 256, size: int = 1 << 20) -> Iterator:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == n or chars > size:
            yield _batch(held, kept["type"], schema)
            held, chars = [], 0
    if held:
        yield _batch(held, kept["type"], schema)


def _blocks(batches: Iterator) -> Iterator:
    """Reads (conv_id, block, at, turn, kind, initial, copies) in order; a row for each conversation and block."""
    kept: dict = {}

    def rows():
        for (conv, block), own in _by_key(_typed(batches, kept), ("conv_id", "block"), ["conv_id", "block", "at", "turn", "kind", "initial", "copies"]):
            n = dict.fromkeys(_COUNTS, 0)
            first = low = high = tail = None
            turns = size = 0
            steps = []
            for _, _, at, turn, kind, initial, copies in own:
                if first is None:
                    first, head = at, initial
                elif tail + initial not in LEGAL:
                    n["illegal"] += 1
                tail = initial
                n["illegal"] += copies - 1  # a role next to itself is never in order
                if kind:
                    n[kind] += 1
                n["blank" if kind == "blank" else "duplicate"] += copies - 1
                if turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
                size += copies
                steps.append((initial, kind in ("blank", "duplicate"), kind == "truncated", copies - 1))
            found = block_repairs(steps)
            yield conv, block, first, size, head, tail, low, high, turns, *n.values(), [x and x[0] for x in found], [x and x[1] for x in found]

    yield from _given(rows(), kept, _BLOCK)


def _conversations(batches: Iterator) -> Iterator:
    """Reads block rows in order; a row for each conversation, and one for each block with the letters of its rows."""
    kept: dict = {}

    def rows():
        for (conv,), own in _by_key(_typed(batches, kept), ("conv_id",), _names(_BLOCK)):
            chain, firsts, sizes, sums = Chain(), [], [], [0] * len(_COUNTS)
            tail = low = high = None
            turns = 0
            for _, _, at, size, head, last, small, great, distinct, *rest in own:
                sums = [a + b for a, b in zip(sums, rest, strict=False)]
                if tail is not None and tail + head not in LEGAL:
                    sums[-1] += 1
                tail = last
                if distinct:
                    turns += distinct - (small == high)
                    low, high = small if low is None else low, great
                costs, audits = rest[len(_COUNTS) :]
                chain.add([None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)])
                firsts.append(at)
                sizes.append(size)
            cost, audit = chain.goal()
            gaps = 0 if low is None else min(high - low + 1 - turns, 2**63 - 1)
            odd = (len(audit) - audit.count("D")) % 2 == 1
            yield conv, None, None, None, odd, gaps, *sums, cost, audit
            for at, (letters, written) in zip(firsts, slices(audit, sizes), strict=True):
                yield conv, at, letters, written, odd, *[None] * 7

    yield from _given(rows(), kept, _FOUND)


def _repaired(batches: Iterator) -> Iterator:
    """Reads the rows of conversations in order, the first of each block with its letters; the digest of each repaired conversation."""
    import hashlib

    kept: dict = {}

    def rows():
        columns = ["conv_id", "copies", "role", "text", "letters", "written", "odd"]
        for (conv,), own in _by_key(_typed(batches, kept), ("conv_id",), columns):
            digest, out, at, letters, lead = hashlib.sha256(), 0, 0, "", 0

            def write(role: str, text: str) -> None:
                nonlocal out
                digest.update((("\n" if out else "") + role + ":" + text).encode())  # noqa: B023
                out += 1

            def insert() -> None:
                write("user" if (out - lead) % 2 == 0 else "assistant", "")

            for _, copies, role, text, more, written, odd in own:
                if more is not None:
                    at, letters, out, lead = 0, more, written, int(odd)
                while letters[at] == "I":
                    insert()
                    at += 1
                if letters[at] != "D":
                    write(role if letters[at] == "K" else "user" if (out - lead) % 2 == 0 else "assistant", text)
                at += copies
            for _ in letters[at:]:  # only inserts are left behind the last row
                insert()
            yield conv, digest.hexdigest()

    yield from _given(rows(), kept, "conv_id {id}, repaired_sha256 string")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per conversation of the rows given, with `audit` and `repaired_sha256`; rows may have a column `copies`.

    Counts blank, duplicate and truncated rows (the first that holds), neighbours out of order and missing turns; cost and
    audit are those of the cheapest repair, ties to the smallest audit. Null conv_id is a conversation of its own; a null
    turn comes first and is no turn. Rows that tie go by role and text; equal rows are one row and its copies. A
    conversation of any length is read in blocks; what one task holds of it is 16 times its audit (a letter a row), and
    its texts stream through the digest. An empty table gives no rows.
    """
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    space = F.lit(" ")
    rows = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, space).alias("role"), F.coalesce(text_col, space).alias("text"), copies.alias("copies"))
    placed = ordered(rows, salts)
    kind = placed.schema["conv_id"].dataType.simpleString()
    some = placed.select("conv_id", "block", "at", "turn", "kind", "initial", "copies")
    some = some.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    blocks = some.mapInArrow(_blocks, _BLOCK.format(id=kind))
    blocks = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    found = materialize(blocks.mapInArrow(_conversations, _FOUND.format(id=kind)), "repairs")
    letters = found.filter("at IS NOT NULL").select(F.col("at").alias("_at"), "letters", "written", "odd")
    texts = placed.select("conv_id", "at", "copies", "role", "text").join(letters, F.col("at") == F.col("_at"), "left")
    texts = texts.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    digests = texts.mapInArrow(_repaired, f"conv_id {kind}, repaired_sha256 string").withColumnRenamed("conv_id", "_conv")
    summary = found.filter("at IS NULL").drop("at", "letters", "written", "odd")
    return summary.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def repair_damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", salts: int = 16) -> DataFrame:
    """`repair` of the rows after `damaged`, with a row for every conversation, also those that lose all rows (zeros, no audit, the digest of nothing)."""
    own = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    found = repair(damaged(own), salts=salts).withColumnRenamed("conv_id", "_conv")
    every = own.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")

    def or_else(name: str, value) -> Column:
        return F.coalesce(name, F.lit(value)).alias(name)

    numbers = ["gaps", *_COUNTS, "cost"]
    nothing = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of an empty text
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], or_else("audit", ""), or_else("repaired_sha256", nothing))
