"""Repair of conversation structure by a rank-convergence parallel Viterbi search.

The roles of a conversation must read ``(s?(ua)+)?``. Each message is kept, given another role or
deleted, and messages may be put in; the cheapest edits are found from the back: a vector holds,
for each state of that pattern, the least cost of the rest. Long conversations are cut into chunks
that all start at once from a speculative vector. Fix-up passes rerun a chunk whose right neighbour
ended in another vector, until vectors differ only by constants, which change no decision. Ever more
neighbouring chunks share a pass, so that a conversation of n chunks needs at most log n passes.
Then each chunk says where each state leads, these maps are strung together from the front, and the
least audit is traced in all chunks at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.llm.common import columns, stash
from tillwork.llm.linequality import WHITE

CHUNK_ROWS, CHUNK_CHARS = 512, 1 << 16
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5  # costs; the last is for a truncated message that stays
# States: nothing yet, after system, after user, after assistant. Symbols: initial (s, u, a, other), + 4 if
# truncated; 8 must go.
STATES, MUST_GO = 4, 8
_ON_INITIAL = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
_NEXT = (2, 2, 3, 2)  # where another role, or a message put in, leads
_ROLE = {2: "user", 3: "assistant"}
AT_END = (0, 2 * INSERT, INSERT, 0)
# Chunks end after an assistant where they can, so that a user's message is likely to follow.
GUESS = (0, 0, DELETE, 0)
_LEGAL = {(0, 1), (1, 2), (2, 1)}


@cache
def back(right: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]:
    """The vector before a message, less its least value; that value; edits and next state from each state."""
    offers = []
    for state in range(STATES):
        of = [("D", DELETE + right[state], state)]
        if symbol != MUST_GO:
            more, to = CUT_OFF * (symbol >= 4), _ON_INITIAL[state][symbol % 4]
            if to is not None:
                of.append(("K", KEEP + more + right[to], to))
            of.append(("R", REROLE + more + right[_NEXT[state]], _NEXT[state]))
        offers.append(of)
    best = [min(cost for _, cost, _ in of) for of in offers]
    for _ in range(STATES):
        best = [min(b, INSERT + best[_NEXT[s]]) for s, b in enumerate(best)]

    def edits(state: int) -> tuple[str, int]:
        letter, _, to = min([o for o in offers[state] if o[1] == best[state]], default=("Z", 0, 0))
        if letter > "I" and best[state] == INSERT + best[_NEXT[state]]:
            after, to = edits(_NEXT[state])
            return "I" + after, to
        return letter, to

    least = min(best)
    return tuple(b - least for b in best), least, tuple(edits(s) for s in range(STATES))


def leftmost(symbols: bytes, right: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before a run of messages."""
    for symbol in reversed(symbols):
        right = back(right, symbol)[0]
    return right


def decisions(symbols: bytes, right: tuple[int, ...]) -> list[tuple[tuple[str, int], ...]]:
    """For each message, the edits and next state from each state."""
    out = []
    for symbol in reversed(symbols):
        right, _, moves = back(right, symbol)
        out.append(moves)
    return out[::-1]


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """Conversations with planted faults, chosen by a checksum of conversation and turn.

    Of 20 remainders, 0 drops the message, 1 empties its text, 2 takes its ends of sentences, 3 repeats
    it and 4 makes it the user's. Column ``copies`` says how often a row stands there. Nulls of role and text,
    and those in the checksum, are one space.
    """
    rows = columns(conversations, conv_col, turn_col, role_col, text_col).toDF("conv_id", "turn", "role", "text")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *named)) % 20
    return rows.withColumn("kind", kind).filter("kind != 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def _later_than(first: Column, turn: Column) -> Column:
    """Whether a turn comes behind the first, nulls first."""
    return F.struct(turn.isNotNull(), turn) > first


def with_faults(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one with their number, and ``fault``: 0, 1 blank, 2 duplicate, 3 truncated."""
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("int").alias("copies"))
    core = F.btrim("text", F.lit(WHITE))
    keyed = same.withColumns({
        "h1": F.xxhash64(F.lit(1), "role", "text"), "h2": F.xxhash64(F.lit(2), "role", "text"), "blank": core == "",
        "cut": ~F.substring(core, -1, 1).isin(".", "!", "?")})
    seen = keyed.filter("not blank").groupBy("conv_id", "h1", "h2").agg(
        F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("first"), F.count("*").alias("n")).filter("n > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first")
    joined = keyed.join(seen, keyed["conv_id"].eqNullSafe(seen["c"]) & (keyed["h1"] == seen["k1"])
                        & (keyed["h2"] == seen["k2"]), "left")
    repeated = F.coalesce(_later_than(F.col("first"), F.col("turn")), F.lit(False))
    fault = F.when(F.col("blank"), 1).when(repeated, 2).when(F.col("cut"), 3).otherwise(0)
    initial = F.coalesce(F.expr("array_position(array('s', 'u', 'a'), substring(role, 1, 1))"), F.lit(0))
    return joined.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"),
                         F.when(initial == 0, 3).otherwise(initial - 1).cast("int").alias("initial"))


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive messages of a conversation as one row; the rows arrive in order."""
    part, number, chunk, chars = TaskContext.get().partitionId(), 0, [], 0
    out, kind = [], None

    def close() -> None:
        nonlocal chunk, chars, number
        if not chunk:
            return
        symbols = bytes(MUST_GO if f in (1, 2) else i + 4 * (f == 3) for _, _, _, _, f, i in chunk)
        counts, illegal, before = [0, 0, 0, 0], 0, None
        for _, _, _, copies, fault, initial in chunk:
            if fault in (1, 2):
                counts[fault] += copies
            else:
                counts[fault] += 1
                counts[2] += copies - 1
            illegal += copies - 1 + (before is not None and (before, initial) not in _LEGAL)
            before = initial
        out.append((chunk[0][0], part, number, symbols, [r[3] for r in chunk], [r[1] for r in chunk],
                    [r[2] for r in chunk], chunk[0][5], before, *counts[1:], illegal, list(leftmost(symbols, GUESS))))
        chunk, chars, number = [], 0, number + 1

    def flush() -> pa.RecordBatch:
        nonlocal out
        done = [pa.array(list(f), k or kind) for f, k in zip(zip(*out), CHUNK.values())]
        out = []
        return pa.record_batch(done, list(CHUNK))

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        names = ("conv_id", "role", "text", "copies", "fault", "initial")
        for row in zip(*[batch.column(n).to_pylist() for n in names]):
            if chunk and chunk[0][0] != row[0]:
                close()
            chunk.append(row)
            chars += len(row[2])
            full = len(chunk) >= CHUNK_ROWS or chars >= CHUNK_CHARS
            if full and (row[5] == 2 or len(chunk) >= 2 * CHUNK_ROWS or chars >= 2 * CHUNK_CHARS):
                close()
        if out:
            yield flush()
    close()
    if out:
        yield flush()


_INTS, _TEXTS = pa.list_(pa.int32()), pa.list_(pa.string())
CHUNK = {
    "conv_id": None, "part": pa.int32(), "seq": pa.int64(), "symbols": pa.binary(), "copies": _INTS, "roles": _TEXTS,
    "texts": _TEXTS, "first": pa.int32(), "last": pa.int32(), "blank": pa.int64(), "duplicate": pa.int64(),
    "truncated": pa.int64(), "illegal": pa.int64(), "left": _INTS}


def chunks_of(rows: DataFrame) -> DataFrame:
    """Chunks of messages in order of conversation and turn, written to the shared folder.

    Rows are dealt by ranges of that order, so a conversation may lie in many partitions; part and seq
    give the order of its chunks.
    """
    faulty = with_faults(rows)
    kind = faulty.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role"]
    ranged = faulty.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    return stash(ranged.mapInArrow(_chunk_rows, (
        f"conv_id {kind}, part int, seq long, symbols binary, copies array<int>, roles array<string>, texts array<string>, "
        "first int, last int, blank long, duplicate long, truncated long, illegal long, left array<int>")), "chunks")


def _fixed(table: pa.Table) -> pa.Table:
    """Rerun neighbouring chunks from the right, where the vector they started from has changed."""
    rows = sorted(table.to_pylist(), key=lambda r: -r["no"])
    after = None
    for row in rows:
        start = row["right"] if after is None else after
        if start != row["start"]:
            row["start"], row["left"] = start, list(leftmost(row["symbols"], tuple(start)))
        after = row["left"]
    return pa.Table.from_pylist(rows, table.schema)


def settled(chunks: DataFrame) -> DataFrame:
    """Chunks of conversations with several: ``start``, the vector that the right neighbour really ends in."""
    several = chunks.groupBy(F.col("conv_id").alias("c")).count().filter("count > 1").select("c")
    cut = chunks.select("conv_id", "part", "seq", "symbols", "left").join(
        several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    in_order = Window.partitionBy("conv_id").orderBy("part", "seq")
    vector = lambda v: F.array(*[F.lit(x) for x in v])
    state = stash(cut.withColumns({
        "no": F.row_number().over(in_order), "start": vector(GUESS)}), "vectors")
    span = 1
    while True:
        by_no = Window.partitionBy("conv_id").orderBy("no")
        seen = state.withColumns({
            "final": F.lead("no").over(by_no).isNull(), "right": F.coalesce(F.lead("left").over(by_no), vector(AT_END))})
        if seen.filter("start != right").isEmpty():
            return seen
        span *= 4
        schema = seen.withColumn("block", F.expr(f"no div {span}")).schema
        fixed = seen.withColumn("block", F.expr(f"no div {span}")).groupBy("conv_id", "block").applyInArrow(_fixed, schema)
        state = stash(fixed.select(*state.columns), "vectors")


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each state at the front of a chunk leads, in place of its messages."""
    for batch in batches:
        ends = []
        for symbols, start in zip(batch.column("symbols").to_pylist(), batch.column("start").to_pylist()):
            ends.append(list(range(STATES)))
            for moves in decisions(symbols, tuple(start)):
                ends[-1] = [moves[s][1] for s in ends[-1]]
        yield batch.drop_columns(["symbols"]).append_column("ends", pa.array(ends, _INTS))


def _strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each chunk begins; chunks arrive conversation by conversation, in order."""
    conv, state = object(), 0
    for batch in batches:
        begins = []
        for one, ends in zip(batch.column("conv_id").to_pylist(), batch.column("ends").to_pylist()):
            if one != conv:
                conv, state = one, 0
            begins.append(state)
            state = ends[state]
        yield pa.record_batch([batch.column("part"), batch.column("seq"), batch.column("start"), batch.column("final"),
                               pa.array(begins, pa.int32())], ["p", "s", "start", "final", "begin"])


def begun(chunks: DataFrame) -> DataFrame:
    """``p``, ``s``, ``start``, ``final``, ``begin``: the vector behind and the state before each chunk of a cut conversation."""
    known = settled(chunks)
    kind = known.schema["conv_id"].dataType.simpleString()
    ends = known.select("conv_id", "part", "seq", "no", "symbols", "start", "final").mapInArrow(
        _mapped, f"conv_id {kind}, part int, seq long, no int, start array<int>, final boolean, ends array<int>")
    return ends.repartition("conv_id").sortWithinPartitions("conv_id", "no").mapInArrow(
        _strung, "p int, s long, start array<int>, final boolean, begin int")


def _traced_chunk(row: dict) -> tuple[str, int, list[str], list[str]]:
    """Edits, cost, and the repaired messages of a chunk."""
    alone = row["begin"] is None
    right, state = (AT_END, 0) if alone else (tuple(row["start"]), row["begin"])
    audit, cost, roles, texts = [], 0, [], []
    moves = decisions(row["symbols"], right)
    for move, symbol, copies, role, text in zip(moves, row["symbols"], row["copies"], row["roles"], row["texts"]):
        letters, to = move[state]
        for letter in letters[:-1]:  # put in before the message
            state = _NEXT[state]
            roles.append(_ROLE[state])
            texts.append("")
        letter, state = letters[-1], to
        if letter != "D":
            roles.append(role if letter == "K" else _ROLE[state])
            texts.append(text)
            cost += CUT_OFF * (symbol >= 4)
        audit.append(letters + "D" * (copies - 1))
    if alone or row["final"]:
        while state in (1, 2):
            state = _NEXT[state]
            roles.append(_ROLE[state])
            texts.append("")
            audit.append("I")
    text = "".join(audit)
    cost += sum(text.count(x) * c for x, c in zip("RDI", (REROLE, DELETE, INSERT)))
    return text, cost, roles, texts


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [_traced_chunk(r) for r in batch.select(
            ["begin", "start", "final", "symbols", "copies", "roles", "texts"]).to_pylist()]
        kept = batch.select(["conv_id", "part", "seq", "first", "last", "blank", "duplicate", "truncated", "illegal"])
        kinds = (pa.string(), pa.int64(), _TEXTS, _TEXTS)
        made = [pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)]
        yield pa.record_batch([*kept.columns, *made], [*kept.schema.names, "audit", "cost", "roles", "texts"])


def traced(rows: DataFrame) -> DataFrame:
    """Repaired chunks: conv_id, part, seq, edits, cost and the messages that result."""
    chunks = chunks_of(rows)
    kind = chunks.schema["conv_id"].dataType.simpleString()
    begins = begun(chunks)
    joined = chunks.join(begins, (chunks["part"] == begins["p"]) & (chunks["seq"] == begins["s"]), "left")
    return joined.mapInArrow(_trace, (
        f"conv_id {kind}, part int, seq long, first int, last int, blank long, duplicate long, truncated long, illegal long, "
        "audit string, cost long, roles array<string>, texts array<string>"))


def repaired_messages(rows: DataFrame) -> DataFrame:
    """``conv_id, part, seq, place, role, text``: the repaired messages; part, seq and place give their order."""
    return traced(rows).select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "m")).select(
        "conv_id", "part", "seq", "place", F.col("m.roles").alias("role"), F.col("m.texts").alias("text"))


_SUMMARY = ("blank", "duplicate", "truncated", "illegal", "cost")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums, edits and hash of each conversation; its chunks arrive in order and pass one by one."""
    held, out, kind = None, [], None

    def close() -> None:
        if held:
            out.append((held["conv_id"], *[held[c] for c in _SUMMARY], "".join(held["audit"]), held["sha"].hexdigest()))

    def flush() -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * len(_SUMMARY), pa.string(), pa.string()]
        names = ["conv_id", *_SUMMARY, "audit", "repaired_sha256"]
        done = pa.record_batch([pa.array(list(f), k) for f, k in zip(zip(*out), kinds)], names)
        out.clear()
        return done

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            if held is None or row["conv_id"] != held["conv_id"]:
                close()
                held = {"conv_id": row["conv_id"], "audit": [], "sha": hashlib.sha256(), "any": False, "last": None,
                        **dict.fromkeys(_SUMMARY, 0)}
            for name in _SUMMARY:
                held[name] += row[name]
            held["illegal"] += held["last"] is not None and (held["last"], row["first"]) not in _LEGAL
            held["last"] = row["last"]
            held["audit"].append(row["audit"])
            if row["roles"]:
                blob = "\n".join(f"{r}:{t}" for r, t in zip(row["roles"], row["texts"]))
                held["sha"].update(("\n" * held["any"] + blob).encode())
                held["any"] = True
        if out:
            yield flush()
    close()
    if out:
        yield flush()


def repair(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn, role, text and copies, how often each stands there; ``every`` has the
    conversations to report, whether or not they have rows. Nulls of turn come first and count as no turn;
    ties of a turn go by role, then text; equal rows of a turn are repeats of the first. A null conv_id is a
    conversation of its own. A role with no or another initial than s, u or a cannot stay. No rows give none,
    a conversation without rows zeros, no edits and the hash of the empty text.
    """
    chunks = traced(rows)
    kind = chunks.schema["conv_id"].dataType.simpleString()
    summed = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(
        _summed, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _SUMMARY) + ", audit string, repaired_sha256 string")
    turns = rows.select("conv_id", "turn").distinct().groupBy(F.col("conv_id").alias("t")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    named = (rows if every is None else every).select(F.col("conv_id").alias("c")).distinct()
    joined = named.join(summed, F.col("c").eqNullSafe(F.col("conv_id")), "left").join(
        turns, F.col("c").eqNullSafe(F.col("t")), "left")
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", *_SUMMARY)]
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(F.col("c").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
