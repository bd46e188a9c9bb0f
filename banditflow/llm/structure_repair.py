"""Conversation structure repair: the cheapest edits that give ``(s?(ua)+)?``, by a run-length min-plus DP.

A conversation's rows, in turn order, become symbols: must go (blank or repeated), or role class
(system, user, assistant, other) with or without a truncated end.  Equal consecutive symbols form a
run.  The automaton of the wanted role order has four states; a symbol is a 4 x 4 min-plus matrix of
edit costs, and a run of n symbols is its n-th power, put together from cached binary powers.

Spark job:

    narrow rows (no text) -> range order (conversation, turn) -> runs, cut in pieces of at most
    ``PIECE`` runs, each with the min-plus product of its runs
    -> pieces of a conversation back to front: cost of the best end after each piece
    -> rows and pieces meet in (conversation, turn) order; each piece unrolls its choices from the
       state it is entered in, row by row, and the edits are applied as the texts stream by

Range order spreads the runs of a hot conversation over tasks; the two passes in conversation order
stream, holding one piece of runs (the summary also the audit, which is a value of its result).

Defined cases: a null role or text counts as one space; a null turn sorts first; rows of one turn are
ordered by the hashes of role and text, so equal rows are neighbours; a null conversation id is a
conversation of its own; a conversation without rows has an empty repair; an empty table gives no rows;
columns other than the four named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from banditflow.session import materialize

# Costs of edits, blank characters, sentence ends, the roles written by edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
USER, ASSISTANT = "user", "assistant"

#: Runs a piece may hold.
PIECE = 4096
#: Rows an output batch may hold, and bytes of text after which one is sent.
BATCH_ROWS, BATCH_BYTES = 5_000, 8 << 20

NEVER = 1 << 60
# States: nothing yet, after system, after user, after assistant.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
GONE = 0  # symbol of a row that must go; others are 1 + 2 * class + truncated
CLASSES = "sua"


def _next(state: int, initial: str) -> int | None:
    """State after a row with this role initial; None where the order does not allow it."""
    if initial == "s":
        return AFTER_S if state == START else None
    if initial == "u":
        return AFTER_U if state != AFTER_U else None
    if initial == "a":
        return AFTER_A if state == AFTER_U else None
    return None


def _wanted(state: int) -> str:
    """The initial that an inserted or re-roled row must have."""
    return "a" if state == AFTER_U else "u"


def _choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of the edits that use the row up, in ASCII order."""
    out = [("D", DELETE, state)]
    if symbol == GONE:
        return out
    kind, late = divmod(symbol - 1, 2)
    extra = TRUNCATED * late
    kept = _next(state, CLASSES[kind]) if kind < len(CLASSES) else None
    if kept is not None:
        out.append(("K", KEEP + extra, kept))
    out.append(("R", REROLE + extra, _next(state, _wanted(state))))
    return out


def _times(a: tuple, b: tuple) -> tuple:
    """Min-plus product."""
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


def _apply(a: tuple, v: tuple) -> tuple:
    return tuple(min(a[i][k] + v[k] for k in STATES) for i in STATES)


def _inserts() -> tuple:
    """Cheapest inserts between two states: closure of one insert."""
    one = [[0 if i == j else NEVER for j in STATES] for i in STATES]
    for i in STATES:
        one[i][_next(i, _wanted(i))] = INSERT
    one = tuple(map(tuple, one))
    return _times(one, one)  # an order never needs more than two


IDENTITY = tuple(tuple(0 if i == j else NEVER for j in STATES) for i in STATES)
INSERTS = _inserts()
#: Cost of ending from each state: nothing, or whole pairs only.
LAST = _apply(INSERTS, (0, NEVER, NEVER, 0))


@lru_cache(maxsize=None)
def _power(symbol: int, log2: int) -> tuple:
    """Matrix of 2^log2 rows of one symbol, inserts before each row included."""
    if log2:
        half = _power(symbol, log2 - 1)
        return _times(half, half)
    step = [[NEVER] * 4 for _ in STATES]
    for i in STATES:
        for _, cost, j in _choices(symbol, i):
            step[i][j] = min(step[i][j], cost)
    return _times(INSERTS, tuple(map(tuple, step)))


def _run_matrix(symbol: int, n: int) -> tuple:
    out = IDENTITY
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = _times(out, _power(symbol, k))
    return out


def _run_apply(symbol: int, n: int, v: tuple) -> tuple:
    for k in range(n.bit_length()):
        if n >> k & 1:
            v = _apply(_power(symbol, k), v)
    return v


class _Path:
    """State of one conversation while its pieces are unrolled."""

    def __init__(self):
        self.state, self.cost = START, 0

    def piece(self, symbols: list[int], counts: list[int], end: tuple) -> Iterator[tuple[str, str, int]]:
        """(edit, role initial, symbol) in order, cheapest and then ASCII-least."""
        after = [end]
        for s, n in zip(symbols[:0:-1], counts[:0:-1]):
            after.append(_run_apply(s, n, after[-1]))
        for s, n in zip(symbols, counts):
            end = after.pop()
            for left in range(n - 1, -1, -1):
                yield from self._row(s, _run_apply(s, left, end))

    def _row(self, symbol: int, after: tuple):
        before = _apply(_power(symbol, 0), after)
        edit = "I"
        while edit == "I":
            q = self.state
            edits = _choices(symbol, q)
            inserted = _next(q, _wanted(q))
            edits.insert(1, ("I", INSERT, inserted))
            for edit, cost, to in edits:
                if cost + (before if edit == "I" else after)[to] == before[q]:
                    break
            self.state, self.cost = to, self.cost + cost
            yield edit, "" if edit in "DK" else _wanted(q), symbol

    def tail(self) -> Iterator[tuple[str, str, int]]:
        while self.state not in (START, AFTER_A):
            role = _wanted(self.state)
            self.state, self.cost = _next(self.state, role), self.cost + INSERT
            yield "I", role, GONE


# ------------------------------------------------------------------ narrow side: symbols, runs, pieces
def _blank(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS)) == ""


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """_c, _t, _role, _text, _h1, _h2 (hashes of role and text): nulls as one space."""
    one = F.lit(" ")
    return df.select(
        F.col(f"`{conv}`").alias("_c"), F.col(f"`{turn}`").alias("_t"),
        F.coalesce(F.col(f"`{role}`").cast("string"), one).alias("_role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), one).alias("_text"),
    ).select(
        "*", F.xxhash64("_role", "_text").alias("_h1"), F.xxhash64("_text", F.lit(1), "_role").alias("_h2")
    )


def _symbols(rows: DataFrame) -> DataFrame:
    """_c, _t, _h1, _h2, _symbol, _fault (1 blank, 2 seen in an earlier turn, 3 truncated, 0 none)."""
    initial = F.substring("_role", 1, 1)
    kind = F.lit(len(CLASSES))
    for i, c in enumerate(CLASSES):
        kind = F.when(initial == c, i).otherwise(kind)
    last = F.substring(F.rtrim(F.col("_text"), F.lit(BLANKS)), -1, 1)
    narrow = rows.select(
        "_c", "_t", "_h1", "_h2", kind.alias("_kind"), _blank(F.col("_text")).alias("_blank"),
        (~last.isin(*ENDS)).alias("_late"),
    )
    # texts that come in more than one turn, with the first of them (equal rows of one turn are neighbours)
    place = F.struct(F.col("_t").isNotNull().alias("known"), F.col("_t").alias("t"))
    seen = narrow.groupBy("_c", "_h1", "_h2").agg(F.min(place).alias("_first"), F.max(place).alias("_final"))
    seen = seen.where("_first < _final").select(
        F.col("_c").alias("_c2"), F.col("_h1").alias("_g1"), F.col("_h2").alias("_g2"), "_first"
    )
    same = F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2"))
    repeated = F.coalesce(F.col("_first") < place, F.lit(False))
    fault = F.when(F.col("_blank"), 1).when(repeated, 2).when(F.col("_late"), 3).otherwise(0)
    symbol = F.when(fault.isin(1, 2), GONE).otherwise(1 + 2 * F.col("_kind") + F.col("_late").cast("int"))
    return narrow.join(seen, same, "left").select(
        "_c", "_t", "_h1", "_h2", symbol.cast("int").alias("_symbol"), fault.cast("int").alias("_fault")
    )


def _pieces(symbols: DataFrame) -> DataFrame:
    """Runs of neighbouring equal symbols, ``PIECE`` of them a row, with counts of faults and their matrix."""
    schema = T.StructType(
        [symbols.schema[c] for c in ("_c", "_t", "_h1", "_h2")]
        + [T.StructField("_symbols", T.ArrayType(T.IntegerType())), T.StructField("_counts", T.ArrayType(T.LongType())),
           T.StructField("_faults", T.ArrayType(T.LongType())), T.StructField("_matrix", T.ArrayType(T.LongType()))]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, before, piece, out = None, None, None, []

        def close():
            if piece is not None:
                product = IDENTITY
                for s, n in zip(piece[4], piece[5]):
                    product = _times(product, _run_matrix(s, n))
                flat = [min(x, NEVER) for r in product for x in r]
                out.append((*piece, flat))

        for batch in batches:
            for c, t, h1, h2, s, fault in zip(*(col.to_pylist() for col in batch.columns)):
                here = (c, t, h1, h2)
                if here == before:  # the same row again, in the same turn
                    s, fault = (GONE, 2) if fault != 1 else (s, fault)
                if piece is None or c != conv or (len(piece[4]) >= PIECE and piece[4][-1] != s):
                    close()
                    piece = [*here, [], [], [0, 0, 0]]
                if piece[4] and piece[4][-1] == s:
                    piece[5][-1] += 1
                else:
                    piece[4].append(s)
                    piece[5].append(1)
                if fault:
                    piece[6][fault - 1] += 1
                conv, before = c, here
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)

    order = ["_c", "_t", "_h1", "_h2"]
    return symbols.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _ends(pieces: DataFrame) -> DataFrame:
    """Adds _end: cost of the best way on from each state after the piece (pieces read back to front)."""
    keep = [c for c in pieces.columns if c != "_matrix"]
    schema = T.StructType([pieces.schema[c] for c in keep] + [T.StructField("_end", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, value, opened = None, LAST, False
        for batch in batches:
            ends = []
            for c, flat in zip(batch.column("_c").to_pylist(), batch.column("_matrix").to_pylist()):
                if not opened or c != conv:
                    conv, value, opened = c, LAST, True
                ends.append(list(value))
                value = _apply(tuple(tuple(flat[4 * i : 4 * i + 4]) for i in STATES), value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(ends, pa.list_(pa.int64()))], names=[*keep, "_end"]
            )

    back = [F.desc("_t"), F.desc("_h1"), F.desc("_h2")]
    return pieces.repartition("_c").sortWithinPartitions("_c", *back).mapInArrow(run, schema)


# ------------------------------------------------------------------ edits applied while the rows stream by
def _stream(df: DataFrame, ids: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Conversation ids (0), pieces (1) and rows (2) in conversation and turn order."""
    rows = _rows(df, conv, turn, role, text)
    pieces = _ends(materialize(_pieces(_symbols(rows))))
    marks = ids.select(F.col(f"`{conv}`").alias("_c")).distinct().withColumn("_what", F.lit(0))
    together = (
        rows.withColumn("_what", F.lit(2))
        .unionByName(pieces.withColumn("_what", F.lit(1)), allowMissingColumns=True)
        .unionByName(marks, allowMissingColumns=True)
        .withColumn("_inside", (F.col("_what") > 0).cast("int"))
    )
    return together.repartition("_c").sortWithinPartitions("_c", "_inside", "_t", "_h1", "_h2", "_what")


class _Conversation:
    """Running facts of one conversation: edits so far, gaps, faults, illegal neighbours."""

    def __init__(self, conv):
        self.conv, self.path, self.edits = conv, _Path(), iter(())
        self.faults, self.illegal, self.initial = [0, 0, 0], 0, None
        self.low = self.high = self.turn = None
        self.turns = 0

    def header(self, symbols, counts, faults, end):
        self.edits = self.path.piece(symbols, counts, tuple(end))
        self.faults = [a + b for a, b in zip(self.faults, faults)]

    def row(self, turn, role: str, text: str) -> Iterator[tuple]:
        """(edit, role, text, turn, fault) of the edits up to and with this row."""
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.turn:
            self.turn, self.turns = turn, self.turns + 1
            self.low, self.high = turn if self.low is None else self.low, turn
        for edit, wanted, symbol in self.edits:
            name = USER if wanted == "u" else ASSISTANT
            if edit == "I":
                yield edit, name, "", None, None
                continue
            if symbol == GONE:
                fault = "blank" if not text.strip(BLANKS) else "duplicate"
            else:
                fault = "truncated" if (symbol - 1) % 2 else None
            yield edit, name if edit == "R" else role, text, turn, fault
            return

    def end(self) -> Iterator[tuple]:
        for edit, wanted, _ in self.path.tail():
            yield edit, USER if wanted == "u" else ASSISTANT, "", None, None

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _events(batches: Iterator[pa.RecordBatch]):
    """(conversation, edit) pairs; edit None closes the conversation."""
    one = None
    for batch in batches:
        col = {n: batch.column(n) for n in batch.schema.names}
        what, convs = col["_what"].to_pylist(), col["_c"].to_pylist()
        turns, roles, texts = col["_t"].to_pylist(), col["_role"].to_pylist(), col["_text"].to_pylist()
        for i, kind in enumerate(what):
            if one is None or kind == 0 or convs[i] != one.conv:
                if one is not None:
                    yield from ((one, e) for e in one.end())
                    yield one, None
                one = _Conversation(convs[i])
            if kind == 1:
                one.header(*(col[n][i].as_py() for n in ("_symbols", "_counts", "_faults", "_end")))
            elif kind == 2:
                yield from ((one, e) for e in one.row(turns[i], roles[i], texts[i]))
    if one is not None:
        yield from ((one, e) for e in one.end())
        yield one, None


def _emit(records: Iterator[tuple[tuple, int]], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    out, size = [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)

    for record, n in records:
        out.append(record)
        size += n
        if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield flush()
            out, size = [], 0
    if out:
        yield flush()


def repaired_turns(
    df: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Every edit of the cheapest repair, in order: conversation, seq (from 0), edit, role, text, turn, fault.

    ``edit`` is K (keep), R (new role), D (delete) or I (insert); the repaired conversation is all rows
    but D.  ``fault`` is the row's first of blank, duplicate, truncated, or null.  Costs: keep 0, new
    role 3, delete 4 (always for blank and duplicate rows), insert 3, a truncated row that stays 3; ties
    go to the ASCII-least edit letters.
    """
    ids = df if ids is None else ids
    schema = T.StructType([
        T.StructField(conv, ids.schema[conv].dataType), T.StructField("seq", T.LongType()), T.StructField("edit", T.StringType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("turn", df.schema[turn].dataType), T.StructField("fault", T.StringType()),
    ])

    def run(batches):
        def records():
            seq = 0
            for one, edit in _events(batches):
                if edit is None:
                    seq = 0
                    continue
                letter, name, words, at, fault = edit
                yield (one.conv, seq, letter, name, words, at, fault), len(words)
                seq += 1

        yield from _emit(records(), schema)

    return _stream(df, ids, conv, turn, role, text).mapInArrow(run, schema)


def repair_summary(
    df: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row a conversation of ``ids`` and ``df`` on the repair of ``repaired_turns``:

    gaps (turn numbers missing between the least and the greatest), blank, duplicate, truncated (rows by
    their first fault), illegal (neighbouring role initials other than su, ua, au), cost, audit (the edit
    letters), repaired_sha256 (of ``role:text`` lines of what is left).
    """
    ids = df if ids is None else ids
    schema = T.StructType(
        [T.StructField(conv, ids.schema[conv].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    )

    def run(batches):
        def records():
            letters, digest, empty = bytearray(), hashlib.sha256(), True
            for one, edit in _events(batches):
                if edit is not None:
                    letters += edit[0].encode()
                    if edit[0] != "D":
                        line = f"{edit[1]}:{edit[2]}"
                        digest.update((line if empty else "\n" + line).encode())
                        empty = False
                    continue
                yield (
                    one.conv, one.gaps, *one.faults, one.illegal, one.path.cost, letters.decode(), digest.hexdigest()
                ), len(letters)
                letters, digest, empty = bytearray(), hashlib.sha256(), True

        yield from _emit(records(), schema)

    return _stream(df, ids, conv, turn, role, text).mapInArrow(run, schema)


def damaged(df: DataFrame) -> DataFrame:
    """Conversations damaged by ``crc32(conv_id:turn) % 20``: 0 drops the row, 1 empties its text, 2 takes
    its sentence ends away, 3 gives it twice, 4 makes its role user.  Nulls are written as one space."""
    def spaced(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = df.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
                     (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, USER).otherwise(F.col("role"))
    times = F.when(F.col("_d") == 3, 2).otherwise(1)
    return rows.where("_d <> 0").select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_n")
    ).drop("_n")
