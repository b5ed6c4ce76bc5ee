"""Repair of conversations: the cheapest edits that make role initials match ``(s?(ua)+)?``.

A row is a symbol (role, fault), and its edits with the inserts before it are a min-plus transition of the four states
below. Equal consecutive symbols are one run, which a vector of costs passes through binary powers
of the transition; the choices are then unrolled from the costs, the letters that come first in ASCII before others.

Rows are put in order by a sort over all partitions. A conversation that lies in one partition is worked off at once; of one that is cut
by borders, each piece is first reduced to its matrix, then the pieces' costs and states are scanned (a row for
each piece), so that no conversation, however long, needs its rows in one task for its edits.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import stored

BROADCAST_ROWS = 50_000
NONE = 1 << 60  # the cost of what is not possible
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs; the last is for a truncated row that stays
FAULTS = ["ok", "blank", "duplicate", "truncated"]

# States by the roles so far: none, system, user (last), assistant (last). The first and the last may end.
TAKES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}  # what an insert or a new role gives
END = (0, 2 * INSERT, INSERT, 0)  # cost of the inserts that end a conversation
Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(NONE, *(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def through(m: Matrix, v: Vector) -> Vector:
    """Costs before the rows of ``m`` from the costs after them."""
    return tuple(min(NONE, *(m[i][k] + v[k] for k in range(4))) for i in range(4))


def _inserts() -> Matrix:
    one = tuple(tuple(0 if i == j else INSERT if WANTED[i][1] == j else NONE for j in range(4)) for i in range(4))
    return product(product(one, one), one)


INSERTS = _inserts()
UNIT: Matrix = tuple(tuple(0 if i == j else NONE for j in range(4)) for i in range(4))


def edits_of(symbol: tuple[str, str], state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row, without inserts, in ASCII order."""
    role, fault = symbol
    out = [("D", DELETE, state)]
    if fault in ("ok", "truncated"):
        more = TRUNCATED if fault == "truncated" else 0
        if (state, role) in TAKES:
            out.append(("K", KEEP + more, TAKES[state, role]))
        out.append(("R", REROLE + more, WANTED[state][1]))
    return out


@functools.cache
def power(symbol: tuple[str, str], k: int) -> Matrix:
    """The transition of ``2 ** k`` rows of a symbol."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    rows = [[NONE] * 4 for _ in range(4)]
    for i in range(4):
        for _, cost, j in edits_of(symbol, i):
            rows[i][j] = min(rows[i][j], cost)
    return product(INSERTS, tuple(map(tuple, rows)))


def run_matrix(symbol: tuple[str, str], n: int) -> Matrix:
    m = UNIT
    for k in range(n.bit_length()):
        if n >> k & 1:
            m = product(power(symbol, k), m)
    return m


def before_run(symbol: tuple[str, str], n: int, v: Vector) -> Vector:
    for k in range(n.bit_length()):
        if n >> k & 1:
            v = through(power(symbol, k), v)
    return v


def runs_of(symbols: Iterable[tuple[tuple[str, str], int]]) -> list[tuple[tuple[str, str], int, int]]:
    """(symbol, rows, entries) of the runs of (symbol, copies)."""
    out = []
    for symbol, group in groupby(symbols, key=lambda x: x[0]):
        copies = [n for _, n in group]
        out.append((symbol, sum(copies), len(copies)))
    return out


def unroll(symbols: list[tuple[tuple[str, str], int]], after: Vector, state: int) -> tuple[list[str], int]:
    """For each entry of (symbol, copies) its letters (inserts before its edit; one letter stands for all copies), and the last state.

    ``after`` are the costs of what follows the entries. Only entries that must go have copies.
    """
    runs = runs_of(symbols)
    ends = [after]  # costs after each run, from the last
    for symbol, n, _ in reversed(runs):
        ends.append(before_run(symbol, n, ends[-1]))
    ends.reverse()
    letters: list[str] = []
    for r, (symbol, _, entries) in enumerate(runs):
        if symbol[1] in ("blank", "duplicate"):
            letters += ["D"] * entries  # a needed insert is no dearer after them, and D comes first
            continue
        steps = [ends[r + 1]]  # costs after each row of the run, from the last
        for _ in range(entries):
            steps.append(through(power(symbol, 0), steps[-1]))
        for here, then in zip(reversed(steps[1:]), reversed(steps[:-1])):
            row = ""
            while not row or row[-1] == "I":
                left = here[state]
                options = edits_of(symbol, state)
                options.insert(1, ("I", INSERT, WANTED[state][1]))  # after D, before K
                letter, state = next(
                    (c, to) for c, cost, to in options if cost + (here if c == "I" else then)[to] == left
                )
                row += letter
            letters.append(row)
    return letters, state


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and copies (0 to 2): rows with the faults that crc32 of ``conv:turn`` gives them."""
    kind = F.crc32(F.concat(_text(F.col(conv)), F.lit(":"), _text(F.col(turn)))) % 20
    body = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(_text(F.col(text)), "[.!?]", "")).otherwise(_text(F.col(text)))
    return conversations.select(
        F.col(conv), F.col(turn), F.when(kind == 4, "user").otherwise(_text(F.col(role))).alias(role), body.alias(text),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def faulty(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """_conv, _name, turn, role, text, _digest, fault and n, an entry for equal rows of one fault.

    Equal rows of one turn are counted before the shuffle. A row is a duplicate if its role and text stand at an earlier turn, or
    if it is not the first of its equals. Rows with 0 copies stay, without fault, so that their conversation is known.
    """
    name = F.col(conv).cast("string")
    out = rows.select(
        F.coalesce(F.concat(F.lit("="), name), F.lit("-")).alias("_conv"), name.alias("_name"), F.col(turn).alias("turn"),
        _text(F.col(role)).alias("role"), _text(F.col(text)).alias("text"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("n"),
    )
    out = out.groupBy("_conv", "_name", "turn", "role", "text").agg(F.sum("n").alias("n"))
    out = out.withColumn("_digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    again = (
        out.filter("n > 0").groupBy("_conv", "_digest")
        .agg(F.count("*").alias("_turns"), F.max(F.col("turn").isNull()).alias("_null"), F.min("turn").alias("_min"))
        .filter("_turns > 1").drop("_turns")
    )
    again = stored(again, "again")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    out = out.join(again, ["_conv", "_digest"], "left")
    later = F.coalesce(F.when(F.col("_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("_min")), F.lit(False))
    first = (
        F.when(F.col("n") == 0, "absent").when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(later, "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("ok")
    )
    alone = F.col("_fault").isin("ok", "truncated") & (F.col("n") > 1)
    entry = lambda fault, n: F.struct(fault.alias("fault"), n.cast("long").alias("n"))
    entries = F.when(
        alone, F.array(entry(F.col("_fault"), F.lit(1)), entry(F.lit("duplicate"), F.col("n") - 1))
    ).otherwise(F.array(entry(F.col("_fault"), F.col("n"))))
    out = out.withColumn("_fault", first).select("_conv", "_name", "turn", "role", "text", "_digest", F.posexplode(entries).alias("_copy", "_e"))
    return out.select("_conv", "_name", "turn", "role", "text", "_digest", "_copy", "_e.fault", "_e.n")


def _symbols(fault: Iterable[str], role: Iterable[str], n: Iterable[int]) -> list[tuple[tuple[str, str], int]]:
    return [((r[:1] if r[:1] in ("s", "u", "a") else " ", f), int(k)) for f, r, k in zip(fault, role, n) if f != "absent"]


def _plan(rows: DataFrame) -> DataFrame | None:
    """For each piece of a conversation in several partitions: _conv, _part, _after (costs), _state (at its start) and _last.

    At most two such pieces begin or end in a partition, so the table has no more rows than twice the partitions.
    """
    cut = rows.groupBy("_conv").agg(F.min("_part").alias("_a"), F.max("_part").alias("_b")).filter("_a < _b").select("_conv")
    cut = stored(cut, "cut")
    if cut.isEmpty():
        return None
    pieces = stored(rows.join(F.broadcast(cut), "_conv").select("_conv", "_part", "_id", "role", "fault", "n"), "pieces")

    def reduce_piece(key: tuple, piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values("_id")
        m = UNIT
        for symbol, n, _ in runs_of(_symbols(piece["fault"], piece["role"], piece["n"])):
            m = product(m, run_matrix(symbol, n))
        return pd.DataFrame({"_conv": [key[0]], "_part": [key[1]], "_matrix": [[x for row in m for x in row]]})

    def costs_after(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces, v, out = pieces.sort_values("_part"), END, []
        for flat in reversed(pieces["_matrix"].tolist()):
            out.append(list(v))
            v = through(tuple(tuple(int(x) for x in flat[4 * i:4 * i + 4]) for i in range(4)), v)
        return pd.DataFrame({"_conv": pieces["_conv"], "_part": pieces["_part"], "_after": out[::-1]})

    def state_map(key: tuple, piece: pd.DataFrame, after: pd.DataFrame) -> pd.DataFrame:
        piece, v = piece.sort_values("_id"), tuple(int(x) for x in after["_after"].iloc[0])
        symbols = _symbols(piece["fault"], piece["role"], piece["n"])
        return pd.DataFrame({"_conv": [key[0]], "_part": [key[1]], "_after": [list(v)], "_map": [[unroll(symbols, v, s)[1] for s in range(4)]]})

    def states(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces, state, at = pieces.sort_values("_part"), 0, []
        for to in pieces["_map"]:
            at.append(state)
            state = int(to[state])
        last = [False] * (len(at) - 1) + [True]
        return pd.DataFrame({"_conv": pieces["_conv"], "_part": pieces["_part"], "_after": pieces["_after"], "_state": at, "_last": last})

    matrices = pieces.groupBy("_conv", "_part").applyInPandas(reduce_piece, "_conv string, _part long, _matrix array<long>")
    after = matrices.groupBy("_conv").applyInPandas(costs_after, "_conv string, _part long, _after array<long>")
    maps = pieces.groupBy("_conv", "_part").cogroup(after.groupBy("_conv", "_part")).applyInPandas(
        state_map, "_conv string, _part long, _after array<long>, _map array<int>"
    )
    return stored(maps.groupBy("_conv").applyInPandas(states, "_conv string, _part long, _after array<long>, _state int, _last boolean"), "plan")


EDITS = (
    "_conv string, _name string, _id long, _k int, turn long, initial string, fault string, n long, edit string, cost long, "
    "new_role string, new_text string"
)
_EDIT_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
_EDIT_NAMES = [c.split()[0] for c in EDITS.split(", ")]
STEP_ROWS, STEP_CHARS = 4096, 4 << 20


def _batches(rows: Iterable[tuple], kinds: list, names: list[str], text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded length and text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text] or "") if text is not None else 0
        if len(held) >= STEP_ROWS or size >= STEP_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def _rows(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names))


def _edit_piece(piece: list[tuple]) -> Iterator[tuple]:
    """The rows of ``EDITS`` of one conversation, or of one piece of it."""
    conv, name, after, state, last = *piece[0][:2], *piece[0][9:12]
    after, state, last = tuple(after or END), state or 0, last is not False
    letters, _ = unroll(_symbols((r[5] for r in piece), (r[4] for r in piece), (r[6] for r in piece)), after, state)
    of, at = iter(letters), 0
    for _, _, _, turn, role, fault, n, text, at, *_ in piece:
        start = (conv, name, at)
        if fault == "absent":
            yield (*start, 0, None, None, fault, 0, "", 0, None, None)
            continue
        for k, letter in enumerate(next(of)):
            wanted, to = WANTED[state]
            if letter == "I":
                yield (*start, k, None, None, None, 1, "I", INSERT, wanted, "")
                state = to
                continue
            more = TRUNCATED if fault == "truncated" and letter != "D" else 0
            cost = {"D": DELETE * n, "K": KEEP + more, "R": REROLE + more}[letter]
            new = None if letter == "D" else wanted if letter == "R" else role
            yield (*start, k, turn, role[:1], fault, n, letter, cost, new, None if letter == "D" else text)
            state = to if letter == "R" else TAKES[state, role[:1]] if letter == "K" else state
    k = 9
    while last and state in (1, 2):
        wanted, state = WANTED[state]
        yield (conv, name, at, k, None, None, None, 1, "I", INSERT, wanted, "")
        k += 1


def edits(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None
) -> DataFrame:
    """An entry (``EDITS``) for each row and each insert: its fault, its edit and what it becomes.

    ``n`` counts equal rows that go together. Order within _conv: _id, then _k.
    Rows stand by turn (null first), then role, then a digest of role and text; nulls in role and text count as one space.
    """
    rows = faulty(conversations, conv, turn, role, text, copies)
    order = ["_conv", "turn", "role", "_digest", "_copy"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_digest", "_copy")
    held = stored(ranged.withColumn("_id", F.monotonically_increasing_id()), "turns").withColumn("_part", F.shiftright("_id", 33))
    plan = _plan(held)
    if plan is None:
        none = F.lit(None)
        planned = held.withColumns({"_after": none.cast("array<long>"), "_state": none.cast("int"), "_last": none.cast("boolean")})
    else:
        planned = held.join(F.broadcast(plan), ["_conv", "_part"], "left")
    names = ["_conv", "_name", "_part", "turn", "role", "fault", "n", "text", "_id", "_after", "_state", "_last"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = groupby(_rows(batches, names), key=lambda r: (r[0], r[2]))
        yield from _batches((e for _, piece in pieces for e in _edit_piece(list(piece))), _EDIT_KINDS, _EDIT_NAMES, 11)

    dealt = planned.withColumn("turn", F.col("turn").cast("long")).select(names).repartition(parts, "_conv", "_part")
    return dealt.sortWithinPartitions("_conv", "_id").mapInArrow(run, EDITS)


AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def audits(edited: DataFrame) -> DataFrame:
    """_name and the columns of ``AUDIT`` for each conversation of :func:`edits`.

    The digest of a conversation has to meet its repaired rows in order, so these pass one task as a stream; nothing but the audit is held.
    """
    names = ["_conv", "_name", "turn", "initial", "fault", "n", "edit", "cost", "new_role", "new_text"]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]

    def audit(rows: Iterator[tuple]) -> tuple:
        count = dict.fromkeys(FAULTS, 0)
        name, illegal, total, letters, digest, lines = None, 0, 0, [], hashlib.sha256(), 0
        turns, low, high, before, seen_turn = 0, None, None, None, None
        for _, name, turn, initial, fault, n, edit, cost, new_role, new_text in rows:
            if fault in count:
                count[fault] += n
                illegal += n - 1 + (before is not None and before + initial not in ("su", "ua", "au"))
                before = initial
                if turn is not None:
                    turns += turn != seen_turn
                    low, high, seen_turn = turn if low is None else low, turn, turn
            total += cost
            letters.append(edit * n)
            if new_role is not None:
                digest.update(f"{chr(10) if lines else ''}{new_role}:{new_text}".encode())
                lines += 1
        gaps = 0 if low is None else high - low + 1 - turns
        return (name, gaps, *(count[f] for f in FAULTS[1:]), illegal, total, "".join(letters), digest.hexdigest())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = groupby(_rows(batches, names), key=lambda r: r[0])
        columns = ["_name", *(c.split()[0] for c in AUDIT.split(", "))]
        yield from _batches((audit(g) for _, g in groups), kinds, columns, 7)

    ordered = edited.repartition("_conv").sortWithinPartitions("_conv", "_id", "_k").select(names)
    return ordered.mapInArrow(run, f"_name string, {AUDIT}")


def repair(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None
) -> DataFrame:
    """conv and the columns of ``AUDIT``: faults, cheapest edits and the digest of the repaired conversation.

    ``copies`` names a column of how often a row stands (0: only its conversation counts). A null conversation is one
    of its own; nulls in role and text count as one space; a role that starts with none of s, u and a cannot be kept. Rows that repeat are duplicates of
    the first. Texts of any length are handled one at a time. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    out = audits(edits(conversations, conv, turn, role, text, copies))
    return out.select(F.col("_name").cast(conversations.schema[conv].dataType).alias(conv), *[c.split()[0] for c in AUDIT.split(", ")])
