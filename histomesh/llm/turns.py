"""Repair of conversation structure by the auction algorithm for shortest paths.

A conversation's rows in order and the role expected next make a lattice: keeping a row,
giving it a role, deleting it, or inserting a turn are its arcs, with whole-number costs. The
cheapest edits that leave ``(system)? (user assistant)+``, or nothing, are a shortest path.
It is found by auction: every node has a price, never above an arc's cost plus the price at
its end; a path grows from the origin along arcs that meet this bound with equality, and
where none does it raises its last node's price and draws back. Prices start from what each
remaining row costs at least. Once the path ends, prices are dual optimal: every arc of every
cheapest path is tight, and the ASCII-least edits are read off the tight arcs.

Work in Spark: rows without their texts (a digest instead) are sorted by range; runs of up to
128 of a conversation become one piece, wherever a task or a conversation is cut. Prices of a
piece's ends are carried back over the pieces, edits of every piece are traced for each role
it may start with, and one pass forward picks them. So a conversation with a third of all
rows is solved in pieces on many tasks, and only its prices, a few numbers a piece, pass
through one. Texts are shuffled once, at the end, to be repaired as streams; a digest of one
conversation's repaired text is a stream by nature, held by one task, one row at a time.

Null roles and texts are one space; null conversations are one conversation. Rows go by turn, nulls
first, then role and the digest of the text. Equal rows at one turn are one row with copies. A
conversation without rows left gets zeros and empty results. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomesh.lineage import cut
from histomesh.llm.frames import pick

# Costs of the edits, the extra cost of a truncated row that stays, roles that can be given.
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
USER, ASSISTANT = "user", "assistant"

PIECE = 128
START, SYSTEM, HUMAN, MACHINE = range(4)
CLOSING = (0, None, None, 0)
ORDER = ("turn", "role", "digest")


def _after(state: int) -> int:
    """The role that a given or inserted turn takes: assistants follow users, users all others."""
    return MACHINE if state == HUMAN else HUMAN


def _kept(code: int, state: int) -> int | None:
    """The state after keeping a row with this code, if that is allowed."""
    initial = code & 3
    if initial == SYSTEM:
        return SYSTEM if state == START else None
    return initial if initial == _after(state) else None


def lattice(codes: bytes, exits: tuple, closing: bool) -> tuple[list, list]:
    """Arcs ``(edit, cost, node)`` of every node, and prices to start from.

    A code has the initial's state in its low bits (0: any other role), 4 for a row that has to
    go and 8 for a truncated one. Node ``4 * i + state`` stands before row i; the last is the
    end, reached from ``exits`` at their costs. Turns may be inserted before each row, and
    behind the last one if the piece closes its conversation.
    """
    end = 4 * (len(codes) + 1)
    arcs = [[] for _ in range(end)] + [[]]
    prices = [0] * (end + 1)
    for i, code in enumerate(codes):
        stays = TRUNCATED if code & 8 else 0
        for state in range(4):
            out, ahead = arcs[4 * i + state], 4 * (i + 1)
            out.append(("D", DELETE, ahead + state))
            out.append(("I", INSERT, 4 * i + _after(state)))
            if not code & 4:
                to = _kept(code, state)
                if to is not None:
                    out.append(("K", stays, ahead + to))
                out.append(("R", RELABEL + stays, ahead + _after(state)))
    for state in range(4):
        out = arcs[end - 4 + state]
        if closing:
            out.append(("I", INSERT, end - 4 + _after(state)))
        if exits[state] is not None:
            out.append(("", exits[state], end))
    left = 0 if closing else min(cost for cost in exits if cost is not None)
    for i in range(len(codes), -1, -1):
        if i < len(codes):
            left += DELETE if codes[i] & 4 else TRUNCATED if codes[i] & 8 else 0
        prices[4 * i : 4 * i + 4] = [left] * 4
    return arcs, prices


def auction(arcs: list, prices: list, origin: int) -> int:
    """Raises ``prices`` until the path from ``origin`` reaches the last node; returns its length.

    Prices stay feasible, so further origins may follow with what is already known. The end's
    price stays 0. Every node must have a way to the end.
    """
    end, path = len(arcs) - 1, [origin]
    while path[-1] != end:
        at = path[-1]
        best, to = min((cost + prices[node], node) for _, cost, node in arcs[at])
        if prices[at] < best:
            prices[at] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    return prices[origin]


def trace(arcs: list, prices: list, origin: int) -> tuple[str, int]:
    """The ASCII-least edits along tight arcs from ``origin`` to the end, and the state they end in."""
    end, dead = len(arcs) - 1, set()
    path, labels, open_ = [origin], [], [iter(arcs[origin])]
    while path[-1] != end:
        at = path[-1]
        for label, cost, node in open_[-1]:
            if cost + prices[node] == prices[at] and node not in dead:
                path.append(node)
                labels.append(label)
                open_.append(iter(arcs[node]))
                break
        else:
            dead.add(path.pop())
            open_.pop()
            labels.pop()
    return "".join(labels), path[-2] % 4


@lru_cache(maxsize=1 << 14)
def prices_before(codes: bytes, exits: tuple, closing: bool) -> tuple:
    """The cheapest cost from every state before a piece, given those behind it."""
    arcs, prices = lattice(codes, exits, closing)
    return tuple(auction(arcs, prices, state) for state in range(4))


@lru_cache(maxsize=1 << 14)
def edits(codes: bytes, exits: tuple, closing: bool, first: bool) -> tuple:
    """(edits, state behind) of a piece for each state before it; only the start for the first."""
    arcs, prices = lattice(codes, exits, closing)
    found = []
    for state in range(1 if first else 4):
        auction(arcs, prices, state)
        found.append(trace(arcs, prices, state))
    return tuple(found)


def repair(initials: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and edits of one short conversation: rows as (initial, has to go, truncated)."""
    codes = bytes(code_of(*row) for row in initials)
    return prices_before(codes, CLOSING, True)[START], edits(codes, CLOSING, True, True)[0][0]


def code_of(initial: str, goes: bool, truncated: bool) -> int:
    return ("?sua".index(initial) if initial in ("s", "u", "a") else 0) | 4 * goes | 8 * truncated


def rows_of(talks: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The four columns as conv, turn, role, text, nulls of the last two one space."""
    read = pick(talks, conv, turn, role, text).toDF("conv", "turn", "role", "text")
    return read.withColumns({"turn": F.col("turn").cast("long")} | {c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def faults(rows: DataFrame) -> DataFrame:
    """Rows without texts, equal ones of a turn together: what is wrong with each.

    ``goes`` is blank or seen before; the first row of its role and text in a conversation has
    not been seen. First turns are found by an aggregation that combines before its shuffle.
    """
    solid = r"[^\x20\x09-\x0D]"
    light = rows.select(
        "conv", "turn", "role", digest(F.col("text")).alias("digest"),
        (~F.col("text").rlike(solid)).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    )
    light = light.groupBy(*light.columns).agg(F.count(F.lit(1)).alias("copies"))
    key = ["conv", "role", "digest"]
    never = F.max(F.col("turn").isNull())
    firsts = light.groupBy(*[F.col(c).alias(f"{c}_1") for c in key]).agg(never.alias("never"), F.min("turn").alias("turn_1"))
    same = F.col("conv").eqNullSafe(F.col("conv_1")) & (F.col("role") == F.col("role_1")) & (F.col("digest") == F.col("digest_1"))
    first = F.when(F.col("never"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("turn_1"))
    return light.join(firsts, same).select("conv", *ORDER, "blank", "truncated", "copies", (~first).alias("repeated"))


FACTS = "first_initial string, last_initial string, first_turn long, last_turn long, n_turns long, blank long, duplicate long, truncated long, illegal long"


class Facts:
    """What a stretch of a conversation adds to its report; stretches are added up in order."""

    NAMES = [field.split(" ")[0] for field in FACTS.split(", ")]

    def __init__(self, values=None):
        self.first_initial = self.last_initial = self.first_turn = self.last_turn = None
        self.n_turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        for name, value in zip(self.NAMES, values or (), strict=bool(values)):
            setattr(self, name, value)

    def add(self, other: Facts) -> None:
        if self.first_initial is None:
            self.first_initial = other.first_initial
        elif other.first_initial is not None and self.last_initial + other.first_initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = self.last_initial if other.last_initial is None else other.last_initial
        if other.first_turn is not None:
            self.n_turns += other.n_turns - (self.last_turn == other.first_turn)
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))

    def values(self) -> list:
        return [getattr(self, name) for name in self.NAMES]

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.n_turns


def of_row(initial: str, turn: int | None, blank: bool, repeated: bool, truncated: bool, copies: int) -> tuple[Facts, list[tuple[int, int]]]:
    """Facts and (code, how often) of a row with its copies, which all but the first repeat it."""
    goes = blank or repeated
    illegal = 0 if initial + initial in ("su", "ua", "au") else copies - 1
    counts = (copies, 0, 0) if blank else (0, copies, 0) if repeated else (0, copies - 1, int(truncated))
    own = Facts([initial, initial, turn, turn, int(turn is not None), *counts, illegal])
    runs = [(code_of(initial, goes, truncated and not goes), 1)]
    return own, runs + [(code_of(initial, True, False), copies - 1)] * (copies > 1)


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]):
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096):
    """Arrow batches of rows as they come."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """``function`` over the rows of each partition in order; ``conv`` keeps its type."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = df.schema["conv"].dataType.simpleString()
    wanted = f"conv {kind}, {schema}"
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], wanted).schema)
    columns = df.columns

    def run(batches):
        yield from _batches(function(_rows(batches, columns)), arrow)

    return df.mapInArrow(run, wanted)


def pieces(rows: DataFrame, most: int = PIECE) -> DataFrame:
    """Conversations in pieces of ``most`` codes, or one more: (conv, place, codes, copies, facts).

    Copies beyond a row's first only repeat a code, so a piece holds (code, how often).
    ``place`` rises in the order of the rows.
    """
    ordered = rows.repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    ordered = ordered.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "repeated", "truncated", "copies")

    def cut_up(rows):
        place = (TaskContext.get().partitionId() << 33) - 1
        codes, copies, facts, now = bytearray(), [], Facts(), None

        def piece():
            nonlocal place
            place += 1
            return (now, place, bytes(codes), copies, *facts.values())

        for conv, turn, *row in rows:
            if codes and (conv != now or len(codes) >= most):
                yield piece()
                codes, copies, facts = bytearray(), [], Facts()
            now = conv
            initial, blank, repeated, truncated, n = row
            own, runs = of_row(initial, turn, blank, repeated, truncated, n)
            facts.add(own)
            for code, often in runs:
                codes.append(code)
                copies.append(often)
        if codes:
            yield piece()

    return _mapped(ordered, cut_up, f"place long, codes binary, copies array<long>, {FACTS}")


def _lengthened(codes: bytes, copies: list[int], labels: str) -> str:
    """Edits of runs as edits of rows; only rows that have to go have copies."""
    out, i = [], 0
    for label in labels:
        if label == "I":
            out.append(label)
        else:
            out.append(label * copies[i])
            i += 1
    return "".join(out)


def solved(cut_pieces: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation with rows."""

    def back(rows):
        now, behind = [], None
        for conv, place, codes, copies, *facts in rows:
            closing = [conv] != now
            now, exits = [conv], CLOSING if [conv] != now else behind
            own = exits if not closing else CLOSING
            extra = DELETE * (sum(copies) - len(copies))
            cost = prices_before(codes, own, closing)
            behind = tuple(c + extra for c in cost)
            yield (conv, place, codes, copies, *facts, closing, [-1 if c is None else c for c in own], behind[START])

    def traced(rows):
        for conv, place, codes, copies, *facts, closing, exits, cost, first in rows:
            own = tuple(None if c < 0 else c for c in exits)
            found = edits(codes, own, closing, first)
            yield (conv, place, *facts, cost, first, [_lengthened(codes, copies, e) for e, _ in found], [s for _, s in found])

    def forward(rows):
        now, facts, cost, audit, state = [], None, 0, [], START

        def report():
            return (now[0], facts.gaps, facts.blank, facts.duplicate, facts.truncated, facts.illegal, cost, "".join(audit))

        for conv, _, *values, least, first, choices, states in rows:
            if [conv] != now:
                if now:
                    yield report()
                now, facts, cost, audit, state = [conv], Facts(), least, [], START
            facts.add(Facts(values))
            audit.append(choices[state])
            state = states[state]
        if now:
            yield report()

    base = f"place long, codes binary, copies array<long>, {FACTS}"
    priced = _mapped(cut_pieces.repartition("conv").sortWithinPartitions("conv", F.desc("place")), back, f"{base}, closing boolean, exits array<long>, cost long")
    leads = cut_pieces.groupBy(F.col("conv").alias("conv_1")).agg(F.min("place").alias("lead"))
    priced = cut(priced)
    marked = priced.join(leads, F.col("conv").eqNullSafe(F.col("conv_1"))).select("conv", *priced.columns[1:], (F.col("place") == F.col("lead")).alias("first"))
    chosen = _mapped(marked, traced, f"place long, {FACTS}, cost long, first boolean, choices array<string>, states array<int>")
    chosen = chosen.repartition("conv").sortWithinPartitions("conv", "place")
    return _mapped(chosen, forward, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


RESULTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def mended(audit: str, rows: Iterator[tuple[str, str]]):
    """(edit, role, text) of a repaired conversation from its edits and its rows in order."""
    state, rows = START, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = _kept(code_of(role[:1], False, False), state)
        else:
            state = _after(state)
            role = USER if state == HUMAN else ASSISTANT
        yield edit, role, text


def _talks(rows):
    """(report, its rows) of every conversation of a stream with a report before its rows."""
    ahead = next(rows, None)
    while ahead is not None:
        report, held = ahead, [None]

        def own():
            for row in rows:
                if row[1] == 0:
                    held[0] = row
                    return
                yield row[2:4]

        texts = own()
        yield report, texts
        for _ in texts:
            pass
        ahead = held[0]


def _streamed(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Each conversation's report followed by its rows, by one shuffle of the texts."""
    results = [F.col(name) for name in RESULTS]
    none = [F.lit(None).cast(reports.schema[name].dataType).alias(name) for name in RESULTS]
    texts = rows.select("conv", F.lit(1).alias("kind"), "role", "text", "turn", digest(F.col("text")).alias("digest"), *none)
    heads = reports.select(
        "conv", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), *results,
    )
    both = heads.union(texts).repartition("conv").sortWithinPartitions("conv", "kind", *ORDER)
    return both.select("conv", "kind", "role", "text", *RESULTS)


def reports(rows: DataFrame, ids: DataFrame, piece: int = PIECE) -> DataFrame:
    """One report per distinct ``conv`` of ``ids``, zeros and no edits where ``rows`` has none of it."""
    found = solved(cut(pieces(faults(rows), piece))).withColumnRenamed("conv", "conv_1")
    every = ids.select("conv").distinct().join(found, F.col("conv").eqNullSafe(F.col("conv_1")), "left")
    zeros = [F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in RESULTS[:-1]]
    return cut(every.select("conv", *zeros, F.coalesce("audit", F.lit("")).alias("audit")))


def repaired_rows(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE) -> DataFrame:
    """The repaired conversations: conv, nth (from 0), edit (K, R or I), role, text."""
    rows = rows_of(talks, conv, turn, role, text)

    def write(stream):
        for report, texts in _talks(stream):
            for nth, (edit, own_role, own_text) in enumerate(mended(report[-1], texts)):
                yield (report[0], nth, edit, own_role, own_text)

    found = _mapped(_streamed(rows, reports(rows, rows, piece)), write, "nth long, edit string, role string, text string")
    return found.withColumnRenamed("conv", conv)


def repaired_digests(talks: DataFrame, ids: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE) -> DataFrame:
    """Every conversation of ``ids`` with its report and ``repaired_sha256`` of its ``role:text`` lines."""
    rows = rows_of(talks, conv, turn, role, text)
    ids = pick(ids, conv).toDF("conv")

    def hashed(stream):
        for report, texts in _talks(stream):
            whole, between = hashlib.sha256(), b""
            for _, own_role, own_text in mended(report[-1], texts):
                whole.update(between + f"{own_role}:{own_text}".encode())
                between = b"\n"
            yield (report[0], *report[4:], whole.hexdigest())

    kinds = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _mapped(_streamed(rows, reports(rows, ids, piece)), hashed, kinds).withColumnRenamed("conv", conv)


def damaged(talks: DataFrame) -> DataFrame:
    """``conversations`` with faults planted by the hash of (conv_id, turn); nulls are one space.

    0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 gives it to the user.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    fate = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        pick(talks, "conv_id", "turn", "role", "text")
        .withColumn("fate", fate)
        .filter("fate <> 0")
        .select("conv_id", "turn", F.when(F.col("fate") == 4, USER).otherwise(role).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
        .drop("copy")
    )
