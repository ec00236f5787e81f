"""Conversation structure repair with Four-Russians block tables.

A conversation should read ``(s?(ua)+)?``: perhaps a system turn, then user and
assistant in turns.  Rows are kept (0), given the role that is due (3), deleted
(4; blank and duplicate rows must be), and empty turns are put in (3); a
truncated row that stays costs 3 more.  The cheapest edits win, and of several
cheapest ones the least in ASCII (Delete, Insert, Keep, Rerole).

* A row is one of nine **symbols**: due for deletion, or its role's initial
  (s, u, a, other) with or without truncation.
* The cost of what is still to come is a **vector** over the four states a
  conversation can be in.  Less its smallest entry it is one of few vectors
  (``Tables`` finds them all), so the step over any block of ``BLOCK`` symbols
  is one entry of a table: (vector behind the block, block) -> vector in front
  and the cost in between.
* A conversation is cut into **segments** of ``SEGMENT`` rows at most, wherever
  its rows lie; the cluster keeps them in range partitions, so a conversation
  that holds a third of all rows is spread.  A segment's blocks are looked up for
  every vector that may stand behind it.  Then the segments of a conversation
  are chained from the last to the first, one entry each.
* With the vector behind a segment known, its blocks are expanded **backward**
  into the vectors between symbols, and edits are chosen **forward**: the first
  letter in ASCII that loses nothing.  This is done for each state that may stand
  in front of the segment, and the right one is picked in order.
* Texts are joined to the edits in one sorted stream; of a conversation only its
  edits (a byte a row) are held.  The digest of a whole repaired text has no
  parallel form and runs through its conversation's stream.

Nulls count as one space (a null turn is one for the damage, comes first in
order, and is left out of ``gaps``); a null conv_id is a conversation.  Rows of
one turn stand in order of a digest of role and text, copies next to each other.
Equal rows are duplicates from the second on.  Roles are read by their first
character; an empty role is no role.  A conversation without rows gives zeros
and an empty audit, an empty table no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clarion.llm.common import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after the system, user and assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn with the role that is due.
DUE = (USER, USER, ASSISTANT, USER)
#: Symbols 0-3: role initials s, u, a, other; 4-7: the same, truncated; 8: to be deleted; 9: nothing, fills the last block.
DOOMED, NOTHING, SYMBOLS = 8, 9, 10
BLOCK, SEGMENT = 3, 4_096
BLANKS = " \t\n\x0b\x0c\r"

_SEGMENT = ("conv_id long, part int, seg int, symbols binary, first string, last string, illegal long, blank long, duplicate long, truncated long, "
            "first_turn long, last_turn long, turns long, vectors array<int>, costs array<long>")
_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def kept(state: int, initial: int) -> int | None:
    """The state after a kept row, or None where its role is not allowed."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


class Tables:
    """All normalised vectors, the step over every symbol and block, and the edits to choose."""

    def __init__(self):
        end = self._filled([0, 99, 99, 0])
        self.vectors: list[tuple[int, ...]] = [end]
        number, step, cost, edits = {end: 0}, [], [], []
        at = 0
        while at < len(self.vectors):  # grows until no symbol leads to a new vector
            behind = self.vectors[at]
            rows = [self._step(behind, s) for s in range(SYMBOLS)]
            least = [min(r) for r in rows]
            plain = [tuple(x - m for x in r) for r, m in zip(rows, least)]
            for v in plain:
                if v not in number:
                    number[v] = len(self.vectors)
                    self.vectors.append(v)
            step.append([number[v] for v in plain])
            cost.append(least)
            edits.append([[self._edits(behind, rows[s], s, state) for state in range(4)] for s in range(SYMBOLS)])
            at += 1
        self.step, self.cost, self.edits = np.array(step), np.array(cost), edits
        # blocks: the last symbol is met first, coming from behind
        self.block, self.block_cost = np.arange(len(step))[:, None], np.zeros((len(step), 1), np.int64)
        for _ in range(BLOCK):
            more = self.cost[self.block]  # (vector, block, symbol in front)
            self.block_cost = (self.block_cost[:, :, None] + more).reshape(len(step), -1)
            self.block = self.step[self.block].reshape(len(step), -1)

    @staticmethod
    def _filled(costs: list[int]) -> tuple[int, ...]:
        """Costs with turns put in where that is cheaper."""
        for _ in range(4):
            costs = [min(c, INSERT + costs[DUE[s]]) for s, c in enumerate(costs)]
        return tuple(costs)

    def _actions(self, behind: tuple[int, ...], symbol: int, state: int) -> list[tuple[str, int, int]]:
        """Letter, cost to the end and next state of what can be done with a row."""
        out = [("D", DELETE + behind[state], state)]
        if symbol != DOOMED:
            more = TRUNCATED * (symbol >= 4)
            if (to := kept(state, symbol % 4)) is not None:
                out.append(("K", KEEP + more + behind[to], to))
            out.append(("R", REROLE + more + behind[DUE[state]], DUE[state]))
        return out

    def _step(self, behind: tuple[int, ...], symbol: int) -> tuple[int, ...]:
        if symbol == NOTHING:
            return behind
        return self._filled([min(c for _, c, _ in self._actions(behind, symbol, s)) for s in range(4)])

    def _edits(self, behind: tuple[int, ...], front: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
        """The least letters in ASCII that lose nothing, up to the row's own, and the state after it."""
        if symbol == NOTHING:
            return "", state
        letters = ""
        while True:
            ways = {c: to for c, cost, to in self._actions(behind, symbol, state) if cost == front[state]}
            if INSERT + front[DUE[state]] == front[state]:
                ways["I"] = DUE[state]
            letter = min(ways)
            letters, state = letters + letter, ways[letter]
            if letter != "I":
                return letters, state

    @staticmethod
    def last(state: int) -> str:
        """Turns to put in at the end."""
        return {SYSTEM: "II", USER: "I"}.get(state, "")

    def blocks(self, symbols: bytes) -> np.ndarray:
        s = np.frombuffer(symbols, np.uint8).astype(np.int64)
        s = np.append(s, np.full(-len(s) % BLOCK, NOTHING)).reshape(-1, BLOCK)
        return s @ SYMBOLS ** np.arange(BLOCK)

    def across(self, symbols: bytes) -> tuple[list[int], list[int]]:
        """For every vector behind the symbols: the vector in front and the cost in between."""
        v, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for b in self.blocks(symbols)[::-1]:
            cost += self.block_cost[v, b]
            v = self.block[v, b]
        return v.tolist(), cost.tolist()

    def trace(self, symbols: bytes, behind: int, states: tuple[int, ...]) -> tuple[list[str], list[int]]:
        """The edits of a segment and the state after it, for each state in front of it."""
        ends = [behind]  # vectors behind the blocks, the last block first
        numbers = self.blocks(symbols).tolist()
        for b in numbers[:0:-1]:
            ends.append(int(self.block[ends[-1], b]))
        letters: list[list[str]] = [[] for _ in states]
        now = list(states)
        for at, v in zip(range(0, len(symbols), BLOCK), reversed(ends)):
            block = symbols[at : at + BLOCK]
            inside = [v]
            for s in block[:0:-1]:
                inside.append(int(self.step[inside[-1], s]))
            for s, behind_s in zip(block, reversed(inside)):
                row = self.edits[behind_s][s]
                for i, state in enumerate(now):
                    text, now[i] = row[state]
                    letters[i].append(text)
        return ["".join(x) for x in letters], now


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy (null for a dropped row) of the damaged rows."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    copies = F.when(kind == 0, F.array(F.lit(None).cast("int"))).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def as_rows(conversations: DataFrame) -> DataFrame:
    """The rows as they are, for ``repair``."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", one("role"), one("text"), F.lit(0).alias("copy"))


def _digest() -> Column:
    return F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)


def marks(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest, copy, initial, blank, duplicate, truncated; no texts."""
    body = F.rtrim("text", F.lit(BLANKS))
    read = rows.where(F.col("copy").isNotNull()).select(
        "conv_id", "turn", _digest().alias("digest"), "copy", F.substring("role", 1, 1).alias("initial"),
        (F.length(body) == 0).alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("open"))
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.asc_nulls_first("turn"), "copy")) > 1
    return read.withColumn("again", again).select(
        "conv_id", "turn", "digest", "copy", "initial", "blank", (F.col("again") & ~F.col("blank")).alias("duplicate"),
        (F.col("open") & ~F.col("blank") & ~F.col("again")).alias("truncated"))


def _in_order() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("digest"), F.asc("copy")]


class _Segment:
    def __init__(self, conv, seg: int):
        self.conv, self.seg, self.symbols, self.first, self.last = conv, seg, bytearray(), None, None
        self.illegal = self.blank = self.duplicate = self.truncated = self.turns = 0
        self.first_turn = self.last_turn = None

    def add(self, turn, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if self.last is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.symbols.append(DOOMED if blank or duplicate else "sua".find(initial) % 4 + 4 * truncated if initial else 3 + 4 * truncated)
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn

    def row(self, part: int) -> tuple:
        vectors, costs = tables().across(bytes(self.symbols))
        return (self.conv, part, self.seg, bytes(self.symbols), self.first, self.last, self.illegal, self.blank, self.duplicate, self.truncated,
                self.first_turn, self.last_turn, self.turns, vectors, costs)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
          "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, here, done = TaskContext.get().partitionId(), None, []
    for b in batches:
        for conv, *row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "blank", "duplicate", "truncated"))):
            if here is None or conv != here.conv or len(here.symbols) == SEGMENT:
                if here:
                    done.append(here.row(part))
                here = _Segment(conv, here.seg + 1 if here and here.conv == conv else 0)
                if len(done) >= 1_000:
                    yield _batch(done, _SEGMENT)
                    done = []
            here.add(*row)
    if here:
        yield _batch([*done, here.row(part)], _SEGMENT)


_CHAINED = "conv_id long, part int, seg int, symbols binary, behind int, leads boolean, cost long"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments come from a conversation's last to its first; gives each the vector behind it and the cost from its front."""
    kinds = _KINDS | {"boolean": pa.bool_()}
    names = [f.split(" ") for f in _CHAINED.split(", ")]
    out: list[tuple] = []
    last, vector, cost = None, 0, 0

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(names)], names=[n for n, _ in names])
    for b in batches:
        for conv, part, seg, symbols, vectors, costs in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "seg", "symbols", "vectors", "costs"))):
            if last and last[0] == conv:
                out.append((*last[:5], False, last[6]))
            else:
                if last:
                    out.append(last)
                vector, cost = 0, 0
            behind, cost, vector = vector, cost + costs[vector], vectors[vector]
            last = (conv, part, seg, symbols, behind, True, cost + tables().vectors[vector][START])
            if len(out) >= 1_000:
                yield made(out)
                out = []
    if last:
        yield made([*out, last])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = "conv_id long, part int, seg int, edits array<string>, exits array<int>, cost long"
    for b in batches:
        rows = []
        for conv, part, seg, symbols, behind, leads, cost in zip(*(b.column(f.split(" ")[0]).to_pylist() for f in _CHAINED.split(", "))):
            edits, exits = tables().trace(symbols, behind, (START,) if leads else tuple(range(4)))
            rows.append((conv, part, seg, edits, exits, cost))
        yield _batch(rows, schema)


_REPAIRED = f"conv_id long, position long, edit string, role string, text string, {_STATS}"


class _Conversation:
    """What is held of the conversation at hand: its edits and figures."""

    def __init__(self, conv):
        self.conv, self.edits, self.state, self.cost = conv, [], START, 0
        self.last = self.last_turn = self.first_turn = None
        self.illegal = self.blank = self.duplicate = self.truncated = self.turns = 0
        self.audit, self.at, self.position = None, 0, 0  # the edits once all are there, and how far they and the turns have come

    def segment(self, s: dict) -> None:
        if not self.edits:
            self.cost = s["cost"]
        i = self.state if len(s["exits"]) == 4 else 0
        self.edits.append(s["edits"][i])
        self.state = s["exits"][i]
        self.illegal += s["illegal"] + (self.last is not None and self.last + s["first"] not in ("su", "ua", "au"))
        self.last = s["last"]
        for c in ("blank", "duplicate", "truncated"):
            setattr(self, c, getattr(self, c) + s[c])
        self.turns += s["turns"] - (s["turns"] > 0 and s["first_turn"] == self.last_turn)
        if s["turns"]:
            self.first_turn = s["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = s["last_turn"]

    def head(self) -> tuple:
        """The conversation's own row; its turns follow."""
        self.audit, self.state = "".join(self.edits) + Tables.last(self.state), START
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return (self.conv, 0, None, None, None, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit)

    def turn(self, own_role: str | None, own_text: str | None) -> Iterator[tuple]:
        """The turns up to a row's own; without a row those at the end."""
        while self.at < len(self.audit):
            edit = self.audit[self.at]
            self.at += 1
            if edit == "D":
                return
            if edit == "K":
                self.state, role = kept(self.state, "sua".find(own_role[:1])), own_role
            else:
                self.state = DUE[self.state]
                role = "assistant" if self.state == ASSISTANT else "user"
            self.position += 1
            yield (self.conv, self.position, edit, role, "" if edit == "I" else own_text, *[None] * 7)
            if edit != "I":
                return


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's segments, then its rows, then what was dropped, in order."""
    here, out, size = None, [], 0
    numbers = [f.split(" ")[0] for f in _SEGMENT.split(", ") if f.split(" ")[0] not in ("conv_id", "part", "seg", "symbols", "vectors", "costs")]

    def ended(c):
        return [*([] if c.audit is not None else [c.head()]), *c.turn(None, None)]
    for b in batches:
        convs, kinds = b.column("conv_id").to_pylist(), b.column("kind").to_pylist()
        for i, (conv, kind) in enumerate(zip(convs, kinds)):
            if here is None or conv != here.conv:
                if here:
                    out += ended(here)
                here = _Conversation(conv)
            if kind == 0:
                here.segment({c: b.column(c)[i].as_py() for c in [*numbers, "edits", "exits", "cost"]})
                continue
            if here.audit is None:
                out.append(here.head())
            if kind == 1:
                text = b.column("text")[i].as_py()
                out += here.turn(b.column("role")[i].as_py(), text)
                size += len(text) + 100
            if size > 1_000_000 or len(out) >= 10_000:
                yield _batch(out, _REPAIRED)
                out, size = [], 0
    if here:
        yield _batch(out + ended(here), _REPAIRED)


def repair(rows: DataFrame) -> DataFrame:
    """Repaired conversations of ``rows`` (``damage`` or ``as_rows``).

    Position 0 has a conversation's figures (gaps, blank, duplicate, truncated,
    illegal, cost, audit); positions from 1 its turns with role, text and edit.
    Rows of a conversation stand together and in order within a partition.
    """
    marked = stored(marks(rows), "marks")
    ranged = marked.repartitionByRange(*_in_order()).sortWithinPartitions(*_in_order())
    segments = stored(ranged.mapInArrow(_segments, _SEGMENT), "segments")
    last_first = segments.select("conv_id", "part", "seg", "symbols", "vectors", "costs").repartition("conv_id").sortWithinPartitions(
        "conv_id", F.desc("part"), F.desc("seg"))
    chained = last_first.mapInArrow(_chain, _CHAINED).repartition("conv_id", "part", "seg")
    traced = chained.mapInArrow(_traced, "conv_id long, part int, seg int, edits array<string>, exits array<int>, cost long")
    same = (F.col("t.conv_id").eqNullSafe(F.col("s.conv_id"))) & (F.col("t.part") == F.col("s.part")) & (F.col("t.seg") == F.col("s.seg"))
    plan = traced.alias("t").join(segments.drop("symbols", "vectors", "costs").alias("s"), same).select("t.*", *[
        f"s.{c}" for c in segments.columns if c not in ("conv_id", "part", "seg", "symbols", "vectors", "costs")])
    texts = rows.select("conv_id", F.when(F.col("copy").isNull(), 2).otherwise(1).alias("kind"), "turn", _digest().alias("digest"), "copy", "role",
                        F.when(F.col("copy").isNotNull(), F.col("text")).alias("text"))
    both = plan.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), "kind", "part", "seg", *_in_order()[1:]).mapInArrow(_applied, _REPAIRED)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = f"conv_id long, {_STATS}, repaired_sha256 string"
    head, sha, out = None, None, []
    for b in batches:
        position, role, text = b.column("position").to_pylist(), b.column("role"), b.column("text")
        for i, at in enumerate(position):
            if at == 0:
                if head:
                    out.append((*head, sha.hexdigest()))
                head, sha = tuple(b.column(f.split(" ")[0])[i].as_py() for f in schema.split(", ")[:-1]), hashlib.sha256()
            else:
                sha.update(b"\n" * (at > 1) + role[i].as_buffer().to_pybytes() + b":")
                sha.update(text[i].as_buffer())
        if len(out) >= 1_000:
            yield _batch(out, schema)
            out = []
    if head:
        yield _batch([*out, (*head, sha.hexdigest())], schema)


def digest(repaired: DataFrame) -> DataFrame:
    """A row per conversation: its figures, edits and the SHA-256 of its repaired ``role:text`` lines."""
    return repaired.mapInArrow(_hashed, f"conv_id long, {_STATS}, repaired_sha256 string").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
