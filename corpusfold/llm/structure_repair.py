"""Conversation structure repair in one sorted stream per partition.

Rows are dealt by conversation and sorted by turn; a generator behind mapInPandas takes the batches as they come and
carries the state of one conversation from batch to batch. A repaired conversation is empty, or an optional system row and
then pairs of user and assistant; an automaton with four states (nothing yet, after system, after user, after
assistant) reads it. For each state the cheapest edits so far are known by their cost and by the rank of their
spelling among the states, which is all that later rows need: what both sides spell is never compared again.
Costs relative to the least one, together with the ranks, take few values, so a step is a lookup in a table that
fills itself, and the backpointer of a row is the number of a table entry: two bytes. Backpointers and the texts that
the repaired conversation needs once more go to a temporary file of the task when a conversation is giant, and the
file goes with it; the audit, a letter a row, is what stays in memory, being part of the result.

Costs: Keep 0, Rerole to user or assistant 3, Delete 4 (required for blank rows and duplicates), Insert an empty user or
assistant row 3; a truncated row that is not deleted adds 3. Among the cheapest edits those of the least spelling count.

Defined results: a null role or text is one space; turns sort nulls first, and rows of equal turn by role and text; equal
rows are duplicates of the first of them; a null conversation id is a conversation; a conversation whose rows are all gone
is reported with zeros; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfold.session import ship_package, stage

RESULT = (
    "conv string, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
ROWS = "conv string, place long, edit string, role string, text string"
LEGAL = {"su", "ua", "au"}
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INSERT, DELETE, REROLE, TRUNCATED = 3, 4, 3, 3
# the state after one more user or assistant row; only one of both fits each state
_ONWARD = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_KEEPS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
Paths = tuple[tuple[int, int] | None, ...]  # for each state: cost above the least, rank of the spelling


class Steps:
    """The table of steps; an entry holds, for each state after the row, the state before and the letters between."""

    start: Paths = ((0, 0), None, None, None)

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.after: list[Paths] = []
        self.rise: list[int] = []
        self.back: list[tuple] = []

    def take(self, paths: Paths, row: tuple[str, bool, bool]) -> int:
        found = self.number.get((paths, row))
        if found is None:
            found = self.number[(paths, row)] = len(self.after)
            self._add(paths, *row)
        return found

    def _add(self, paths: Paths, initial: str, must_go: bool, truncated: bool) -> None:
        best: dict[int, tuple] = {}
        for before, path in enumerate(paths):
            if path is None:
                continue
            at, cost = before, path[0]
            for inserted in range(3):
                edits = [("D", DELETE, at)]
                if not must_go:
                    extra = TRUNCATED if truncated else 0
                    edits.append(("R", REROLE + extra, _ONWARD[at]))
                    kept = _KEEPS.get(initial, {}).get(at)
                    if kept is not None:
                        edits.append(("K", extra, kept))
                for letter, price, to in edits:
                    # spellings up to the row before differ before either ends, so their ranks decide
                    way = (cost + price, path[1], "I" * inserted + letter, before)
                    if to not in best or way < best[to]:
                        best[to] = way
                at, cost = _ONWARD[at], cost + INSERT
        least = min(way[0] for way in best.values())
        spelled = sorted(way[1:3] for way in best.values())
        self.after.append(tuple(
            (best[q][0] - least, spelled.index(best[q][1:3])) if q in best else None for q in range(4)
        ))
        self.rise.append(least)
        self.back.append(tuple((best[q][3], best[q][2]) if q in best else None for q in range(4)))

    @staticmethod
    def end(paths: Paths) -> tuple[int, str, int]:
        """Cost above the least, letters after the last row, and the state before them."""
        needed = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
        ways = [(p[0] + INSERT * needed[q], p[1], "I" * needed[q], q) for q, p in enumerate(paths) if p is not None]
        cost, _, letters, state = min(ways)
        return cost, letters, state


class Spill:
    """Two sequences of one conversation, backpointers and rows, of which a bounded part is held in memory."""

    def __init__(self, most_pointers: int, most_chars: int):
        self.most_pointers, self.most_chars = most_pointers, most_chars
        self.pointers, self.rows, self.chars = array("H"), [], 0
        self.files: dict[str, object] = {}
        self.blocks: dict[str, list[tuple[int, int]]] = {"pointers": [], "rows": []}

    def add(self, pointer: int, role: str, text: str) -> None:
        self.pointers.append(pointer)
        self.rows.append((role, text))
        self.chars += len(role) + len(text) + 100
        if len(self.pointers) >= self.most_pointers:
            self._out("pointers", self.pointers.tobytes())
            self.pointers = array("H")
        if self.chars >= self.most_chars:
            self._out("rows", pickle.dumps(self.rows))
            self.rows, self.chars = [], 0

    def _out(self, name: str, data: bytes) -> None:
        if name not in self.files:
            self.files[name] = tempfile.TemporaryFile()
        self.blocks[name].append((self.files[name].tell(), len(data)))
        self.files[name].write(data)

    def _in(self, name: str, block: tuple[int, int]) -> bytes:
        self.files[name].seek(block[0])
        return self.files[name].read(block[1])

    def pointers_back(self) -> Iterator[int]:
        yield from reversed(self.pointers)
        for block in reversed(self.blocks["pointers"]):
            held = array("H")
            held.frombytes(self._in("pointers", block))
            yield from reversed(held)

    def rows_on(self) -> Iterator[tuple[str, str]]:
        for block in self.blocks["rows"]:
            yield from pickle.loads(self._in("rows", block))
        yield from self.rows

    def close(self) -> None:
        for file in self.files.values():
            file.close()


class Conversation:
    """What is known of the rows of one conversation so far."""

    def __init__(self, conv: str | None, steps: Steps, spill: Spill):
        self.conv, self.steps, self.spill = conv, steps, spill
        self.paths, self.cost = Steps.start, 0
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.row = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, later: bool, truncated: bool) -> None:
        initial = role[:1]
        if self.row is not None and self.row[1][:1] + initial not in LEGAL:
            self.illegal += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        duplicate = not blank and (later or self.row == (turn, role, text))
        truncated = truncated and not blank and not duplicate
        self.row = (turn, role, text)
        self.n += 1
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        step = self.steps.take(self.paths, (initial if initial in _KEEPS else "", blank or duplicate, truncated))
        self.paths = self.steps.after[step]
        self.cost += self.steps.rise[step]
        self.spill.add(step, role, text)

    def audit(self) -> str:
        more, letters, state = Steps.end(self.paths)
        spelled = bytearray(letters.encode())
        for step in self.spill.pointers_back():
            state, letters = self.steps.back[step][state]
            spelled += letters[::-1].encode()
        spelled.reverse()
        self.cost += more
        return spelled.decode()

    def repaired(self, audit: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of every row, deleted and inserted ones too."""
        rows, state = self.spill.rows_on(), NOTHING
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(rows)
            if letter == "K":
                state = _KEEPS[role[:1]][state]
            elif letter in "RI":
                state = _ONWARD[state]
                role = _NAMES[state]
            yield letter, role, text

    def report(self) -> tuple:
        audit = self.audit()
        digest, between = hashlib.sha256(), b""
        for letter, role, text in self.repaired(audit):
            if letter != "D":
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (
            self.conv, self.n, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, audit, digest.hexdigest()
        )

    def edited(self) -> Iterator[tuple]:
        place = 0
        for letter, role, text in self.repaired(self.audit()):
            yield self.conv, None if letter == "D" else place, letter, role, text
            place += letter != "D"


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: a twentieth each of the rows dropped, emptied, without stops, repeated, and put to user."""

    def spelled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = (F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn"))) % 20).cast("int")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", spelled("role").alias("role"), spelled("text").alias("text"), kind.alias("kind"))
    changed = rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return changed.drop("copy")


def _sorted(turns: DataFrame) -> DataFrame:
    """Rows with their faults, dealt by conversation and sorted by turn; a row that is gone only names its conversation."""
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    rows = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], gone.alias("gone"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    # only what is said again at another turn; repeats at one turn stand next to each other in the stream
    again = (
        rows.where(~F.col("gone") & ~blank).groupBy(F.col("conv_id").alias("_conv"), digest.alias("_digest"))
        .agg(F.min(at).alias("_first"), F.max(at).alias("_last")).where("_first < _last").select("_conv", "_digest", "_first")
    )
    again = stage(again, "repair-repeats")
    known = rows.withColumn("_d", digest).withColumn("_at", at)
    met = known.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_d") == F.col("_digest")), "left")
    kept = ~F.col("gone")
    faults = met.select(
        F.col("conv_id").cast("string").alias("conv"), "conv_id", "turn", F.when(kept, F.col("role")).alias("role"),
        F.when(kept, F.col("text")).alias("text"), "gone", blank.alias("blank"),
        F.coalesce(F.col("_at") > F.col("_first"), F.lit(False)).alias("later"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    )
    ordered = faults.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    # as a string, since a column of numbers with nulls becomes one of floats on its way to pandas
    return ordered.select("conv", F.col("turn").cast("string").alias("turn"), "role", "text", "gone", "blank", "later", "truncated")


def _stream(turns: DataFrame, rows: bool, most_pointers: int, most_chars: int) -> DataFrame:
    ship_package(turns.sparkSession)
    schema = ROWS if rows else RESULT
    columns = [part.split()[0] for part in schema.split(", ")]

    def repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, current, done, chars = Steps(), None, [], 0

        def finish(conversation: Conversation) -> Iterator[tuple]:
            try:
                yield from conversation.edited() if rows else [conversation.report()]
            finally:
                conversation.spill.close()

        def out(conversation: Conversation) -> Iterator[pd.DataFrame]:
            nonlocal done, chars
            for row in finish(conversation):
                done.append(row)
                chars += 100 + len(row[-1]) + len(row[-2])
                if chars >= most_chars:
                    yield pd.DataFrame(done, columns=columns)
                    done, chars = [], 0

        for frame in frames:
            for conv, turn, role, text, gone, *faults in frame.itertuples(index=False, name=None):
                if current is None or current.conv != conv:
                    if current is not None:
                        yield from out(current)
                    current = Conversation(conv, steps, Spill(most_pointers, most_chars))
                if not gone:
                    current.add(None if turn is None else int(turn), role, text, *faults)
        if current is not None:
            yield from out(current)
        if done:
            yield pd.DataFrame(done, columns=columns)

    found = _sorted(turns).mapInPandas(repair, schema)
    kind = turns.schema["conv_id"].dataType
    return found.select(F.col("conv").cast(kind).alias("conv_id"), *columns[1:])


def reports(turns: DataFrame, *, most_pointers: int = 1 << 22, most_chars: int = 1 << 24) -> DataFrame:
    """Faults, cost, edits and digest of the repaired form, one row per conversation."""
    return _stream(turns, False, most_pointers, most_chars)


def repair(turns: DataFrame, *, most_pointers: int = 1 << 22, most_chars: int = 1 << 24) -> DataFrame:
    """The repaired conversations as rows: conv_id, place, edit, role, text; a deleted row has no place."""
    return _stream(turns, True, most_pointers, most_chars)
