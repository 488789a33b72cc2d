"""Structure repair of conversations by weighted interval parsing.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``. The repair grammar is in Chomsky normal form: its
nonterminals N(p, q) stand for rows, with edits, that lead from place p of the pattern to place q, and its rules are
N(p, q) -> N(p, r) N(r, q), beside those of a single row (kept, given another role, deleted) and those of inserted turns,
by which every cell is closed on both sides. A cell of a span holds for each nonterminal the smallest (cost, audit). A
derivation is at some place at every seam, so any one split of a span gives the smallest value of all splits; spans are
combined bottom-up by length: neighbours of 1, 2, 4, ... rows. Equally cheap audits of a cell are never beginnings of one
another (the longer one would have inserted more, at the same edits), so the smallest parts make the smallest whole.

Rows are numbered by turn, null turns first, ties by role and text. Blocks of ``BLOCK`` rows are parsed where they are,
then a conversation's blocks are combined the same way, so one that holds most rows is parsed by many tasks; only the
combination of its blocks and its audit, which is one value, are handled together.

A null conversation id is a conversation. A null role or text counts as one blank; a null turn sorts first and is left out
of the gaps. A role that is none of the three initials cannot be kept. Repeated rows are duplicates. An empty table gives
no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracelake.llm.shared import BLANKS, SLICE_ROWS, batch_of, fold_groups, slices, written
from tracelake.operators.ordinals import sequence_number

BLOCK = 512
CONVERSATION = "conv_id"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
# Costs of edits, and what a truncated row that is not deleted adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Places in the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
STEPS = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
LEGAL = ("su", "ua", "au")

# (cost, audit) by (place before, place after).
Cell = dict[tuple[int, int], tuple[int, str]]


def _better(cell: Cell, at: tuple[int, int], cost: int, audit: str) -> None:
    if at not in cell or (cost, audit) < cell[at]:
        cell[at] = cost, audit


def join(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (s, q), (more, rest) in right.items():
            if r == s:
                _better(out, (p, q), cost + more, audit + rest)
    return out


def inserted() -> Cell:
    """The cell of no rows: turns that are put in, as few as lead from one place to another."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    steps: Cell = {at: (INSERT, "I") for role in "ua" for at in STEPS[role]}
    while True:
        longer = join(cell, steps)
        merged = dict(cell)
        for at, (cost, audit) in longer.items():
            _better(merged, at, cost, audit)
        if merged == cell:
            return cell
        cell = merged


NO_ROWS = inserted()


def row_cell(initial: str, drop: bool, truncated: bool) -> Cell:
    """The cell of one row, closed under insertion."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if not drop:
        more = TRUNCATED if truncated else 0
        for at in STEPS.get(initial, ()):
            _better(cell, at, more, "K")
        for role in "ua":
            for at in STEPS[role]:
                _better(cell, at, REROLE + more, "R")
    return join(join(NO_ROWS, cell), NO_ROWS)


ROW_CELLS = {
    (initial, drop, truncated): row_cell(initial, drop, truncated)
    for initial in "sua?"
    for drop in (False, True)
    for truncated in (False, True)
}


def combine(cells: Sequence[Cell]) -> Cell:
    """The cell of neighbouring spans: pairs, pairs of pairs and so on. No spans make the cell of no rows."""
    level = list(cells)
    while len(level) > 1:
        odd = level[-1:] if len(level) % 2 else []
        level = [join(a, b) for a, b in zip(level[::2], level[1::2])] + odd
    return level[0] if level else NO_ROWS


class _Block:
    """Faults and cell of neighbouring rows of one conversation."""

    def __init__(self) -> None:
        self.cells: list[Cell] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.lowest = self.highest = None

    def add(self, turn: int | None, initial: str, fault: str | None) -> None:
        if self.first is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None:
            self.turns += turn != self.highest
            self.lowest = turn if self.lowest is None else self.lowest
            self.highest = turn
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        known = initial if initial in STEPS else "?"
        self.cells.append(ROW_CELLS[known, fault in ("blank", "duplicate"), fault == "truncated"])

    def result(self) -> tuple:
        cell = [(p, q, cost, audit) for (p, q), (cost, audit) in combine(self.cells).items()]
        faults = (self.blank, self.duplicate, self.truncated, self.illegal)
        return (*faults, self.first, self.last, self.turns, self.lowest, self.highest, cell)


class _Conversation:
    """The blocks of a conversation, put together as spans of doubling numbers of blocks."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, Cell]] = []
        self.faults = [0] * 4
        self.last = self.lowest = self.highest = None
        self.turns = 0

    def add(self, blank, duplicate, truncated, illegal, first, last, turns, lowest, highest, cell) -> None:
        seam = self.last is not None and self.last + first not in LEGAL
        self.faults = [a + b for a, b in zip(self.faults, (blank, duplicate, truncated, illegal + seam))]
        self.last = last
        if lowest is not None:
            # Turns come sorted, so a turn of two blocks is the highest of one and the lowest of the next.
            self.turns += turns - (lowest == self.highest)
            self.lowest = lowest if self.lowest is None else self.lowest
            self.highest = highest
        self.spans.append((1, {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in cell}))
        while len(self.spans) > 1 and self.spans[-1][0] == self.spans[-2][0]:
            (size, left), (_, right) = self.spans[-2:]
            self.spans[-2:] = [(2 * size, join(left, right))]

    def result(self) -> tuple:
        whole = combine([cell for _, cell in self.spans])
        cost, audit = min(whole[START, q] for q in FINAL if (START, q) in whole)
        gaps = 0 if self.lowest is None else self.highest - self.lowest + 1 - self.turns
        return (gaps, *self.faults, cost, audit)


def faults(numbered: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, initial, fault) of numbered rows: the first of blank, duplicate and truncated, or null."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    first = numbered.groupBy(CONVERSATION, "role", digest.alias("_d")).agg(F.min("pos").alias("_pos"))
    first = first.select(F.col(CONVERSATION).alias("_conv"), "_pos")
    seen = F.col("_conv").eqNullSafe(F.col(CONVERSATION)) & (F.col("_pos") == F.col("pos"))
    bare = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    slim = numbered.select(CONVERSATION, "pos", "turn", F.substring("role", 1, 1).alias("initial"), bare.alias("_end"))
    fault = (
        F.when(F.col("_end") == "", "blank")
        .when(F.col("_pos").isNull(), "duplicate")
        .when(~F.col("_end").isin(".", "!", "?"), "truncated")
    )
    return slim.join(first, seen, "left").select(CONVERSATION, "pos", "turn", "initial", fault.alias("fault"))


def parse(numbered: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): one row per conversation."""
    rows = faults(numbered).withColumn("block", F.floor(F.col("pos") / BLOCK))
    blocks = fold_groups(
        rows,
        [CONVERSATION, "block"],
        ["pos"],
        ["turn", "initial", "fault"],
        _Block,
        "blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, lowest long,"
        " highest long, cell array<struct<p: int, q: int, cost: long, audit: string>>",
    )
    values = [c for c in blocks.columns if c not in (CONVERSATION, "block")]
    return fold_groups(
        blocks, [CONVERSATION], ["block"], values, _Conversation, ", ".join(f"{c} long" for c in COUNTS) + ", audit string"
    )


def edits(parsed: DataFrame) -> DataFrame:
    """(conv_id, pos, edit, before, role, after): what becomes of each row.

    ``before`` and ``after`` are the roles of turns put in around it, ``role`` that of a row with a new one.
    """
    made = T.StructType.fromDDL("pos long, edit string, before array<string>, role string, after array<string>")
    schema = T.StructType([parsed.schema[CONVERSATION], *made.fields])
    kinds = to_arrow_schema(schema)

    def place(audit: str) -> Iterator[tuple]:
        # An odd number of turns starts with a system turn; users and assistants take turns behind it.
        number = -(sum(c != "D" for c in audit) % 2)
        pos, before = 0, []
        tail = len(audit.rstrip("I"))
        for at, c in enumerate(audit):
            role = "user" if number % 2 == 0 else "assistant"
            number += c != "D"
            if c == "I":
                before.append(role)
                continue
            after = []
            if at + 1 == tail:
                # Turns behind the last row; they go on taking turns.
                after = ["user" if (number + n) % 2 == 0 else "assistant" for n in range(len(audit) - tail)]
            yield pos, c, before, role if c == "R" else None, after
            if after:
                return
            pos, before = pos + 1, []

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in slices(batches):
            for key, audit in zip(*(c.to_pylist() for c in batch.columns)):
                for row in place(audit):
                    rows.append((key, *row))
                    if len(rows) >= 16 * SLICE_ROWS:
                        yield batch_of(rows, kinds)
                        rows = []
        if rows:
            yield batch_of(rows, kinds)

    return parsed.select(CONVERSATION, "audit").mapInArrow(explode, schema)


def repaired_rows(numbered: DataFrame, parsed: DataFrame) -> DataFrame:
    """(conv_id, pos, part, role, text, edit): the repaired conversations. ``pos`` and ``part`` sort them.

    Turns that are put in have the position of the row they stand next to.
    """
    made = edits(parsed).withColumnsRenamed({CONVERSATION: "_conv", "pos": "_pos", "role": "_role"})
    same = F.col("_conv").eqNullSafe(F.col(CONVERSATION)) & (F.col("_pos") == F.col("pos"))

    def put_in(roles: Column) -> Column:
        return F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))

    own = F.struct(F.coalesce("_role", "role").alias("role"), F.col("text").alias("text"), F.col("edit").alias("edit"))
    parts = F.concat(put_in(F.col("before")), F.when(F.col("edit") == "D", F.array()).otherwise(F.array(own)), put_in(F.col("after")))
    # A sort-merge join: Spark takes the edits for as small as the file of their audits, which are many rows in one value.
    joined = numbered.join(made.hint("merge"), same).select(CONVERSATION, "pos", F.posexplode(parts).alias("part", "_row"))
    return joined.select(CONVERSATION, "pos", "part", "_row.role", "_row.text", "_row.edit")


def repair(spark: SparkSession, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was found in each conversation (see ``parse``), and the repaired rows."""
    rows = conversations.select(
        CONVERSATION, "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    )
    numbered = written(spark, sequence_number(rows, [CONVERSATION], ["turn", "role", "text"], "pos"), "repair-rows")
    parsed = written(spark, parse(numbered), "repair")
    return parsed, repaired_rows(numbered, parsed)
