"""Repair of conversation structure by weighted interval parsing.

The rows of a conversation are the terminals of a repair grammar: each can be kept (cost 0), given
the role user or assistant (1) or deleted (2), and turns without text can be inserted anywhere (5).
A repaired conversation is empty, or one optional system turn and then pairs of user and assistant.

The grammar is in Chomsky normal form. Its nonterminals are pairs (p, q) of positions in that
pattern, "these rows lead from p to q"; the rules are (p, q) -> (p, r) (r, q), the terminals are
edits of a row, closed on both sides under insertion. The cell of a span holds for every
nonterminal the least (cost, audit), audit being the initials of the edits in order. Cells are
combined bottom-up by span length.

Two facts keep this linear. Whatever leads from p to q over a span passes some r at every place in
it, so all splits of a span give the same cell, and the chart needs one split per span: the halves.
And the least audit of two joined spans joins the least audits of both: an audit of equal cost is
never the beginning of another one, since more insertions cost more. So a conversation of any
length is parsed by many tasks, in spans of SPAN rows first and of FAN spans after that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewcast.operators.numbering import number_rows
from crewcast.sources.shared_storage import fresh_path, written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: What a truncated row costs if it stays.
TRUNCATED = 5
#: Rows of the spans that one task parses alone, and such spans that are joined at once after that.
SPAN, FAN = 256, 16

# Positions in the pattern: before all, after the system turn, after a user, after an assistant.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_AFTER = {
    (_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER,
}
_ENDS = (_START, _ASSISTANT)
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}

# Nothing leads back to before the first user.
_NONTERMINALS = [(p, q) for p in range(4) for q in range(4) if p <= q or q >= _USER]
_NUMBER = {pair: n for n, pair in enumerate(_NONTERMINALS)}
_RULES = [
    (_NUMBER[p, q], [(_NUMBER[p, r], _NUMBER[r, q]) for r in range(4) if (p, r) in _NUMBER and (r, q) in _NUMBER])
    for p, q in _NONTERMINALS
]

#: (cost, audit) or None by nonterminal.
Cell = tuple[tuple[int, str] | None, ...]


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    cell = []
    for _, splits in _RULES:
        best = None
        for a, b in splits:
            if left[a] is not None and right[b] is not None:
                cost = left[a][0] + right[b][0]
                if best is None or cost <= best[0]:
                    audit = left[a][1] + right[b][1]
                    if best is None or (cost, audit) < best:
                        best = cost, audit
        cell.append(best)
    return tuple(cell)


def _inserted() -> Cell:
    """The cell of no row: insertions alone, by their closure."""
    cell: list = [(0, "") if p == q else None for p, q in _NONTERMINALS]
    for (p, initial), q in _AFTER.items():
        if initial != "s":
            cell[_NUMBER[p, q]] = (COST[INSERT], INSERT)
    while (wider := joined(tuple(cell), tuple(cell))) != tuple(cell):
        cell = list(wider)
    return tuple(cell)


_EMPTY_SPAN = _inserted()


@lru_cache(maxsize=64)
def terminal(initial: str, fault: str) -> Cell:
    """The cell of one row: initial s, u, a or another sign; fault "d" (must go), "t" (truncated) or "-"."""
    cell: list = [(COST[DELETE], DELETE) if p == q else None for p, q in _NONTERMINALS]
    if fault != "d":
        more = TRUNCATED if fault == "t" else 0
        for (p, role), q in _AFTER.items():
            edits = [(COST[KEEP] + more, KEEP)] if role == initial else []
            if role != "s":
                edits.append((COST[REROLE] + more, REROLE))
            if edits:
                cell[_NUMBER[p, q]] = min(edits)
    return joined(joined(_EMPTY_SPAN, tuple(cell)), _EMPTY_SPAN)


def combined(cells: list[Cell]) -> Cell:
    """The cell of all these neighbouring spans, by span length: pairs, pairs of pairs, ..."""
    while len(cells) > 1:
        pairs = [joined(a, b) for a, b in zip(cells[::2], cells[1::2], strict=False)]
        cells = pairs + cells[2 * len(pairs) :]
    return cells[0] if cells else _EMPTY_SPAN


@lru_cache(maxsize=20_000)
def parsed(initials: str, faults: str) -> Cell:
    """The cell of a span of rows, one character a row. What a worker has parsed it remembers."""
    return combined([terminal(i, f) for i, f in zip(initials, faults, strict=True)])


def cheapest(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    return min(found for q in _ENDS if (found := cell[_NUMBER[_START, q]]) is not None)


def edits(audit: str, initials: str) -> Iterator[tuple[str, int | None, str | None]]:
    """(edit, row from 1 or None, new role or None) in order; initials are those of all rows."""
    place, row = _START, 0
    for edit in audit:
        if edit == INSERT:
            place = _AFTER[place, "a" if place == _USER else "u"]
            yield edit, None, _ROLES[place]
            continue
        row += 1
        if edit == KEEP:
            place = _AFTER[place, initials[row - 1]]
        elif edit == REROLE:
            place = _AFTER[place, "a" if place == _USER else "u"]
        yield edit, row, _ROLES[place] if edit == REROLE else None


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by the CRC-32 of "conv_id:turn", modulo 20.

    0 drops the row, 1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 makes it
    the user's. Nulls count as one space, in role, text and the checksum; conv_id and turn stay null.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    kind = F.col("_kind")
    return (
        conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(F.concat_ws(":", *shown)) % 20).alias("_kind"))
        .filter(kind != 0)
        .select(
            F.col("conv_id").cast("bigint").alias("conv_id"),
            F.col("turn").cast("bigint").alias("turn"),
            F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        )
        .drop("_copy")
    )


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, n (from 1), turn, role, text; written, runs jobs.

    Rows go by turn, nulls first, equal turns by role and text, so equal rows stand side by side.
    """
    numbers = [F.col(c).cast("bigint").alias(c) for c in ("conv_id", "turn")]
    rows = turns.select(*numbers, *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    return written(number_rows(rows, ["conv_id"], "turn", "n", ties=["role", "text"]), fresh_path(turns.sparkSession, "turns"))


def faulty_turns(numbered: DataFrame) -> DataFrame:
    """conv_id, n, turn, initial and fault of each row of numbered_turns; written without texts, runs a job.

    A fault is the first that holds: "b" blank, "r" repeats an earlier row of the conversation in
    role and text, "t" truncated (the last sign that is no white space is none of .!?), else "-".
    """
    # The first row of each (role, text) is found by an aggregate and meets the rows by their unique
    # number, so neither a frequent text nor a long conversation is a hot key.
    alike = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    first = numbered.groupBy(F.col("conv_id").alias("_conv"), alike.alias("_alike")).agg(F.min("n").alias("_first")).drop("_alike")
    initial = F.substring("role", 1, 1)
    rows = numbered.select(
        "conv_id", "n", "turn",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("_blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("_open"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("n") == F.col("_first"))
    fault = F.when(F.col("_blank"), "b").when(F.col("_first").isNull(), "r").when(F.col("_open"), "t").otherwise("-")
    return written(
        rows.join(first, same, "left").select("conv_id", "n", "turn", "initial", fault.alias("fault")),
        fresh_path(numbered.sparkSession, "faulty-turns"),
    )


def _cell_columns(cells: list[Cell]) -> list[pa.Array]:
    """costs and audits by nonterminal; a cost of -1 stands for none."""
    costs = [[-1 if c is None else c[0] for c in cell] for cell in cells]
    audits = [["" if c is None else c[1] for c in cell] for cell in cells]
    return [pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))]


_SPAN_COLUMNS = "conv_id bigint, span bigint, initials string, costs array<bigint>, audits array<string>"


def _spans(faulty: DataFrame) -> DataFrame:
    """The cells of spans of SPAN rows."""
    rows = F.array_sort(F.collect_list(F.struct("n", "initial", "fault")))
    grouped = faulty.groupBy("conv_id", F.floor((F.col("n") - 1) / SPAN).alias("span")).agg(rows.alias("rows"))
    words = grouped.select(
        "conv_id", "span", F.array_join("rows.initial", "").alias("initials"), F.array_join("rows.fault", "").alias("faults")
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        must_go = str.maketrans("br", "dd")
        for batch in batches:
            conv, span, initials, faults = batch.columns
            cells = [parsed(i, f.translate(must_go)) for i, f in zip(initials.to_pylist(), faults.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([conv, span, initials, *_cell_columns(cells)], ["conv_id", "span", "initials", "costs", "audits"])

    return words.mapInArrow(parse, _SPAN_COLUMNS)


def _joined_spans(spans: DataFrame) -> DataFrame:
    """Each FAN neighbouring spans of a conversation become one."""
    rows = F.array_sort(F.collect_list(F.struct("span", "initials", "costs", "audits")))
    grouped = spans.groupBy("conv_id", F.floor(F.col("span") / FAN).alias("span")).agg(rows.alias("rows"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(batch.num_rows):  # one span at a time: their audits may be long
                row = batch.slice(part, 1)
                parts = row.column(2).to_pylist()[0]
                cells = [tuple(None if c < 0 else (c, a) for c, a in zip(x["costs"], x["audits"], strict=True)) for x in parts]
                initials = pa.array(["".join(x["initials"] for x in parts)])
                yield pa.RecordBatch.from_arrays(
                    [row.column(0), row.column(1), initials, *_cell_columns([combined(cells)])],
                    ["conv_id", "span", "initials", "costs", "audits"],
                )

    return grouped.select("conv_id", "span", "rows").mapInArrow(join, _SPAN_COLUMNS)


def parsed_conversations(faulty: DataFrame) -> DataFrame:
    """conv_id, cost, audit, initials (of all rows), illegal of each conversation of faulty_turns.

    illegal counts neighbouring rows whose initials are none of su, ua, au. Runs jobs: one per
    level of spans.
    """
    spark = faulty.sparkSession
    spans = written(_spans(faulty), fresh_path(spark, "spans"))
    while spans.agg(F.max("span")).first()[0]:
        spans = written(_joined_spans(spans), fresh_path(spark, "spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, audits, illegal = [], [], []
            initials = batch.column(2).to_pylist()
            for signs, cost, audit in zip(initials, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                best = cheapest(tuple(None if c < 0 else (c, a) for c, a in zip(cost, audit, strict=True)))
                costs.append(best[0])
                audits.append(best[1])
                illegal.append(sum(a + b not in ("su", "ua", "au") for a, b in zip(signs, signs[1:], strict=False)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(costs, pa.int64()), pa.array(audits), pa.array(initials), pa.array(illegal, pa.int64())],
                ["conv_id", "cost", "audit", "initials", "illegal"],
            )

    return spans.select("conv_id", "span", "initials", "costs", "audits").mapInArrow(
        finish, "conv_id bigint, cost bigint, audit string, initials string, illegal bigint"
    )


def repaired_turns(numbered: DataFrame, parses: DataFrame) -> DataFrame:
    """conv_id, position, edit, n, role, text: the repaired rows in order; deleted rows have no role and text.

    Edits and rows meet by (conv_id, n), which is unique, so a long conversation is spread.
    """

    def list_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "position", "edit", "n", "new_role"])

        held = []
        for batch in batches:
            for conv, audit, initials in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                for position, (edit, row, role) in enumerate(edits(audit, initials), start=1):
                    held.append((conv, position, edit, row, role))
                    if len(held) >= 10_000:
                        yield batch_of(held)
                        held = []
        if held:
            yield batch_of(held)

    made = parses.select("conv_id", "audit", "initials").mapInArrow(
        list_edits, "conv_id bigint, position bigint, edit string, n bigint, new_role string"
    )
    rows = numbered.select(F.col("conv_id").alias("_conv"), F.col("n").alias("_n"), F.col("role").alias("_role"), F.col("text").alias("_text"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("n") == F.col("_n"))
    stays = F.col("edit") != DELETE
    return made.join(rows, same, "left").select(
        "conv_id", "position", "edit", "n",
        F.when(stays, F.coalesce("new_role", "_role")).alias("role"),
        F.when(stays, F.coalesce("_text", F.lit(""))).alias("text"),
    )


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: SHA-256 of the `role:text` lines of each conversation, joined by line feeds.

    A digest is computed from first to last, so a conversation is one task's work; its rows pass
    through it one batch at a time and are never held together.
    """
    lines = repaired.select("conv_id", "position", F.when(F.col("role").isNotNull(), F.concat("role", F.lit(":"), "text")).alias("line"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, empty = None, None, True
        done: list[tuple[int | None, str]] = []
        for batch in batches:
            for key, line in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if sha is None or key != conv:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha, empty = key, hashlib.sha256(), True
                if line is not None:
                    sha.update(line if empty else b"\n" + line)
                    empty = False
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.int64(), pa.string()), strict=True)], ["conv_id", "repaired_sha256"])
                done = []
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()])], ["conv_id", "repaired_sha256"])

    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.mapInArrow(digest, "conv_id bigint, repaired_sha256 string")


def repair_report(conversations: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """One row per conv_id of `conversations`: its faults, the cheapest repair and the digest of the result.

    `turns` are the rows to repair, those of `conversations` unless given (then damaged ones, say).
    Columns: conv_id, gaps (numbers missing between the first and last turn, nulls left out),
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null roles and texts are one space, hence blank or of no known role. Turns without a number
    come first; equal turns go by role and text. Rows without conv_id are one conversation. A
    conversation without rows has zeros, an empty audit and the digest of the empty string; an
    empty table gives an empty table. Texts of any length are moved, never cut. Other columns are
    not read. Runs jobs while it is built.
    """
    spark = conversations.sparkSession
    numbered = numbered_turns(conversations if turns is None else turns)
    rows = faulty_turns(numbered)
    parses = written(parsed_conversations(rows), fresh_path(spark, "repairs"))
    digests = conversation_digests(repaired_turns(numbered, parses))

    def faults(kind: str) -> Column:
        return F.count(F.when(F.col("fault") == kind, 1))

    counts = rows.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        faults("b").alias("blank"), faults("r").alias("duplicate"), faults("t").alias("truncated"),
    )

    def by_conversation(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.withColumnRenamed("conv_id", "_other")
        return left.join(other, F.col("conv_id").eqNullSafe(F.col("_other")), "left").drop("_other")

    result = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    for part in (counts, parses.drop("initials"), digests):
        result = by_conversation(result, part)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return result.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
