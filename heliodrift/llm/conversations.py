"""Repair of conversations by weighted interval parsing.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Its rows are kept, given
another role or deleted, and empty rows are inserted, at the least total cost; of several
cheapest repairs the one whose edits (their initials, in order) sort first is taken.

The grammar is in Chomsky normal form. Its symbols are pairs of states of the wanted pattern
(0 nothing yet, 1 after ``s``, 2 after ``u``, 3 after ``a``), with the rules ``pq -> pr rq``: what
leads from p to r, then what leads from r to q. A row is a leaf, and the insertion closure of
the leaves allows inserted rows before and after it. A cell of the chart holds, for one span
of rows and one symbol, the least (cost, audit). Cells are combined bottom-up by the length
of the span, over all places where it can be split. Two audits of one cell and cost are never one
the beginning of the other, since what the longer one adds are insertions, which cost; so the
least of a whole is made of the least of its parts, and audits compare as numbers of two bits
an edit.

Conversations of up to ``SPAN_ROWS`` rows are parsed together, many at a time, where they are
grouped. Longer ones are numbered by an operator that splits hot keys, cut into spans of that
many rows, which are parsed anywhere, and the spans' cells are combined ``FOLD`` neighbours at
a time, in as many rounds as that takes. As symbols are pairs of states, every span has a cell
wherever it is cut. No task holds more than ``FOLD`` spans or the texts of one. Only the digest
of a long conversation passes through one task, as a stream of its spans.

A row's first fault counts: blank (no sign but white space), duplicate (role and text seen
earlier in the conversation), truncated (its last sign is not one of ``.!?``). Blank and duplicate
rows must be deleted; other rows may be. Null roles and texts are one space. Rows are ordered by
turn, nulls first, then role and text, so repeated rows are neighbours and the later one a
duplicate. A null id is a conversation like others. Rows that are not ``present`` only name their
conversation; one without any present row has no edits, as has one of which nothing is left.
An empty table gives no rows; columns besides the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliodrift.llm.checksum_sql import crc32_sql
from heliodrift.llm.tables import stored
from heliodrift.operators.sequences import row_numbers

#: Rows of a span that is parsed at once: its audits have 30 edits at most, which fit 64 bits.
SPAN_ROWS = 12
#: Neighbouring spans that a task combines.
FOLD = 256
#: Conversations that are parsed together.
BATCH = 1_000

# The costs of the edits, and what a truncated row that stays adds.
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_EDITS = "DIKR"  # by their two bits, in the order in which audits compare
_D, _I, _K, _R = range(4)
_NEVER = 1 << 40
WHITE_SPACE = " \t\n\x0b\x0c\r"

# What each role's initial leads to, from state to state.
_STEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),), "": ()}
SYMBOLS = ((0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3))
_NUMBER = {symbol: k for k, symbol in enumerate(SYMBOLS)}
#: ``pq -> pr rq`` by the symbols' numbers.
RULES = tuple(
    (_NUMBER[p, q], _NUMBER[p, r], _NUMBER[r, q])
    for p, q in SYMBOLS
    for r in range(4)
    if (p, r) in _NUMBER and (r, q) in _NUMBER
)
_LEGAL = {"su", "ua", "au"}
# Faults as they are counted; a row that must go has no need of its initial.
FINE, CUT, BLANK, COPY = range(4)

Cell = tuple[int, str]
_NO_CELL: Cell = (_NEVER, "")


def _least(cells: dict, symbol: tuple[int, int], cell: Cell) -> None:
    cells[symbol] = min(cells.get(symbol, _NO_CELL), cell)


def inserted() -> dict[tuple[int, int], Cell]:
    """The insertion closure of no row: the least inserted rows that lead from state to state."""
    cells: dict[tuple[int, int], Cell] = {(p, p): (0, "") for p in range(4)}
    for _ in range(4):  # no two states are further apart
        for (p, r), (cost, audit) in list(cells.items()):
            for role in "ua":
                for r2, q in _STEPS[role]:
                    if r == r2:
                        _least(cells, (p, q), (cost + INSERT, audit + "I"))
    return cells


def leaf(initial: str, fault: int) -> list[Cell]:
    """The cells of one row, insertions before and after it included, by symbol."""
    row: dict[tuple[int, int], Cell] = {(p, p): (DELETE, "D") for p in range(4)}
    if fault in (FINE, CUT):
        more = TRUNCATED if fault == CUT else 0
        for step in _STEPS[initial]:
            _least(row, step, (more, "K"))
        for role in "ua":
            for step in _STEPS[role]:
                _least(row, step, (RELABEL + more, "R"))
    around, closed = inserted(), {}
    for (p, r), (c1, a1) in around.items():
        for (r2, t), (c2, a2) in row.items():
            for (t2, q), (c3, a3) in around.items():
                if r == r2 and t == t2:
                    _least(closed, (p, q), (c1 + c2 + c3, a1 + a2 + a3))
    return [closed.get(symbol, _NO_CELL) for symbol in SYMBOLS]


#: Kinds of rows: what can stay, by initial and fault, and at last what must go.
_KINDS = [(i, f) for i in ("s", "u", "a", "") for f in (FINE, CUT)] + [("", BLANK)]


def kind_of(initial: str, fault: int) -> int:
    return 8 if fault in (BLANK, COPY) else 2 * ("sua".find(initial) if initial in ("s", "u", "a") else 3) + fault


def _pack(audit: str) -> int:
    return sum(_EDITS.index(x) << (62 - 2 * k) for k, x in enumerate(audit))


def _unpack(audit: int, size: int) -> str:
    return "".join(_EDITS[(audit >> (62 - 2 * k)) & 3] for k in range(size))


_LEAVES = [leaf(*kind) for kind in _KINDS]
_LEAF_COST = np.array([[c for c, _ in cells] for cells in _LEAVES], np.int64)
_LEAF_AUDIT = np.array([[_pack(a) for _, a in cells] for cells in _LEAVES], np.uint64)
_LEAF_SIZE = np.array([[len(a) for _, a in cells] for cells in _LEAVES], np.uint64)
_EMPTY = [inserted().get(symbol, _NO_CELL) for symbol in SYMBOLS]


def chart(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs, packed audits and their lengths of the whole of many spans of one length, by symbol.

    ``kinds`` has a row for each span; its columns, at most ``SPAN_ROWS``, are the rows of the span.
    """
    rows = kinds.shape[1]
    cost = [None, np.moveaxis(_LEAF_COST[kinds.T], 2, 0)]
    audit = [None, np.moveaxis(_LEAF_AUDIT[kinds.T], 2, 0)]
    size = [None, np.moveaxis(_LEAF_SIZE[kinds.T], 2, 0)]
    for length in range(2, rows + 1):
        starts = rows - length + 1
        c = np.full((len(SYMBOLS), starts, len(kinds)), _NEVER, np.int64)
        a, s = np.zeros(c.shape, np.uint64), np.zeros(c.shape, np.uint64)
        for split in range(1, length):
            left, right = slice(0, starts), slice(split, split + starts)
            for whole, x, y in RULES:
                total = cost[split][x, left] + cost[length - split][y, right]
                first = size[split][x, left]
                joined = audit[split][x, left] | (audit[length - split][y, right] >> (first * np.uint64(2)))
                better = (total < c[whole]) | ((total == c[whole]) & (joined < a[whole]))
                np.copyto(c[whole], total, where=better)
                np.copyto(a[whole], joined, where=better)
                np.copyto(s[whole], first + size[length - split][y, right], where=better)
        for out, level in ((cost, np.minimum(c, _NEVER)), (audit, a), (size, s)):
            out.append(level)
    return cost[rows][:, 0], audit[rows][:, 0], size[rows][:, 0]


def parse(spans: Sequence[Sequence[int]]) -> list[list[Cell]]:
    """The cells of each span of kinds, by symbol; spans of one length are parsed together."""
    out: list[list[Cell]] = [_EMPTY] * len(spans)
    by_length: dict[int, list[int]] = {}
    for k, kinds in enumerate(spans):
        by_length.setdefault(len(kinds), []).append(k)
    by_length.pop(0, None)
    for same in by_length.values():
        for at in range(0, len(same), BATCH):
            part = same[at : at + BATCH]
            cost, audit, size = (x.T.tolist() for x in chart(np.array([spans[k] for k in part])))
            for k, c, a, s in zip(part, cost, audit, size, strict=True):
                out[k] = [(x, _unpack(y, z)) if x < _NEVER else _NO_CELL for x, y, z in zip(c, a, s, strict=True)]
    return out


def joined(left: Sequence[Cell], right: Sequence[Cell]) -> list[Cell]:
    """The cells of two neighbouring spans as one."""
    out = [_NO_CELL] * len(SYMBOLS)
    for whole, x, y in RULES:
        cost = left[x][0] + right[y][0]
        if cost <= out[whole][0] and cost < _NEVER:
            out[whole] = min(out[whole], (cost, left[x][1] + right[y][1]))
    return out


def whole(cells: Sequence[Cell]) -> Cell:
    """The cheapest repair: nothing is left, or the last row that stays is an ``a``."""
    return min(cells[_NUMBER[0, 0]], cells[_NUMBER[0, 3]])


def placed(odd: bool, place: int) -> str:
    """The role at a place of a repaired conversation of odd or even length."""
    return ("user", "assistant")[(place - odd) % 2]


def applied(rows: Sequence[tuple[str, str]], audit: str, place: int, odd: bool) -> list[tuple[str, str, str]]:
    """Edit, role and text of what an audit leaves of rows; ``place`` is that of the first one."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            out.append((edit, placed(odd, place), ""))
        else:
            role, text = rows[at]
            at += 1
            if edit == "D":
                continue
            out.append((edit, role if edit == "K" else placed(odd, place), text))
        place += 1
    return out


def pieces(audit: str, rows: int = SPAN_ROWS) -> Iterator[tuple[str, int]]:
    """The audit cut where spans of ``rows`` rows begin, and the place of each one's first row.

    Insertions belong to the row before them, those at the very start to the first row.
    """
    start, place, next_place, seen = 0, 0, 0, 0
    for at, edit in enumerate(audit):
        if edit != "I":
            if seen and seen % rows == 0:
                yield audit[start:at], place
                start, place = at, next_place
            seen += 1
        next_place += edit != "D"
    yield audit[start:], place


def _legal_breaks(initials: Sequence[str]) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _gaps(turns: Sequence[int]) -> int | None:
    found = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return found if found < 2**63 else None


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults, dealt by a checksum of conversation and turn; nulls are one space.

    A row that is dropped stays as one that is not ``present``.
    """
    conv, turn = (F.coalesce(rows[c].cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    name = F.concat(conv, F.lit(":"), turn)
    case = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce(rows["role"], F.lit(" ")), F.coalesce(rows["text"], F.lit(" "))
    table = rows.select(
        rows["conv_id"],
        rows["turn"],
        F.when(case == 4, "user").otherwise(role).alias("role"),
        F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (case != 0).alias("present"),
        F.when(case == 3, 2).otherwise(1).alias("times"),
    )
    return table.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).drop("time", "times")


def _readable(rows: DataFrame, present: Column) -> DataFrame:
    role, text = F.coalesce(rows["role"], F.lit(" ")), F.coalesce(rows["text"], F.lit(" "))
    end = F.right(F.rtrim(text, F.lit(WHITE_SPACE)), F.lit(1))
    fault = F.when(end == "", BLANK).when(end.isin(".", "!", "?"), FINE).otherwise(CUT)
    return rows.select(
        rows["conv_id"], rows["turn"], role.alias("role"), text.alias("text"), fault.alias("fault"), present.alias("present")
    )


_REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_NAMES = [field.split()[0] for field in _REPORT.split(", ")]
_TURNS = "array<struct<edit:string,role:string,text:string>>"
_TURNS_TYPE = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))


def _short(rows: DataFrame, key: str) -> DataFrame:
    """Conversations of few rows, each repaired where its rows meet."""
    row = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text", "fault")
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("present"), row))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                convs = part.column(1).to_pylist()
                for conv in convs:
                    seen = set()
                    for r in conv:
                        said = (r["role"], r["text"])
                        if r["fault"] != BLANK and said in seen:
                            r["fault"] = COPY
                        seen.add(said)
                cells = parse([[kind_of(r["role"][:1], r["fault"]) for r in conv] for conv in convs])
                report, turns = [], []
                for conv, parsed in zip(convs, cells, strict=True):
                    cost, audit = whole(parsed)
                    faults = [r["fault"] for r in conv]
                    report.append(
                        (
                            _gaps([r["turn"] for r in conv if r["known"]]),
                            *(faults.count(f) for f in (BLANK, COPY, CUT)),
                            _legal_breaks([r["role"][:1] for r in conv]),
                            cost,
                            audit,
                        )
                    )
                    odd = (len(audit) - audit.count("D")) % 2 == 1
                    found = applied([(r["role"], r["text"]) for r in conv], audit, 0, odd)
                    turns.append([dict(zip(("edit", "role", "text"), x, strict=True)) for x in found])
                columns = [pa.array(x, pa.int64()) for x in list(zip(*report, strict=True))[:-1]]
                yield pa.record_batch(
                    [part.column(0), *columns, pa.array([r[-1] for r in report]), pa.array(turns, _TURNS_TYPE)],
                    ["conv_id", *_NAMES, "turns"],
                )

    found = grouped.mapInArrow(run, f"conv_id {key}, {_REPORT}, turns {_TURNS}")
    return found.withColumns({"span": F.lit(0).cast("bigint"), "spans": F.lit(1).cast("bigint")})


_CELLS = "array<struct<cost:bigint,audit:string>>"
_CELLS_TYPE = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
_SPAN = f"span bigint, first string, last string, illegal bigint, cells {_CELLS}"


def _span_batch(keys: pa.Array, spans: list[tuple]) -> pa.RecordBatch:
    span, first, last, illegal, cells = zip(*spans, strict=True)
    shaped = [[{"cost": c, "audit": a} for c, a in x] for x in cells]
    arrays = [pa.array(span, pa.int64()), pa.array(first), pa.array(last), pa.array(illegal, pa.int64())]
    return pa.record_batch([keys, *arrays, pa.array(shaped, _CELLS_TYPE)], ["conv_id", "span", "first", "last", "illegal", "cells"])


def _leaf_spans(facts: DataFrame, key: str) -> DataFrame:
    """The cells of each span of ``SPAN_ROWS`` rows."""
    row = F.struct("pos", "initial", "fault")
    grouped = facts.groupBy("conv_id", F.expr(f"(pos - 1) div {SPAN_ROWS}").alias("span")).agg(
        F.sort_array(F.collect_list(row)).alias("rows")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(2).to_pylist()
                cells = parse([[kind_of(r["initial"], r["fault"]) for r in x] for x in rows])
                initials = [[r["initial"] for r in x] for x in rows]
                numbers = batch.column(1).to_pylist()
                yield _span_batch(
                    batch.column(0),
                    [(n, i[0], i[-1], _legal_breaks(i), c) for n, i, c in zip(numbers, initials, cells, strict=True)],
                )

    return grouped.mapInArrow(run, f"conv_id {key}, {_SPAN}")


def _folded(spans: DataFrame, key: str) -> DataFrame:
    """``FOLD`` neighbouring spans as one, combined by length: pairs, pairs of pairs and so on."""
    node = F.struct("span", "first", "last", "illegal", "cells")
    grouped = spans.groupBy("conv_id", F.expr(f"span div {FOLD}").alias("into")).agg(
        F.sort_array(F.collect_list(node)).alias("nodes")
    )

    def both(left: tuple, right: tuple) -> tuple:
        broken = left[3] + right[3] + (left[2] + right[1] not in _LEGAL)
        return (left[0], left[1], right[2], broken, joined(left[4], right[4]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = [
                    (n["span"], n["first"], n["last"], n["illegal"], [(c["cost"], c["audit"]) for c in n["cells"]])
                    for n in batch.column(2)[row].as_py()
                ]
                while len(found) > 1:
                    found = [both(*found[k : k + 2]) if k + 1 < len(found) else found[k] for k in range(0, len(found), 2)]
                yield _span_batch(batch.column(0).slice(row, 1), [(batch.column(1)[row].as_py(), *found[0][1:])])

    return grouped.mapInArrow(run, f"conv_id {key}, {_SPAN}")


def _keyed(df: DataFrame, *more: str) -> DataFrame:
    """A column to join by in which null ids are equal."""
    return df.withColumn("conv", F.struct("conv_id", *more))


def _long(rows: DataFrame, key: str) -> DataFrame:
    """Conversations of many rows: spans parsed apart, their cells combined, then each span repaired."""
    order = ("turn", "role", "text")
    numbered = stored(row_numbers(rows.where("present").drop("present"), "pos", ("conv_id",), order))
    facts = numbered.select(
        "conv_id", "turn", "pos", "fault", "role", F.substring("role", 1, 1).alias("initial"), F.sha2("text", 256).alias("said")
    )
    said = facts.groupBy("conv_id", "role", "said").agg(F.min("pos").alias("first_pos"))
    said = _keyed(said, "role", "said").select("conv", "first_pos")
    later = (F.col("fault") != BLANK) & (F.col("pos") > F.col("first_pos"))
    facts = _keyed(facts, "role", "said").join(said, "conv").withColumn("fault", F.when(later, COPY).otherwise(F.col("fault")))
    facts = stored(facts.select("conv_id", "turn", "pos", "initial", "fault"))
    spans = stored(_leaf_spans(facts, key))
    left = spans.agg(F.max("span")).first()[0]
    while left:
        spans, left = stored(_folded(spans, key)), left // FOLD
    ends = {"cost": F.array_min(F.array(*(F.col("cells")[_NUMBER[0, q]] for q in (0, 3))))}
    best = spans.withColumns(ends).select("conv_id", "illegal", "cost.cost", "cost.audit")
    wide = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.countDistinct("turn")
    totals = facts.groupBy("conv_id").agg(
        F.coalesce(wide, F.lit(0)).alias("wide"),
        *(F.count_if(F.col("fault") == f).alias(n) for n, f in (("blank", BLANK), ("duplicate", COPY), ("truncated", CUT))),
        F.expr(f"(max(pos) + {SPAN_ROWS - 1}) div {SPAN_ROWS}").alias("spans"),
    )
    totals = totals.withColumn("gaps", F.when(F.col("wide") <= 2**63 - 1, F.col("wide")).cast("bigint"))
    report = _keyed(best).drop("conv_id").join(_keyed(totals), "conv").select("conv_id", *_NAMES, "spans")
    report = stored(report)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                audit = batch.column(1)[row].as_py()
                odd = (len(audit) - audit.count("D")) % 2 == 1
                found = list(pieces(audit))
                yield pa.record_batch(
                    [
                        pa.array([batch.column(0)[row].as_py()] * len(found), batch.column(0).type),
                        pa.array(range(len(found)), pa.int64()),
                        pa.array([x for x, _ in found]),
                        pa.array([x for _, x in found], pa.int64()),
                        pa.array([odd] * len(found)),
                    ],
                    ["conv_id", "span", "piece", "place", "odd"],
                )

    edits = report.select("conv_id", "audit").mapInArrow(cut, f"conv_id {key}, span bigint, piece string, place bigint, odd boolean")
    texts = numbered.groupBy("conv_id", F.expr(f"(pos - 1) div {SPAN_ROWS}").alias("span")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("rows")
    )
    both = _keyed(texts, "span").join(_keyed(edits, "span").drop("conv_id", "span"), "conv").drop("conv")

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                _, _, rows_, piece, place, odd = (batch.column(k)[row].as_py() for k in range(6))
                found = applied([(r["role"], r["text"]) for r in rows_], piece, place, odd)
                turns = [dict(zip(("edit", "role", "text"), x, strict=True)) for x in found]
                kept = [batch.column(k).slice(row, 1) for k in range(2)]
                yield pa.record_batch([*kept, pa.array([turns], _TURNS_TYPE)], ["conv_id", "span", "turns"])

    turns = both.select("conv_id", "span", "rows", "piece", "place", "odd").mapInArrow(
        repaired, f"conv_id {key}, span bigint, turns {_TURNS}"
    )
    # The report of a conversation stands in its first span.
    first = _keyed(report.withColumn("span", F.lit(0).cast("bigint")), "span").drop("conv_id", "span", "spans")
    sizes = _keyed(report).select("conv", "spans")
    out = _keyed(turns, "span").join(first, "conv", "left").drop("conv")
    return stored(_keyed(out).join(sizes, "conv").drop("conv"))


def repair(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """Every conversation repaired: one row for each span of it.

    ``turns`` are the rows that the span becomes, with their edits. Counts of faults, ``cost`` and
    ``audit`` of the conversation stand in its span 0, ``spans`` in all.
    """
    key = rows.schema["conv_id"].dataType.simpleString()
    rows = _readable(rows, F.lit(True) if present is None else present)
    counts = rows.where("present").groupBy("conv_id").count()
    long_ids = stored(_keyed(counts.where(F.col("count") > SPAN_ROWS)).select("conv"))
    columns = ["conv_id", *_NAMES, "span", "spans", "turns"]
    if long_ids.isEmpty():
        return _short(rows, key).select(*columns)
    keyed = _keyed(rows)
    short = _short(keyed.join(long_ids, "conv", "left_anti").drop("conv"), key)
    long = _long(keyed.join(long_ids, "conv", "left_semi").drop("conv"), key)
    return short.select(*columns).unionByName(long.select(*columns))


def digests(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of :func:`repair`, with the digest of its lines ``role:text``."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    short = repaired.where("spans = 1").select("conv_id", *_NAMES, F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    several = repaired.where("spans > 1").select("conv_id", *_NAMES, "span", F.size("turns").alias("n"), lines.alias("lines"))
    kept = [*(several.schema[c] for c in ("conv_id", *_NAMES)), T.StructField("repaired_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, begun = None, hashlib.sha256(), False
        names = ["conv_id", *_NAMES]

        def finished() -> pa.RecordBatch:
            return pa.record_batch([*head, pa.array([digest.hexdigest()])], [*names, "repaired_sha256"])

        for batch in batches:
            spans, sizes = (batch.column(c).to_pylist() for c in ("span", "n"))
            for row, (span, size) in enumerate(zip(spans, sizes, strict=True)):
                if span == 0:  # the spans of a conversation follow each other
                    if head:
                        yield finished()
                    head, digest, begun = [batch.column(c).slice(row, 1) for c in names], hashlib.sha256(), False
                if size:
                    digest.update((b"\n" if begun else b"") + batch.column("lines")[row].as_py().encode())
                    begun = True
        if head:
            yield finished()

    ordered = several.repartition("conv_id").sortWithinPartitions("conv_id", "span")
    return short.unionByName(ordered.mapInArrow(run, T.StructType(kept)))


def _edit_sql(path: str, cost: str, edit: str) -> str:
    """A path, six digits of cost and then its edits, with one more edit."""
    return f"(lpad(CAST(CAST(left({path}, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || substr({path}, 7) || '{edit}')"


def _stays_sql(initial: str, cost: str, edit: str, *paths: str) -> str:
    when = "NOT r.gone" + (f" AND r.kind = '{initial}'" if initial else "")
    made = ", ".join(_edit_sql(f"c.{p}", cost, edit) for p in paths)
    return f"CASE WHEN {when} THEN least({made}) END" if len(paths) > 1 else f"CASE WHEN {when} THEN {made} END"


def _deleted_sql(path: str) -> str:
    return _edit_sql(f"c.{path}", str(DELETE), "D")


def _kept_sql(initial: str, *paths: str) -> str:
    return _stays_sql(initial, "r.more", "K", *paths)


def _relabelled_sql(*paths: str) -> str:
    return _stays_sql("", f"{RELABEL} + r.more", "R", *paths)


def _inserted_sql(path: str) -> str:
    return _edit_sql(f"c.{path}", str(INSERT), "I")


# Forward along the rows: the best path to each state (z for nothing yet). Marks + and * between
# the rows stand for inserting a row user, a row assistant.
_STEP_SQL = f"""CASE r.kind
  WHEN '+' THEN {{'kind': '', 'gone': false, 'more': 0, 'z': c.z, 's': c.s, 'a': c.a,
    'u': least(c.u, {_inserted_sql('z')}, {_inserted_sql('s')}, {_inserted_sql('a')})}}
  WHEN '*' THEN {{'kind': '', 'gone': false, 'more': 0, 'z': c.z, 's': c.s, 'a': least(c.a, {_inserted_sql('u')}), 'u': c.u}}
  ELSE {{'kind': '', 'gone': false, 'more': 0, 'z': {_deleted_sql('z')},
    's': least({_deleted_sql('s')}, {_kept_sql('s', 'z')}),
    'a': least({_deleted_sql('a')}, {_kept_sql('a', 'u')}, {_relabelled_sql('u')}),
    'u': least({_deleted_sql('u')}, {_kept_sql('u', 'z', 's', 'a')}, {_relabelled_sql('z', 's', 'a')})}} END"""


def _node_sql(kind: str, gone: str = "false", more: str = "0", start: str = "NULL") -> str:
    none = "NULL::VARCHAR"
    z = f"{start}::VARCHAR"
    return f"{{'kind': {kind}, 'gone': {gone}, 'more': {more}, 'z': {z}, 's': {none}, 'a': {none}, 'u': {none}}}"


_SPACE_SQL = r"[\x20\x09-\x0D]"
SQL = f"""
WITH dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fall FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE fall WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fall WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE fall WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM dealt),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    left(role, 1) AS initial, right(regexp_replace(text, '{_SPACE_SQL}+\\z', ''), 1) AS ending FROM damaged),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS step FROM numbered),
faults AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN again THEN 'duplicate'
    WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM marked),
totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal,
    list_reduce(list_concat([{_node_sql("'z'", start="'000000'")}, {_node_sql("'+'")}, {_node_sql("'*'")}], flatten(list(
      [{_node_sql('initial', "fault IN ('blank', 'duplicate')", f"CASE fault WHEN 'truncated' THEN {TRUNCATED} ELSE 0 END")},
       {_node_sql("'+'")}, {_node_sql("'*'")}] ORDER BY pos))), lambda c, r: {_STEP_SQL}) AS last
  FROM faults GROUP BY conv_id),
best AS (SELECT * EXCLUDE (last), least(last.z, last.a) AS path FROM totals),
edits AS (
  SELECT conv_id, k, substr(path, 6 + k, 1) AS edit FROM (SELECT conv_id, path, unnest(range(1, length(path) - 5)) AS k FROM best)),
placed AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS pos, count(*) FILTER (edit <> 'D') OVER w - 1 AS place,
    count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id) % 2 AS odd
  FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
lines AS (
  SELECT placed.conv_id, k, CASE WHEN edit = 'K' THEN role WHEN (place + odd) % 2 = 0 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line
  FROM placed LEFT JOIN numbered ON placed.conv_id IS NOT DISTINCT FROM numbered.conv_id AND placed.pos = numbered.pos
  WHERE edit <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS t FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(left(path, 6) AS BIGINT), 0) AS cost, coalesce(substr(path, 7), '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id
LEFT JOIN texts ON o.conv_id IS NOT DISTINCT FROM texts.conv_id
"""
