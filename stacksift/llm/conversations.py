"""Conversations with faults: what is wrong with them, and the cheapest repair of their turns.

Each turn is a 4 x 4 matrix over (cost, audit) elements: from what stood before it (nothing, system, user, assistant)
to what stands after it, with the closure of inserted turns before. Elements add as costs and joined audits and are
chosen by the least cost, then the least audit. The product is associative, so a conversation is the product of its
blocks, taken in rounds of 64 neighbours, and no task needs a whole long conversation: rows are ordered by range, a
block is at most 4,096 neighbouring rows.

Choosing by audit is sound although texts of unlike length are compared: of two audits over the same turns with the
same cost none begins with the other, since the rest of it would cost something.

What must be whole in one value or stream is what the result asks for: a conversation's audit is one string, and a
digest of a conversation reads its repaired turns in order, as a stream of sorted rows that may spill.

Defined cases: a null role or text is one space; a null conv_id is one conversation; rows of one turn (or of null turns)
go by role, then text; equal rows of one conversation are one row with a count; an empty role, or one with another initial
than s, u or a, can't be kept; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .line_dedup import BLANKS

KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: States by the initial of the last role; the text may end before any role, or behind an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
ROLES = ("user", "assistant")
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
BLOCK_BITS = 12
FAN = 64

Matrix = list  # 16 elements, by row: None or (cost, audit)


def damage(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, n: the rows after damage. Equal rows, and a repeated one, are one row that counts n."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    drawn = rows.select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"), (F.crc32(named) % 20).alias("drawn"))
    of = F.col("drawn")
    text = F.when(of == 1, "").when(of == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    hurt = drawn.where(of != 0).select("conv", "turn", F.when(of == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(of == 3, 2).otherwise(1).alias("n"))
    return hurt.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))


def in_order(rows: DataFrame) -> DataFrame:
    """The rows with pos, which rises along each conversation and is written once, so that later steps agree on it.

    Rows are dealt by range, so a conversation of a third of all rows is spread over many tasks. Bounds see 64
    characters of a text, which go in the same order as whole texts.
    """
    cols = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = rows.repartitionByRange(*cols, F.substring("text", 1, 64)).sortWithinPartitions(*cols, "text")
    return cut(dealt.withColumn("pos", F.monotonically_increasing_id()))


def faults(ordered: DataFrame) -> DataFrame:
    """conv, turn, pos, n, initial, fault: the first fault of each row's first copy; the other copies are duplicates or blank."""
    firsts = ordered.groupBy("conv", "role", F.sha2("text", 256)).agg(F.min("pos").alias("first")).select("first")
    bare = F.rtrim("text", F.lit(BLANKS))
    ends = F.substring(bare, -1, 1).isin(".", "!", "?")
    seen = ordered.select("conv", "turn", "pos", "n", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), ends.alias("ends"))
    met = seen.join(firsts, seen["pos"] == firsts["first"], "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("ends"), TRUNCATED).otherwise(FINE)
    return met.select("conv", "turn", "pos", "n", "initial", fault.alias("fault"))


def fault_counts(rows: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated."""
    one = F.when(F.col("fault") == DUPLICATE, F.col("n")).when(F.col("fault") == BLANK, 0).otherwise(F.col("n") - 1)
    turns = rows.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("fault") == BLANK, F.col("n")).otherwise(0)).alias("blank"), F.sum(one).alias("duplicate"), F.sum((F.col("fault") == TRUNCATED).cast("long")).alias("truncated")
    )
    wide = F.col("turn").cast("decimal(20,0)")
    gaps = F.when(F.count("turn") > 0, F.least(F.max(wide) - F.min(wide) + 1 - F.count("turn"), F.lit(2**63 - 1).cast("decimal(20,0)"))).cast("long")
    return turns.groupBy("conv").agg(F.coalesce(gaps, F.lit(0).cast("long")).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


# --- matrices --------------------------------------------------------------------------------------------------------
def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus: the least (cost, audit) over what may stand between."""
    out: Matrix = [None] * 16
    steps = [[(j, *b[4 * k + j]) for j in range(4) if b[4 * k + j]] for k in range(4)]
    for i in range(4):
        for k in range(4):
            if left := a[4 * i + k]:
                cost, audit = left
                for j, more, edits in steps[k]:
                    best, total = out[4 * i + j], cost + more
                    if best is None or total <= best[0]:
                        new = (total, audit + edits)
                        if best is None or new < best:
                            out[4 * i + j] = new
    return out


def _of(steps: Iterator) -> Matrix:
    out: Matrix = [None] * 16
    for i, j, element in steps:
        out[4 * i + j] = min(out[4 * i + j] or element, element)
    return out


UNIT = _of((i, i, (0, "")) for i in range(4))


def _closed() -> Matrix:
    """Any number of inserted turns: three are the most that lead anywhere new."""
    one = _of([(i, i, (0, "")) for i in range(4)] + [(i, j, (INSERT_COST, INSERT)) for (i, role), j in NEXT.items() if role != "s"])
    return product(product(one, one), one)


CLOSED = _closed()


def turn_matrix(initial: str, fault: int) -> Matrix:
    """What a turn may become, behind any inserted ones."""
    steps = [(i, i, (DELETE_COST, DELETE)) for i in range(4)]
    if fault in (FINE, TRUNCATED):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        steps += [(i, j, (more, KEEP)) for (i, role), j in NEXT.items() if role == initial]
        steps += [(i, j, (more + REROLE_COST, REROLE)) for (i, role), j in NEXT.items() if role != "s"]
    return product(CLOSED, _of(steps))


def deleted(n: int) -> Matrix:
    """n more copies of a turn: each is a duplicate and must go. What is inserted among them is no better than behind."""
    return _of((i, i, (DELETE_COST * n, DELETE * n)) for i in range(4))


# --- blocks ----------------------------------------------------------------------------------------------------------
ELEMENT = "segments array<struct<first:bigint,rows:bigint>>, many array<struct<pos:bigint,n:bigint>>, illegal bigint, head string, tail string, costs array<bigint>, audits array<string>"


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


class Block:
    """Neighbouring rows of one conversation: their product, their places, and the pairs of roles that may not stand side by side."""

    __slots__ = ("head", "illegal", "many", "matrix", "segments", "tail")

    def __init__(self, segments=(), many=(), illegal=0, head="", tail="", matrix=UNIT):
        self.segments, self.many, self.illegal, self.head, self.tail, self.matrix = list(segments), list(many), illegal, head, tail, matrix

    @classmethod
    def read(cls, x: dict) -> Block:
        return cls(
            [(s["first"], s["rows"]) for s in x["segments"]], [(m["pos"], m["n"]) for m in x["many"]], x["illegal"], x["head"], x["tail"],
            [None if c is None else (c, a) for c, a in zip(x["costs"], x["audits"], strict=True)],
        )

    def row(self) -> tuple:
        segments = [{"first": a, "rows": b} for a, b in self.segments]
        return segments, [{"pos": a, "n": b} for a, b in self.many], self.illegal, self.head, self.tail, [e and e[0] for e in self.matrix], [e and e[1] for e in self.matrix]

    def add_row(self, pos: int, n: int, initial: str, fault: int, turns: dict) -> None:
        if self.segments:
            self.illegal += _illegal(self.tail, initial)
            self.segments[0] = (self.segments[0][0], self.segments[0][1] + 1)
        else:
            self.head = initial
            self.segments = [(pos, 1)]
        self.tail = initial
        if (initial, fault) not in turns:
            turns[initial, fault] = turn_matrix(initial, fault)
        self.matrix = product(self.matrix, turns[initial, fault])
        if n > 1:
            self.illegal += n - 1
            self.many.append((pos, n))
            self.matrix = product(self.matrix, deleted(n - 1))

    def add(self, other: Block) -> None:
        self.illegal += other.illegal + _illegal(self.tail, other.head)
        self.segments += other.segments
        self.many += other.many
        self.tail = other.tail
        self.matrix = product(self.matrix, other.matrix)


def _emit(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(df: DataFrame, schema: str) -> tuple[str, pa.Schema]:
    """The schema of a Python step that returns conv and other columns, for Spark and for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType().add(df.schema["conv"])
    for f in df.sparkSession.createDataFrame([], schema).schema:
        kind.add(f)
    return kind, to_arrow_schema(kind)


def _blocks(schema: pa.Schema, width: int = 256) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, out, turns = None, None, [], {}
        for b in batches:
            for conv, blk, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block is None or at != (conv, blk):
                    if block is not None:
                        out.append((*at, *block.row()))
                        if len(out) >= width:
                            yield _emit(schema, out)
                            out = []
                    at, block = (conv, blk), Block()
                block.add_row(*row, turns)
        if block is not None:
            yield _emit(schema, [*out, (*at, *block.row())])

    return run


def _merged(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 16):
                out = []
                for conv, blk, parts in zip(*(c.to_pylist() for c in b.slice(i, 16).columns), strict=True):
                    parts.sort(key=lambda p: p["blk"])
                    block = Block.read(parts[0])
                    for p in parts[1:]:
                        block.add(Block.read(p))
                    out.append((conv, blk, *block.row()))
                yield _emit(schema, out)

    return run


def block_products(rows: DataFrame) -> DataFrame:
    """conv and the product of each conversation. Rounds of 64 neighbours; their number grows with the logarithm of the blocks."""
    low = 2**33 - 1
    idx = F.shiftright(F.col("pos").bitwiseAND(F.lit(low)), BLOCK_BITS)
    part = F.shiftright("pos", 33)
    most = rows.agg(F.max(idx).alias("idx"), F.max(part).alias("part")).first()
    each = (most["idx"] or 0) + 1
    blocks = ((most["part"] or 0) + 1) * each
    small = rows.select("conv", (part * each + idx).alias("blk"), "pos", "n", "initial", "fault")
    kind, arrow = _arrow(small, f"blk bigint, {ELEMENT}")
    out = small.repartition("conv", "blk").sortWithinPartitions("conv", "pos").mapInArrow(_blocks(arrow), kind)
    while blocks > 1:
        fields = [c for c in out.columns if c != "conv"]
        grouped = out.groupBy("conv", F.floor(F.col("blk") / FAN).alias("up")).agg(F.collect_list(F.struct(*fields)).alias("parts"))
        out = grouped.mapInArrow(_merged(arrow), kind)
        blocks = -(-blocks // FAN)
    return out.drop("blk")


# --- plans and their effect ------------------------------------------------------------------------------------------
def _solved(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                out = []
                for row in b.slice(i, 64).to_pylist():
                    block = Block.read(row)
                    ends = product(block.matrix, CLOSED)
                    cost, audit = min(e for e in (ends[j] for j in ENDS) if e)
                    out.append((row["conv"], cost, audit, block.illegal, *block.row()[:2]))
                yield _emit(schema, out)

    return run


def plans(rows: DataFrame) -> DataFrame:
    """conv, cost, audit, illegal, segments, many: the cheapest repair of each conversation."""
    products = block_products(rows)
    kind, arrow = _arrow(products, "cost bigint, audit string, illegal bigint, segments array<struct<first:bigint,rows:bigint>>, many array<struct<pos:bigint,n:bigint>>")
    return products.mapInArrow(_solved(arrow), kind)


def edited_turns(audit: str, segments: list[tuple[int, int]], many: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each turn that the repair leaves: the row's place (-1: inserted), whether its role is set, and 0 user, 1 assistant, 2 as it is."""
    edits = np.frombuffer(audit.encode(), "u1")
    places = np.concatenate([np.arange(a, a + n) for a, n in segments])
    if many:
        times = np.ones(len(places), "i8")
        times[np.searchsorted(places, [p for p, _ in many])] = [n for _, n in many]
        places = np.repeat(places, times)
    at = np.full(len(edits), -1)
    at[edits != ord(INSERT)] = places
    left = edits != ord(DELETE)
    edits, at = edits[left], at[left]
    role = (np.arange(len(edits)) + len(edits) % 2) % 2  # a kept system turn in front makes their number odd
    role[edits == ord(KEEP)] = 2
    return at, edits != ord(KEEP), role


def _edits(schema: pa.Schema, width: int = 65_536) -> Callable:
    names = pa.array([*ROLES, None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (row,) = b.slice(i, 1).to_pylist()
                at, _, role = edited_turns(row["audit"], [(s["first"], s["rows"]) for s in row["segments"]], [(m["pos"], m["n"]) for m in row["many"]])
                for lo in range(0, len(at), width):
                    n = len(at[lo : lo + width])
                    seq = np.arange(lo, lo + n)
                    place = np.where(at[lo : lo + n] < 0, -1 - seq, at[lo : lo + n])  # no row has these, and they are dealt evenly
                    yield pa.RecordBatch.from_arrays([pa.array([row["conv"]] * n, schema[0].type), pa.array(seq), pa.array(place), names.take(pa.array(role[lo : lo + n]))], schema=schema)

    return run


def repaired_rows(solved: DataFrame, ordered: DataFrame) -> DataFrame:
    """conv, seq, role, text: the turns after the repair; seq is their order in the conversation."""
    kind, arrow = _arrow(solved, "seq bigint, at bigint, new_role string")
    edits = solved.select("conv", "audit", "segments", "many").mapInArrow(_edits(arrow), kind)
    met = edits.join(ordered.select("pos", "role", "text"), edits["at"] == F.col("pos"), "left")
    return met.select("conv", "seq", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _digests(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []
        for b in batches:
            for conv, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or conv != at:
                    if state is not None:
                        out.append((at, state.hexdigest()))
                    at, state = conv, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
                if len(out) >= 1024:
                    yield _emit(schema, out)
                    out = []
        if state is not None:
            yield _emit(schema, [*out, (at, state.hexdigest())])

    return run


def digests(repaired: DataFrame) -> DataFrame:
    """conv, repaired_sha256: a stream over sorted rows; nothing of a conversation but the state of its hash is kept."""
    line = F.concat_ws(":", "role", "text").alias("line")
    rows = repaired.repartition("conv").sortWithinPartitions("conv", "seq").select("conv", line)
    kind, arrow = _arrow(rows, "repaired_sha256 string")
    return rows.mapInArrow(_digests(arrow), kind)


def _beside(report: DataFrame, more: DataFrame) -> DataFrame:
    """``report`` with the columns of ``more`` where it has the conversation; the null one meets itself."""
    return report.join(more.withColumnRenamed("conv", "same_conv"), F.col("conv").eqNullSafe(F.col("same_conv")), "left").drop("same_conv")


def repair(conversations: DataFrame, damaged: bool = True) -> tuple[DataFrame, DataFrame]:
    """A report for each conversation, and the repaired turns (conv, seq, role, text).

    With ``damaged`` the rows are damaged first, as the contract of the query has it; without, they are taken as they are.
    """
    if damaged:
        rows = damage(conversations)
    else:
        role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
        rows = conversations.select(F.col("conv_id").alias("conv"), "turn", role, text).groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    ordered = in_order(rows)
    seen = cut(faults(ordered))
    solved = cut(plans(seen))
    repaired = repaired_rows(solved, ordered)
    report = conversations.select(F.col("conv_id").alias("conv")).distinct()
    for more in (fault_counts(seen), solved, digests(repaired)):
        report = _beside(report, more)
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return report.select(F.col("conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")), repaired
