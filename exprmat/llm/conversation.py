"""Conversation structure repair: weighted CYK interval parsing of the edits of a conversation.

The role initials of a repaired conversation read ``(s?(ua)+)?``: an optional system row, then user and
assistant in turn. Its automaton has the states 0 (start), 1 (after s), 2 (after u) and 3 (after a);
0 and 3 may end. The repair grammar in Chomsky normal form has a nonterminal for each pair of states:
``[p,q]`` derives the rows of a span when their edits lead from p to q. Rules are ``[p,q] -> [p,r] [r,q]``,
the edits of one row, and insertions, whose closure stands before and after every row. A span's cell
keeps for every nonterminal its least (cost, audit). Every split of a span derives the same cell,
because the states meet at any place, so a span needs only one split: blocks of ``BLOCK`` neighbouring
rows are parsed by halves, and blocks are combined by ``FAN`` at a time over levels of growing
span length, each level a table. The cheapest nonterminal of the whole conversation is then handed down
the levels, and each block spells its rows.

Two audits of a span with the same states and cost never begin one with the other (a further I would
cost more), so the least audit of two halves is the two least audits after each other.

Rows are ordered by turn (null first), then role, then the SHA-256 of the row. Only digests, roles and
faults are sorted; a text moves when the repaired rows are made. A conversation of any length is
spread over blocks and tasks; its ``audit`` is one string.

Faults, the first that holds: blank (nothing but ``[\\x20\\x09-\\x0D]``), duplicate (role and text seen
earlier in the conversation), truncated (last visible character none of ``.!?``). Edits: Keep 0,
Rerole 2, Delete 3, Insert 2 (an empty text); blank and duplicate rows must be deleted, truncated
rows that stay cost 1 more.

Cases: null role or text is one blank; null turns come first and are ignored in ``gaps``; rows with a
null conversation id are one conversation; repeated rows are duplicates of the first; equal turns
are allowed; roles with other initials can be reroled or deleted; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from exprmat.llm.common import pin

BLOCK_BITS = 9
BLOCK = 1 << BLOCK_BITS
FAN_BITS = 3
BLANKS = " \t\n\x0b\x0c\r"

START, ENDS = 0, (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that Insert and Rerole give in each state.
WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}
ROLE = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1

Cell = dict[tuple[int, int], tuple[int, str]]


def combine(x: Cell, y: Cell) -> Cell:
    """``[p,q] -> [p,r] [r,q]``: the cell of two neighbouring spans."""
    out: Cell = {}
    for (p, r), (c, a) in x.items():
        for q in range(4):
            if (r, q) in y:
                d, b = y[r, q]
                new = (c + d, a + b)
                if (p, q) not in out or new < out[p, q]:
                    out[p, q] = new
    return out


def _insertions() -> Cell:
    """Closure of insertions: from each state by rising numbers of inserted rows."""
    out: Cell = {}
    for p in range(4):
        q, cost, audit = p, 0, ""
        while (p, q) not in out:
            out[p, q] = (cost, audit)
            q, cost, audit = STEP[q, WANTED[q]], cost + INSERT, audit + "I"
    return out


CLOSURE = _insertions()


def row_cell(who: str, what: str) -> Cell:
    """The cell of one row: ``who`` is its initial (s, u, a or o), ``what`` its fault (k none, t, b, d)."""
    more = UNFINISHED if what == "t" else 0
    edits: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if what in "kt":
        for p in range(4):
            edits[p, STEP[p, WANTED[p]]] = (REROLE + more, "R")
        for (p, c), q in STEP.items():
            if c == who:
                edits[p, q] = (KEEP + more, "K")
    return combine(combine(CLOSURE, edits), CLOSURE)


@lru_cache(maxsize=1 << 15)
def _short(who: str, what: str) -> Cell:
    if len(who) == 1:
        return row_cell(who, what)
    half = len(who) // 2
    return combine(_short(who[:half], what[:half]), _short(who[half:], what[half:]))


def span_cell(who: str, what: str) -> Cell:
    """The cell of a span of rows, from its halves."""
    if len(who) <= 8:
        return _short(who, what)
    half = len(who) // 2
    return combine(span_cell(who[:half], what[:half]), span_cell(who[half:], what[half:]))


def illegal(who: str) -> int:
    return sum(who[i:i + 2] not in ("su", "ua", "au") for i in range(len(who) - 1))


def _flat(cell: Cell, via: dict | None = None) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a, "via": (via or {}).get((p, q), [])} for (p, q), (c, a) in sorted(cell.items())]


CELLS = "array<struct<p:int,q:int,cost:long,audit:string,via:array<int>>>"
CELLS_ARROW = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("via", pa.list_(pa.int32()))]))


@dataclass
class Repaired:
    """``conversations``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit.
    ``rows``: conv, pos, part (their order), role, text, turn, edit (K, R or I)."""

    conversations: DataFrame
    rows: DataFrame


def _sized(c: Column) -> Column:
    """A value with its length before it, so that joined values stay apart; null is ``n``."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.char_length(s).cast("string"), F.lit(":"), s), F.lit("n"))


def _digest(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[_sized(c) for c in columns]), 256))


def _same_conv(a: DataFrame, b: DataFrame) -> Column:
    return a["conv"].eqNullSafe(b["conv"])


def _faulty(rows: DataFrame) -> DataFrame:
    """One row per row of a conversation: conv, turn, role, rid, who, what; repeats counted out."""
    core = F.btrim("text", F.lit(BLANKS))
    fault = F.when(core == "", "b").when(~F.substring(core, -1, 1).isin(".", "!", "?"), "t").otherwise("k")
    initial = F.substring("role", 1, 1)
    light = rows.select(
        "conv", "turn", "role", "rid", _digest(F.col("conv"), F.col("role"), F.col("text")).alias("same"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("who"), fault.alias("fault"))
    light = pin(light.groupBy("conv", "turn", "role", "rid", "same", "who", "fault").agg(F.count("*").alias("times")), "conversation-rows")
    first = light.groupBy("same").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unknown"))
    earlier = F.when(F.col("unknown"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")
    seen = earlier | (F.col("copy") > 1)
    return (light.join(first, "same").select("*", copies)
            .select("conv", "turn", "role", "rid", "copy", "who",
                    F.when(F.col("fault") == "b", "b").when(seen, "d").otherwise(F.col("fault")).alias("what")))


def _parse_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cells, wrong = [], []
        for rows in b.column("rows").to_pylist():
            who, what = "".join(r["who"] for r in rows), "".join(r["what"] for r in rows)
            cells.append(_flat(span_cell(who, what)))
            wrong.append(illegal(who))
        for name, values, kind in (("cells", cells, CELLS_ARROW), ("illegal", wrong, pa.int64())):
            b = b.append_column(name, pa.array(values, kind))
        yield b


def _combine_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to 2**FAN_BITS neighbouring spans become one, with the states met between them."""
    for b in batches:
        cells, wrong, firsts, lasts, kids = [], [], [], [], []
        for spans in b.column("spans").to_pylist():
            whole: Cell = {}
            via: dict = {}
            for k, s in enumerate(spans):
                own = {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in s["cells"]}
                if not k:
                    whole, via = own, {pq: list(pq) for pq in own}
                    continue
                nxt: Cell = {}
                path: dict = {}
                for (p, r), (c, a) in whole.items():
                    for q in range(4):
                        if (r, q) in own:
                            new = (c + own[r, q][0], a + own[r, q][1])
                            if (p, q) not in nxt or new < nxt[p, q]:
                                nxt[p, q], path[p, q] = new, [*via[p, r], q]
                whole, via = nxt, path
            cells.append(_flat(whole, via))
            joints = sum(illegal(x["last"] + y["first"]) for x, y in zip(spans[:-1], spans[1:], strict=True))
            wrong.append(joints + sum(s["illegal"] for s in spans))
            firsts.append(spans[0]["first"])
            lasts.append(spans[-1]["last"])
            kids.append([s["at"] for s in spans])
        out = b.drop_columns(["spans"])
        for name, values, kind in (("cells", cells, CELLS_ARROW), ("illegal", wrong, pa.int64()), ("first", firsts, pa.string()),
                                   ("last", lasts, pa.string()), ("kids", kids, pa.list_(pa.int64()))):
            out = out.append_column(name, pa.array(values, kind))
        yield out


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of a block's rows: audit letters with the role they give, in order."""
    kind = pa.list_(pa.struct([("pos", pa.int64()), ("part", pa.int32()), ("rid", pa.binary()), ("edit", pa.string()), ("role", pa.string())]))
    for b in batches:
        out = []
        for rows, cells, p, q in zip(*(b.column(n).to_pylist() for n in ("rows", "cells", "p", "q")), strict=True):
            audit = next(c["audit"] for c in cells if (c["p"], c["q"]) == (p, q))
            made, at, part, state = [], 0, 0, p
            for letter in audit:
                row = rows[min(at, len(rows) - 1)]
                if letter != "D":
                    role = row["who"] if letter == "K" else WANTED[state]
                    state = STEP[state, role]
                    made.append({"pos": row["pos"], "part": part, "rid": row["rid"] if letter != "I" else None,
                                 "edit": letter, "role": None if letter == "K" else ROLE[role]})
                part += 1
                at += letter != "I"
            out.append(made)
        yield b.select(["conv"]).append_column("made", pa.array(out, kind))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> Repaired:
    """Parse every conversation and return its faults, cheapest edits and repaired rows."""
    conv_type = rows.schema[conv_col].dataType
    conv_ddl = conv_type.simpleString()
    base = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    base = base.withColumn("rid", _digest(F.col("conv"), F.col("turn"), F.col("role"), F.col("text")))
    # the sort keys keep a conversation's neighbours in one or in neighbouring partitions
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "rid", "copy"]
    placed = (_faulty(base).repartitionByRange(*order).sortWithinPartitions(*order)
              .select("conv", "turn", "rid", "who", "what", F.monotonically_increasing_id().alias("pos")))
    placed = pin(placed, "conversation-order")

    # blocks: rows of one conversation within BLOCK positions of one partition
    local = F.col("pos").bitwiseAND((1 << 33) - 1)
    most = placed.agg(F.max(F.shiftright(local, BLOCK_BITS))).first()[0] or 0
    bits = int(most).bit_length()
    at = F.shiftleft(F.shiftright("pos", 33), bits) + F.shiftright(local, BLOCK_BITS)
    entry = F.struct("pos", "rid", "who", "what")
    blocks = placed.groupBy("conv", at.alias("at")).agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    row_ddl = "array<struct<pos:long,rid:binary,who:string,what:string>>"
    blocks = pin(blocks.mapInArrow(_parse_block, f"conv {conv_ddl}, at long, rows {row_ddl}, cells {CELLS}, illegal long"), "conversation-blocks")

    # levels of growing span length, until every conversation is one span
    spans = blocks.select("conv", "at", "cells", "illegal", F.col("rows")[0]["who"].alias("first"),
                          F.element_at("rows", -1)["who"].alias("last"))
    levels, done, shift = [], [], 0
    while True:
        known = spans.groupBy("conv").agg(F.count("*").alias("n"), F.min("at").alias("base"))
        tagged = spans.join(known.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))).drop("c")
        done.append(tagged.where("n = 1").select("conv", "at", F.lit(len(levels)).alias("level"), "cells", "illegal"))
        if not tagged.where("n > 1").limit(1).count():
            break
        shift = FAN_BITS
        near = F.shiftright(F.col("at") - F.col("base"), shift)
        span = F.struct("at", "cells", "illegal", "first", "last")
        met = tagged.where("n > 1").groupBy("conv", near.alias("at")).agg(F.sort_array(F.collect_list(span)).alias("spans"))
        spans = pin(met.mapInArrow(
            _combine_spans, f"conv {conv_ddl}, at long, cells {CELLS}, illegal long, first string, last string, kids array<long>"),
            "conversation-spans")
        levels.append(spans)
    roots = done[0]
    for d in done[1:]:
        roots = roots.union(d)
    best = F.array_min(F.transform(F.filter("cells", lambda c: (c["p"] == START) & c["q"].isin(*ENDS)),
                                   lambda c: F.struct(c["cost"], c["audit"], c["p"], c["q"])))
    roots = pin(roots.select("conv", "at", "level", "illegal", best.alias("best")), "conversation-roots")

    # the chosen nonterminal of each span, from the longest spans down to the blocks
    chosen = None
    for k in range(len(levels), -1, -1):
        own = roots.where(F.col("level") == k).select("conv", "at", F.col("best.p").alias("p"), F.col("best.q").alias("q"))
        if chosen is not None:
            above = levels[k].join(chosen.select(F.col("conv").alias("c"), F.col("at").alias("a"), "p", "q"),
                                   F.col("conv").eqNullSafe(F.col("c")) & (F.col("at") == F.col("a")))
            way = F.filter("cells", lambda c: (c["p"] == F.col("p")) & (c["q"] == F.col("q")))[0]["via"]
            steps = F.transform("kids", lambda a, i: F.struct(a.alias("at"), F.get("way", i).alias("p"), F.get("way", i + 1).alias("q")))
            own = own.union(above.withColumn("way", way).select("conv", F.explode(steps).alias("s")).select("conv", "s.*"))
        chosen = pin(own, "conversation-chosen") if k else own
    picked = blocks.select("conv", "at", "rows", "cells").join(
        chosen.select(F.col("conv").alias("c"), F.col("at").alias("a"), "p", "q"),
        F.col("conv").eqNullSafe(F.col("c")) & (F.col("at") == F.col("a"))).select("conv", "rows", "cells", "p", "q")
    made = picked.mapInArrow(_spell, f"conv {conv_ddl}, made array<struct<pos:long,part:int,rid:binary,edit:string,role:string>>")
    made = pin(made.select("conv", F.explode("made").alias("m")).select("conv", "m.*"), "conversation-edits")

    texts = base.groupBy("rid").agg(F.any_value("role").alias("old"), F.any_value("text").alias("text"), F.any_value("turn").alias("turn"))
    kept = made.where("rid is not null").join(texts, "rid").select(
        "conv", "pos", "part", F.coalesce("role", "old").alias("role"), "text", "turn", "edit")
    added = made.where("rid is null").select("conv", "pos", "part", "role", F.lit("").alias("text"), F.lit(None).cast("long").alias("turn"), "edit")

    turns = placed.groupBy("conv", "turn").agg(F.count("*").alias("n"), *[
        F.sum((F.col("what") == x).cast("long")).alias(x) for x in "bdt"])
    counts = turns.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        F.sum("b").alias("blank"), F.sum("d").alias("duplicate"), F.sum("t").alias("truncated"))
    r = roots.select(F.col("conv").alias("c"), "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))
    summary = counts.join(r, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    return Repaired(summary, kept.union(added))


def conversation_digests(rows: DataFrame) -> DataFrame:
    """``conv`` and the SHA-256 of its repaired ``role:text`` joined by newlines.

    A digest is sequential, so a conversation's rows pass one task in order; they are read in batches
    and never held together.
    """
    ddl = rows.schema["conv"].dataType.simpleString()
    ordered = rows.select("conv", "pos", "part", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = ordered.repartition("conv").sortWithinPartitions("conv", "pos", "part").select("conv", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, kind = None, None, pa.int64()
        out: tuple[list, list] = ([], [])
        for b in batches:
            kind = b.schema.field(0).type
            for c, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if state is not None and c == conv:
                    state.update(b"\n")
                else:
                    if state is not None:
                        out[0].append(conv)
                        out[1].append(state.hexdigest())
                    conv, state = c, hashlib.sha256()
                state.update(line.encode())
            if len(out[0]) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.string())], names=["conv", "digest"])
                out = ([], [])
        if state is not None:
            out[0].append(conv)
            out[1].append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.string())], names=["conv", "digest"])

    return ordered.mapInArrow(run, f"conv {ddl}, digest string")
