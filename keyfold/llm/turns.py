"""Repair of conversation structure at least cost, by layers of costs.

The roles of a repaired conversation, by their initials, follow the grammar
(s?(ua)+)?.  Its automaton has four states: Z before anything, S after a system
turn, U after a user turn, A after an assistant turn; Z and A accept.  For each
cost c in turn, a layer holds for every turn j the set of states, as bits, from
which the turns from j on can be finished at cost c exactly (the idea of Wu and
Manber's layers of errors).  The first layer with the start bit set gives the
cost; walking it forward, always by the least letter whose bit is set, gives
the least audit.  D deletes a turn (4), I inserts an empty one (3), K keeps (0),
R changes the role (3); K and R of a truncated turn cost 3 more.

Long conversations.  Four such problems, one for each state at the end, fit in
one word of 16 bits, so a block of 32 turns gives a 4 x 4 matrix of least costs
and audits; matrices multiply by adding costs and joining audits.  (Of two
audits of one block and one cost neither begins with the other, so the least
of a whole is made of the least of its parts.)  Turns are dealt out by ranges
of (conversation, turn): a conversation that crosses ranges or has over
`PIECE` turns is cut into pieces, whose matrices meet in one group and whose
texts don't.

Order of turns: by turn (null first), then role, then text; equal rows are one
after another.  Defined results: a null conversation id is one conversation;
null roles and texts count as one space; the initial of an empty role is
empty; a conversation without any turn left has zeros, an empty audit and the
hash of the empty string; gaps count up to the largest long; an empty table
gives an empty table; texts of any length stay whole; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, mapped, materialise

#: Turns of a block of one problem, and of a piece of a conversation.
BLOCK, PIECE = 32, 512
SPACE = " \t\n\v\f\r"
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: Bits of Z, S, U, A in each of four nibbles.
_Z, _S, _U, _A = 0x1111, 0x2222, 0x4444, 0x8888
_NEXT = {"u": {"Z": "U", "S": "U", "A": "U"}, "a": {"U": "A"}, "s": {"Z": "S"}}
_STATES = "ZSUA"


def _before_user(w: int) -> int:
    u = w & _U
    return (u >> 2) | (u >> 1) | (u << 1)


def _before_assistant(w: int) -> int:
    return (w & _A) >> 1


def _before_either(w: int) -> int:
    return _before_user(w) | _before_assistant(w)


def _before_system(w: int) -> int:
    return (w & _S) >> 1


_BEFORE = {"u": _before_user, "a": _before_assistant, "s": _before_system}


def layers(turns: str, end: int, goal: int) -> list[list[int]]:
    """layer[c][j]: states (16 bits) from which turns j.. finish at cost c.

    turns: a letter each, the role's initial (s, u, a; o for others), capital
    if truncated, x if it must go.  end: the bits after the last turn.  Layers
    are added until all bits of goal have been seen before the first turn, or
    no more can come."""
    n, out, seen = len(turns), [], 0
    moves = [(None, 0) if t == "x" else (_BEFORE.get(t.lower()), TRUNCATED if t.isupper() else 0) for t in turns]
    for c in range(DELETE * n + 2 * INSERT + 1):
        row = [0] * (n + 1)
        row[n] = end if c == 0 else 0
        fewer = out[c - INSERT] if c >= INSERT else None
        gone = out[c - DELETE] if c >= DELETE else None
        for j in range(n, -1, -1):
            w = row[j]
            if fewer is not None:
                w |= _before_either(fewer[j])
            if j < n:
                if gone is not None:
                    w |= gone[j + 1]
                if turns[j] != "x":
                    step, more = moves[j]
                    if step is not None and c >= more:
                        w |= step((row if more == 0 else out[c - more])[j + 1])
                    if c >= REROLE + more:
                        w |= _before_either(out[c - REROLE - more][j + 1])
            row[j] = w
        out.append(row)
        seen |= row[0]
        if seen & goal == goal:
            break
    return out


def trace(turns: str, layer: list[list[int]], cost: int, state: str, nibble: int) -> str:
    """The least audit from this state at this cost, for the end of a nibble."""
    bit = {s: 1 << (4 * nibble + k) for k, s in enumerate(_STATES)}
    has = lambda c, j, s: c >= 0 and s is not None and bool(layer[c][j] & bit[s])
    j, out, n = 0, [], len(turns)
    forward = {s: next((to[s] for r, to in _NEXT.items() if r != "s" and s in to)) for s in _STATES}
    while j < n or cost:
        t = turns[j] if j < n else ""
        more = TRUNCATED if t.isupper() else 0
        if j < n and has(cost - DELETE, j + 1, state):
            out.append("D")
            j, cost = j + 1, cost - DELETE
        elif has(cost - INSERT, j, forward[state]):
            out.append("I")
            cost, state = cost - INSERT, forward[state]
        elif t and t != "x" and has(cost - more, j + 1, to := _NEXT.get(t.lower(), {}).get(state)):
            out.append("K")
            j, cost, state = j + 1, cost - more, to
        else:
            out.append("R")
            j, cost, state = j + 1, cost - REROLE - more, forward[state]
    return "".join(out)


Matrix = list[list[tuple[int, str] | None]]


@lru_cache(1 << 14)
def _block(turns: str) -> Matrix:
    end = sum(1 << (4 * k + k) for k in range(4))
    layer = layers(turns, end, 0x10000)  # all layers: that bit is never set
    first: Matrix = [[None] * 4 for _ in range(4)]
    for s in range(4):
        for e in range(4):
            c = next((c for c, row in enumerate(layer) if row[0] >> (4 * e + s) & 1), None)
            if c is not None:
                first[s][e] = (c, trace(turns, layer, c, _STATES[s], e))
    return first


def _joined(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(4)]
    for s in range(4):
        for e in range(4):
            ways = [(a[s][m][0] + b[m][e][0], m) for m in range(4) if a[s][m] and b[m][e]]
            if ways:
                least = min(ways)[0]
                out[s][e] = (least, min(a[s][m][1] + b[m][e][1] for c, m in ways if c == least))
    return out


def _product(parts: list[Matrix]) -> Matrix:
    """The product, by halves, so that audits are copied log n times."""
    while len(parts) > 1:
        parts = [_joined(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def matrix(turns: str) -> Matrix:
    """Least costs and audits between any two states."""
    return _product([_block(turns[k : k + BLOCK]) for k in range(0, len(turns), BLOCK)] or [_block("")])


def _accepted(m: Matrix) -> tuple[int, str]:
    return min(x for x in (m[0][0], m[0][3]) if x)


@lru_cache(1 << 16)
def repaired(turns: str) -> tuple[int, str]:
    """Least cost and least audit of a conversation."""
    if len(turns) > 2 * BLOCK:
        return _accepted(matrix(turns))
    layer = layers(turns, 0b1001, 1)
    cost = len(layer) - 1
    return cost, trace(turns, layer, cost, "Z", 0)


def walk(state: str, turns: str, audit: str) -> tuple[list[tuple[str, int]], str]:
    """(role, index of the turn or -1) of what an audit leaves, and the state
    after it."""
    out, j = [], 0
    for e in audit:
        if e == "D":
            j += 1
            continue
        if e == "K":
            role = turns[j].lower()
        else:
            role = "u" if state in _NEXT["u"] else "a"
        state = _NEXT[role][state]
        out.append((e + role, -1 if e == "I" else j))
        j += e != "I"
    return out, state


_TURN = "array<struct<edit string, turn long, role string, text string>>"
_NAME = {"u": "user", "a": "assistant"}


class _Piece:
    """Turns of one conversation, in order, within one range."""

    def __init__(self, conv, before):
        self.conv, self.before = conv, before
        self.turn, self.role, self.text, self.letters = [], [], [], []
        self.blank = self.duplicate = self.truncated = 0

    def add(self, turn, role: str, text: str, again: bool) -> None:
        body = text.rstrip(SPACE)
        kind = (role[:1] if role[:1] in ("s", "u", "a") else "o") if role else "o"
        if not body:
            self.blank, kind = self.blank + 1, "x"
        elif again:
            self.duplicate, kind = self.duplicate + 1, "x"
        elif body[-1] not in ".!?":
            self.truncated, kind = self.truncated + 1, kind.upper()
        self.turn.append(turn)
        self.role.append(role)
        self.text.append(text)
        self.letters.append(kind)

    def facts(self) -> dict:
        first = [r[:1] for r in self.role]
        known = [t for t in self.turn if t is not None]
        return {
            "rows": len(self.turn),
            "blank": self.blank,
            "duplicate": self.duplicate,
            "truncated": self.truncated,
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])),
            "head": first[0] if first else None,
            "tail": first[-1] if first else None,
            "low": known[0] if known else None,
            "high": known[-1] if known else None,
            "kinds": len(set(known)),
        }


def _gaps(low: int | None, high: int | None, kinds: int) -> int:
    return 0 if low is None else min(high - low + 1 - kinds, (1 << 63) - 1)


def _left(state: str, turns: list, roles: list, texts: list, letters: str, audit: str) -> list[dict]:
    """The turns that an audit leaves."""
    kept, _ = walk(state, letters, audit)
    out = []
    for edit, j in kept:
        name = _NAME.get(edit[1]) if edit[0] != "K" else roles[j]
        out.append({"edit": edit[0], "turn": None if j < 0 else turns[j], "role": name, "text": "" if j < 0 else texts[j]})
    return out


class Repair(NamedTuple):
    """report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    one row a conversation; turns: conv_id, piece, turns (edit, turn, role,
    text), what is left in order, in one row or, for long conversations, in
    rows to be read in order of piece; whole: all is in one row."""

    report: DataFrame
    turns: DataFrame


def _flagged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, gone) and `later`: a row of the same
    role and text stands at an earlier turn of the conversation."""
    mark = F.unhex(F.md5(F.concat_ws("\x1f", F.length("role").cast("string"), "role", "text")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    rows = rows.withColumns({"mark": F.when(~F.col("gone"), mark), "place": place})
    seen = rows.where("not gone").groupBy("conv_id", "mark").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    seen = seen.where("first < last").select(F.col("conv_id").alias("seen_conv"), F.col("mark").alias("seen_mark"), "first")
    got = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("seen_conv")) & (F.col("mark") == F.col("seen_mark")), "left")
    return got.select("conv_id", "turn", "role", "text", "gone", F.coalesce(F.col("first") < F.col("place"), F.lit(False)).alias("later"))


def _cut(kind: str):
    """Pieces of the sorted rows of a range."""
    schema = arrow_schema(_PIECES.format(kind=kind))

    def batch_of(done: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(done, schema=schema)

    def finish(p: _Piece, number: int, whole: bool) -> dict:
        letters = "".join(p.letters)
        row = p.facts() | {"conv_id": p.conv, "piece": (TaskContext.get().partitionId() << 33) + number, "whole": whole, "letters": letters}
        if whole:
            row["cost"], row["audit"] = repaired(letters)
            row["gaps"] = _gaps(row["low"], row["high"], row["kinds"])
            row["left"] = _left("Z", p.turn, p.role, p.text, letters, row["audit"])
        else:
            flat = [x for line in matrix(letters) for x in line]
            row["costs"] = [None if x is None else x[0] for x in flat]
            row["audits"] = [None if x is None else x[1] for x in flat]
            row |= {"turns": p.turn, "roles": p.role, "texts": p.text}
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, number, last, done, size = None, True, 0, None, [], 0
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(6)]
            for conv, turn, role, text, gone, later in zip(*cols, strict=True):
                new = now is None or conv != now.conv
                if new or len(now.turn) >= PIECE:
                    if now is not None:
                        # Whole: neither at the edge of the range nor cut before or here.
                        done.append(finish(now, number, new and not first and not now.before))
                        size += sum(map(len, now.text))
                        number, first = number + 1, first and not new
                    now = _Piece(conv, not new)
                    if new:
                        last = None
                if not gone:
                    same = (turn, role, text)
                    now.add(turn, role, text, later or same == last)
                    last = same
                if len(done) >= 1000 or size > 1 << 20:
                    yield batch_of(done)
                    done, size = [], 0
        if now is not None:
            done.append(finish(now, number, False))
        if done:
            yield batch_of(done)

    return run


_FACTS = "rows long, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, kinds long"
_PIECES = f"conv_id {{kind}}, piece long, whole boolean, letters string, {_FACTS}, gaps long, cost long, audit string, left {_TURN}, costs array<long>, audits array<string>, turns array<long>, roles array<string>, texts array<string>"
_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _meet(kind: str):
    """Of all pieces of a conversation: its facts, and each piece's share of the audit."""
    schema = arrow_schema(_MET.format(kind=kind))

    def one(pieces: pa.Table) -> pa.Table:
        rows = sorted(pieces.to_pylist(), key=lambda r: r["piece"])
        cost, audit = _accepted(_product([[[None if c is None else (c, a) for c, a in zip(r["costs"][4 * s : 4 * s + 4], r["audits"][4 * s : 4 * s + 4], strict=True)] for s in range(4)] for r in rows]))
        total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "kinds"), 0)
        low = high = tail = None
        out, at, state = [], 0, "Z"
        for k, r in enumerate(rows):
            for c in total:
                total[c] += r[c]
            if r["rows"]:
                if tail is not None and tail + r["head"] not in ("su", "ua", "au"):
                    total["illegal"] += 1
                tail = r["tail"]
            if r["low"] is not None:
                total["kinds"] -= r["low"] == high
                low, high = r["low"] if low is None else low, r["high"]
            # The piece's turns, with the insertions before each; the last piece has those at the end too.
            end, turns = at, 0
            while turns < r["rows"]:
                turns += audit[end] != "I"
                end += 1
            end = len(audit) if k == len(rows) - 1 else end
            share, at = audit[at:end], end
            out.append({"piece": r["piece"], "share": share, "state": state})
            state = walk(state, r["letters"], share)[1]
        whole = {k: v for k, v in total.items() if k != "kinds"} | {"conv_id": rows[0]["conv_id"], "gaps": _gaps(low, high, total["kinds"]), "cost": cost, "audit": audit}
        empty = dict.fromkeys(whole) | {"conv_id": rows[0]["conv_id"]}
        return pa.Table.from_pylist([(empty if k else whole) | x | {"lead": k == 0} for k, x in enumerate(out)], schema=schema)

    return one


_MET = "conv_id {kind}, piece long, lead boolean, share string, state string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repair(rows: DataFrame) -> Repair:
    """Repair conversations (conv_id, turn, role, text[, gone]).  Rows that are
    `gone` are no turns, but their conversation is reported."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = _flagged(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), gone.alias("gone")))
    # The first letters of a text cut ties of range bounds, so that these stay short.
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    pieces = materialise(mapped(ranged, _cut(kind), _PIECES.format(kind=kind)), "turns", lean=True)

    cut = pieces.where("not whole").select("conv_id", "piece", "letters", "rows", "blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "kinds", "costs", "audits")
    met = materialise(cut.groupBy("conv_id").applyInArrow(_meet(kind), _MET.format(kind=kind)), "turns-met")
    report = pieces.where("whole").select("conv_id", *_REPORT).unionByName(met.where("lead").select("conv_id", *_REPORT))

    parts = pieces.where("not whole").select("piece", "conv_id", "letters", "turns", "roles", "texts").join(met.select("piece", "share", "state"), "piece")
    out = f"conv_id {kind}, piece long, left {_TURN}"
    schema = arrow_schema(out)

    def render(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "piece": r["piece"], "left": _left(r["state"], r["turns"], r["roles"], r["texts"], r["letters"], r["share"])}], schema=schema)

    long = mapped(parts, render, out).select("conv_id", "piece", F.lit(False).alias("whole"), F.col("left").alias("turns"))
    return Repair(report, pieces.where("whole").select("conv_id", "piece", "whole", F.col("left").alias("turns")).unionByName(long))


def damage(rows: DataFrame) -> DataFrame:
    """conversations with faults put in by crc32(conv_id:turn) % 20: 0 takes a
    row away (column gone), 1 empties its text, 2 takes out [.!?], 3 repeats
    it, 4 makes its role user.  Nulls count as one space, but for conv_id and
    turn themselves, which stay."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    got = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("fault"))
    body = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    got = got.withColumns({"text": body, "role": F.when(F.col("fault") == 4, "user").otherwise(F.col("role")), "gone": F.col("fault") == 0})
    return got.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text", "gone")


def _lines() -> Column:
    return F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the repaired role:text lines, joined by line
    feeds.  A long conversation's pieces stream past in order; nothing of it is
    held but the running hash."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    body = turns.select("conv_id", "piece", "whole", F.size("turns").alias("n"), F.array_join(_lines(), "\n").alias("body"))
    short = body.where("whole").select("conv_id", F.sha2(F.col("body").cast("binary"), 256).alias("repaired_sha256"))
    out = f"conv_id {kind}, repaired_sha256 string"
    schema = arrow_schema(out)

    def run(batches):
        conv, hash_, lines = None, None, 0
        done = lambda: pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": hash_.hexdigest()}], schema=schema)
        for batch in batches:
            for c, n, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if hash_ is None or c != conv:
                    if hash_ is not None:
                        yield done()
                    conv, hash_, lines = c, hashlib.sha256(), 0
                if n:
                    hash_.update((b"\n" if lines else b"") + text.encode("utf-8", "surrogatepass"))
                    lines += n
        if hash_ is not None:
            yield done()

    ordered = body.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "n", "body")
    return short.unionByName(mapped(ordered, run, out))
