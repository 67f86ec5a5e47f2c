"""Conversation structure repair: the cheapest edits that give a legal order of turns, by branch and bound.

A legal conversation is empty or an optional system turn followed by user and assistant
in alternation, ending with the assistant: role initials ``(s?(ua)+)?``. Rows of a
conversation are taken by turn (nulls first), then role, then text. Each row has at most
one fault, the first of: blank (nothing but ASCII white space), duplicate (role and text
seen in an earlier row), truncated (last solid character not one of ``.!?``).

Edits, in the order of the rows: Keep (0), Rerole to user or assistant (3), Delete (4,
required for blank and duplicate rows), Insert an empty turn of user or assistant (3,
anywhere). A truncated row that stays adds 3. Of all cheapest lists of edits the one
whose initials are ASCII-least is the audit.

The search is depth first over an explicit stack. A node is (rows consumed, state of the
role order); its prefix is cut when its cost plus a lower bound of the rest exceeds the
incumbent's cost, or meets it with a greater audit, or when the dominance table holds a
prefix of the same node that is no worse. The bounds come from the problem without the
rule that a system turn comes first. When the stack is empty the incumbent is optimal.

A prefix of a node is fixed by its letters, so of two prefixes with one cost neither is
the beginning of the other, and the lesser stays lesser whatever follows. Hence
conversations can be solved in pieces: the best audit for every (entry state, exit state)
of a piece, then a chain over pieces.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation with a
third of all rows spreads over many tasks. Conversations that lie whole inside a
partition and have at most ``LONGEST`` rows and ``LARGEST`` characters are solved where
they are; the others (two a partition, and long ones) go on as pieces of at most ``PIECE``
rows. Only what the result itself needs is sequential for one conversation: its chain of
pieces and its SHA-256, both of which stream.

A null role or text counts as one space; null conversation ids form one conversation,
null turns count as rows without a number. Conversations without rows (``present`` false
in all of them) have zeros, an empty audit and the hash of an empty string; an empty
table has no rows. Repeated rows are duplicates. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnoscope.llm.common import materialise

#: Rows and characters up to which a conversation is solved in one piece; rows of a piece of longer ones.
LONGEST = 128
LARGEST = 1 << 24
PIECE = 64
#: Characters of text after which a task hands over an output batch.
FLUSH = 1 << 22

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
SPACE = " \t\n\x0b\x0c\r"
LEGAL_PAIRS = frozenset(("su", "ua", "au"))
#: States of the role order: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FULL = {"u": "user", "a": "assistant"}


# ------------------------------------------------------------------ search

def suffix_bounds(rows: list[tuple[str, str]], user_open: bool) -> tuple[list[int], list[int]]:
    """Lower bounds of the cost of each suffix when a user, or an assistant, is due.

    They solve the relaxed problem in which a system turn may stay anywhere.
    ``user_open`` says that the end wants an assistant to be due.
    """
    n = len(rows)
    user, assistant = [0] * (n + 1), [0] * (n + 1)
    if user_open:
        user[n] = INSERT
    else:
        assistant[n] = INSERT
    for i in range(n - 1, -1, -1):
        initial, fault = rows[i]
        u, a = DELETE + user[i + 1], DELETE + assistant[i + 1]
        if fault not in ("b", "d"):
            more = TRUNCATED if fault == "t" else 0
            u = min(u, more + (KEEP if initial == "u" else REROLE) + assistant[i + 1])
            a = min(a, more + (KEEP if initial == "a" else REROLE) + user[i + 1])
            if initial == "s":
                u, a = min(u, more + user[i + 1]), min(a, more + assistant[i + 1])
        user[i], assistant[i] = min(u, INSERT + a), min(a, INSERT + u)
    return user, assistant


def cheapest_edits(rows: list[tuple[str, str]], entry: int = NOTHING, exits: tuple[int, ...] = (NOTHING, ASSISTANT),
                   ) -> tuple[int, str] | None:
    """Cost and audit of the best edits of ``rows`` (role initial, fault) from ``entry`` to one of ``exits``."""
    n = len(rows)
    due_user, due_assistant = suffix_bounds(rows, exits == (USER,))
    turns_wanted = max(exits) >= USER
    dominance: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(n + 1)]
    incumbent = None
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if incumbent is not None:
            bound = cost + (due_assistant if state == USER else due_user)[i]
            if bound > incumbent[0] or (bound == incumbent[0] and audit > incumbent[1][:len(audit)]):
                continue
        held = dominance[i][state]
        if held is not None and (cost, audit) >= held:
            continue
        dominance[i][state] = (cost, audit)
        if i == n and state in exits:
            if incumbent is None or (cost, audit) < incumbent:
                incumbent = (cost, audit)
            continue
        due, to = ("a", ASSISTANT) if state == USER else ("u", USER)
        children = [(cost + INSERT, "I", i, to)] if turns_wanted else []
        if i < n:
            initial, fault = rows[i]
            children.append((cost + DELETE, "D", i + 1, state))
            if fault not in ("b", "d"):
                stays = cost + (TRUNCATED if fault == "t" else 0)
                if initial == "s" and state == NOTHING:
                    children.append((stays + KEEP, "K", i + 1, SYSTEM))
                if turns_wanted:
                    children.append((stays, "K", i + 1, to) if initial == due else (stays + REROLE, "R", i + 1, to))
        # The most promising child is searched first, the ASCII-least of equals.
        ranked = sorted(((c + (due_assistant if s == USER else due_user)[j], letter, j, s, c) for c, letter, j, s in children), reverse=True)
        stack.extend((j, s, c, audit + letter) for _, letter, j, s, c in ranked)
    return incumbent


def apply_edits(audit: str, rows: list[tuple[str, str]], state: int = NOTHING) -> tuple[list[tuple[str, str]], int]:
    """Repaired (role, text) rows, and the state after them."""
    out, at = [], 0
    for letter in audit:
        due, to = ("a", ASSISTANT) if state == USER else ("u", USER)
        if letter == "I":
            out.append((FULL[due], ""))
            state = to
            continue
        role, text = rows[at]
        at += 1
        if letter == "D":
            continue
        if letter == "K" and role[:1] == "s":
            to = SYSTEM
        out.append((role if letter == "K" else FULL[due], text))
        state = to
    return out, state


def fault_of(text: str, seen: bool) -> str:
    """b(lank), d(uplicate), t(runcated) or nothing."""
    solid = text.strip(SPACE)
    if not solid:
        return "b"
    if seen:
        return "d"
    return "" if solid[-1] in ".!?" else "t"


def joined(repaired: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in repaired)


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class Structure:
    """Counts of a run of rows, and the rows as (initial, fault)."""

    def __init__(self, rows: list[tuple], faults: list[str]):
        """``rows`` are (turn, role, text)."""
        self.search = [(role[:1], fault) for (_, role, _), fault in zip(rows, faults, strict=True)]
        initials = [i for i, _ in self.search]
        turns = [t for t, _, _ in rows if t is not None]  # in order
        self.blank, self.duplicate, self.truncated = (faults.count(f) for f in "bdt")
        self.illegal = sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:]))
        self.first, self.last = turns[0] if turns else None, turns[-1] if turns else None
        self.distinct = sum(a != b for a, b in zip(turns, turns[1:])) + bool(turns)

    @property
    def gaps(self) -> int:
        return self.last - self.first + 1 - self.distinct if self.distinct else 0


# ------------------------------------------------------------------ tasks

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_REPORT = [("key", pa.string()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_REPORT_DDL = "key string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_TURNS_DDL = "array<struct<role:string,text:string>>"


class _Out:
    """Collects rows and hands them over as batches of bounded size."""

    def __init__(self, fields: list):
        self.schema, self.rows, self.size = pa.schema(fields), [], 0

    def add(self, row: dict, size: int = 0) -> None:
        self.rows.append(row)
        self.size += size + 64

    def full(self) -> bool:
        return self.size >= FLUSH

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist(self.rows, self.schema)
        self.rows, self.size = [], 0
        return out


def _solve(key, rows: list[tuple], keep_turns: bool) -> dict:
    """Report row of one whole conversation; ``rows`` are (turn, role, text, present)."""
    here = [r[:3] for r in rows if r[3]]
    seen, faults = set(), []
    for _, role, text in here:
        faults.append(fault_of(text, (role, text) in seen))
        seen.add((role, text))
    s = Structure(here, faults)
    cost, audit = cheapest_edits(s.search)
    repaired, _ = apply_edits(audit, [r[1:] for r in here])
    out = {"key": key, "gaps": s.gaps, "blank": s.blank, "duplicate": s.duplicate, "truncated": s.truncated, "illegal": s.illegal,
           "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(utf8(joined(repaired))).hexdigest(), "open": False}
    if keep_turns:
        out["turns"] = [{"role": r, "text": t} for r, t in repaired]
    return out


def _rows(batches: Iterator[pa.RecordBatch], step: int = 1024) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


_FIRST = [*_REPORT, ("turns", _TURNS), ("open", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
          ("present", pa.bool_())]
_FIRST_DDL = f"{_REPORT_DDL}, turns {_TURNS_DDL}, open boolean, turn long, role string, text string, present boolean"


def _first_pass(keep_turns: bool, longest: int):
    """Sorted rows to solved conversations, and the rows of those that cannot be closed here."""
    def run(batches):
        out = _Out(_FIRST)
        held, key, size = [], None, 0
        started, spilled, first = False, False, True

        def hand_over():
            for turn, role, text, present in held:
                out.add({"key": key, "open": True, "turn": turn, "role": role, "text": text, "present": present}, 2 * len(text))

        for k, turn, role, text, present in _rows(batches):
            if not started or k != key:
                if started:
                    # The partition's first conversation may have begun before it.
                    if first or spilled:
                        hand_over()
                    else:
                        solved = _solve(key, held, keep_turns)
                        out.add(solved, 2 * size * keep_turns + len(held))
                    first = False
                held, key, size, started, spilled = [], k, 0, True, False
            held.append((turn, role, text, present))
            size += len(text)
            if len(held) > longest or size > LARGEST:
                spilled = True
            if spilled and (len(held) > longest or size > FLUSH):
                hand_over()
                held, size = [], 0
            if out.full():
                yield out.batch()
        if started:
            hand_over()
        if out.rows:
            yield out.batch()
    return run


_LIGHT = [("key", pa.string()), ("part", pa.int32()), ("seg", pa.int64()), ("n", pa.int32()), ("blank", pa.int64()),
          ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()),
          ("first", pa.int64()), ("last", pa.int64()), ("distinct", pa.int64()), ("costs", pa.list_(pa.int64())),
          ("audits", pa.list_(pa.string()))]
_PIECE = [*_LIGHT, ("rows", _TURNS)]
_PIECE_DDL = ("key string, part int, seg long, n int, blank long, duplicate long, truncated long, illegal long, head string, tail string, "
              f"first long, last long, distinct long, costs array<long>, audits array<string>, rows {_TURNS_DDL}")
_SHARE = [("key", pa.string()), ("part", pa.int32()), ("seg", pa.int64()), ("share", pa.string()), *_REPORT[1:-1]]
_SHARE_DDL = "key string, part int, seg long, share string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"
_DONE = [*_REPORT, ("part", pa.int32()), ("seg", pa.int64()), ("turns", _TURNS)]
_DONE_DDL = f"{_REPORT_DDL}, part int, seg long, turns {_TURNS_DDL}"


def _table(search: list[tuple[str, str]]) -> tuple[list, list]:
    """Best cost and audit from each state to each state, null where there is no way."""
    costs, audits = [], []
    for entry in range(4):
        for end in range(4):
            # The first two states are left for good once a turn of user or assistant stands.
            best = cheapest_edits(search, entry, (end,)) if end >= max(entry, USER) or entry <= end or entry == ASSISTANT > end >= USER else None
            costs.append(None if best is None else best[0])
            audits.append(None if best is None else best[1])
    return costs, audits


def _pieces(most: int):
    """Sorted rows with ``seen`` to pieces of one conversation each."""
    def run(batches):
        part = TaskContext.get().partitionId()
        out = _Out(_PIECE)
        held, key, faults, before, seg = [], None, [], None, 0

        def close():
            nonlocal held, faults, seg
            s = Structure(held, faults)
            costs, audits = _table(s.search)
            out.add({"key": key, "part": part, "seg": seg, "n": len(held), "blank": s.blank, "duplicate": s.duplicate,
                     "truncated": s.truncated, "illegal": s.illegal, "head": s.search[0][0] if held else None,
                     "tail": s.search[-1][0] if held else None, "first": s.first, "last": s.last, "distinct": s.distinct,
                     "costs": costs, "audits": audits, "rows": [{"role": r, "text": t} for _, r, t in held]},
                    sum(2 * len(t) for _, _, t in held))
            held, faults, seg = [], [], seg + 1

        size = 0
        for k, turn, role, text, present, seen in _rows(batches):
            if before is not None and (k != key or len(held) >= most or size > FLUSH):
                close()
                size = 0
                if out.full():
                    yield out.batch()
            key = k
            row = (k, turn, role, text)
            if present:
                # Equal rows of one turn lie side by side; all but the first are repeats.
                faults.append(fault_of(text, bool(seen) or row == before))
                held.append(row[1:])
                size += len(text)
                before = row
            else:
                before = (k,)
        if before is not None:
            close()
        if out.rows:
            yield out.batch()
    return run


def _by_key(batches):
    """Rows as dictionaries."""
    for batch in batches:
        yield from batch.to_pylist()


def _chain():
    """Pieces of a conversation in order to each piece's share of the best audit; totals lie with the last piece."""
    def run(batches):
        out = _Out(_SHARE)
        state = None

        def finish():
            cost, audit = min(state["paths"][s] for s in (NOTHING, ASSISTANT) if s in state["paths"])
            audit = "".join(state["done"]) + audit
            totals = {c: state[c] for c in COUNTS[1:-1]} | {"cost": cost, "audit": audit}
            totals["gaps"] = state["last"] - state["first"] + 1 - state["distinct"] if state["distinct"] else 0
            at, left = 0, len(state["pieces"])
            for part, seg, n in state["pieces"]:
                left -= 1
                end, rows = at, 0
                while end < len(audit) and (rows < n or not left):
                    rows += audit[end] != "I"
                    end += 1
                out.add({"key": state["key"], "part": part, "seg": seg, "share": audit[at:end], **({} if left else totals)}, end - at)
                at = end

        for piece in _by_key(batches):
            if state is None or piece["key"] != state["key"]:
                if state is not None:
                    finish()
                    if out.full():
                        yield out.batch()
                state = {"key": piece["key"], "paths": {NOTHING: (0, "")}, "done": [], "pieces": [], "distinct": 0,
                         "first": None, "last": None, "tail": None, **dict.fromkeys(COUNTS[1:-1], 0)}
            _advance(state, piece)
        if state is not None:
            finish()
        if out.rows:
            yield out.batch()
    return run


def _advance(state: dict, p: dict) -> None:
    """One piece more: counts across its border, and the best path to each state."""
    for c in ("blank", "duplicate", "truncated", "illegal"):
        state[c] += p[c]
    if p["n"]:
        if state["tail"] is not None:
            state["illegal"] += state["tail"] + p["head"] not in LEGAL_PAIRS
        state["tail"] = p["tail"]
    if p["distinct"]:
        state["distinct"] += p["distinct"] - (state["last"] == p["first"])
        state["first"] = p["first"] if state["first"] is None else state["first"]
        state["last"] = p["last"]
    paths: dict[int, tuple[int, str]] = {}
    for entry, (cost, audit) in state["paths"].items():
        for end in range(4):
            more = p["costs"][4 * entry + end]
            if more is not None:
                found = (cost + more, audit + p["audits"][4 * entry + end])
                if end not in paths or found < paths[end]:
                    paths[end] = found
    # What all paths share is settled; paths soon meet, so little is carried on.
    common = commonprefix([audit for _, audit in paths.values()])
    state["done"].append(common)
    state["paths"] = {s: (cost, audit[len(common):]) for s, (cost, audit) in paths.items()}
    state["pieces"].append((p["part"], p["seg"], p["n"]))


def _finish(keep_turns: bool):
    """Pieces in order, with their shares of the audit and their rows, to repaired turns and one hash per conversation."""
    def run(batches):
        out = _Out(_DONE)
        key, state, digest, empty = None, NOTHING, hashlib.sha256(), True
        fresh = True
        for batch in batches:
            for at in range(batch.num_rows):  # one piece at a time
                p = batch.slice(at, 1).to_pylist()[0]
                if fresh:
                    key, state, digest, empty, fresh = p["key"], NOTHING, hashlib.sha256(), True, False
                repaired, state = apply_edits(p["share"], [(r["role"], r["text"]) for r in p["rows"]], state)
                if repaired:
                    digest.update(utf8(joined(repaired)) if empty else b"\n" + utf8(joined(repaired)))
                    empty = False
                row = {"key": key, "part": p["part"], "seg": p["seg"]}
                if keep_turns:
                    row["turns"] = [{"role": r, "text": t} for r, t in repaired]
                if p["audit"] is not None:  # the last piece
                    row |= {c: p[c] for c in (*COUNTS, "audit")} | {"repaired_sha256": digest.hexdigest()}
                    fresh = True
                if keep_turns or fresh:
                    out.add(row, sum(len(t) for _, t in repaired) * keep_turns + len(p["audit"] or ""))
                if out.full():
                    yield out.batch()
        if out.rows:
            yield out.batch()
    return run


# ------------------------------------------------------------------ operator

def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           present: Column | None = None, keep_turns: bool = False, longest: int = LONGEST, piece: int = PIECE,
           ) -> tuple[DataFrame, DataFrame | None]:
    """Report (one row per conversation) and, if asked for, the repaired turns of conversations.

    The report has ``conv``, the counts gaps, blank, duplicate, truncated, illegal, the cost,
    the audit and the SHA-256 of the repaired ``role:text`` lines. Turns come in blocks:
    ``conv``, part, seg (the order of a conversation's blocks), turns (role, text).
    Rows where ``present`` is not true only name their conversation.
    """
    kind = rows.schema[conv].dataType
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    base = rows.select(F.col(conv).cast("string").alias("key"), F.col(turn).cast("long").alias("turn"),
                       F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), here.alias("present"))

    def in_order(df):
        # The beginning of a text is enough of a key, and small enough to be sampled.
        return (df.repartitionByRange("key", "turn", "role", F.substring("text", 1, 32))
                .sortWithinPartitions("key", "turn", "role", "text"))

    first = materialise(in_order(base).mapInArrow(_first_pass(keep_turns, longest), _FIRST_DDL))
    closed = first.where("NOT open")
    rest = first.where("open").select("key", "turn", "role", "text", "present",
                                      F.sha2(F.to_json(F.struct("key", "role", "text")), 256).alias("digest"))
    firsts = rest.where("present").groupBy("digest").agg(F.min(F.struct("turn")).alias("first"))
    seen = F.coalesce(F.struct("turn") > F.col("first"), F.lit(False))
    flagged = rest.join(firsts, "digest", "left").select("key", "turn", "role", "text", "present", seen.alias("seen"))
    pieces = materialise(in_order(flagged).mapInArrow(_pieces(piece), _PIECE_DDL))

    def by_conversation(df):
        return df.repartition("key").sortWithinPartitions("key", "part", "seg")

    shares = by_conversation(pieces.drop("rows")).mapInArrow(_chain(), _SHARE_DDL)
    told = by_conversation(shares.join(pieces.select("part", "seg", "rows"), ["part", "seg"])
                           .select("key", "part", "seg", "share", *COUNTS, "audit", "rows"))
    done = told.mapInArrow(_finish(keep_turns), _DONE_DDL)
    done = materialise(done) if keep_turns else done
    key = F.col("key").cast(kind).alias(conv)
    columns = [key, *COUNTS, "audit", "repaired_sha256"]
    report = closed.select(*columns).union(done.where("audit IS NOT NULL").select(*columns))
    if not keep_turns:
        return report, None
    blocks = closed.select(key, F.lit(0).alias("part"), F.lit(0).cast("long").alias("seg"), "turns")
    return report, blocks.union(done.select(key, "part", "seg", "turns"))
