"""Repair of the turn structure of conversations by generalised LR parsing.

The roles of a good conversation follow a small grammar.  Its LR automaton reads the
turns; where a turn does not fit, it may be deleted, given another role, or a turn be
inserted before it, at a price.  All readings are kept at once on a graph-structured
stack: stacks share their tails, and equal stack tops are merged by the least
(cost, audit), the audit being the text of edit initials so far.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import SPACE
from .positions import AT, coded, in_order

#: Role initials of a good conversation: nothing, or an optional system turn and pairs
#: of user and assistant.  Left-recursive, so that the stack stays short.
GRAMMAR = [("C", ""), ("C", "B"), ("C", "sB"), ("B", "P"), ("B", "BP"), ("P", "ua")]
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ["su", "ua", "au"]

# What an edit costs.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: Rows of a conversation that one parse reads; longer ones are parsed in segments.
SEGMENT = 1024

#: How a row may be treated: kept freely, kept at a price, or deleted only.
FREE, DEAR, DOOMED = 0, 1, 2


class Automaton:
    """SLR automaton of a grammar whose terminals are the letters that no rule names.

    A stack is a tuple (state, stack below) or None under the first; tails are shared.
    """

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.rules = [("", rules[0][0]), *rules]
        self.heads = {head for head, _ in rules}
        self.follow = self._follow()
        self.states: dict[frozenset, int] = {}
        self.goto: dict[tuple[int, str], int] = {}
        self.items: list[frozenset] = []
        waiting = [self._closure({(0, 0)})]
        self.states[waiting[0]] = 0
        while waiting:
            items = waiting.pop(0)
            self.items.append(items)
            for symbol in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
                after = self._closure(
                    {(r, d + 1) for r, d in items if self.rules[r][1][d : d + 1] == symbol}
                )
                if after not in self.states:
                    self.states[after] = len(self.states)
                    waiting.append(after)
                self.goto[(self.states[items], symbol)] = self.states[after]
        self.start = (0, None)

    def _closure(self, items: set) -> frozenset:
        found, waiting = set(items), list(items)
        while waiting:
            rule, dot = waiting.pop()
            for number, (head, _) in enumerate(self.rules):
                if head and self.rules[rule][1][dot : dot + 1] == head and (number, 0) not in found:
                    found.add((number, 0))
                    waiting.append((number, 0))
        return frozenset(found)

    def _follow(self) -> dict[str, set]:
        empty = {head for head, body in self.rules if not body}
        first = {head: set() for head, _ in self.rules}
        follow = {head: set() for head, _ in self.rules}
        follow[self.rules[0][1]].add("$")
        for _ in range(len(self.rules) ** 2):  # more rounds than sets can grow in
            for head, body in self.rules:
                for symbol in body:
                    first[head] |= first.get(symbol, {symbol})
                    if symbol not in empty:
                        break
                rest = set(follow[head])
                for symbol in reversed(body):
                    if symbol in first:
                        follow[symbol] |= rest
                    starts = first.get(symbol, {symbol})
                    rest = rest | starts if symbol in empty else set(starts)
        return follow

    def read(self, stack: tuple, symbol: str) -> list[tuple]:
        """The stacks after all reductions before ``symbol`` and its shift; for the end
        ``$`` the stack itself, once, if it is a whole sentence."""
        found, waiting = [], [stack]
        while waiting:
            top = waiting.pop()
            if symbol == "$" and (0, 1) in self.items[top[0]]:
                found.append(stack)
            elif (top[0], symbol) in self.goto:
                found.append((self.goto[(top[0], symbol)], top))
            for rule, dot in self.items[top[0]]:
                head, body = self.rules[rule]
                if rule and dot == len(body) and symbol in self.follow[head]:
                    below = top
                    for _ in body:
                        below = below[1]
                    waiting.append((self.goto[(below[0], head)], below))
        return list(dict.fromkeys(found))


def _better(best: dict, top: int, cost: int, audit: str) -> bool:
    """Merge equal stack tops: keep the least (cost, audit)."""
    if top in best and best[top] <= (cost, audit):
        return False
    best[top] = (cost, audit)
    return True


class Repairer:
    """The automaton's stacks numbered, with the tops that each edit leads to."""

    #: Stacks that a grammar may reach; a right-recursive one would reach ever more.
    MOST_STACKS = 256

    def __init__(self, rules: Sequence[tuple[str, str]] = tuple(GRAMMAR), roles: str = "".join(ROLES)):
        machine = Automaton(rules)
        self.letters = sorted({x for _, body in rules for x in body} - machine.heads)
        self.roles = roles
        stacks = {machine.start: 0}
        self.moves: list[dict[str, list[int]]] = []
        for stack in stacks_of(stacks):
            self.moves.append({})
            for letter in self.letters:
                reached = machine.read(stack, letter)
                for after in reached:
                    stacks.setdefault(after, len(stacks))
                self.moves[-1][letter] = [stacks[after] for after in reached]
            if len(stacks) > self.MOST_STACKS:
                raise ValueError("the grammar needs stacks without bound; write it left-recursively")
        self.tops = len(stacks)
        self.whole = [top for stack, top in stacks.items() if machine.read(stack, "$")]

    def _insert(self, best: dict) -> dict:
        """``best`` and all that inserted turns make of it."""
        waiting = sorted(best)
        while waiting:
            top = waiting.pop(0)
            cost, audit = best[top]
            for letter in self.roles:
                for after in self.moves[top].get(letter, ()):
                    if _better(best, after, cost + INSERT, audit + "I"):
                        waiting.append(after)
        return best

    def parse(self, entry: int, rows: Sequence[tuple[str, int]]) -> dict[int, tuple[int, str]]:
        """Stack tops after ``rows`` (initial, treatment), each with its least
        (cost, audit), starting from ``entry``."""
        best = self._insert({entry: (0, "")})
        for initial, kind in rows:
            after: dict[int, tuple[int, str]] = {}
            price = TRUNCATED if kind == DEAR else 0
            for top, (cost, audit) in best.items():
                _better(after, top, cost + DELETE, audit + "D")
                if kind == DOOMED:
                    continue
                for to in self.moves[top].get(initial, ()):
                    _better(after, to, cost + price, audit + "K")
                for letter in self.roles:
                    for to in self.moves[top].get(letter, ()):
                        _better(after, to, cost + price + REROLE, audit + "R")
            best = self._insert(after)
        return best

    @staticmethod
    def chain(first: dict, then: dict) -> dict:
        """Two neighbouring segments as one: {entry: {top: (cost, audit)}}."""
        out: dict = {}
        for entry, middles in first.items():
            best: dict = {}
            for middle, (cost, audit) in middles.items():
                for top, (more, rest) in then[middle].items():
                    _better(best, top, cost + more, audit + rest)
            out[entry] = best
        return out

    def finish(self, best: dict) -> tuple[int, str]:
        return min(best[top] for top in self.whole if top in best)


def stacks_of(stacks: dict) -> Iterator[tuple]:
    """The keys of a dict that grows while they are read."""
    done = 0
    while done < len(stacks):
        yield list(stacks)[done]
        done += 1


@functools.cache
def repairer() -> Repairer:
    return Repairer()


# --- rows -----------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """A test table: (conv_id, turn, role, text) with faults put in by a checksum of
    conv_id and turn; nulls count as one space, but for the order of turns."""
    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    key = F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")
    draw = F.crc32(key) % 20
    text = (
        F.when(draw == 1, F.lit(""))
        .when(draw == 2, F.translate(said("text"), ".!?", ""))
        .otherwise(said("text"))
    )
    return (
        rows.select(
            "conv_id", "turn",
            F.when(draw == 4, F.lit("user")).otherwise(said("role")).alias("role"),
            text.alias("text"),
            draw.alias("draw"),
        )
        .where(F.col("draw") != 0)
        .withColumn("copy", F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", "role", "text")
    )


def _segments(pdfs: Iterator[pd.DataFrame]) -> Iterator[list]:
    """Lists of row tuples, one per run of equal (conv, segment); sorted input."""
    held: list = []
    for pdf in pdfs:
        for row in zip(*(pdf[c].tolist() for c in ("conv", "segment", "spans", "first", "initial", "kind"))):
            if held and held[0][:2] != row[:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


PARSED = (
    "conv string, segment bigint, spans boolean, first bigint, n bigint, head string, tail string,"
    " illegal bigint, entry int, top int, cost bigint, audit string"
)


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:]))


def _parse(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A conversation in one segment is parsed to its end; of others, every segment is
    parsed from every stack top it may be entered with."""
    made = repairer()
    out: list[tuple] = []
    for held in _segments(pdfs):
        conv, segment, spans, first = held[0][:4]
        rows = [(r[4], r[5]) for r in held]
        initials = [r[4] for r in held]
        common = (conv, segment, spans, first, len(held), initials[0], initials[-1], _illegal(initials))
        if spans:
            for entry in range(made.tops):
                for top, (cost, audit) in made.parse(entry, rows).items():
                    out.append((*common, entry, top, cost, audit))
        else:
            cost, audit = made.finish(made.parse(0, rows))
            out.append((*common, 0, -1, cost, audit))
        if len(out) >= 2000:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PARSED.split(", ")])
            out = []
    yield pd.DataFrame(out, columns=[c.split()[0] for c in PARSED.split(", ")])


CHOSEN = (
    "conv string, illegal bigint, cost bigint, audit string,"
    " pieces array<struct<first:bigint,out:bigint,audit:string>>"
)


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The segments of one long conversation, chained pairwise, and the least audit cut
    into a piece per segment.  Holds some bytes per turn, no texts."""
    made = repairer()
    parts = [part for _, part in pdf.sort_values("segment").groupby("segment", sort=True)]
    tables = []
    for part in parts:
        table: dict = {}
        for entry, top, cost, audit in zip(part["entry"], part["top"], part["cost"], part["audit"]):
            table.setdefault(entry, {})[top] = (cost, audit)
        tables.append(table)
    while len(tables) > 1:
        pairs = [made.chain(a, b) for a, b in zip(tables[::2], tables[1::2])]
        tables = pairs + tables[len(pairs) * 2 :]
    cost, audit = made.finish(tables[0][0])
    edges = [(p["tail"].iloc[0], q["head"].iloc[0]) for p, q in zip(parts, parts[1:])]
    illegal = sum(int(p["illegal"].iloc[0]) for p in parts) + sum(_illegal(list(e)) for e in edges)
    pieces, at, kept = [], 0, 0
    for number, part in enumerate(parts):
        n, end, rows = int(part["n"].iloc[0]), at, 0
        while end < len(audit) and (rows < n or number == len(parts) - 1):
            rows += audit[end] != "I"
            end += 1
        piece = audit[at:end]
        pieces.append({"first": int(part["first"].iloc[0]), "out": kept, "audit": piece})
        kept += len(piece) - piece.count("D")
        at = end
    return pd.DataFrame([(pdf["conv"].iloc[0], illegal, cost, audit, pieces)], columns=["conv", "illegal", "cost", "audit", "pieces"])


EDITS = "conv string, place bigint, at bigint, action string, role string"


def _edits(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns that stay, piece by piece: their place, their row and their role ('' when
    the row's own role is kept)."""
    for pdf in pdfs:
        if not len(pdf):
            continue
        # All pieces as one text of letters; sums start anew where a piece starts.
        sizes = pdf["audit"].str.len().to_numpy()
        letters = np.frombuffer("".join(pdf["audit"]).encode(), np.uint8)
        starts = np.cumsum(sizes) - sizes

        def count(what: np.ndarray, offset: pd.Series) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(what)])
            return total[1:] - 1 - np.repeat(total[starts] - offset.to_numpy(), sizes)

        stays = letters != ord("D")
        rows, place = count(letters != ord("I"), pdf["first"])[stays], count(stays, pdf["out"])[stays]
        action = letters[stays]
        system = np.repeat(pdf["system"].to_numpy(bool), sizes)[stays]
        new = np.where((place - system) % 2 == 0, ROLES["u"], ROLES["a"])
        yield pd.DataFrame({
            "conv": np.repeat(pdf["conv"].to_numpy(), sizes)[stays], "place": place, "at": rows,
            "action": np.array(["D", "I", "K", "R"])[np.searchsorted(np.frombuffer(b"DIKR", np.uint8), action)],
            "role": np.where(action == ord("K"), "", new),
        })


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair conversations given as (conv_id, turn, role, text) rows.

    Returns two tables.  Per conversation: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit.  Per turn that stays: conv_id, place (from 0), action (K, R or
    I), role, text.

    Rows of a conversation are taken by turn (nulls first), then role and text; a null
    conv_id is a conversation, null roles and texts count as one space.  Equal rows are
    a turn and its duplicates.  A conversation may become empty.  An empty table gives
    two empty ones.  Other columns of ``rows`` are left out, so their names don't matter.

    Turns are sorted in ranges, so a conversation of any length is spread over tasks; it
    is parsed in segments of ``SEGMENT`` rows, from every possible stack top, and the
    segments are chained by their tables.  Parsing sees role initials and faults, never
    texts.  One row holds a conversation's audit, a byte per turn.
    """
    taken = rows.select(
        F.col("conv_id"),
        coded(F.col("conv_id")).alias("conv"),
        F.col("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    placed = in_order(taken, ["conv", "turn", "role", "text"], "turns")
    words = F.btrim("text", F.lit(SPACE))
    slim = materialize(
        placed.select(
            "conv", "conv_id", "turn", AT,
            F.substring("role", 1, 1).alias("initial"),
            F.sha2(F.concat(coded(F.col("role")), F.col("text")), 256).alias("said"),
            (words == "").alias("blank"),
            F.coalesce(~F.substring(words, -1, 1).isin(".", "!", "?"), F.lit(False)).alias("open"),
        ),
        "turn-facts",
    )
    # What was said more than once, and where first: one row per repeated turn.
    repeated = materialize(
        slim.where(~F.col("blank")).groupBy("conv", "said").agg(F.min(AT).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1).drop("_n"),
        "repeated",
    )
    judged = slim.join(repeated, ["conv", "said"], "left").withColumn(
        "duplicate", ~F.col("blank") & F.coalesce(F.col(AT) > F.col("_first"), F.lit(False))
    )
    judged = materialize(
        judged.select(
            "conv", "conv_id", "turn", AT, "initial", "blank", "duplicate",
            (F.col("open") & ~F.col("blank") & ~F.col("duplicate")).alias("truncated"),
        ),
        "judged",
    )
    # The turns are combined one by one first: many rows of one turn count once.
    facts = (
        judged.groupBy("conv", "turn")
        .agg(
            F.first("conv_id").alias("conv_id"), F.min(AT).alias("low"), F.max(AT).alias("high"),
            *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")],
        )
        .groupBy("conv")
        .agg(
            F.first("conv_id").alias("conv_id"), F.min("low").alias("low"), F.max("high").alias("high"),
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
            *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        )
    )
    facts = materialize(facts, "facts")
    segment = F.floor(F.col(AT) / SEGMENT)
    cut = facts.where(F.floor(F.col("low") / SEGMENT) != F.floor(F.col("high") / SEGMENT)).select("conv", F.lit(True).alias("spans"))
    kind = (
        F.when(F.col("blank") | F.col("duplicate"), DOOMED).when(F.col("truncated"), DEAR).otherwise(FREE)
    )
    states = judged.select("conv", segment.alias("segment"), F.col(AT).alias("first"), "initial", kind.alias("kind"))
    states = states.join(materialize(cut, "cut"), "conv", "left").select(
        "conv", "segment", F.coalesce("spans", F.lit(False)).alias("spans"), "first", "initial", "kind"
    )
    parsed = materialize(
        states.repartition("conv", "segment").sortWithinPartitions("conv", "segment", "first").mapInPandas(_parse, PARSED),
        "parsed",
    )
    single = parsed.where(~F.col("spans"))
    long = materialize(parsed.where("spans").groupBy("conv").applyInPandas(_chain, CHOSEN), "chained")
    results = ("conv", "illegal", "cost", "audit")
    outcome = single.select(*results).unionByName(long.select(*results))
    cuts = long.select("conv", F.explode("pieces").alias("p")).select("conv", "p.first", "p.out", "p.audit")
    pieces = single.select("conv", "first", F.lit(0).cast("long").alias("out"), "audit").unionByName(cuts)
    # A system turn leads where the first turn that stays is kept and has that initial.
    plain = F.regexp_replace("audit", "^D*", "")
    opens = pieces.where((F.col("out") == 0) & plain.startswith("K")).select(
        "conv", (F.col("first") + F.length("audit") - F.length(plain)).alias(AT)
    )
    systems = judged.where(F.col("initial") == "s").select("conv", AT)
    led = materialize(opens.join(systems, ["conv", AT]).select("conv", F.lit(True).alias("led")), "led")
    pieces = pieces.join(led, "conv", "left").withColumn("system", F.coalesce("led", F.lit(False)))
    edits = pieces.select("conv", "first", "out", "system", "audit").mapInPandas(_edits, EDITS)
    edits = materialize(edits, "edits")
    texts = placed.select(F.col(AT).alias("at"), F.col("role").alias("own"), "text")
    stay = edits.where(F.col("action") != "I").join(texts, "at").select(
        "conv", "place", "action", F.when(F.col("role") == "", F.col("own")).otherwise(F.col("role")).alias("role"), "text"
    ).unionByName(edits.where(F.col("action") == "I").select("conv", "place", "action", "role", F.lit("").alias("text")))
    names = facts.select("conv", "conv_id")
    per_conversation = facts.drop("low", "high").join(outcome, "conv").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )
    return per_conversation, stay.join(names, "conv").select("conv_id", "place", "action", "role", "text")


def _digest(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the lines of each conversation, taken up line by line."""
    import hashlib

    current, state, done = None, None, []
    for pdf in pdfs:
        for conv, line in zip(pdf["conv"].tolist(), pdf["line"].tolist()):
            if conv == current:
                state.update(b"\n")
            else:
                if state is not None:
                    done.append((current, state.hexdigest()))
                current, state = conv, hashlib.sha256()
            state.update(line.encode("utf-8", "surrogatepass"))
    if state is not None:
        done.append((current, state.hexdigest()))
    yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of repaired turns, ``role:text`` lines joined by line
    ends.  The hash runs over a conversation from its first to its last byte, so one
    task reads a conversation's turns, but holds a batch of them."""
    lines = turns.select(coded(F.col("conv_id")).alias("conv"), "place", F.concat("role", F.lit(":"), "text").alias("line"))
    return (
        lines.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "line")
        .mapInPandas(_digest, "conv string, repaired_sha256 string")
    )
