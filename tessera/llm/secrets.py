"""Secret scan with one combined deterministic automaton (operator 4).

All rule regexes are compiled together: parsed to an NFA, determinised by
subset construction, minimised by partition refinement and stored as one
transition array.  A batch of texts is cut into lanes at bytes on which the
automaton is back in its start state whatever came before (so no match crosses
a cut), and all lanes are stepped together, one byte at a time; an accepting
state is absorbing, so a lane's last state says whether any rule matched in it.
Only such lanes are walked again, with each rule's own minimal automaton, to
get the leftmost-longest non-overlapping spans.  The combined automaton holds
each rule up to its ``core`` (a prefix that every counting match has): long
counted repeats of several rules would multiply its states, and what follows
the core is read by the rule's own automaton.

Cases: a null or empty text has no spans; repeated rows are scanned one by one;
an empty table gives an empty table; other columns are not read.  Offsets are
code points, end exclusive.  There is no shuffle: one pass over the texts, in
time linear in their length (``Scanner.spans``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sc
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

LANE_BYTES = 512
SLICE = 1 << 22


def any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


class Rule:
    """``scan`` finds spans (leftmost, longest); the match counts if ``keep``
    holds for its length, or for the length of what follows ``head``."""

    def __init__(self, kind: str, scan: str, least: int = 0, head: str = "", core: str = ""):
        self.kind, self.scan, self.least = kind, scan, least
        self.head = re.compile(head.encode()) if head else None
        self.core = core or scan          # a prefix of every match that counts: what the combined automaton looks for

    def counts(self, match: bytes) -> bool:
        skip = self.head.match(match).end() if self.head else 0
        return len(match) - skip >= self.least


_KEYS = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + any_case("api") + "_?" + any_case("key")
_SEP = "[\"']?\\x20*[:=]\\x20*[\"']?"
_VALUE = "[A-Za-z0-9+/_.=-]"
BASE_RULES = [
    Rule("assign", f"({_KEYS}){_SEP}{_VALUE}+", 6, f"({_KEYS}){_SEP}", core=f"({_KEYS}){_SEP}{_VALUE}"),
    Rule("access", "AKIA[A-Z0-9]+", 20, core="AKIA[A-Z0-9]{4}"),
    Rule("hex", "[0-9a-f]+", 24, core="[0-9a-f]{16}"),
]
MORE_RULES = [
    Rule("private_key", "-----BEGIN ([A-Z]+ )?PRIVATE KEY-----"),
    Rule("forge_token", "gh[pousr]_[A-Za-z0-9]{36,}", core="gh[pousr]_[A-Za-z0-9]"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}", core="xox[abprs]-[A-Za-z0-9-]"),
    Rule("web_token", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", core="eyJ[A-Za-z0-9_-]+[.]eyJ"),
    Rule("live_key", "sk_live_[0-9a-zA-Z]{16,}", core="sk_live_[0-9a-zA-Z]"),
]
RULES = BASE_RULES + MORE_RULES


class Nfa:
    """Thompson construction over bytes from a parsed ASCII regex."""

    def __init__(self):
        self.free: list[list[int]] = []                          # epsilon edges
        self.step: list[list[tuple[np.ndarray, int]]] = []       # byte-set edges

    def state(self) -> int:
        self.free.append([])
        self.step.append([])
        return len(self.free) - 1

    def add(self, tree, at: int, back: bool = False) -> int:
        """Append ``tree`` (``back``: read from right to left) after state ``at``;
        returns the state behind it."""
        for op, arg in reversed(tree) if back else tree:
            if op in (sc.LITERAL, sc.IN, sc.ANY):
                to = self.state()
                self.step[at].append((_bytes(op, arg), to))
                at = to
            elif op is sc.SUBPATTERN:
                at = self.add(arg[3], at, back)
            elif op is sc.BRANCH:
                end = self.state()
                for way in arg[1]:
                    self.free[self.add(way, self._after(at), back)].append(end)
                at = end
            elif op is sc.MAX_REPEAT:
                lo, hi, sub = arg
                for _ in range(lo):
                    at = self.add(sub, at, back)
                if hi is sc.MAXREPEAT:
                    loop = self._after(at)
                    self.free[self.add(sub, loop, back)].append(loop)
                    at = self._after(loop)
                else:
                    end = self.state()
                    for _ in range(hi - lo):
                        self.free[at].append(end)
                        at = self.add(sub, at, back)
                    self.free[at].append(end)
                    at = end
            else:
                raise ValueError(f"not supported in a rule: {op}")
        return at

    def _after(self, at: int) -> int:
        to = self.state()
        self.free[at].append(to)
        return to

    def closure(self, state: int) -> int:
        """States reachable from ``state`` without a byte, as a bit set; only
        those with byte edges or without any edge (ends) matter."""
        seen, todo = {state}, [state]
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return sum(1 << s for s in seen if self.step[s] or not self.free[s])


def _bytes(op, arg) -> np.ndarray:
    m = np.zeros(256, bool)
    if op is sc.LITERAL:
        m[arg] = True
    elif op is sc.ANY:
        m[:] = True
        m[10] = False
    else:
        invert = arg[0][0] is sc.NEGATE
        for kind, x in arg[invert:]:
            if kind is sc.LITERAL:
                m[x] = True
            elif kind is sc.RANGE:
                m[x[0]:x[1] + 1] = True
            else:
                raise ValueError(f"not supported in a rule: {kind}")
        if invert:
            m = ~m
    return m


class Dfa:
    """``move[state, byte_class[byte]]`` is the next state; state 0 is the
    start; ``accept[state]`` is a bit mask of rules; ``dead`` has no way out."""

    def __init__(self, patterns: list[str], anchored: bool, back: bool = False):
        nfa = Nfa()
        root = nfa.state()
        if not anchored:
            nfa.step[root].append((np.ones(256, bool), root))
        ends = {}
        for i, p in enumerate(patterns):
            ends[nfa.add(_parser.parse(p), nfa._after(root), back)] = 1 << i
        sets = np.array([m for edges in nfa.step for m, _ in edges])
        _, first, self.byte_class = np.unique(sets, axis=1, return_index=True, return_inverse=True)
        self.byte_class = self.byte_class.reshape(-1).astype(np.uint8)
        move, accept = self._subsets(nfa, root, ends, first, absorbing=not anchored and not back)
        self.move, self.accept = self._minimise(move, accept)
        loops = (self.move == np.arange(len(self.move))[:, None]).all(1)
        self.dead = loops & (self.accept == 0)

    @staticmethod
    def _subsets(nfa: Nfa, root: int, ends: dict, sample: np.ndarray, absorbing: bool):
        """Subset construction; sets of NFA states are bit sets."""
        after = [[0] * len(sample) for _ in nfa.step]
        for s, edges in enumerate(nfa.step):
            for m, to in edges:
                reach = nfa.closure(to)
                for j in np.flatnonzero(m[sample]).tolist():
                    after[s][j] |= reach
        begin = nfa.closure(root)
        names, move, accept, todo = {begin: 0}, [], [], [begin]
        for states in todo:                       # grows while it is read
            members = [i for i in range(states.bit_length()) if states >> i & 1]
            mask = 0
            for s in members:
                mask |= ends.get(s, 0)
            accept.append(mask)
            if absorbing and mask:
                move.append([names[states]] * len(sample))
                continue
            row = [0] * len(sample)
            for s in members:
                row = [x | y for x, y in zip(row, after[s])]
            for to in row:
                if to not in names:
                    names[to] = len(names)
                    todo.append(to)
            move.append([names[to] for to in row])
        return np.array(move, np.int64), np.array(accept, np.int64)

    @staticmethod
    def _minimise(move: np.ndarray, accept: np.ndarray):
        """Refine the partition by accept mask until successors agree."""
        part = np.unique(accept, return_inverse=True)[1].reshape(-1)
        while True:
            key = np.column_stack([part, part[move]])
            new = np.unique(key, axis=0, return_inverse=True)[1].reshape(-1)
            if new.max() == part.max():
                break
            part = new
        _, rep = np.unique(part, return_index=True)
        rank = np.argsort(np.argsort(rep))         # the start state's class first
        order = rep[np.argsort(rep)]
        return rank[part[move[order]]], accept[order]

    def resets(self) -> np.ndarray:
        """Bytes after which every state that has not accepted is the start."""
        live = self.accept == 0
        return (self.move[live] == 0).all(0)[self.byte_class]


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        whole = Dfa([r.core for r in rules], anchored=False)
        self.byte_class, self.reset = whole.byte_class, whole.resets()
        self.classes = whole.move.shape[1]
        self.move = (whole.move * self.classes).astype(np.int32).reshape(-1)   # next state's row
        self.hit = np.flatnonzero(whole.accept)
        self.states = len(whole.move)
        self.own = [Dfa([r.scan], anchored=True) for r in rules]
        self.walk = [(d.move.tolist(), d.byte_class.tolist(), d.accept.tolist(), d.dead.tolist()) for d in self.own]
        self.back: dict[int, tuple] = {}          # reversed automata, made when needed
        self.begins = [~d.dead[d.move[0]][d.byte_class] for d in self.own]

    def lanes(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.flatnonzero(self.reset[buf]) + 1
        grid = np.searchsorted(after, np.arange(LANE_BYTES, len(buf), LANE_BYTES))
        cuts = np.unique(np.concatenate([offs[:-1], after[grid[grid < len(after)]]]))
        cuts = cuts[cuts < len(buf)]
        return cuts, np.append(cuts[1:], len(buf))

    def flagged(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which lanes hold a match: one step of the automaton a byte, all lanes at once."""
        order = np.argsort(start - end, kind="stable")
        at, size = start[order], (end - start)[order]
        code = self.byte_class[buf]
        state = np.zeros(len(order), np.int32)
        live = len(order)
        alive = np.searchsorted(-size, -np.arange(size[0]) if len(size) else [], "left")
        for t in range(len(alive)):
            live = alive[t]
            np.take(self.move, state[:live] + code[at[:live] + t], out=state[:live])
        out = np.zeros(len(order), bool)
        out[order] = np.isin(state // self.classes, self.hit)
        return out

    def starts(self, i: int, text: bytes) -> list[int]:
        """Where matches of a rule start: one pass of the reversed automaton from
        the right, which accepts at p if some match begins there."""
        if i not in self.back:
            d = Dfa([self.rules[i].scan], anchored=False, back=True)
            self.back[i] = d.move.tolist(), d.byte_class.tolist(), d.accept.tolist()
        move, code, accept = self.back[i]
        s, out = 0, []
        for p in range(len(text) - 1, -1, -1):
            s = move[s][code[text[p]]]
            if accept[s]:
                out.append(p)
        return out[::-1]

    def _walk(self, i: int, text: bytes, begin: list[int], budget: int) -> list[tuple[int, int, int]] | None:
        """Leftmost-longest matches of a rule from the places ``begin``; None if
        that takes more than ``budget`` steps."""
        move, code, accept, dead = self.walk[i]
        done, found = 0, []
        for p in begin:
            if p < done:
                continue
            s, last = 0, -1
            for q in range(p, len(text)):
                s = move[s][code[text[q]]]
                if dead[s]:
                    break
                if accept[s]:
                    last = q + 1
            budget -= q - p
            if budget < 0:
                return None
            if last > 0:
                done = last
                if self.rules[i].counts(text[p:last]):
                    found.append((p, i, last))
        return found

    def spans(self, lane: np.ndarray) -> list[tuple[int, int, int]]:
        """``(start, rule, end)`` of each rule's spans in a lane (byte offsets).
        Where trying every possible start comes to cost more than a few passes, the
        real starts are found from the right first, so that no try is in vain."""
        text, found = lane.tobytes(), []
        for i in range(len(self.rules)):
            begin = np.flatnonzero(self.begins[i][lane]).tolist()
            if not begin:
                continue
            got = self._walk(i, text, begin, 16 * len(text) + 4096)
            found += got if got is not None else self._walk(i, text, self.starts(i, text), 1 << 62)
        return found

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Sorted spans of each text, in code points."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offs) - 1)]
        start, end = self.lanes(buf, offs)
        if not len(start):
            return out
        hits = np.flatnonzero(self.flagged(buf, start, end))
        rows = np.searchsorted(offs, start[hits], "right") - 1
        for r in np.unique(rows).tolist():
            base = offs[r]
            points = np.concatenate([[0], np.cumsum((buf[base:offs[r + 1]] & 0xC0) != 0x80)])
            for k in hits[rows == r].tolist():
                shift = start[k] - base
                out[r] += [(int(points[shift + p]), i, int(points[shift + q])) for p, i, q in self.spans(buf[start[k]:end[k]])]
            out[r].sort()
        return out


SPAN = "array<struct<start:bigint,kind:string,end:bigint>>"


def scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, spans)``: all spans of all rules in each text, by start and
    then in the order of the rules."""
    rules = RULES if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kinds = [r.kind for r in rules]
        kind = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(1), SLICE):
                found = [[(p, kinds[i], q) for p, i, q in row] for row in scanner.scan(buf, offs)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([[{"start": p, "kind": k, "end": q} for p, k, q in row] for row in found], pa.list_(kind))],
                    names=[id_col, "spans"])

    d = docs.select(id_col, text_col)
    return d.mapInArrow(run, f"`{id_col}` {d.schema[id_col].dataType.simpleString()}, spans {SPAN}")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans."""
    base = [r.kind for r in BASE_RULES]
    s = scan(docs)

    def of(kinds: list[str]) -> Column:
        return F.filter("spans", lambda x: x["kind"].isin(kinds))

    n = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in base]
    digest = F.sha2(joined(of(base)), 256)
    return s.select("doc_id", *n, digest.alias("base_sha256"), joined(F.col("spans")).alias("spans"))
