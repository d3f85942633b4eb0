"""Secret scans with one combined deterministic automaton.

The rules' regular expressions are compiled to one nondeterministic automaton over bytes, made
deterministic by subset construction, minimised, and kept as two arrays: next state by (state, byte)
and the rules that accept in a state. One pass over the bytes of a batch of texts then finds the places
of all rules. Bytes after which every state is the start state cut the batch into strips, which
advance together, one array step per byte column, so no Python code runs per byte.

A rule ends in a repeated class or a literal; the accepting places of a match are its tail, whose
length the rule bounds below. The start of a match is found by the automaton of the reversed rule.

Own rules may use groups (also ``(?:``), alternatives, ``? * + {m} {m,} {m,n} {,n}``, classes, negated classes, ``.`` and the
escapes ``\\d \\w \\s \\D \\W \\S \\n \\r \\t \\f \\v \\a \\xHH`` with the meaning of ``re`` with ``re.ASCII``; any other construct
(anchors, ``\\b``, lazy repeats, look-around, characters beyond ASCII in classes) is a ValueError. Matches of rules with
negated classes, ``.``, class escapes or counts are the leftmost, longest ones that do not overlap.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    min_tail: int
    any_case: bool = False
    base: bool = False


# The three base rules, then the rules this operator adds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
         8, any_case=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 12, base=True),
    Rule("hex", r"[0-9a-f]+", 32, base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 36),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 10),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 16),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
)


ASCII = frozenset(range(128))
DIGITS, SPACES = frozenset(b"0123456789"), frozenset(b" \t\n\r\f\v")
WORDS = DIGITS | frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
CLASSES = {"d": DIGITS, "w": WORDS, "s": SPACES, "D": ASCII - DIGITS, "W": ASCII - WORDS, "S": ASCII - SPACES}
CONTROLS = {"n": 10, "r": 13, "t": 9, "f": 12, "v": 11, "a": 7}
_NEXT = ("set", frozenset(range(0x80, 0xC0)))
# A character beyond ASCII in UTF-8.
BEYOND = ("or", ("cat", ("set", frozenset(range(0xC2, 0xE0))), _NEXT),
          ("cat", ("set", frozenset(range(0xE0, 0xF0))), _NEXT, _NEXT),
          ("cat", ("set", frozenset(range(0xF0, 0xF5))), _NEXT, _NEXT, _NEXT))
COUNT = re.compile(r"\{(\d*)(,?)(\d*)\}", re.ASCII)


class Parser:
    """A regular expression as nested tuples: ("set", bytes), ("cat", ...), ("or", ...), ("rep", x, low, high).

    ``general`` tells whether it has constructs whose accepting places need not be the tail of one match.
    """

    def __init__(self, pattern: str, any_case: bool):
        self.text, self.at, self.any_case, self.general = pattern, 0, any_case, False

    def parse(self) -> tuple:
        tree = self.alternatives()
        if self.at != len(self.text):
            raise self.error("unexpected character")
        return tree

    def error(self, what: str) -> ValueError:
        return ValueError(f"{what} at {self.at} in {self.text!r}")

    def peek(self) -> str:
        return self.text[self.at:self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise self.error("unexpected end")
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self) -> tuple:
        arms = [self.sequence()]
        while self.peek() == "|":
            self.take()
            arms.append(self.sequence())
        return arms[0] if len(arms) == 1 else ("or", *arms)

    def sequence(self) -> tuple:
        parts = []
        while self.peek() and self.peek() not in "|)":
            part = self.atom()
            if (op := self.peek()) and op in "?*+":
                self.take()
                part = ("rep", part, int(op == "+"), 1 if op == "?" else None)
            elif op == "{":
                part = self.counted(part)
            if self.peek() and self.peek() in "?*+{" and self.text[self.at - 1] in "?*+}" and part[0] == "rep":
                raise self.error("repeat of a repeat is not supported")
            parts.append(part)
        return ("cat", *parts)

    def counted(self, part: tuple) -> tuple:
        found = COUNT.match(self.text, self.at)
        if not found or not (found[1] or found[3]):
            raise self.error("no count; a brace is written with a backslash")
        low = int(found[1] or 0)
        high = low if not found[2] else int(found[3]) if found[3] else None
        if high is not None and high < max(low, 1):
            raise self.error("count without a match")
        self.at, self.general = found.end(), True
        if self.peek() and self.peek() in "?*+{":
            raise self.error("repeat of a repeat is not supported")
        more = [("rep", part, 0, None)] if high is None else [("rep", part, 0, 1)] * (high - low)
        return ("cat", *[part] * low, *more)

    def atom(self) -> tuple:
        c = self.take()
        if c == "(":
            if self.peek() == "?":
                if self.text[self.at:self.at + 2] != "?:":
                    raise self.error("group is not supported")
                self.at += 2
            tree = self.alternatives()
            if self.take() != ")":
                raise self.error("open group")
            return tree
        if c in "^$?*+{":
            raise self.error(f"{c!r} is not supported here")
        if c == ".":
            return self.beyond(ASCII - {10})
        if c == "[":
            return self.members()
        if c == "\\" and self.peek() and self.peek() in CLASSES:
            self.general = True
            return self.chosen(self.take())
        code = self.literal(c)
        if code < 128:
            return ("set", self.fold({code}))
        if self.any_case:
            raise self.error("characters beyond ASCII are not supported in any case")
        return ("cat", *[("set", frozenset([b])) for b in chr(code).encode("utf-8", "surrogatepass")])

    def beyond(self, chosen: frozenset) -> tuple:
        """These or a character beyond ASCII."""
        self.general = True
        return ("or", ("set", chosen), BEYOND)

    def chosen(self, name: str) -> tuple:
        return self.beyond(CLASSES[name]) if name.isupper() else ("set", CLASSES[name])

    def members(self) -> tuple:
        negated = self.peek() == "^"
        self.at += negated
        chosen, wide, start = set(), False, self.at
        while self.peek() != "]" or self.at == start:
            c = self.take()
            if c == "[" and self.peek() == ":":
                raise self.error("named class is not supported")
            if named := c == "\\" and self.peek() != "" and self.peek() in CLASSES:
                name = self.take()
                chosen |= CLASSES[name]
                wide |= name.isupper()
                self.general = True
            else:
                low = high = self.literal(c)
            if self.peek() == "-" and self.text[self.at + 1:self.at + 2] != "]":
                self.take()
                c = self.take()
                if named or c == "\\" and self.peek() != "" and self.peek() in CLASSES:
                    raise self.error("range of a class")
                high = self.literal(c)
                if high < low:
                    raise self.error("empty range")
            if not named:
                if high > 127:
                    raise self.error("characters beyond ASCII are not supported in classes")
                chosen |= set(range(low, high + 1))
        self.take()
        chosen = self.fold(chosen)
        if negated:
            return ("set", ASCII - chosen) if wide else self.beyond(ASCII - chosen)
        return self.beyond(chosen) if wide else ("set", chosen)

    def literal(self, c: str) -> int:
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            digits = self.take() + self.take()
            if not re.fullmatch("[0-9A-Fa-f]{2}", digits):
                raise self.error("no hexadecimal digits")
            return int(digits, 16)
        if c in CONTROLS:
            return CONTROLS[c]
        if c.isalnum():
            raise self.error(f"escape of {c!r} is not supported")
        return ord(c)

    def fold(self, chosen: set[int]) -> frozenset:
        if self.any_case:
            chosen = chosen | {ord(f(chr(b))) for b in chosen if chr(b).isalpha() for f in (str.lower, str.upper)}
        return frozenset(chosen)


def mirrored(tree: tuple) -> tuple:
    """The tree of the reversed language."""
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return ("rep", mirrored(tree[1]), *tree[2:])
    arms = [mirrored(x) for x in tree[1:]]
    return (tree[0], *(arms[::-1] if tree[0] == "cat" else arms))


class Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Adds a tree after a state; returns the state behind it."""
        kind = tree[0]
        if kind == "set":
            here, end = self.state(), self.state()
            self.empty[start].append(here)
            self.moves[here] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1:]:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for arm in tree[1:]:
                self.empty[self.add(arm, start)].append(end)
            return end
        _, part, low, high = tree
        loop, end = self.state(), self.state()
        self.empty[start].append(loop)
        behind = self.add(part, loop)
        self.empty[behind].append(end)
        if high is None:
            self.empty[behind].append(loop)
        if low == 0:
            self.empty[loop].append(end)
        return end

    def closure(self, states: set[int]) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Automaton:
    step: np.ndarray    # next state times 256, at (state times 256 + byte)
    accept: np.ndarray  # bit i: rule i accepts in this state
    reset: np.ndarray   # bytes after which every state is the start state
    dead: int           # the state that nothing leaves or accepts, or -1


def compile_rules(trees: list[tuple], anchored: bool = False) -> Automaton:
    """Subset construction over all rules at once, then partition refinement to the smallest automaton."""
    nfa = Nfa()
    root = nfa.state()
    ends = {nfa.add(tree, root): i for i, tree in enumerate(trees)}
    again = frozenset() if anchored else nfa.closure({root})
    subsets, order, rows = {nfa.closure({root}): 0}, [nfa.closure({root})], []
    while len(rows) < len(order):
        targets: list[set[int]] = [set() for _ in range(256)]
        for state in order[len(rows)]:
            if nfa.moves[state]:
                chosen, target = nfa.moves[state]
                for b in chosen:
                    targets[b].add(target)
        row, known = np.zeros(256, np.int64), {}
        for b in range(256):
            key = frozenset(targets[b])
            if key not in known:
                subset = nfa.closure(key) | again
                if subset not in subsets:
                    subsets[subset] = len(order)
                    order.append(subset)
                known[key] = subsets[subset]
            row[b] = known[key]
        rows.append(row)
    step = np.array(rows)
    accept = np.array([sum(1 << i for end, i in ends.items() if end in s) for s in order], np.int64)
    block = np.unique(accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    swap = np.arange(len(first))  # the start state is 0
    swap[[0, block[0]]] = swap[[block[0], 0]]
    step, accept = swap[block[step[first]]][swap], accept[first][swap]
    stuck = np.flatnonzero((step == np.arange(len(step))[:, None]).all(axis=1) & (accept == 0))
    return Automaton((step * 256).astype(np.int32).ravel(), accept.astype(np.uint8 if len(trees) <= 8 else np.int64),
                     (step == 0).all(axis=0), int(stuck[0]) * 256 if len(stuck) else -1)


def accepting(dfa: Automaton, data: np.ndarray, lanes: int = 4096) -> np.ndarray:
    """For each byte, the rules that accept after it: one pass in strips that advance together."""
    out = np.zeros(len(data), dfa.accept.dtype)
    if not len(data):
        return out
    resets = np.flatnonzero(dfa.reset[data])
    wanted = np.linspace(0, len(data), max(1, min(lanes, len(data) // 64)) + 1)[1:-1]
    at = np.searchsorted(resets, wanted)
    cuts = np.unique(np.concatenate([[0], resets[at[at < len(resets)]] + 1, [len(data)]]))
    starts, lengths = cuts[:-1], np.diff(cuts)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    state, step, accept = np.zeros(len(starts), np.int32), dfa.step, dfa.accept
    for t in range(int(lengths[0])):
        n = alive[t]
        place = starts[:n] + t
        now = step[state[:n] + data[place]]
        state[:n] = now
        out[place] = accept[now >> 8]
    return out


def longest(dfa: Automaton, data: bytes, end: int, low: int) -> int:
    """Start of the longest match of a reversed rule that ends at this byte, not before ``low``."""
    state, found = 0, end
    for i in range(end, low - 1, -1):
        state = int(dfa.step[state + data[i]])
        if state == dfa.dead:
            break
        if dfa.accept[state >> 8]:
            found = i
    return found


class Scanner:
    """The compiled rules: fixed size, compiled once by the driver and broadcast."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        parsers = [Parser(r.pattern, r.any_case) for r in rules]
        trees = [p.parse() for p in parsers]
        self.rules, self.dfa = rules, compile_rules(trees)
        for i, rule in enumerate(rules):
            if int(self.dfa.accept[0]) >> i & 1:
                raise ValueError(f"{rule.pattern!r} matches the empty text")
        self.general = {i: (compile_rules([mirrored(t)]), compile_rules([t], anchored=True))
                        for i, (p, t) in enumerate(zip(parsers, trees)) if p.general}
        self.back = [compile_rules([mirrored(t)], anchored=True) for t in trees]
        self.bare = [t[0] == "cat" and len(t) == 2 for t in trees]

    def scan(self, texts: list[str]) -> Iterator[tuple[list, list]]:
        """For each text: base spans, all spans; (start, rule number, end) in code points, sorted."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        joined = b"\xff".join(raw) + b"\xff"  # a byte that is in no text and no rule
        data = np.frombuffer(joined, np.uint8)
        masks = accepting(self.dfa, data)
        ends = np.cumsum([len(r) + 1 for r in raw])
        found: dict[int, dict] = {}
        for i, rule in enumerate(self.rules):
            hit = np.flatnonzero(masks & (1 << i))
            if not len(hit):
                continue
            if i in self.general:
                for o in np.unique(np.searchsorted(ends, hit, side="right")).tolist():
                    for start, end in self.leftmost(i, raw[o], int(ends[o]) - len(raw[o]) - 1):
                        found.setdefault(o, {})[(start, i, end)] = rule.base
                continue
            new = np.flatnonzero(np.diff(hit) > 1) + 1
            first, last = hit[np.concatenate([[0], new])], hit[np.concatenate([new - 1, [len(hit) - 1]])]
            if self.bare[i]:  # the tail is the match, so short ones hide nothing
                good = last - first + 1 >= rule.min_tail
                first, last = first[good], last[good]
            owner = np.searchsorted(ends, first, side="right")
            done, current, resumed = 0, -1, False
            for f, t, o in zip(first.tolist(), last.tolist(), owner.tolist()):
                if o != current:
                    done, current, resumed = int(ends[o]) - len(raw[o]) - 1, o, False
                start = f if self.bare[i] else longest(self.back[i], joined, f, int(ends[o]) - len(raw[o]) - 1)
                long = t - f + 1 >= rule.min_tail
                if start < done and not resumed:  # an earlier match hides this one; go on behind that
                    resumed = True
                    for span in self.behind(i, joined, done, int(ends[o]) - 1):
                        if span[3] >= rule.min_tail:
                            found.setdefault(o, {})[span[:3]] = rule.base
                apart = start >= done and not resumed
                if apart:
                    done = t + 1
                if long:
                    spans = found.setdefault(o, {})
                    spans[(start, i, t + 1)] = spans.get((start, i, t + 1), False) or (apart and rule.base)
        for o, r in enumerate(raw):
            spans = found.get(o)
            if not spans:
                yield [], []
                continue
            offset = int(ends[o]) - len(r) - 1
            count = np.concatenate([[0], np.cumsum((np.frombuffer(r, np.uint8) & 0xC0) != 0x80)])
            placed = sorted((int(count[s - offset]), i, int(count[e - offset]), base) for (s, i, e), base in spans.items())
            yield [x[:3] for x in placed if x[3]], [x[:3] for x in placed]

    def leftmost(self, i: int, data: bytes, offset: int) -> Iterator[tuple[int, int]]:
        """The leftmost, longest matches of a rule in one text that do not overlap, with a tail as long as it asks."""
        back, ahead = self.general[i]
        begins = np.flatnonzero(accepting(back, np.frombuffer(data, np.uint8)[::-1])[::-1])
        done = 0
        for start in begins.tolist():
            if start < done:
                continue
            state, first, at = 0, -1, start
            while at < len(data):
                state = int(ahead.step[state + data[at]])
                if state == ahead.dead:
                    break
                at += 1
                if ahead.accept[state >> 8]:
                    first, done = (at if first < 0 else first), at
            if done - first + 1 >= self.rules[i].min_tail:
                yield offset + start, offset + done

    def behind(self, i: int, data: bytes, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """A rule's matches from a byte on, each search beginning behind the last match: start, rule, end, tail."""
        state, bit, first = 0, 1 << i, -1
        low = start
        for at in range(start, end + 1):
            state = int(self.dfa.step[state + data[at]]) if at < end else 0
            if at < end and self.dfa.accept[state >> 8] & bit:
                first = at if first < 0 else first
            elif first >= 0:
                yield longest(self.back[i], data, first, low), i, at, at - first
                low, first = at, -1
                state = int(self.dfa.step[data[at]]) if at < end else 0


SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
          "matches array<struct<kind:string,start:int,end:int>>")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: tuple[Rule, ...] = RULES, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per input row: counts of the base kinds, digest of the base spans, all spans.

    Null texts count as empty and have no spans; rows may repeat and ids may be null. Base spans are the
    leftmost ones of a kind that do not overlap; a rule's further hits inside an earlier one and the
    spans of the other rules are in ``spans`` and ``matches`` only. A batch of texts is scanned in parts of
    about ``batch_bytes``; a text is never cut.
    """
    ship_package(df.sparkSession)
    compiled = df.sparkSession.sparkContext.broadcast(Scanner(rules))
    kinds = [r.kind for r in rules]
    out_schema = df.sparkSession.createDataFrame([], SCHEMA).schema
    out_schema["doc_id"].dataType = df.schema[id_col].dataType

    def parts(texts: list[str]) -> Iterator[list[str]]:
        part, size = [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= batch_bytes:
                yield part
                part, size = [], 0
        if part:
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = compiled.value
        for batch in batches:
            rows = []
            for part in parts([t or "" for t in batch.column(1).to_pylist()]):
                for base, every in scanner.scan(part):
                    text = lambda spans: ",".join(f"{kinds[i]}:{s}:{e}" for s, i, e in spans)
                    of = lambda kind: sum(kinds[i] == kind for _, i, _ in base)
                    rows.append((of("assign"), of("access"), of("hex"), hashlib.sha256(text(base).encode()).hexdigest(),
                                 text(every), [{"kind": kinds[i], "start": s, "end": e} for s, i, e in every]))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds_of = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.struct(
                [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds_of))],
                names=[f.name for f in out_schema])

    return df.select(id_col, text_col).mapInArrow(run, out_schema)
