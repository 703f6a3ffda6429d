"""Secret scans: fixed base patterns, and credential formats inferred as probabilistic automata.

Training (bounded, on the driver): labelled credentials, a list of (format, string). The strings of a
format form a prefix tree whose states are merged when a Hoeffding test finds their next-symbol and
stop frequencies compatible (ALERGIA). A symbol is the character itself within the head that the strings
of the format share (at most LITERAL places, in at most HEADS forms each seen twice on average) or if it is no letter or
digit, else its class; so the tree learns marks such as fixed heads and dots, and a format without a head by its classes,
separators and lengths.
Scanning: a candidate starts wherever a head of some format stands, for formats without one where a run of token
characters begins or behind a separator in it; it ends where the run ends or before a separator in it. Its score is its log-likelihood under the automaton (steps and
stop) and under the lengths of the labelled strings (a Gaussian of LENGTH_SHARE of the length around each,
so near lengths count too), against a string drawn evenly from 68 characters and 1,000 lengths, for formats without a head
against the runs of ordinary text; candidates that the best
automaton makes likelier by MARGIN are spans, of overlapping ones the likeliest (from one start the longest
whose length factor is within LENGTH_SLACK of the likeliest's). There is no least or
greatest length, and no character that a candidate must have.

Spans are kind:start:end in code points, end exclusive. For assign the span is the whole assignment,
name and value. Kinds, in order at equal starts: assign, access, hex, grammar.

Defined cases: a null text counts as empty and has no spans; base_sha256 is then the digest of the
empty string. Repeated rows stay; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, text_or_empty

# The base patterns of the scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "grammar")

#: Characters of a run, besides those of the labelled strings.
TOKEN = "+/_.=-" + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
SEPARATOR = re.compile(r"[^A-Za-z0-9]")
LITERAL, HEADS = 4, 8
#: Log-likelihood over even draws (of the 68 token characters, and of 1,000 lengths), in nats, that a candidate must reach.
MARGIN = 8.0
EVEN, EVEN_LENGTH = -math.log(68), -math.log(1_000)
#: What a format without a head is held against instead, since even draws would look like its keys: the runs of ordinary
#: text, by shares of small letters, digits, capitals and the six other characters, and a mean length of six.
PLAIN = {"a": math.log(0.80 / 26), "9": math.log(0.12 / 10), "A": math.log(0.06 / 26)}
PLAIN_OTHER, PLAIN_LENGTH = math.log(0.02 / 6), 6.0
#: Deviation of the length factor, as a share of a labelled length; one character at least.
LENGTH_SHARE = 0.05
LENGTH_SLACK = 1.0
#: Most labelled strings that are used in training, by format: those of least SHA-256. A bound of the driver's work.
MOST_LABELLED = 400


def shared_head(strings: Iterable[str]) -> int:
    """How many first characters are a head: the longest length at which the strings have few beginnings, each of several."""
    strings = list(strings)
    length = 0
    while length < LITERAL and len({s[: length + 1] for s in strings}) <= min(HEADS, len(strings) // 2):
        length += 1
    return length


def symbols(s: str, literal: int = LITERAL) -> list[str]:
    out = []
    for i, c in enumerate(s):
        if i < literal or not c.isalnum():
            out.append(c)
        else:
            out.append("9" if c.isdigit() else "a" if c.islower() else "A")
    return out


class Automaton:
    """A deterministic automaton with symbol and stop probabilities, and the lengths of its strings."""

    def __init__(self, states: list[tuple[dict[str, tuple[int, float]], float]], lengths: Iterable[int], alphabet: Iterable[str] = (), literal: int = LITERAL):
        self.states, self.alphabet, self.literal = states, frozenset(alphabet), literal
        seen = Counter(lengths)
        total = sum(seen.values())
        self.lengths = [(n, max(1.0, LENGTH_SHARE * n), math.log(k / total)) for n, k in sorted(seen.items())]
        self.by_length: dict[int, float] = {}
        #: No longer string can reach MARGIN: each character adds ``most`` at most, and the length factor falls faster.
        most = max([0.0, *(p - (math.log(10 if c == "9" else 26) if c in "9aA" else 0.0) - self.plain(c) for steps, _ in states for c, (_, p) in steps.items())])
        bound = lambda n: self.length(n) + n * most - literal * EVEN - self.plain_length(n)
        self.reach = max(seen)
        while bound(self.reach) >= MARGIN:
            self.reach += 1
        #: No shorter string can reach it either.
        self.least = min(seen)
        while self.least > 1 and bound(self.least - 1) >= MARGIN:
            self.least -= 1
        #: What the strings begin with, the head or the whole of a shorter string; the empty text where they have no head.
        self.heads = self._heads()

    def _heads(self) -> set[str]:
        out, todo = set(), [(0, "")]
        while todo:
            state, head = todo.pop()
            steps = self.states[state][0]
            if len(head) == self.literal or not steps:
                out.add(head)
            else:
                todo += [(to, head + c) for c, (to, _) in steps.items()]
                if head and any(n == len(head) for n, _, _ in self.lengths):
                    out.add(head)
        return out

    def plain(self, c: str) -> float:
        """Log-probability of a symbol's character in what the format is held against."""
        return EVEN if self.literal else PLAIN.get(c, PLAIN_OTHER)

    def plain_length(self, n: int) -> float:
        return EVEN_LENGTH if self.literal else (n - 1) * math.log(1 - 1 / PLAIN_LENGTH) - math.log(PLAIN_LENGTH)

    def length(self, n: int) -> float:
        """Log-density of the length ``n``."""
        if n not in self.by_length:
            parts = [p - 0.5 * ((n - m) / d) ** 2 - math.log(d * math.sqrt(2 * math.pi)) for m, d, p in self.lengths]
            top = max(parts)
            self.by_length[n] = top + math.log(sum(math.exp(x - top) for x in parts))
        return self.by_length[n]

    def scores(self, s: str, start: int, ends: set[int]) -> Iterator[tuple[float, float, int]]:
        """``score``, length factor and end of the pieces of ``s`` from ``start`` to each of ``ends`` that is not refused."""
        state, total = 0, 0.0
        for i, c in enumerate(symbols(s[start : start + self.reach], self.literal), 1):
            step = self.states[state][0].get(c)
            if step is None:
                return
            state = step[0]
            at = start + i
            total += step[1] - (0.0 if i <= self.literal or not s[at - 1].isalnum() else math.log(10 if c == "9" else 26)) - self.plain(c)
            if at in ends:
                yield total + self.states[state][1] + self.length(i) - self.plain_length(i), self.length(i), at

    def score(self, s: str) -> float:
        """Log-likelihood over even draws; minus infinity if the automaton refuses the string."""
        return next((x for x, _, _ in self.scores(s, 0, {len(s)})), -math.inf)


def infer(strings: Iterable[str], alpha: float = 0.05) -> Automaton:
    """ALERGIA: merge statistically compatible states of the prefix tree of ``strings``."""
    strings = sorted(strings)
    literal = shared_head(strings)
    nxt: list[dict[str, int]] = [{}]
    come, stop, used = [0], [0], [Counter()]
    for s in strings:
        q = 0
        come[0] += 1
        for c in symbols(s, literal):
            used[q][c] += 1
            if c not in nxt[q]:
                nxt[q][c] = len(nxt)
                nxt.append({})
                come.append(0)
                stop.append(0)
                used.append(Counter())
            q = nxt[q][c]
            come[q] += 1
        stop[q] += 1
    spread = math.sqrt(0.5 * math.log(2 / alpha))

    def apart(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > spread * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def apart_by(a: int, b: int) -> float:
        """Distance of the two states' frequencies of next symbols."""
        return sum(abs(used[a][c] / come[a] - used[b][c] / come[b]) for c in used[a].keys() | used[b].keys())

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if apart(stop[a], come[a], stop[b], come[b]):
                return False
            for c in used[a].keys() | used[b].keys():
                if apart(used[a][c], come[a], used[b][c], come[b]):
                    return False
                if c in nxt[a] and c in nxt[b]:
                    todo.append((nxt[a][c], nxt[b][c]))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree at b to the automaton at a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            come[a] += come[b]
            stop[a] += stop[b]
            used[a] += used[b]
            for c, q in nxt[b].items():
                if c in nxt[a]:
                    todo.append((nxt[a][c], q))
                else:
                    nxt[a][c] = q

    red = [0]
    while True:
        blue = sorted((q, r, c) for r in red for c, q in nxt[r].items() if q not in red)
        if not blue:
            break
        q, r, c = min(blue, key=lambda x: (-come[x[0]], x))
        # the likest compatible state first; the root stays apart, so what has been read of a head is kept
        near = next((p for p in sorted(red[1:], key=lambda p: (apart_by(p, q), p)) if compatible(p, q)), None)
        if near is None:
            red.append(q)
        else:
            nxt[r][c] = near
            fold(near, q)
    name = {q: i for i, q in enumerate(red)}
    states = []
    for q in red:
        total = come[q] + 0.5 * (len(nxt[q]) + 1)
        states.append(({c: (name[p], math.log((used[q][c] + 0.5) / total)) for c, p in nxt[q].items()}, math.log((stop[q] + 0.5) / total)))
    return Automaton(states, map(len, strings), set().union(*strings), literal)


def labelled_examples(each: int = 200, seed: int = 7) -> list[tuple[str, str]]:
    """Labelled credentials made by rule from publicly documented formats."""
    draw = random.Random(seed)
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alnum = upper + lower + digit

    def some(alphabet: str, n: int) -> str:
        return "".join(draw.choice(alphabet) for _ in range(n))

    # Head, alphabet and length of public credential formats.
    formats = {
        "forge": lambda: "ghp_" + some(alnum, 36),
        "forge_app": lambda: "ghs_" + some(alnum, 36),
        "chat": lambda: f"xoxb-{some(digit, 12)}-{some(digit, 12)}-{some(alnum, 24)}",
        "pay": lambda: "sk_live_" + some(alnum, 24),
        "maps": lambda: "AIza" + some(alnum + "-_", 35),
        "lab": lambda: "glpat-" + some(alnum + "-_", 20),
        "index": lambda: "pypi-" + some(alnum + "-_", draw.randint(85, 180)),
        "jwt": lambda: f"eyJhb{some(alnum + '-_', draw.choice((15, 31, 47)))}.eyJ{some(alnum + '-_', draw.randint(40, 400))}.{some(alnum + '-_', 43)}",
    }
    return [(name, make()) for name, make in formats.items() for _ in range(each)]


def train(labelled: Iterable[tuple[str, str]], alpha: float = 0.05) -> dict[str, Automaton]:
    by: dict[str, list[str]] = defaultdict(list)
    for name, s in labelled:
        by[name].append(s)
    # an even sample of the labelled strings, the same in every run
    some = lambda v: sorted(set(v), key=lambda s: (hashlib.sha256(s.encode()).digest(), s))[:MOST_LABELLED]
    return {name: infer(some(v), alpha) for name, v in sorted(by.items())}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


class Scanner:
    """The automata by what their strings begin with, and the runs that they may be in."""

    def __init__(self, model: dict[str, Automaton]):
        self.by_head: dict[str, list[Automaton]] = defaultdict(list)
        for a in model.values():
            for h in a.heads - {""}:
                self.by_head[h].append(a)
        self.headless = [a for a in model.values() if "" in a.heads]
        #: Places (by look-ahead, so they may overlap) at which a string may begin.
        self.begin = re.compile("(?=(" + "|".join(re.escape(h) for h in sorted(self.by_head, key=lambda h: (-len(h), h))) + "))") if self.by_head else None
        token = "[" + re.escape("".join(sorted({*TOKEN}.union(*(a.alphabet for a in model.values()))))) + "]"
        self.run = re.compile(token + "*")
        self.long_run = re.compile(f"{token}{{{min(a.least for a in self.headless)},}}") if self.headless else None

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind's place, end) of candidates that an automaton makes likelier than even draws by MARGIN."""
        found: list[tuple[float, int, int]] = []
        stop = -1
        for m in self.begin.finditer(text) if self.begin else ():
            start = m.start()
            if start >= stop:
                stop = max(start + 1, self.run.match(text, start).end())
                ends = {x for x in (stop, *(x.start() for x in SEPARATOR.finditer(text, start, stop))) if text[x - 1] != "."}
            automata = {id(a): a for n in range(LITERAL + 1) for a in self.by_head.get(text[start : start + n], ())}
            self._score(text, start, ends, automata.values(), found)
        for m in self.long_run.finditer(text) if self.long_run else ():
            breaks = list(SEPARATOR.finditer(text, m.start(), m.end()))
            ends = {x for x in (m.end(), *(b.start() for b in breaks)) if text[x - 1] != "."}
            for start in (m.start(), *(b.end() for b in breaks)):
                self._score(text, start, ends, [a for a in self.headless if m.end() - start >= a.least], found)
        taken: list[tuple[int, int]] = []
        for _, start, end in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            at = bisect_left(taken, (start, end))
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                taken.insert(at, (start, end))
        return [(a, 3, b) for a, b in taken]


    @staticmethod
    def _score(text: str, start: int, ends: set[int], automata: Iterable[Automaton], found: list) -> None:
        """Add the best piece from ``start`` under each automaton that makes one likely enough."""
        for a in automata:
            if some := [x for x in a.scores(text, start, ends) if x[0] >= MARGIN]:
                best = max(some)
                found.append((best[0], start, max(end for _, length, end in some if length >= best[1] - LENGTH_SLACK)))


def grammar_spans(text: str, model: dict[str, Automaton]) -> list[tuple[int, int, int]]:
    return Scanner(model).spans(text)


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, labelled: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """Counts, digest and spans of the secrets in each text (see the query's contract)."""
    small_batches(docs.sparkSession)
    scanner = Scanner(train(labelled_examples() if labelled is None else labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts, digests, spans = ([], [], [], []), [], []
            for text in b.column(1).to_pylist():
                base = sorted(base_spans(text))
                every = sorted(base + scanner.spans(text))
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in every))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3], pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_grammar long")


def mask(docs: DataFrame, labelled: Iterable[tuple[str, str]] | None = None, fill: str = "<secret>") -> DataFrame:
    """``docs`` with every found span of its text replaced by ``fill``; null texts stay null."""
    small_batches(docs.sparkSession)
    scanner = Scanner(train(labelled_examples() if labelled is None else labelled))

    def clean(texts):
        out = []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            spans = sorted((a, b) for a, _, b in base_spans(text) + scanner.spans(text))
            parts, at = [], 0
            for a, b in spans:
                if b <= at:
                    continue
                if a >= at:
                    parts += [text[at:a], fill]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]) if spans else text)
        return out

    @F.pandas_udf("string")
    def masked(s: pd.Series) -> pd.Series:
        return pd.Series(clean(s), dtype=object)

    return docs.withColumn("text", masked("text"))
