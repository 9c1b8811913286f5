"""Secret scans: probabilistic automata inferred from labelled credentials score candidate strings."""

from __future__ import annotations

import base64
import bisect
import json
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import sent

CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-.="
#: Shorter strings of these characters are no candidates; no labelled credential is shorter.
MIN_LENGTH = 16
#: Bits by which a credential format must beat plain text.
THRESHOLD = 14.0
#: Strings longer than this many times the longest labelled credential are no candidates themselves; those inside them are.
LONGER = 2
#: A format is looked for inside words if it begins with SURE symbols of at least this joint probability (bits).
SURE, SURE_BITS = 4, -8.0
#: Candidates scored at once.
BLOCK = 200_000
#: Confidence of the compatibility test of two states.
ALPHA = 0.02
PER_KIND = 300
#: Weight of the uniform distribution in every state's symbol distribution.
SMOOTHING = 0.5
#: Bits of a symbol that the automaton has never seen in its state; it goes on as after the commonest one.
LOST = 9.0
#: Plain text changes between small letters, capitals, digits and marks at most this often.
SWITCH = 0.1
_SYMBOL = np.full(256, -1, np.int64)
_SYMBOL[[ord(c) for c in CHARS]] = np.arange(len(CHARS))
_CLASS = np.repeat([0, 1, 2, 3], [26, 26, 10, 6])
_CLASS_BITS = np.log2(np.array([26, 26, 10, 6]))


def labelled_credentials(per_kind: int = PER_KIND, seed: int = 7) -> list[tuple[str, str]]:
    """(kind, text): invented credentials in public formats, and strings of kinds that begin with "plain"."""
    g = random.Random(seed)
    upper, lower, digits = CHARS[:26], CHARS[26:52], CHARS[52:62]
    b62, b32, hexa, b64, b64u = upper + lower + digits, upper + "234567", "0123456789abcdef", CHARS[:62] + "+/", CHARS[:62] + "_-"

    def some(alphabet, n):
        return "".join(g.choices(alphabet, k=n))

    def jwt():
        def part(x):
            return base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")

        head = g.choice([{"alg": g.choice(["HS256", "RS256", "ES256"]), "typ": "JWT"}, {"alg": "RS256", "typ": "JWT", "kid": some(b62, 8)}])
        return ".".join([part(head), part({"sub": some(digits, 10), "exp": g.randint(10**9, 2 * 10**9)}), some(b64u, 43)])

    kinds = {
        "aws-access-key-id": lambda: g.choice(["AKIA", "ASIA"]) + some(b32, 16),
        "aws-secret-key": lambda: some(b64, 40),
        "hex-secret-upper": lambda: some(hexa, g.choice([16, 18, 20, 24, 32, 40, 48, 56, 64])).upper(),
        "hex-secret": lambda: some(hexa, g.choice([16, 18, 20, 24, 32, 40, 48, 56, 64])),
        "github-token": lambda: "gh" + g.choice("pousr") + "_" + some(b62, 36),
        "google-api-key": lambda: "AIza" + some(b64u, 35),
        "slack-token": lambda: "xox" + g.choice("bpas") + "-" + some(digits, 12) + "-" + some(digits, 12) + "-" + some(b62, 24),
        "stripe-key": lambda: g.choice(["sk", "rk"]) + "_live_" + some(b62, 24),
        "npm-token": lambda: "npm_" + some(b62, 36),
        "gitlab-token": lambda: "glpat-" + some(b64u, 20),
        "json-web-token": jwt,
        "account-key": lambda: some(b64, 86) + "==",
        "private-key": lambda: "-----BEGIN_" + g.choice(["RSA_", "EC_", "DSA_", "OPENSSH_", "ENCRYPTED_", ""]) + "PRIVATE_KEY-----",
    }
    syllables = "the and ing er ion tion ent ou re es st en at ed or is it al ar te se co de ra li ri ro ne me an ch le la un ver ge be au ein keit ment eau ai que ción mente os as".replace("ó", "o").split()

    def word():
        w = "".join(g.choices(syllables, k=g.randint(5, 12)))
        return w.capitalize() if g.random() < 0.2 else w

    plain = [
        word,
        lambda: "".join(x.capitalize() for x in g.choices(syllables, k=g.randint(5, 9))),
        lambda: "-".join("".join(g.choices(syllables, k=g.randint(1, 3))) for _ in range(g.randint(3, 7))),
        lambda: "_".join("".join(g.choices(syllables, k=g.randint(1, 3))) for _ in range(g.randint(3, 7))),
        lambda: "/".join("".join(g.choices(syllables, k=g.randint(1, 3))) for _ in range(g.randint(3, 7))),
        lambda: word().upper(),
        lambda: some(digits, g.randint(16, 40)),
        lambda: "-".join(some(digits, 4) for _ in range(g.randint(4, 6))),
        lambda: f"{g.randint(1990, 2030)}-{g.randint(1, 12):02d}-{g.randint(1, 28):02d}/{word()}",
        lambda: "".join(g.choices(syllables, k=g.randint(4, 8))) + some(digits, g.randint(1, 4)),
        lambda: g.choice("-_=+/.") * g.randint(16, 60),
    ]
    out = [(kind, make()) for kind, make in kinds.items() for _ in range(per_kind)]
    out += [("plain", x) for make in plain for x in (make() for _ in range(per_kind)) if len(x) >= MIN_LENGTH]

    def some_words(a, b, most):
        return ["".join(g.choices(syllables, k=g.randint(1, most))) for _ in range(g.randint(a, b))]

    others = {
        "plain-uuid": lambda: "-".join(some(hexa, n) for n in (8, 4, 4, 4, 12)),
        "plain-asset": lambda: "/".join(some_words(1, 5, 3)) + g.choice("./-") + some(hexa, g.choice([8, 10, 12, 16, 20, 32, 40])) + g.choice([".js", ".css", ".png", ".min.js", ".html", ""]),
        "plain-host": lambda: ".".join(some_words(2, 4, 3)) + g.choice(["", "/" + "/".join(some_words(1, 4, 3)), "/" + "-".join(some_words(2, 6, 2)) + ".html"]),
        "plain-setting": lambda: g.choice("_.".join(some_words(1, 2, 2)).split("_")) + "=" + g.choice([some(digits, g.randint(1, 12)), *some_words(1, 3, 4)]),
    }
    return out + [(kind, x) for kind, make in others.items() for x in (make() for _ in range(per_kind)) if len(x) >= MIN_LENGTH]


class _Tree:
    """Frequency prefix tree, later a graph: visits, ends and transitions of each state."""

    def __init__(self, strings):
        self.visits, self.ends, self.to = [0], [0], [{}]
        for s in strings:
            at = 0
            self.visits[0] += 1
            for c in s:
                nxt = self.to[at].get(c)
                if nxt is None:
                    nxt = self.to[at][c] = len(self.visits)
                    self.visits.append(0)
                    self.ends.append(0)
                    self.to.append({})
                at = nxt
                self.visits[at] += 1
            self.ends[at] += 1

    def differ(self, f1, n1, f2, n2, bound):
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(self, a: int, b: int, bound: float) -> bool:
        """Hoeffding test of end and symbol frequencies, here and in all states reached by equal symbols."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits[a], self.visits[b]
            if self.differ(self.ends[a], n, self.ends[b], m, bound):
                return False
            for c in self.to[a].keys() | self.to[b].keys():
                x, y = self.to[a].get(c), self.to[b].get(c)
                if self.differ(self.flow[a].get(c, 0), n, self.flow[b].get(c, 0), m, bound):
                    return False
                if x is not None and y is not None:
                    todo.append((x, y))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below b to the graph at a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, y in self.to[b].items():
                self.flow[a][c] = self.flow[a].get(c, 0) + self.flow[b][c]
                if c in self.to[a]:
                    todo.append((self.to[a][c], y))
                else:
                    self.to[a][c] = y

    def merge(self, alpha: float) -> list[int]:
        """State merging from the root outwards; returns the states that remain."""
        self.flow = [{c: self.visits[y] for c, y in t.items()} for t in self.to]
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, known = [0], {0}
        while True:
            edge = next(((r, c, y) for r in red for c, y in sorted(self.to[r].items()) if y not in known), None)
            if edge is None:
                return red
            r, c, y = edge
            for x in red:
                if self.compatible(x, y, bound):
                    self.to[r][c] = x
                    self.fold(x, y)
                    break
            else:
                red.append(y)
                known.add(y)


class Automaton:
    """Log probabilities (bits) and successors by state and symbol; lengths have a table of their own."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        tree = _Tree(strings)
        states = tree.merge(alpha)
        place = {s: i for i, s in enumerate(states)}
        n, k = len(states), len(CHARS)
        self.next = np.tile(np.arange(n, dtype=np.int32)[:, None], k)
        self.bits = np.full((n, k), -LOST, np.float32)
        for s, i in place.items():
            going = sum(tree.flow[s].values())
            if not going:
                continue
            self.next[i] = place[tree.to[s][max(tree.flow[s].items(), key=lambda x: (x[1], x[0]))[0]]]
            for c, f in tree.flow[s].items():
                j = int(_SYMBOL[ord(c)])
                self.next[i, j] = place[tree.to[s][c]]
                self.bits[i, j] = math.log2((f + SMOOTHING / k) / (going + SMOOTHING))
        lengths = np.bincount([len(s) for s in strings]).astype(float)
        self.length = lengths / lengths.sum()
        self.mean = float((np.arange(len(lengths)) * self.length).sum())

    def length_bits(self, n: np.ndarray) -> np.ndarray:
        """Lengths seen among the labelled strings share 95 %, a geometric tail the rest."""
        seen = np.where(n < len(self.length), self.length[np.minimum(n, len(self.length) - 1)], 0.0)
        tail = np.exp(-n / self.mean) / self.mean
        return np.log2(0.95 * seen + 0.05 * tail + 1e-300)

    def prefix_bits(self, data: np.ndarray, start: np.ndarray, reach: np.ndarray, who: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Bits of data[start[who]:start[who]+size], one pass for all prefixes of a start; reaches descend, sizes ascend."""
        out, got = np.zeros(len(start)), np.zeros(len(who))
        state = np.zeros(len(start), np.int32)
        live, done = len(start), 0
        for i in range(int(reach[0]) if len(reach) else 0):
            while reach[live - 1] <= i:
                live -= 1
            c = data[start[:live] + i]
            out[:live] += self.bits[state[:live], c]
            state[:live] = self.next[state[:live], c]
            upto = done + int(np.searchsorted(size[done:], i + 1, "right"))
            got[done:upto] = out[who[done:upto]]
            done = upto
        return got + self.length_bits(size)


def _steps(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(running sum of bits, bits of each change) of characters as runs of one class, uniform within the class."""
    kind = _CLASS[np.maximum(symbols, 0)]
    change = np.full(len(symbols), math.log2(1 - SWITCH))
    change[1:][kind[1:] != kind[:-1]] = math.log2(SWITCH / 3)
    return np.r_[0.0, np.cumsum(change - _CLASS_BITS[kind])], change


def _run_bits(symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits of strings that are runs of one class of characters."""
    step, change = _steps(symbols)
    return step[start + size] - step[start] - change[start] - 2.0


class Formats:
    """One automaton for each labelled kind, of credentials and of plain strings."""

    def __init__(self, labelled: list[tuple[str, str]], alpha: float = ALPHA):
        kinds: dict[str, list[str]] = {}
        for kind, text in labelled:
            kinds.setdefault(kind, []).append(text)
        plain = sorted(k for k in kinds if k.startswith("plain"))
        if not plain or len(plain) == len(kinds):
            raise ValueError("labels need plain strings and at least one kind of credential")
        # kinds whose strings all have a mark say nothing of strings without one
        self.marked = [all(re.search(r"[_+/.=-]", t) for t in kinds[k]) for k in plain]
        self.plain = [Automaton(kinds.pop(k), alpha) for k in plain]
        self.names = sorted(kinds)
        self.automata = [Automaton(kinds[k], alpha) for k in self.names]
        self.longest = LONGER * max(len(a.length) - 1 for a in self.automata)

    def bits(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(kind index, bits of the best kind, bits of the best plain kind) of strings, many of which may have one start."""
        kind, lead, rest = np.zeros(len(start), np.int64), np.full(len(start), -np.inf), np.full(len(start), -np.inf)
        if not len(start):
            return kind, lead, rest
        begin, who = np.unique(start, return_inverse=True)
        reach = np.zeros(len(begin), np.int64)
        np.maximum.at(reach, who, end - start)
        down = np.argsort(-reach, kind="stable")
        place = np.empty(len(down), np.int64)
        place[down] = np.arange(len(down))
        o = np.argsort(end - start, kind="stable")
        s, n = start[o], (end - start)[o]
        args = symbols, begin[down], reach[down], place[who[o]], n
        best, most = np.zeros(len(o), np.int64), np.full(len(o), -np.inf)
        for k, a in enumerate(self.automata):
            x = a.prefix_bits(*args)
            best[x > most] = k
            most = np.maximum(most, x)
        # words that no labelled string is like are still runs of small letters, digits and so on
        plain = _run_bits(symbols, s, n) + self.plain[0].length_bits(n)
        marks = np.r_[0, np.cumsum(_CLASS[np.maximum(symbols, 0)] == 3)]
        bare = marks[s + n] == marks[s]
        for a, marked in zip(self.plain, self.marked):
            x = a.prefix_bits(*args)
            plain = np.maximum(plain, np.where(bare & marked, -np.inf, x))
        kind[o], lead[o], rest[o] = best, most, plain
        return kind, lead, rest

    def scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(kind index, bits over plain text) of strings data[start:end]."""
        kind, lead, plain = self.bits(_SYMBOL[data], start, end)
        return kind, lead - plain

    def glued(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(run, start, end) of strings anywhere in runs that begin as a format surely does, in its labelled lengths."""
        size = np.maximum(end - start - MIN_LENGTH + 1, 0)
        run = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size) + start[run]
        out = []
        for a in self.automata:
            i, state, bits = np.arange(len(at)), np.zeros(len(at), np.int32), np.zeros(len(at))
            for k in range(SURE):
                c = symbols[at[i] + k]
                bits = bits + a.bits[state, c]
                on = np.flatnonzero(bits >= SURE_BITS)
                i, state, bits = i[on], a.next[state[on], c[on]], bits[on]
            for n in np.flatnonzero(a.length > 0):
                j = i[at[i] + n <= end[run[i]]]
                out.append((run[j], at[j], at[j] + n))
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3))

    def strings(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(run, start, end) of all candidates of the runs data[start:end]: whole, between marks, and glued; each once."""
        some = np.flatnonzero(end - start <= self.longest)
        parts = [(some, start[some], end[some]), inside(data, start, end, MIN_LENGTH, self.longest), self.glued(_SYMBOL[data], start, end)]
        r, a, b = (np.concatenate([p[i] for p in parts]) for i in range(3))
        o = np.lexsort((b, a))
        r, a, b = r[o], a[o], b[o]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        return r[new], a[new], b[new]

    def found(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, threshold: float):
        """(run, start, end, kind index, bits) of the best strings of the runs data[start:end] that reach ``threshold``."""
        symbols = _SYMBOL[data]
        run, s, e = self.strings(data, start, end)
        parts = [self.bits(symbols, s[i : i + BLOCK], e[i : i + BLOCK]) for i in range(0, len(s), BLOCK)] or [self.bits(symbols, s, e)]
        kind, lead, plain = (np.concatenate([p[i] for p in parts]) for i in range(3))
        bits = lead - plain
        # a string inside a run must also beat the run as one plain string
        whole = np.full(len(start), -np.inf)
        at = np.flatnonzero((s == start[run]) & (e == end[run]))
        whole[run[at]] = plain[at]
        step, change = _steps(symbols)
        a, b = start[run], end[run]
        before = np.where(s > a, step[s] - step[a] - change[a] + math.log2(1 - SWITCH), 0)
        around = before + step[b] - step[e] - np.log2(b - a)
        inner = np.flatnonzero((s > a) | (e < b))
        bits[inner] = np.minimum(bits, lead + around - whole[run])[inner]
        on = np.flatnonzero(bits >= threshold)
        on = on[best_inside(run[on], s[on], e[on], bits[on])]
        return run[on], s[on], e[on], kind[on], bits[on]


def with_key_headers(data: np.ndarray) -> np.ndarray:
    """The bytes with the blanks inside ``-----BEGIN ...-----`` written as underscores, so that such a line is one run."""
    raw = data.tobytes()
    out = data
    for m in re.finditer(rb"-----BEGIN [A-Z ]{1,40}-----", raw):
        if out is data:
            out = data.copy()
        part = out[m.start() : m.end()]
        part[part == 32] = 95
    return out


def candidates(data: np.ndarray, offs: np.ndarray, min_length: int = MIN_LENGTH):
    """(row, start, end) of all maximal runs of credential characters of at least ``min_length`` bytes."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    table = (_SYMBOL >= 0).astype(np.uint8)
    _, s, e = K._spans(data, offs, table)
    on = e - s >= min_length
    s, e = s[on], e[on]
    return np.searchsorted(offs, s, "right") - 1, s, e


def inside(data: np.ndarray, start: np.ndarray, end: np.ndarray, min_length: int, longest: int):
    """(run, start, end) of the strings inside runs that begin or end at a mark.

    A string begins with its run or after a mark, and ends with its run or before a
    mark; of several marks in a row the one next to a letter or digit may belong
    to it.  Whole runs are not among them.
    """
    z = np.zeros(0, np.int64)
    if not len(start):
        return z, z, z
    mark = np.zeros(len(data) + 4, bool)  # data[i] is at i + 2
    mark[2:-2] = _CLASS[np.maximum(_SYMBOL[data], 0)] == 3
    mark[2:-2] &= _SYMBOL[data] >= 0
    n = np.arange(len(data) + 1)
    here, back, back2, on = mark[n + 2], mark[n + 1], mark[n], mark[np.minimum(n + 3, len(mark) - 1)]
    opens = np.flatnonzero(back & (~here | (here & ~on)))
    closes = np.flatnonzero(here & (~back | (back & ~back2)))

    def within(at, edge):
        run = np.searchsorted(start, at, "right") - 1
        ok = (run >= 0) & (at > start[run]) & (at < end[run])
        both = np.r_[at[ok], edge]
        o = np.argsort(both, kind="stable")
        return both[o], np.r_[run[ok], np.arange(len(edge))][o]

    a, run = within(opens, start)
    b, _ = within(closes, end)
    lo = np.searchsorted(b, a + min_length)
    hi = np.maximum(lo, np.searchsorted(b, np.minimum(end[run], a + longest), "right"))
    size = hi - lo
    k = np.repeat(np.arange(len(a)), size)
    j = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size) + lo[k]
    part = (a[k] != start[run[k]]) | (b[j] != end[run[k]])
    k, j = k[part], j[part]
    return run[k], a[k], b[j]


def best_inside(group: np.ndarray, start: np.ndarray, end: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Indexes of strings that overlap no better one of their run; the longer of equals."""
    taken: dict[int, list[tuple[int, int]]] = {}
    keep = []
    for i in np.lexsort((start, start - end, -bits)).tolist():
        own = taken.setdefault(int(group[i]), [])
        span = (int(start[i]), int(end[i]))
        at = bisect.bisect(own, span)
        if (at == 0 or own[at - 1][1] <= span[0]) and (at == len(own) or own[at][0] >= span[1]):
            own.insert(at, span)
            keep.append(i)
    return np.array(sorted(keep), np.int64)


def trained(labelled: list[tuple[str, str]] | None = None, alpha: float = ALPHA) -> Formats:
    return Formats(labelled_credentials() if labelled is None else labelled, alpha)


def secrets(docs: DataFrame, formats: Formats | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kind, start_byte, n_bytes, score): strings that look like credentials.

    Candidates are runs of letters, digits and ``_+/-.=``, the strings inside a run
    that begin and end at its ends or at one of those marks, and strings anywhere in
    it that begin as a format surely does and have one of its labelled lengths.  They
    have at least ``MIN_LENGTH`` bytes, as no labelled credential is shorter, and at most
    ``LONGER`` times the bytes of the longest; a longer run is judged by the strings inside.
    Lines of the form ``-----BEGIN ...-----`` count as one run.  Each candidate is
    scored by the automaton of each kind.  score is the lead in bits of the best kind
    over plain strings, and for a string inside a run also over the whole run as a
    plain string, whichever is less.  Rows of at least ``threshold`` return, of
    strings that overlap the best one; the secret itself does not return.

    Rows with a null doc_id are left out; null and empty texts have no candidates;
    long texts and long runs are scanned whole; repeated rows give their rows once;
    ties between kinds go to the first by name, between strings to the longer, then the first.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    held = sent(docs.sparkSession, formats or trained())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")

    def scan(batches):
        model = held()
        for batch in batches:
            data, offs = K.buffer(batch.column(1))
            for lo, hi in K.pieces(offs):
                own, part = with_key_headers(data[offs[lo] : offs[hi]]), offs[lo : hi + 1] - offs[lo]
                row, s, e = candidates(own, part)
                if not len(row):
                    continue
                run, s, e, kind, bits = model.found(own, s, e, threshold)
                row = row[run]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + row)), pa.array([model.names[k] for k in kind], pa.string()), K.long_column(s - part[row]), K.long_column(e - s), pa.array(np.round(bits, 3))],
                    ["doc_id", "kind", "start_byte", "n_bytes", "score"],
                )

    return texts.mapInArrow(scan, "doc_id long, kind string, start_byte long, n_bytes long, score double").distinct()
