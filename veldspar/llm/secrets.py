"""Secret scans: base rules, and probabilistic automata inferred from labelled credentials.

The base rules label credentials of the corpus; fixed public formats, filled with digits of a counter's hash, add examples of kinds that a corpus may lack.
For each kind the labelled strings form two prefix trees with counts: of character classes, and of outlines, where a character that all strings have at a
place stands for itself and any other is alike.  States whose outgoing frequencies agree within Hoeffding's bound, and whose successors do too, are
merged (ALERGIA), which leaves two probabilistic automata of the format: of its composition, and of its length and constant parts.  Every candidate, a run
of 16 or more credential characters with a digit and a letter, is scored by its mean log likelihood per class and by its outline's log likelihood;
it's a secret where both reach what all but one in a hundred of the kind's labelled strings reach that the automata were not fitted on (a quarter; of few
strings, by the spread of their scores).
Where a whole run isn't, nor without punctuation at its ends, its parts between delimiters are scored, those that are as long as labelled strings of the kind or
begin as all of them do.
"""

from __future__ import annotations

import hashlib
import math
import os.path
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import shared_dir, written
from ._words import give_back

KINDS = ("assign", "access", "hex", "learned")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ENDS = ".=/_-"
_PIECE = re.compile(r"[^.=/_-]+")
_WORDS = ("passw", "secret", "token", "api")
# the base rules' lengths are applied after matching; for these two patterns a bound in the pattern gives the same matches
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: How much less likely than the least of the held outlines a secret's outline may be (a length that no string had); a symbol that no state knows costs three times as much.
RARER = 3.0
#: Labelled strings of a kind, first in the order of their hash, that the states of its automata are inferred from; counts, constant places, lengths and thresholds
#: come from all of them.
SAMPLE = 400
# Public credential formats (kind, prefix, alphabet, least and greatest length of the rest).
FORMATS = (
    ("access-key", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16),
    ("base64-secret", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 40, 40),
    ("hex-lower", "", "0123456789abcdef", 40, 40),
    ("hex-upper", "", "0123456789ABCDEF", 40, 40),
    ("personal-token", "ghp_", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 36, 36),
    ("secret-key", "sk_live_", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 24, 24),
    ("web-token", "eyJ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 40, 160),
)
_CLASS = {c: k for k, chars in {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"}.items() for c in chars}


def symbols(text: str) -> str:
    """Character classes; other characters stand for themselves."""
    return "".join(_CLASS.get(c, c) for c in text)


def examples(n: int = 120) -> dict[str, list[str]]:
    """Labelled strings of the fixed formats."""
    out = {}
    for kind, prefix, alphabet, short, long in FORMATS:
        strings = []
        for k in range(n):
            size = short + (k * 37) % (long - short + 1)
            digits = b"".join(hashlib.sha512(f"{kind}:{k}:{j}".encode()).digest() for j in range(-(-size // 64)))
            strings.append(prefix + "".join(alphabet[b % len(alphabet)] for b in digits[:size]))
        out[kind] = strings
    return out


class Automaton:
    """A probabilistic deterministic automaton by state merging."""

    def __init__(self, strings: Iterable[str], alpha: float = 0.05):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        # prefix tree: visits and ends of each state, successors with the counts of their transitions
        self.visits, self.ends, self.next = [0], [0], [{}]
        for s in strings:
            state = 0
            self.visits[0] += 1
            for c in s:
                if c not in self.next[state]:
                    self.next[state][c] = [len(self.visits), 0]
                    self.visits.append(0)
                    self.ends.append(0)
                    self.next.append({})
                step = self.next[state][c]
                step[1] += 1
                state = step[0]
                self.visits[state] += 1
            self.ends[state] += 1
        self._infer()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.ends[a], self.visits[a], self.ends[b], self.visits[b]):
                return False
            for c in {*self.next[a], *self.next[b]}:
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self._differ(x[1] if x else 0, self.visits[a], y[1] if y else 0, self.visits[b]):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to state ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, (state, n) in self.next[b].items():
                if c in self.next[a]:
                    self.next[a][c][1] += n
                    todo.append((self.next[a][c][0], state))
                else:
                    self.next[a][c] = [state, n]

    def _infer(self) -> None:
        red = [0]
        while True:
            blue = sorted({(x[0], s, c) for s in red for c, x in self.next[s].items() if x[0] not in red})
            if not blue:
                break
            state, source, c = max(blue, key=lambda x: (self.visits[x[0]], -x[0]))
            for target in red:
                if self._compatible(target, state):
                    self.next[source][c][0] = target
                    self._fold(target, state)
                    break
            else:
                red.append(state)
        self.states = len(red)
        place = {s: k for k, s in enumerate(red)}
        #: for each state: ends, and of each symbol the state after it and the times that it was taken
        self.seen = [(self.ends[s], {c: (place[x[0]], x[1]) for c, x in self.next[s].items()}) for s in red]
        self.rare = math.log(1e-4)
        del self.visits, self.ends, self.next
        self.add({})

    def add(self, more: dict[tuple[int, str], int]) -> None:
        """Count what further strings took, as ``taken`` has it; a symbol that no string took at its state before keeps the state."""
        for (state, c), n in more.items():
            ends, steps = self.seen[state]
            if c:
                to, m = steps.get(c, (state, 0))
                steps[c] = (to, m + n)
            else:
                self.seen[state] = (ends + n, steps)
        #: for each state: log probability of an end, and of each symbol with the state after it
        self.table = []
        for ends, steps in self.seen:
            visits = ends + sum(n for _, n in steps.values())
            self.table.append((math.log((ends + 0.05) / (visits + 1)), {c: (to, math.log(n / (visits + 1))) for c, (to, n) in steps.items()}))

    def taken(self, s: str) -> Iterator[tuple[int, str]]:
        """(state, symbol) of each step of a string; the empty symbol for its end."""
        state = 0
        for c in s:
            yield state, c
            state = self.table[state][1].get(c, (state, 0.0))[0]
        yield state, ""

    def score(self, s: str) -> float:
        """Mean log likelihood per symbol, the end counted; a symbol never seen at its state costs much and keeps the state."""
        return self.total(s) / (len(s) + 1)

    def total(self, s: str) -> float:
        """The log likelihood of the string and its end."""
        state, total = 0, 0.0
        for c in s:
            to = self.table[state][1].get(c)
            if to is None:
                total += self.rare
            else:
                state, total = to[0], total + to[1]
        return total + self.table[state][0]


def constants(strings: list[str]) -> dict[int, str]:
    """The places where all strings that reach them, half of all at least, have one character."""
    out = {}
    for k in range(max(map(len, strings), default=0)):
        here = [s[k] for s in strings if len(s) > k]
        if 2 * len(here) >= len(strings) and len(set(here)) == 1:
            out[k] = here[0]
    return out


@dataclass(frozen=True)
class Kind:
    name: str
    model: Automaton
    least: float
    # the automaton of outlines, its least score, and what outlines keep of a string
    outlines: Automaton
    least_outline: float
    fixed: dict[int, str]
    # least and greatest length of the labelled strings, and what all begin with
    short: int
    long: int
    prefix: str

    def margin(self, value: str) -> float:
        """By how much a string passes the least scores of a symbol; negative if it fails one of them."""
        outline = self.outlines.total(outlined(value, self.fixed)) - self.least_outline
        return min(outline / (len(value) + 1), self.model.score(symbols(value)) - self.least) if outline >= 0 else outline


def outlined(value: str, fixed: dict[int, str]) -> str:
    return "".join(c if k in fixed else "x" for k, c in enumerate(value))


def _kind(name: str, model: Automaton, outlines: Automaton, fixed: dict[int, str], lengths: tuple[int, int], prefix: str, low: tuple[float, float], mean: float, spread: float) -> Kind:
    """``low``: the hundredth of the scores and of the outlines' scores of held strings, from below."""
    least = min(low[0], mean - 3.5 * spread)  # few strings don't show the hundredth; outlines are stricter
    return Kind(name, model, least, outlines, low[1] - RARER, fixed, *lengths, prefix if len(prefix) >= 3 else "")


def learn_kinds(labelled: dict[str, list[str]]) -> list[Kind]:
    """Each kind with 20 strings or more."""
    out = []
    for kind, strings in sorted(labelled.items()):
        if len(strings) >= 20:
            fitted, held = [s for k, s in enumerate(strings) if k % 4 != 3], strings[3::4]
            fixed = constants(fitted)
            model, outlines = Automaton(symbols(s) for s in fitted), Automaton(outlined(s, fixed) for s in fitted)
            scores, totals = sorted(model.score(symbols(s)) for s in held), sorted(outlines.total(outlined(s, fixed)) for s in held)
            low = len(held) // 100
            mean = sum(scores) / len(scores)
            spread = math.sqrt(sum((x - mean) ** 2 for x in scores) / len(scores))
            out.append(_kind(kind, model, outlines, fixed, (min(map(len, strings)), max(map(len, strings))), os.path.commonprefix(strings), (scores[low], totals[low]), mean, spread))
    return out


def _taken(model: Automaton, outlines: Automaton, fixed: dict[int, str]):
    """(which, state, symbol, n): the steps that a task's strings take in both automata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for s in batch.column(0).to_pylist():
                n.update((0, *x) for x in model.taken(symbols(s)))
                n.update((1, *x) for x in outlines.taken(outlined(s, fixed)))
        keys = list(n)
        cols = [pa.array([k[j] for k in keys], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([n[k] for k in keys], pa.int64())], names=["which", "state", "symbol", "n"])

    return run


def _held(model: Automaton, outlines: Automaton, fixed: dict[int, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            scores = [[model.score(symbols(s)) for s in values], [outlines.total(outlined(s, fixed)) for s in values]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()) for x in scores], names=["score", "total"])

    return run


def learn_all(name: str, values: DataFrame, sample: int = SAMPLE) -> list[Kind]:
    """The kind of all distinct strings of the column ``value``, or none if they are fewer than 20.

    States are inferred from the first ``sample`` strings by hash.  A quarter of all strings is held, and the constant places, the counts of both automata and the
    thresholds come from all others, and from all held ones; of ``sample`` strings or fewer the result is that of ``learn_kinds``.
    """
    first = [r.value for r in values.orderBy(F.xxhash64("value"), "value").limit(sample + 1).collect()]
    if len(first) <= sample:
        return learn_kinds({name: first})
    first = first[:sample]
    last = values.sparkSession.createDataFrame([(first[-1],)], "value string").select(F.xxhash64("value")).first()[0]
    own = F.struct(F.xxhash64("value"), "value") <= F.struct(F.lit(last), F.lit(first[-1]))
    rest = values.where(~own)
    fit, held = (rest.where(c) for c in (F.pmod(F.xxhash64("value"), F.lit(4)) != 3, F.pmod(F.xxhash64("value"), F.lit(4)) == 3))
    fitted = values.sparkSession.createDataFrame([(x,) for k, x in enumerate(first) if k % 4 != 3], "value string").union(fit)
    chars = fitted.select(F.posexplode(F.split("value", "")).alias("k", "c")).where("c != ''").groupBy("k").agg(F.count("*").alias("n"), F.min("c").alias("c"), F.max("c").alias("d"))
    n = fitted.count()
    fixed = {r.k: r.c for r in chars.where((F.col("c") == F.col("d")) & (2 * F.col("n") >= n)).collect()}
    some = [s for k, s in enumerate(first) if k % 4 != 3]
    model, outlines = Automaton(symbols(s) for s in some), Automaton(outlined(s, fixed) for s in some)
    more: tuple[dict, dict] = ({}, {})
    for r in fit.mapInArrow(_taken(model, outlines, fixed), "which int, state int, symbol string, n long").groupBy("which", "state", "symbol").agg(F.sum("n").alias("n")).collect():
        more[r.which][r.state, r.symbol] = r.n
    model.add(more[0])
    outlines.add(more[1])
    out = values.sparkSession.createDataFrame([(x,) for x in first[3::4]], "value string").union(held)
    scores = written(out.mapInArrow(_held(model, outlines, fixed), "score double, total double"), shared_dir(values.sparkSession), "scores")
    all_ = scores.agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread")).first()
    low = tuple(scores.orderBy(c).offset(all_.n // 100).first()[c] for c in ("score", "total"))
    ends = values.agg(F.min(F.length("value")).alias("short"), F.max(F.length("value")).alias("long"), F.min("value").alias("a"), F.max("value").alias("b")).first()
    return [_kind(name, model, outlines, fixed, (ends.short, ends.long), os.path.commonprefix([ends.a, ends.b]), low, all_.mean, all_.spread)]


def learn(labelled: dict[str, list[str]]) -> list[tuple[str, Automaton, float]]:
    """(kind, automaton, least score) of each kind with 20 strings or more."""
    return [(k.name, k.model, k.least) for k in learn_kinds(labelled)]


def _mixed(value: str) -> bool:
    return len(value) >= 16 and any(c in "0123456789" for c in value) and any(c.isalpha() for c in value)


def accepted(value: str, models: list[Kind]) -> list[tuple[int, int]]:
    """(start, end) of what the automata accept of a run: all of it, all but punctuation at its ends, or else parts, those with a known prefix and then the likeliest first."""
    bare = value.strip(_ENDS)
    for part in dict.fromkeys((value, bare)):
        if _mixed(part) and any(m.margin(part) >= 0 for m in models):
            at = value.index(part)
            return [(at, at + len(part))]
    pieces = [(m.start(), m.end()) for m in _PIECE.finditer(value)]
    longest = max((m.long for m in models), default=0)
    found = []
    for j, (start, _) in enumerate(pieces):
        here = [m for m in models if m.prefix and value.startswith(m.prefix, start)]
        for k in range(j, len(pieces)):
            end = pieces[k][1]
            # a longer part than any labelled string is one piece, or begins with a known prefix and goes on with "-" and "_"
            if end - start > longest and k > j and not (here and set(value[pieces[k - 1][1] : pieces[k][0]]) <= {"-", "_"}):
                break
            if _mixed(part := value[start:end]):
                fit = [m for m in models if m.short <= len(part) and (len(part) <= m.long or m in here)]
                best = max(((m in here, m.margin(part)) for m in fit if m.margin(part) >= 0), default=None)
                if best:
                    found.append((best, start, end))
    out: list[tuple[int, int]] = []
    for _, start, end in sorted(found, key=lambda x: (not x[0][0], -x[0][1], x[1], -x[2])):
        if all(end <= s or e <= start for s, e in out):
            out.append((start, end))
    return sorted(out)


def _left(candidate: tuple[int, int, str], starts: list[int], ends: list[int]) -> list[tuple[int, int, str]]:
    """What base spans, sorted and apart, leave of a candidate."""
    start, end, value = candidate
    out, at = [], start
    for k in range(bisect_right(ends, start), bisect_left(starts, end)):
        out.append((at, starts[k]))
        at = ends[k]
    out.append((at, end))
    return [(a, b, value[a - start : b - start]) for a, b in out if a < b and _mixed(value[a - start : b - start])]


def _apart(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what sorted spans cover."""
    starts, ends = [], []
    for start, _, end in spans:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, str]], list[tuple[int, int, str]]]:
    """Base spans (start, kind, end), labelled values (kind, value) and candidates (start, end, value) of a text."""
    spans, values, candidates = [], [], []
    low = text.lower()
    if any(w in low for w in _WORDS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                spans.append((m.start(), 0, m.end()))
                values.append((0, m[2]))
    for run in _RUN.finditer(text):
        value, at = run[0], run.start()
        if len(value) >= 20:
            for kind, rule in ((1, _ACCESS), (2, _HEX)):
                for m in rule.finditer(value):
                    spans.append((at + m.start(), kind, at + m.end()))
                    values.append((kind, m[0]))
        if _mixed(value):
            candidates.append((at, run.end(), value))
    spans.sort()
    if spans and candidates:
        covered = _apart(spans)
        candidates = [x for c in candidates for x in _left(c, *covered)]
    return spans, values, candidates


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())]))
_VALUE = pa.list_(pa.struct([("kind", pa.int64()), ("value", pa.string())]))
_CAND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [base_spans(t) for t in batch.column(1).fill_null("").to_pylist()]
        keys = (("start", "kind", "end"), ("kind", "value"), ("start", "end", "value"))
        cols = [pa.array([[dict(zip(k, x)) for x in g[j]] for g in got], t) for j, (k, t) in enumerate(zip(keys, (_SPAN, _VALUE, _CAND)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["_own", "base", "vals", "cands"])
    give_back()


Models = list[Kind]


def all_spans(base: list[tuple[int, int, int]], candidates: list[tuple[int, int, str]], models: Models) -> list[tuple[int, int, int]]:
    """Base spans and those that the automata accept of the candidates, which lie apart from them."""
    more = [(start + a, 3, start + b) for start, _, value in candidates for a, b in accepted(value, models)]
    return sorted([*base, *more])


def _score(models: Models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, cands in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = all_spans([(x["start"], x["kind"], x["end"]) for x in base], [(x["start"], x["end"], x["value"]) for x in cands], models)
                out.append([dict(zip(("start", "kind", "end"), x)) for x in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _SPAN)], names=["_own", "base", "spans"])

    return run


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    types = f"_own {kind}, base {_SPANS}, vals array<struct<kind:long,value:string>>, cands array<struct<start:long,end:long,value:string>>"
    return written(docs.select(F.col(id_col).alias("_own"), text_col).mapInArrow(_scan, types), shared_dir(docs.sparkSession), "found")


def _fit(found: DataFrame, sample: int) -> Models:
    labels = found.where(F.size("vals") > 0).select(F.explode("vals").alias("v")).select("v.*").where(F.length("value") >= 16).distinct()
    labels = written(labels, shared_dir(found.sparkSession), "labels")
    out = learn_kinds(examples())
    for k in range(3):
        out += learn_all(KINDS[k], labels.where(F.col("kind") == k).select("value"), sample)
    return sorted(out, key=lambda m: m.name)


_SPANS = "array<struct<start:long,kind:long,end:long>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(id_col, base, spans), one row per row of ``docs``: arrays of (start, kind, end), in code points, sorted; ``kind`` is a place in KINDS.

    ``base`` holds the base rules' matches, ``spans`` also those that the automata add; an added span overlaps no base span.  Null or
    empty text has none.  The states of the automata are inferred from at most ``sample`` distinct labelled strings of each base kind; all of them give counts and thresholds.  A null id stays null;
    rows don't affect each other beyond the labelled strings.  Other columns are not read.
    """
    found = _found(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return found.select("_own", "base", "cands").mapInArrow(_score(_fit(found, sample)), f"_own {kind}, base {_SPANS}, spans {_SPANS}").withColumnRenamed("_own", id_col)


def cut(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with each span replaced; spans that overlap or touch give one mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start > at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _cut(models: Models, text_col: str, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts = []
            for t in batch.column(k).to_pylist():
                if t:
                    base, _, candidates = base_spans(t)
                    if spans := all_spans(base, candidates, models):
                        t = cut(t, spans, mark)
                texts.append(t)
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))
        give_back()

    return run


def cut_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", sample: int = SAMPLE) -> DataFrame:
    """``docs``, same rows and columns, with the secrets in its texts replaced by ``mark``.  Null text stays null."""
    return docs.mapInArrow(_cut(_fit(_found(docs, id_col, text_col), sample), text_col, mark), docs.schema)


def joined(spans: str):
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(x) for x in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, (x["kind"] + 1).cast("int")), x["start"].cast("string"), x["end"].cast("string"))), ",")
