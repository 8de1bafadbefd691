"""Secret scan: base patterns plus formats inferred as probabilistic automata.

For each format of labelled credentials a prefix tree is built and its states
are merged where their outgoing frequencies are statistically compatible
(Hoeffding bound), which gives a deterministic probabilistic automaton. Every
candidate is scored under each automaton against a background model of ordinary
tokens; the likeliest format and end whose log-likelihood ratio per symbol reaches
the threshold make a span. A candidate starts where a token does or after a
separator in it, and ends before a separator or where the token does, so one in a
URL, after ``key=`` or before a full stop is scored too. Base spans always stay.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cuts_of, map_slices, small_batches, with_release

ASSIGN = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
# A run is maximal, so a run that is too short has no later start that is long enough.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Whole tokens. A candidate starts there or after a separator, and ends before one or with the token.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]+")
SEPARATOR = re.compile(r"[+/_.=-]")
#: Candidates of fewer symbols have no score: the shortest labelled credential has 20.
SHORTEST = 16
BASE = ("assign", "access", "hex")

_HEX, _UP, _LOW, _DIG = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALL = _UP + _LOW + _DIG
#: Public credential formats. Labelled ones are drawn as these parts in a row: literal start, alphabet, lengths of the rest.
FORMATS = (
    ("cloud_key", ("AKIA", _UP + _DIG, (16, 16))),
    ("cloud_temp", ("ASIA", _UP + _DIG, (16, 16))),
    ("forge_token", ("ghp_", _ALL, (36, 36))),
    ("chat_token", ("xoxb-", _DIG, (10, 13)), ("-", _DIG, (10, 13)), ("-", _ALL, (24, 24))),
    ("pay_key", ("sk_live_", _ALL, (24, 32))),
    ("maps_key", ("AIza", _ALL + "_-", (35, 35))),
    ("package_token", ("npm_", _ALL, (36, 36))),
    ("lab_token", ("glpat-", _ALL + "_-", (20, 20))),
    ("web_token", ("eyJ", _ALL + "_-", (60, 120))),
    ("signed_token", ("eyJ", _ALL + "_-", (15, 60)), (".eyJ", _ALL + "_-", (20, 160)), (".", _ALL + "_-", (43, 86))),
    ("hex_key", ("", _HEX, (32, 64))),
)
SAMPLES, SEED = 120, 7
LITERAL = 3  # symbols at the start that are kept as they are


def labelled(n: int = SAMPLES, seed: int = SEED) -> dict[str, list[str]]:
    """``n`` labelled credentials of each format, always the same ones."""
    r = random.Random(seed)
    part = lambda start, alphabet, lengths: start + "".join(r.choices(alphabet, k=r.randint(*lengths)))
    return {name: ["".join(part(*p) for p in parts) for _ in range(n)] for name, *parts in FORMATS}


def symbols(token: str) -> list[str]:
    """The first symbols as they are where they are letters or signs; then classes."""
    return [c if i < LITERAL and not c.isdigit() else _CLASS.get(c, c) for i, c in enumerate(token)]


_CLASS = {c: "9" for c in _DIG} | {c: "f" if c in _HEX else "z" for c in _LOW} | {c: "A" for c in _UP}
_SIZE = {"9": 10, "f": 6, "z": 20, "A": 26}


class Automaton:
    """A deterministic probabilistic automaton from a prefix tree by state merging."""

    def __init__(self, words: list[list[str]], alpha: float = 0.05) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        for w in words:
            q = 0
            for s in [*w, "$"]:
                self.count[q][s] += 1
                if s != "$":
                    if s not in self.next[q]:
                        self.next[q][s] = len(self.next)
                        self.next.append({})
                        self.count.append(Counter())
                    q = self.next[q][s]
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _alike(self, a: int, b: int, depth: int = 4) -> bool:
        """Do the two states and those soon after them send words on alike?"""
        ca, cb = self.count[a], self.count[b]
        na, nb = sum(ca.values()), sum(cb.values())
        if not na or not nb:
            return True
        gap = self._bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
        if any(abs(ca[s] / na - cb[s] / nb) > gap for s in ca.keys() | cb.keys()):
            return False
        return not depth or all(self._alike(q, self.next[b][s], depth - 1) for s, q in self.next[a].items() if s in self.next[b])

    def _fold(self, a: int, b: int) -> None:
        """Adds the subtree of ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            for s, q in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], q))
                else:
                    self.next[a][s] = q

    def _apart(self, a: int, b: int) -> float:
        """How differently two states send words on, 0 to 2."""
        ca, cb = self.count[a], self.count[b]
        na, nb = max(1, sum(ca.values())), max(1, sum(cb.values()))
        return sum(abs(ca[s] / na - cb[s] / nb) for s in ca.keys() | cb.keys())

    def _merge(self) -> None:
        """Takes the state that most words pass and merges it with the compatible
        state that is nearest, or keeps it as a new one, until none is left."""
        red = [0]
        while blue := [(-sum(self.count[t].values()), q, s, t) for q in red for s, t in self.next[q].items() if t not in red]:
            _, parent, s, b = min(blue)
            near = [(self._apart(r, b), r) for r in red if self._alike(r, b)]
            if near:
                _, r = min(near)
                self.next[parent][s] = r
                self._fold(r, b)
            else:
                red.append(b)
        keep = {q: i for i, q in enumerate(red)}
        self.count = [self.count[q] for q in red]
        self.next = [{s: keep[t] for s, t in self.next[q].items()} for q in red]
        self._log = [{s: math.log(n / sum(c.values()) / _SIZE.get(s, 1)) for s, n in c.items()} for c in self.count]

    def ends(self, token: str, classes: list[str], at: int, ends: set[int], shortest: int = SHORTEST) -> list[tuple[int, float]]:
        """(end, log-likelihood) of the candidates from ``at`` that a path takes."""
        q, total, out = 0, 0.0, []
        for i in range(at, len(token) + 1):
            log = self._log[q]
            if i - at >= shortest and i in ends and "$" in log:
                out.append((i, total + log["$"]))
            if i == len(token):
                break
            s = token[i] if i - at < LITERAL and not token[i].isdigit() else classes[i]
            if s not in self.next[q]:
                break
            total, q = total + log[s], self.next[q][s]
        return out

    def score(self, word: list[str]) -> float:
        """Log-likelihood of a word; minus infinity if no path takes it."""
        q, total = 0, 0.0
        for s in word:
            p = self._log[q].get(s)
            if p is None or s not in self.next[q]:
                return -math.inf
            total, q = total + p, self.next[q][s]
        return total + self._log[q].get("$", -math.inf)


class Background:
    """Bigrams of symbol classes in ordinary tokens: invented words, numbers, addresses, file names."""

    def __init__(self, n: int = 4000, seed: int = SEED) -> None:
        r, pairs = random.Random(seed), Counter()
        part = lambda: "".join(r.choices("bcdfghlmnprstv", k=1) + r.choices("aeiou", k=1) + r.choices("lnrst", k=r.randint(0, 1)))
        word = lambda: "".join(part() for _ in range(r.randint(2, 9)))
        number = lambda: str(r.randint(0, 10 ** r.randint(1, 18)))
        for _ in range(n):
            t = r.choice((word, word, number, lambda: word() + number(), lambda: ".".join(number()[:3] for _ in range(4)), lambda: f"{word()}.{word()}-{number()}", lambda: f"{word()}_{word()}.{word()}"))()
            c = ["^", *(_CLASS.get(x, "-") for x in t), "$"]
            pairs.update(zip(c, c[1:], strict=False))
        sums = Counter()
        for (a, _), k in pairs.items():
            sums[a] += k
        self._log = {(a, b): math.log((pairs[a, b] + 1) / (sums[a] + 6) / {"-": 6}.get(b, _SIZE.get(b, 1))) for a in "^9fzA-" for b in "9fzA-$"}

    def sums(self, token: str) -> tuple[list[str], list[float]]:
        """Classes of the symbols, and the log-likelihood of all steps up to each one."""
        c = [_CLASS.get(x, "-") for x in token]
        return c, [0.0, *accumulate(self._log[p] for p in zip(c, c[1:], strict=False))]

    def part(self, c: list[str], sums: list[float], start: int, end: int) -> float:
        """``score`` of the symbols from ``start`` to ``end``."""
        return self._log["^", c[start]] + sums[end - 1] - sums[start] + self._log[c[end - 1], "$"]

    def score(self, token: str) -> float:
        c = ["^", *(_CLASS.get(x, "-") for x in token), "$"]
        return sum(self._log[p] for p in zip(c, c[1:], strict=False))


class Formats:
    """All automata; ``best`` scores a candidate by format likelihood. ``least``: the
    ratio that makes a span; ``shortest``: candidates of fewer symbols have no score."""

    def __init__(self, samples: dict[str, list[str]] | None = None, least: float = 0.25, shortest: int = SHORTEST) -> None:
        self.least, self.shortest, self.background = least, shortest, Background()
        self.automata = {k: Automaton([symbols(t) for t in v]) for k, v in sorted((samples or labelled()).items())}

    def best(self, token: str) -> tuple[str, float] | None:
        word, floor = symbols(token), self.background.score(token)
        name, score = max(((k, a.score(word)) for k, a in self.automata.items()), key=lambda x: x[1])
        ratio = (score - floor) / (len(token) + 1)
        return (name, ratio) if ratio >= self.least else None

    def spans(self, token: str) -> list[tuple[int, str, int]]:
        """(start, format, end) of the credentials in a token; from each start the
        format and the end with the largest log-likelihood ratio."""
        cuts = [m.start() for m in SEPARATOR.finditer(token)]
        starts, ends = [0, *(c + 1 for c in cuts)], {*cuts, len(token)}
        classes, out, free = [_CLASS.get(c, c) for c in token], [], 0
        back = None
        for at in starts:
            if at < free or len(token) - at < self.shortest:
                continue
            found = [(e, k, score) for k, a in self.automata.items() for e, score in a.ends(token, classes, at, ends, self.shortest)]
            if found:
                back = back or self.background.sums(token)
                ratios = ((score - self.background.part(*back, at, e), e, k) for e, k, score in found)
                good = [x for x in ratios if x[0] / (x[1] - at + 1) >= self.least]
                if good:
                    _, free, name = max(good)
                    out.append((at, name, free))
        return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def more_spans(text: str, formats: Formats, taken: list[tuple[int, int, int]]) -> list[tuple[int, str, int]]:
    """(start, format, end) of candidates that no base span covers or lies in."""
    found = []
    for m in TOKEN.finditer(text):
        if m.end() - m.start() >= formats.shortest:
            found += [(m.start() + a, k, m.start() + z) for a, k, z in formats.spans(m.group())]
    if not found or not taken:
        return found
    starts = [s for s, _, _ in taken]  # in order
    furthest = list(accumulate((e for _, _, e in taken), max))
    nearest = list(accumulate((e for _, _, e in reversed(taken)), min))[::-1]

    def free(a: int, z: int) -> bool:
        before, after = bisect_right(starts, a), bisect_left(starts, a)
        return not (before and furthest[before - 1] >= z) and not (after < len(taken) and nearest[after] <= z)

    return [x for x in found if free(x[0], x[2])]


def scan(spark: SparkSession, docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """doc_id, text, spans (array of kind, start, end by start, then base kinds as
    listed, then formats by name; code points, end exclusive) for every row.

    A null text counts as empty and has no span; the text column keeps its null.
    Rows that repeat a doc_id or have none are scanned row by row. Further columns
    are ignored. An empty table gives no rows."""
    known = formats or Formats()  # a few automata, of a size fixed by the labelled sample

    def make():
        f = known

        def run(ids: list, texts: list[str | None]) -> dict:
            spans = []
            for t in texts:
                base = base_spans(t) if t else []
                found = [(s, k, BASE[k], e) for s, k, e in base]
                found += [(s, len(BASE), k, e) for s, k, e in more_spans(t, f, base)] if t else []
                spans.append([{"kind": k, "start": s, "end": e} for s, _, k, e in sorted(found)])
            return {"doc_id": ids, "text": texts, "spans": spans}

        return run

    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])
    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], make, kind, "doc_id long, text string, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of ``scan``'s rows."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``<secret>``; all other
    columns, rows and texts stay as they are. A null text stays null; rows that
    repeat a doc_id or have none are changed row by row. An empty table stays empty."""
    known = formats or Formats()
    at, schema = docs.columns.index("text"), docs.schema

    def cut(text: str | None) -> str | None:
        base = base_spans(text) if text else []
        spans = sorted([(s, e) for s, _, e in base] + ([(s, e) for s, _, e in more_spans(text, known, base)] if text else []))
        if not spans:
            return text
        parts, end = [], 0
        for s, e in spans:
            if s >= end:
                parts += [text[end:s], "<secret>"]
            end = max(end, e)
        return "".join(parts) + text[end:]

    def run(batches):
        for batch in batches:
            for start, n in cuts_of(batch):
                part = batch.slice(start, n)
                texts = pa.array(map(cut, part.column(at).to_pylist()), part.column(at).type)
                yield pa.RecordBatch.from_arrays([texts if i == at else part.column(i) for i in range(part.num_columns)], schema=part.schema)

    small_batches(spark)
    return docs.mapInArrow(with_release(run), schema)
