"""Hierarchical language identification.

A linear classifier first picks the family of the language; then one-versus-one
linear support vector machines tell the languages of that family apart. Features
are hashed character 1- to 3-grams of the lower-cased text, log-scaled and of
unit length. Learning uses a bounded sample of labelled documents: about
``PER_LANGUAGE`` of each language, chosen by a hash of the id.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_rows, map_slices, slices, with_release

DIM = 1 << 13
#: Bound on the labelled sample: rows of each language, and of all languages where these are many.
PER_LANGUAGE, MOST_ROWS = 300, 20_000
UNKNOWN = "und"
#: Families of language codes. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl da sv no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "indic": "hi bn ur mr gu pa ne si",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue wuu",
    "celtic": "ga cy gd br",
    "malayic": "id ms tl jv",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and unit-length values of the whole text's character n-grams."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    c = np.where(c <= 32, np.uint32(32), c)
    c = np.concatenate((np.array([32], np.uint32), c, np.array([32], np.uint32)))
    mul, total = np.uint32(2654435761), np.zeros(DIM)
    one = (c + np.uint32(1)) * mul
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(40503) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(69069) + one[2:]
    for h in (one, two, three):
        h = (h ^ (h >> np.uint32(16))) * np.uint32(2246822507)
        total += np.bincount((h >> np.uint32(19)).astype(np.int64), minlength=DIM)
    at = np.flatnonzero(total)
    v = np.log1p(total[at])
    return at, v / np.sqrt((v * v).sum())


class Sample:
    """Rows of features, kept as buckets and values: none is ever spread out."""

    def __init__(self, at: list[np.ndarray], v: list[np.ndarray]) -> None:
        self.rows = list(zip(at, v, strict=True))
        self.sizes = np.array([len(x) for x in at], np.int64)
        self.at, self.v = np.concatenate(at).astype(np.int64), np.concatenate(v).astype(np.float32)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def some(self, rows: np.ndarray) -> Sample:
        return Sample(*zip(*(self.rows[i] for i in np.flatnonzero(rows)), strict=True))

    def times(self, w: np.ndarray) -> np.ndarray:
        """The product of each row with ``w``."""
        return np.add.reduceat(self.v * w[self.at], self.starts)

    def summed(self, g: np.ndarray) -> np.ndarray:
        """The sum of all rows, each times its part of ``g``."""
        return np.bincount(self.at, self.v * np.repeat(g, self.sizes), DIM)


@dataclass
class Linear:
    """A linear support vector machine: positive for the first of two classes."""

    w: np.ndarray
    b: float

    @classmethod
    def fit(cls, x: Sample, y: np.ndarray, rounds: int = 60, reg: float = 1e-4) -> Linear:
        """Squared hinge loss by full-batch Nesterov steps; y is 1 or -1, classes weigh alike."""
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
        w, b, vw, vb, step = np.zeros(DIM), 0.0, np.zeros(DIM), 0.0, 0.45
        for k in range(rounds):
            m = k / (k + 3)
            aw, ab = w + m * vw, b + m * vb
            gap = np.maximum(0, 1 - y * (x.times(aw) + ab)) * weight * y
            nw, nb = aw + step * (2 * x.summed(gap) - reg * aw), ab + step * 2 * gap.sum()
            vw, vb, w, b = nw - w, nb - b, nw, nb
        return cls(w.astype(np.float32), float(b))


class Hierarchy:
    """Families, then languages one against one."""

    def __init__(self, x: Sample, langs: list[str]) -> None:
        """``x``: a row of features for each label."""
        self.langs = sorted(set(langs))
        of, y = np.array([family(c) for c in langs]), np.array(langs)
        self.families = {f: [c for c in self.langs if family(c) == f] for f in sorted(set(of))}
        self.top = {f: Linear.fit(x, np.where(of == f, 1.0, -1.0)) for f in self.families} if len(self.families) > 1 else {}
        self.pairs = {}
        for own in self.families.values():
            for a, b in combinations(own, 2):
                rows = (y == a) | (y == b)
                self.pairs[a, b] = Linear.fit(x.some(rows), np.where(y[rows] == a, 1.0, -1.0))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text):
            return UNKNOWN, 0.0
        at, v = features(text)
        margin = lambda m: float(m.w[at] @ v) + m.b
        sure = lambda z: 1 / (1 + np.exp(-4 * z))
        score, own = 1.0, next(iter(self.families))
        if self.top:
            z = {f: margin(m) for f, m in self.top.items()}
            own = max(z, key=z.get)
            score = sure(z[own])
        langs = self.families[own]
        if len(langs) > 1:
            votes, power = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
            for a, b in combinations(langs, 2):
                z = margin(self.pairs[a, b])
                votes[a if z > 0 else b] += 1
                power[a] += z
                power[b] -= z
            best = max(langs, key=lambda c: (votes[c], power[c]))
            return best, float(score * sure(power[best] / (len(langs) - 1)))
        return langs[0], float(score)


def held_out() -> F.Column:
    """Documents that are never learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def learn(spark: SparkSession, docs: DataFrame, per_language: int = PER_LANGUAGE) -> Hierarchy | None:
    """Learns from text and lang of documents that are not held out; None if no
    such row has a letter and a lang. The sample is bounded: about ``per_language``
    rows of each language, and so many fewer (one at least) that all languages
    together have about ``MOST_ROWS``; every language is learned. A text's features
    have a fixed size, so no text goes to the driver."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out(), F.lit(False)))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    if not counts:
        return None
    per_language = max(1, min(per_language, MOST_ROWS // len(counts)))
    share = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, per_language / n))])
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)) * 1_000_003)
    rows = drawn.filter(F.length("text") > 0).mapInArrow(with_release(_featured), "lang string, at binary, v binary").collect()
    if not rows:
        return None
    return _fitted(rows)


def _featured(batches):
    kind = pa.schema([("lang", pa.string()), ("at", pa.binary()), ("v", pa.binary())])
    for langs, texts in slices(batches, "lang", "text"):
        got = [(c, *features(t)) for c, t in zip(langs, texts, strict=True) if has_letter(t)]
        yield pa.RecordBatch.from_pydict({"lang": [g[0] for g in got], "at": [g[1].astype(np.uint16).tobytes() for g in got], "v": [g[2].astype(np.float32).tobytes() for g in got]}, kind)


def _fitted(rows: list) -> Hierarchy:
    rows = sorted(rows, key=lambda r: (r.lang, r.at, r.v))
    x = Sample([np.frombuffer(r.at, np.uint16) for r in rows], [np.frombuffer(r.v, np.float32) for r in rows])
    return Hierarchy(x, [r.lang for r in rows])


def identify(spark: SparkSession, docs: DataFrame, model: Hierarchy | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    ``und`` with score 0 if the text is null, has no letter, or nothing could be
    learned. A null doc_id is not held out and never learned from. Rows that
    repeat a doc_id are predicted row by row. Further columns are ignored."""
    model = model or learn(spark, docs)  # weights of a fixed size for each pair of languages

    def make():
        m = model

        def run(ids: list, held: list, texts: list[str | None]) -> dict:
            got = [m.predict(t) if m else (UNKNOWN, 0.0) for t in texts]
            return {"doc_id": ids, "held_out": held, "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    return map_slices(rows, ["doc_id", "held_out", "text"], make, kind, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(spark: SparkSession, docs: DataFrame, least: float = 0.0) -> DataFrame:
    """``docs`` without the documents that have no language: a null or empty text, a
    text without a letter, or a score under ``least``; if nothing could be learned,
    no document has one. All columns stay, whatever else they are called. Rows that
    repeat a doc_id, or have none, are decided row by row, equal ones alike. An
    empty table gives no rows."""
    model = learn(spark, docs)

    def make():
        def ok(text: str | None) -> bool:
            lang, score = model.predict(text) if model else (UNKNOWN, 0.0)
            return lang != UNKNOWN and score >= least

        return ok

    return keep_rows(docs, "text", make)
