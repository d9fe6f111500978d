"""Language identification in two steps: the family first, then one-versus-one linear support vector machines inside it.

A text's features are the frequencies of hashed trigrams of the bytes of its lower-cased words. All machines are linear and
trained here, on the driver, with the squared hinge loss; one product of matrices applies all of them to a batch. The machines only choose among
the languages they know: whether a text is in the chosen one at all is told by how well its trigrams fit that language's own, against
how well those of the sample do.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.arrays import _IS_WORD, flat, large, slices
from glyphmill.llm.session import released, table

#: Languages that are hard to tell apart share a family; one that is missing here is a family by itself.
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da", "no"), "romance": ("fr", "es", "it", "pt", "ro", "ca"), "slavic": ("ru", "uk", "pl", "cs", "bg", "sr")}
BUCKETS = 1 << 12
#: Texts whose features are held at once.
ROWS = 512


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram frequencies of each text of a large_string array, the share of its bytes other than ASCII white space that belong to words with letters, and the number of its trigrams."""
    data, offsets = flat(pc.utf8_lower(column))
    n, rows = len(data), len(offsets) - 1
    word = _IS_WORD[data] & ~((data >= 48) & (data < 58))
    b = np.where(word, data, 32).astype(np.int64)
    before, after = np.full(n, 32, np.int64), np.full(n, 32, np.int64)
    before[1:], after[:-1] = b[:-1], b[1:]
    some = np.diff(offsets) > 0
    before[offsets[:-1][some]] = after[offsets[1:][some] - 1] = 32  # a text's neighbours are not its own
    row = np.repeat(np.arange(rows), np.diff(offsets))
    code = ((before * 961 + b) * 961 + after) * 0x9E3779B1 >> 13 & BUCKETS - 1
    at = np.flatnonzero(word)
    counts = np.bincount(row[at] * BUCKETS + code[at], minlength=rows * BUCKETS).reshape(rows, BUCKETS)
    letters = np.bincount(row[at], minlength=rows)
    visible = np.bincount(row[data > 32], minlength=rows)
    return (counts / np.maximum(letters, 1)[:, None]).astype(np.float32), letters / np.maximum(visible, 1), letters


@dataclass(frozen=True)
class Model:
    """families: their names; langs: of each family; pairs: what each row of weights decides between, ("", family, family) or (family, lang, lang)."""

    families: tuple[str, ...]
    langs: dict[str, tuple[str, ...]]
    pairs: tuple[tuple[str, str, str], ...]
    weights: np.ndarray
    bias: np.ndarray
    fits: dict[str, "Fit"]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Family, language and margin (the least by which the winner beats another of its level) of each row. Each level is a vote of its machines; of equal votes the larger sum of margins wins, then the first name."""
        scores = x @ self.weights.T + self.bias if self.pairs else np.zeros((len(x), 0), np.float32)
        family, margin = self._vote("", self.families, scores)
        lang = np.empty(len(x), object)
        for f in self.families:
            own = np.flatnonzero(family == f)
            lang[own], m = self._vote(f, self.langs[f], scores[own])
            margin[own] = np.minimum(margin[own], m)
        return family, lang, margin

    def _vote(self, level: str, names: tuple[str, ...], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        votes, least = np.zeros((len(scores), len(names))), np.full((len(scores), len(names)), 1e9)
        for k, (own, a, b) in enumerate(self.pairs):
            if own == level:
                for name, s in ((a, scores[:, k]), (b, -scores[:, k])):
                    j = names.index(name)
                    votes[:, j] += (s > 0) + np.tanh(s) * 1e-3
                    least[:, j] = np.minimum(least[:, j], s)
        if not names:
            return np.full(len(scores), None, object), np.zeros(len(scores))
        best = votes.argmax(1)
        return np.array(names, object)[best], least[np.arange(len(scores)), best]


@dataclass(frozen=True)
class Fit:
    """How the texts of one language fit its trigrams: logs of their shares; mean, spread of a text's mean, and spread of one trigram; the farthest that a text of the sample is below the mean, in spreads for its length."""

    logs: np.ndarray
    mean: float
    of_text: float
    of_one: float
    farthest: float

    def below(self, x: np.ndarray, trigrams: np.ndarray) -> np.ndarray:
        return (self.mean - x @ self.logs) / (self.of_text + self.of_one / np.sqrt(np.maximum(trigrams, 1)))


#: A text is as far below its language's mean as this many times the sample's last percentile at most. Of a language with fewer texts in the sample than ENOUGH that isn't known, and no text is rejected for it.
FARTHEST, ENOUGH = 2.5, 30


def fitted(x: np.ndarray, trigrams: np.ndarray) -> Fit:
    share = np.average(x, axis=0, weights=np.maximum(trigrams, 1)).astype(np.float64)
    share = (share + 1e-6) / (share + 1e-6).sum()
    logs = np.log(share)
    mean = float(share @ logs)
    of_one = float(np.sqrt(share @ (logs - mean) ** 2)) + 1e-3
    own = x @ logs
    long_ = own[trigrams >= np.median(trigrams)]
    first = Fit(logs.astype(np.float32), float(np.median(long_)), float(long_.std()) + 0.02, of_one, 0.0)
    if len(x) < ENOUGH:
        return Fit(first.logs, first.mean, first.of_text, first.of_one, float("inf"))
    return Fit(first.logs, first.mean, first.of_text, first.of_one, float(max(1.0, np.quantile(first.below(x, trigrams), 0.99))) * FARTHEST)


def machine(x: np.ndarray, y: np.ndarray, cost: float = 100.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """A linear machine for y of -1 and 1: squared hinge loss, classes weighted alike, accelerated gradient descent on features scaled by their spread."""
    scale = 1 / np.sqrt(x.mean(0) + 1e-4)
    z = np.concatenate([x * scale, np.ones((len(x), 1))], 1).astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(z.shape[1], np.float32)
    u = z.mean(0)
    for _ in range(20):  # the largest curvature, by power iteration
        u = z.T @ (share * (z @ (u / (np.linalg.norm(u) + 1e-12))))
    step = 1 / (1 / cost + 2.2 * float(np.linalg.norm(u)))
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (z @ v))
        new = v - step * (v / cost - 2 * (z.T @ (share * slack * y)))
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return (w[:-1] * scale).astype(np.float32), float(w[-1])


def train(texts: pa.Array, langs: list[str]) -> Model:
    """Machines for the families met in langs and for the languages of each."""
    parts = [features(part) for _, part in slices(large(texts), rows=ROWS)] or [(np.zeros((0, BUCKETS), np.float32), None, np.zeros(0, np.int64))]
    x, trigrams = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    y = np.array(langs, object)
    names = sorted(set(langs))
    by = {f: tuple(n for n in names if family_of(n) == f) for f in sorted({family_of(n) for n in names})}
    of = np.array([family_of(n) for n in langs], object)
    levels = [("", tuple(by), of)] + [(f, own, y) for f, own in by.items()]
    pairs, rows = [], []
    for level, own, label in levels:
        for a, b in combinations(own, 2):
            at = np.flatnonzero((label == a) | (label == b))
            pairs.append((level, a, b))
            rows.append(machine(x[at], np.where(label[at] == a, 1, -1).astype(np.float32)))
    weights = np.stack([w for w, _ in rows]) if rows else np.zeros((0, BUCKETS), np.float32)
    return Model(tuple(by), by, tuple(pairs), weights, np.array([b for _, b in rows], np.float32), {n: fitted(x[y == n], trigrams[y == n]) for n in names})


def fit(docs: DataFrame, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on about sample_rows of the rows with a label and text, chosen by a hash of the id: the bound on what the driver holds. Everything else covers all rows."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\S"))
    every = max(1, labelled.count() // sample_rows)
    rows = labelled.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(every)) == 0)
    got = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).toArrow()
    return train(got["text"], got["lang"].to_pylist())


RESULT = "struct<family:string,lang:string,margin:double,kept:boolean>"


def identified(text: F.Column, model: Model, min_letters: float = 0.25) -> F.Column:
    """Family, language, margin and whether the text is kept, of a text column. A text is rejected, with language "und" and margin 0, if it has no letter, or fewer than min_letters of its visible bytes lie in words of letters, or
    if its trigrams don't fit the predicted language as those of the sample's texts do (another language, or letters that are none); so is a null."""

    @F.arrow_udf(RESULT)
    def apply(column: pa.Array) -> pa.Array:
        family, lang, margin, kept = [], [], [], []
        for _, part in slices(large(column), rows=ROWS):
            x, share, trigrams = features(part)
            f, l, m = model.predict(x)
            ok = (share >= min_letters) & (share > 0) & bool(model.families)
            for name, fit_ in model.fits.items():
                own = np.flatnonzero(l == name)
                ok[own] &= fit_.below(x[own], trigrams[own]) <= fit_.farthest
            family.append(np.where(ok, f, "und"))
            lang.append(np.where(ok, l, "und"))
            margin.append(np.where(ok, m, 0.0))
            kept.append(ok)
        released()
        joined = lambda parts, kind: pa.array(np.concatenate(parts).tolist() if parts else [], kind)
        return pa.StructArray.from_arrays([joined(family, pa.string()), joined(lang, pa.string()), joined(margin, pa.float64()), joined(kept, pa.bool_())], ["family", "lang", "margin", "kept"])

    return apply(text)


def language_id(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, family, lang, margin, kept: one row for each row, whatever it holds; other columns are left out.

    Null, empty and letterless texts give "und" and kept false; a very long text is one row of features like others; of equal votes the larger sum of margins wins, then the first name; repeated rows give repeated rows; an empty table gives none."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", identified(F.col("text"), model).alias("r")).select("doc_id", "r.*")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id(docs, fit(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is recognised, unchanged; those of null, empty or letterless texts, and of texts that don't fit the language predicted for them, go.

    Repeated rows stay or go alike; without any labelled text nothing is recognised; an empty table stays empty; other columns are passed on (one called _identified_ is not allowed to be among them)."""
    model = fit(docs)
    found = docs.withColumn("_identified_", identified(F.col("text").cast("string"), model))
    return found.where("_identified_.kept").drop("_identified_")
