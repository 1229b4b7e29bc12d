"""Language ID with a string kernel.

A text is lower-cased, and every run of non-letters becomes one blank. The kernel of two texts is the number of different
1-, 2- and 3-grams that both have (blended spectrum, presence only), divided by the geometric mean of their own numbers.
N-grams of letters of any script have places in a table by hash, so there is no alphabet to cut. Landmark texts give the Nyström features K(x, landmarks)
K(landmarks, landmarks)^-1/2; one ridge regression for each language against the rest is fitted on them. As the kernel is
linear in presence, landmarks and weights fold into one matrix with a row per n-gram, and a batch of texts is scored as
one product of its presence matrix with it.

The model is fitted on a bounded sample: `per_class` texts (those of smallest hash of the key) of each of the `languages`
languages with most rows, of which `landmarks` are landmarks (fewer of each beyond MOST_LANDMARKS). Every row is scored,
whole texts only. lang, source and key are never inputs of a prediction.

keep_known() also drops texts that the language found does not explain. A 3-gram is typical of a language if a share
TYPICAL of its sample has it. The share of a text's 3-grams that are typical of the
language found, and CERTAIN / sqrt(their number) for chance in short texts, must reach a floor of the language: CAUTION
times the share that 99 % of its own sample reach, each text counted by the others. Unlike the scores of regressions
against the rest, whose sum is fixed, this does not depend on how many languages there are.

A text that is null or has no letter is `und` with score 0, as is everything if no row can be learned from. Rows with a
null key or null lang are scored but not learned from. Equal texts get equal results; ties go to the first language in
code point order. Other columns are kept or not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .runtime import map_batches

#: Texts of each language that the model is fitted on, those of them that are landmarks, languages learned, and landmarks in all.
PER_CLASS, LANDMARKS, LANGUAGES, MOST_LANDMARKS = 400, 64, 256, 2048
#: Bits of the places of shorter n-grams, and of 3-grams.
SHORT, LONG = 18, 20
#: Weight of the ridge.
RIDGE = 1e-3
#: Of a language's texts those that have a typical 3-gram, at least; the part of its texts' usual share that must be reached; three standard deviations of one 3-gram.
TYPICAL, CAUTION, CERTAIN = 0.05, 0.8, 1.5
#: Texts in one presence matrix.
ROWS = 64


def held_out(key: str = "doc_id") -> Column:
    """Rows never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def _places(codes: np.ndarray, bits: int, odd: int) -> np.ndarray:
    return (codes * np.uint64(odd) >> np.uint64(64 - bits)).astype(np.int64)


def grams(text: str | None) -> np.ndarray | None:
    """The places of the text's 1-, 2- and 3-grams, with repeats; 3-grams stand from 1 << SHORT on. None if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    s = np.where(_letters()[points], points, 0).astype(np.uint64)
    if not s.any():
        return None
    s = np.pad(s, 1)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    two = s[:-1] << np.uint64(21) | s[1:]
    three = two[:-1] << np.uint64(21) | s[2:]
    return np.concatenate([_places(s, SHORT, 0x9E3779B97F4A7C15), _places(two, SHORT, 0xD6E8FEB86659FD93), (1 << SHORT) + _places(three, LONG, 0xBF58476D1CE4E5B9)])


def _typical(rows: list[tuple[str, np.ndarray]], languages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of typical 3-grams, of which languages they are, and the floors of the languages."""
    each, floors = [], np.zeros(len(languages))
    for k, lang in enumerate(languages):
        own = [x for of, x in rows if of == lang]
        counts = np.bincount(np.concatenate([*own, np.zeros(0, np.int64)]), minlength=1 << LONG)
        each.append(np.flatnonzero((counts >= TYPICAL * len(own)) & (counts > 0)))
        if len(own) > 1:
            shares = [np.count_nonzero((counts[x] - 1 >= TYPICAL * (len(own) - 1)) & (counts[x] > 1)) / len(x) for x in own]
            floors[k] = CAUTION * np.quantile(shares, 0.01)
    at = np.unique(np.concatenate([*each, np.zeros(0, np.int64)]))
    of = np.zeros((len(at), len(languages)), bool)
    for k, x in enumerate(each):
        of[np.searchsorted(at, x), k] = True
    return at, of, floors


@dataclass
class Model:
    columns: np.ndarray  # the places of n-grams that landmarks have
    weights: np.ndarray  # n-gram x language
    bias: np.ndarray
    languages: list[str]
    typical_at: np.ndarray  # places of 3-grams
    typical: np.ndarray  # 3-gram x language
    floors: np.ndarray

    def scores(self, texts: list[str | None], familiar: np.ndarray | None = None) -> np.ndarray:
        """Rows of one-versus-rest outputs; a row of NaN for a text without letters. familiar: filled with how far each text's share is above each language's floor."""
        out = np.full((len(texts), len(self.languages)), np.nan)
        held = np.zeros((1 << SHORT) + (1 << LONG), bool)
        for at in range(0, len(texts), ROWS):
            part = texts[at : at + ROWS]
            matrix, norms = np.zeros((len(part), len(self.columns)), np.float32), np.full(len(part), np.nan)
            usual, threes = np.zeros((len(part), len(self.typical_at) if familiar is not None else 0), np.float32), np.ones((len(part), 1))
            for k, t in enumerate(part):
                if (places := grams(t)) is None:
                    continue
                held[places] = True
                norms[k] = np.sqrt(np.count_nonzero(held))
                matrix[k] = held[self.columns]
                if familiar is not None:
                    usual[k], threes[k] = held[self.typical_at + (1 << SHORT)], np.count_nonzero(held[1 << SHORT :])
                held[places] = False
            out[at : at + len(part)] = (matrix @ self.weights) / norms[:, None] + self.bias
            if familiar is not None:
                familiar[at : at + len(part)] = (usual @ self.typical.astype(np.float32) + CERTAIN * np.sqrt(threes)) / threes - self.floors
        return out

    def predict(self, texts: list[str | None], reject: bool = False) -> tuple[list[str], list[float]]:
        """Languages and scores; with reject, `und` for texts that the language found does not explain."""
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        familiar = np.zeros((len(texts), len(self.languages))) if reject else None
        scores = self.scores(texts, familiar)
        known = ~np.isnan(scores[:, 0])
        best = np.where(known, np.nan_to_num(scores).argmax(1), 0)
        if familiar is not None:
            known &= familiar[np.arange(len(texts)), best] >= 0
        chance = np.where(known, np.clip((np.nan_to_num(scores.max(1)) + 1) / 2, 0, 1), 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], chance.tolist()


def sample(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_class: int = PER_CLASS, languages: int = LANGUAGES) -> list[tuple[str, str]]:
    """(lang, text) of at most per_class rows of each of the languages with most rows, those of smallest hash of the key; held-out rows never."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("key").isNotNull() & F.col("lang").isNotNull() & ~held_out("key"))
    hashed = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 20))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not counts:
        return []
    # first by a share of the hashes that holds the smallest ones with near certainty, so that no language is sorted whole
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(int(min(1.0, (3 * per_class + 100) / n) * (1 << 20)) + 1)) for k, n in counts.items()))
    few = rows.withColumn("h", hashed).where(F.col("h") < share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.col("key").cast("string"), "text"))
    found = few.withColumn("rank", rank).where(F.col("rank") <= per_class).select("lang", "rank", "text").collect()
    return [(r["lang"], r["text"]) for r in sorted(found, key=lambda r: (r["rank"], r["lang"]))]


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    known = [(lang, np.unique(places)) for lang, t in rows if (places := grams(t)) is not None]
    languages = sorted({lang for lang, _ in known})
    if not languages:
        return Model(np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0), [], np.zeros(0, np.int64), np.zeros((0, 0), bool), np.zeros(0))
    seen = dict.fromkeys(languages, 0)
    chosen = []
    for lang, at in known:
        if seen[lang] < min(landmarks, max(1, MOST_LANDMARKS // len(languages))):
            seen[lang] += 1
            chosen.append(at)
    columns = np.unique(np.concatenate(chosen))
    norms = np.array([np.sqrt(len(at)) for _, at in known])

    def dense(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(columns)), np.float32)
        for k, at in enumerate(rows):
            where = np.searchsorted(columns, at)
            where = where[(where < len(columns)) & (columns[np.minimum(where, len(columns) - 1)] == at)]
            out[k, where] = 1
        return out

    marks = dense(chosen) / np.sqrt(np.array([len(at) for at in chosen], np.float32))[:, None]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.concatenate([dense([at for _, at in known[k : k + 256]]) @ marks.T for k in range(0, len(known), 256)]).astype(np.float64) / norms[:, None] @ root
    wanted = np.where(np.array([lang for lang, _ in known])[:, None] == np.array(languages), 1.0, -1.0)
    middle, level = features.mean(0), wanted.mean(0)
    centred = features - middle
    beta = np.linalg.solve(centred.T @ centred + ridge * len(known) * np.eye(root.shape[1]), centred.T @ (wanted - level))
    threes = [(lang, at[at >= 1 << SHORT] - (1 << SHORT)) for lang, at in known]
    return Model(columns, (marks.T.astype(np.float64) @ (root @ beta)).astype(np.float32), level - middle @ beta, languages, *_typical(threes, languages))


def predict(df: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score", reject: bool = False) -> DataFrame:
    """df with the predicted language and its score; with reject, `und` for texts that the language found does not explain."""
    kept = [f for f in df.schema if f.name not in (lang_pred, score)]
    keep, at = [df.columns.index(f.name) for f in kept], df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = model.predict(batch.column(at).to_pylist(), reject)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*(f.name for f in kept), lang_pred, score])

    return map_batches(df, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{lang_pred}` string", f"`{score}` double"]))


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: key, held_out, lang_pred, score."""
    model = fit(sample(df, key, text, lang))
    rows = df.select(F.col(f"`{key}`").alias("key"), held_out(f"`{key}`").alias("held_out"), F.col(f"`{text}`").alias("text"))
    return predict(rows, model).select(F.col("key").alias(key), "held_out", "lang_pred", "score")


def keep_known(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.25) -> DataFrame:
    """The rows of df whose language is found with at least that score and explains the text, with the language found as their lang."""
    model = fit(sample(df, key, text, lang))
    found = predict(df, model, text, "__lang", "__score", reject=True)
    return found.where((F.col("__lang") != "und") & (F.col("__score") >= least)).withColumn(lang, F.col("__lang")).select(*df.columns)
