"""Language identification in two steps: the family, then the languages within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursewright.llm import words
from coursewright.llm.staging import unused

# Families of closely related languages by language code.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr ne pa gu ur",
    "semitic": "ar he mt am",
}
#: Rows of each language that the model is fitted on, at most; all others are only predicted.
SAMPLE_ROWS = 400
#: Columns that byte runs of the given lengths are hashed to.
COLUMNS, RUNS = 8192, (1, 2, 3, 4)
#: Texts judged at once: their bytes, and their number, since each takes a row of COLUMNS numbers.
SLICE_BYTES, SLICE_ROWS = 512 << 10, 256
#: Passes of the solver over the sample, its penalty and the scale of a text's shares.
PASSES, PENALTY, SCALE = 30, 1.0, 40.0
UNKNOWN = "und"


def family_of(language: str) -> str:
    """The family's name; a language that is not listed is a family of its own."""
    return next((name for name, codes in FAMILIES.items() if language in codes.split()), f"of {language}")


_LETTER = np.full(256, 0x20, dtype=np.uint8)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)


def shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, COLUMNS): how a text's byte runs are spread over the columns.

    A-Z and accented Latin letters are taken in lower case, other ASCII as one blank.
    """
    n = len(offsets) - 1
    plain = _LETTER[data]
    accented = np.zeros(len(data), dtype=bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    plain = np.where(accented, plain + 0x20, plain).astype(np.uint8)
    row = np.repeat(np.arange(n), np.diff(offsets))
    keep = np.ones(len(plain), dtype=bool)
    keep[1:] = (plain[1:] != 0x20) | (plain[:-1] != 0x20) | (row[1:] != row[:-1])
    plain, row = plain[keep].astype(np.uint64), row[keep]
    out = np.zeros(n * COLUMNS, dtype=np.float32)
    code = np.zeros(len(plain), dtype=np.uint64)
    for size in range(1, max(RUNS) + 1):
        if len(plain) < size:
            break
        code = (code[: len(plain) - size + 1] << np.uint64(8)) | plain[size - 1 :]
        if size not in RUNS:
            continue
        same = row[: len(code)] == row[size - 1 :]
        hashed = (code + np.uint64(size << 40)) * np.uint64(0x9E3779B97F4A7C15)
        column = (hashed >> np.uint64(64 - (COLUMNS.bit_length() - 1))).astype(np.int64)
        out += np.bincount((row[: len(code)] * COLUMNS + column)[same], minlength=n * COLUMNS).astype(np.float32)
    table = out.reshape(n, COLUMNS)
    return table / np.maximum(table.sum(axis=1, keepdims=True), 1)


def machine(x: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A linear support vector machine (squared hinge loss, dual coordinate descent); the last weight is the offset.

    Fitted on ``rows`` of ``x``, which is not copied.
    """
    weight, offset, share = np.zeros(x.shape[1]), 0.0, np.zeros(len(rows))
    ridge = 0.5 / PENALTY
    norm = np.einsum("ij,ij->i", x, x)[rows] + 1 + ridge
    rng = np.random.default_rng(1)
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)):
            row = x[rows[i]]
            slope = y[i] * (row @ weight + offset) - 1 + ridge * share[i]
            fresh = max(0.0, share[i] - slope / norm[i])
            if fresh != share[i]:
                step = (fresh - share[i]) * y[i]
                weight += step * row
                offset += step
                share[i] = fresh
    return np.append(weight, offset)


def one_versus_one(x: np.ndarray, labels: np.ndarray, names: list[str]) -> np.ndarray:
    """(pairs, COLUMNS + 1): a machine for each pair of names, the first of which is positive."""
    made = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            own = np.flatnonzero((labels == a) | (labels == b))
            made.append(machine(x, own, np.where(labels[own] == a, 1.0, -1.0)))
    return np.asarray(made, dtype=np.float32).reshape(len(made), COLUMNS + 1)


def choose(table: np.ndarray, names: list[str], machines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chosen name's number, score): most votes, then the largest sum of margins.

    The score is the least certain vote of the chosen name, as a logistic value from 0.5.
    """
    n, m = len(table), len(names)
    if m == 1:
        return np.zeros(n, dtype=np.int64), np.ones(n)
    margin = (table * SCALE) @ machines[:, :-1].T + machines[:, -1]
    votes, total = np.zeros((n, m)), np.zeros((n, m))
    least = np.full((n, m), np.inf)
    pair = 0
    for i in range(m):
        for j in range(i + 1, m):
            own = margin[:, pair]
            for name, value in ((i, own), (j, -own)):
                votes[:, name] += value > 0
                total[:, name] += value
                least[:, name] = np.minimum(least[:, name], value)
            pair += 1
    best = np.lexsort((total, votes), axis=1)[:, -1]
    certain = 1 / (1 + np.exp(-2.0 * np.clip(least[np.arange(n), best], -30, 30)))
    return best, certain


@dataclass
class Model:
    """Machines between families, and between the languages of each."""

    families: list[str]
    between: np.ndarray
    languages: dict[str, list[str]]
    within: dict[str, np.ndarray]

    def predict(self, table: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return [UNKNOWN] * len(table), np.zeros(len(table))
        family, score = choose(table, self.families, self.between)
        names = np.empty(len(table), dtype=object)
        for k, name in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            if len(rows):
                best, certain = choose(table[rows], self.languages[name], self.within[name])
                names[rows] = np.asarray(self.languages[name], dtype=object)[best]
                score[rows] *= certain
        return names.tolist(), score


def _lookup(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(v) for pair in sorted(values.items()) for v in pair))


def _limits(known: DataFrame, bounds: dict[str, int], sample_rows: int) -> dict[str, tuple[int, int]]:
    """language -> (largest draw, number) of its ``sample_rows`` least distinct draws up to its bound."""
    within = known.where(F.col("draw") <= F.element_at(_lookup(bounds), F.col("lang"))).select("lang", "draw").distinct()
    ranked = within.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("n") <= sample_rows)
    return {r.lang: (r.most, r.n) for r in ranked.groupBy("lang").agg(F.max("draw").alias("most"), F.count(F.lit(1)).alias("n")).collect()}


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from (text, lang) rows; null or empty texts and null languages are left out.

    Of each language the ``sample_rows`` distinct texts with the least hashes are used, or all
    if it has fewer; copies of a text count once.  A bound on the hash, set by the language's
    number of distinct texts, leaves about twice as many to be ranked, whatever the size of the
    table; where it leaves too few, all are ranked.  Only the chosen texts' spread over the
    columns reaches the driver, which fits the machines.
    """
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND text <> ''").select("lang", "text", F.xxhash64("text").alias("draw"))
    distinct = {r.lang: r.n for r in known.select("lang", "draw").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not distinct:
        return Model([], np.empty((0, 0)), {}, {})
    bounds = {name: min((1 << 63) - 1, (2 * sample_rows << 64) // n - (1 << 63)) for name, n in distinct.items()}
    limits = _limits(known, bounds, sample_rows)
    short = [name for name, n in distinct.items() if limits.get(name, (0, 0))[1] < min(n, sample_rows)]
    if short:
        limits |= _limits(known.where(F.col("lang").isin(short)), dict.fromkeys(short, (1 << 63) - 1), sample_rows)
    limits = {name: most for name, (most, _) in limits.items()}
    chosen = known.where(F.col("draw") <= F.element_at(_lookup(limits), F.col("lang"))).groupBy("lang", "draw").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.pieces(batch, "text", SLICE_BYTES, SLICE_ROWS):
                rows = [row.astype(np.float16).tobytes() for row in shares(*words.buffers(part.column("text"))) * 256]
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("draw"), pa.array(rows, pa.binary())], names=["lang", "draw", "row"])

    got = chosen.mapInArrow(run, "lang string, draw long, row binary").collect()
    got.sort(key=lambda r: (r.lang, r.draw))
    x = np.empty((len(got), COLUMNS), dtype=np.float32)
    for k, r in enumerate(got):
        x[k] = np.frombuffer(r.row, np.float16)
    x *= SCALE / 256
    languages = np.asarray([r.lang for r in got], dtype=object)
    del got
    groups: dict[str, list[str]] = {}
    for name in sorted(limits):
        groups.setdefault(family_of(name), []).append(name)
    families = sorted(groups)
    of = np.asarray([family_of(name) for name in languages], dtype=object)
    within = {name: one_versus_one(x, languages, groups[name]) for name in families}
    return Model(families, one_versus_one(x, of, families), groups, within)


def lettered(text: str = "text") -> Column:
    """Whether a text holds a letter; false for a null text."""
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), by whole texts alone.

    ``und`` with score 0 for a null text, one without a letter, or a model without languages.
    Columns named lang_pred or score are replaced, all others kept.  One pass, no shuffle.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    (known_col,) = unused(docs, "_lettered")
    marked = docs.select(*keep, lettered(text).alias(known_col))
    schema = T.StructType([docs.schema[c] for c in keep]).add("lang_pred", T.StringType()).add("score", T.DoubleType())
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.pieces(batch, text, SLICE_BYTES, SLICE_ROWS):
                names, scores = sent.value.predict(shares(*words.buffers(part.column(text))))
                known = part.column(known_col).to_numpy(zero_copy_only=False).astype(bool)
                names = [name if ok else UNKNOWN for name, ok in zip(names, known, strict=True)]
                scores = np.where(known, scores, 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return marked.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; never for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
