"""Scores of texts under a hashed maximum-entropy language model.

A token is predicted in three factors: its class, its slot within the class, and its share of the
slot.  Class and slot are softmaxes over hashed features of the words before (the last one, the
last two, and the one before the last); the share is the token's part of
the slot's training tokens.  The most frequent words have a slot each; all other words share the
remaining slots by hash.  So the cost of a token and the size of the model do not depend on
the vocabulary, and every word, also an unseen one, has a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursewright.llm import words
from coursewright.llm.staging import Stages

#: Classes, slots of a class, and classes whose slots hold one frequent word each.
CLASSES, SLOTS, OWN = 32, 32, 16
#: Rows of hashed features, and rounds of gradient updates, each over its own share of the training texts.
BUCKETS, ROUNDS = 1 << 15, 4
#: Training tokens from which one task sends a gradient, whose size is that of the weights.
LEARNED = 3_000_000
#: Words whose counts go to every task; the others' counts are joined.
FREQUENT = 1 << 16
#: Tokens whose probabilities are held at once, prior weight and step of an update.
_TOKENS, _PRIOR, _STEP, _MOST = 1 << 14, 10.0, 0.5, 1.0
END = int(words.draws(1, 41)[0])
_CELL = np.uint64(44)


def _token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first): the words of each text in lower case and one end."""
    data = words.lowered(data)
    start, end, first = words.word_bounds(data, offsets)
    texts = len(offsets) - 1
    out = np.empty(len(start) + texts, np.uint64)
    out[np.arange(len(start)) + np.repeat(np.arange(texts), np.diff(first))] = words.word_hashes(data, start, end)
    out[first[1:] + np.arange(texts)] = END
    return out, first + np.arange(texts + 1)


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for piece in words.pieces(batch, "text"):
        yield piece, *_token_hashes(*words.buffers(piece.column("text")))


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, n): how often each token hash occurs in the ``text`` column; the end of a text is a token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes, _ in _tokens(batch):
                token, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    return texts.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What tasks know of the counts: bounded by ``FREQUENT`` words and ``CLASSES`` * ``SLOTS`` slots."""

    total: int  # training tokens
    distinct: int  # distinct training tokens
    token: np.ndarray  # frequent tokens by hash
    count: np.ndarray
    slot: np.ndarray  # their slots
    mass: np.ndarray  # of each slot: training tokens and half of its words, one unseen included
    head: np.ndarray  # by the leading bits of a hash: the first frequent token that may have them

    @property
    def floor(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each token among the frequent ones, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        if not len(self.token):
            return out
        cell = (hashes >> _CELL).astype(np.int64)
        at, stop = self.head[cell], self.head[cell + 1]
        left = np.flatnonzero(at < stop)
        while len(left):
            here = at[left]
            hit = self.token[here] == hashes[left]
            out[left[hit]] = here[hit]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return out

    def slots(self, hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
        known = place >= 0
        out = _shared_slot(hashes)
        out[known] = self.slot[place[known]]
        return out


def _shared_slot(hashes: np.ndarray) -> np.ndarray:
    return OWN * SLOTS + (hashes & np.uint64((CLASSES - OWN) * SLOTS - 1)).astype(np.int32)


def _vocabulary(counts: DataFrame) -> Vocabulary:
    """From the written (token, n); what comes to the driver is bounded by ``FREQUENT`` rows and the slots."""
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.orderBy(F.col("n").desc(), "token").limit(FREQUENT).toArrow()
    token, count = (top.column(c).to_numpy() for c in ("token", "n"))
    token = token.view(np.uint64)
    shared = (CLASSES - OWN) * SLOTS
    slot = _shared_slot(token)
    slot[: OWN * SLOTS] = np.arange(min(OWN * SLOTS, len(token)))
    masses = np.zeros(CLASSES * SLOTS)
    kinds = np.zeros(CLASSES * SLOTS)
    by = counts.groupBy(F.col("token").bitwiseAND(shared - 1).alias("slot")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    for row in by.toLocalIterator():
        masses[OWN * SLOTS + row.slot] += row.n
        kinds[OWN * SLOTS + row.slot] += row.v
    own = min(OWN * SLOTS, len(token))
    shares = _shared_slot(token[:own])
    np.subtract.at(masses, shares, count[:own])
    np.subtract.at(kinds, shares, 1)
    masses[:own], kinds[:own] = count[:own], 1
    order = np.argsort(token)
    token, count, slot = token[order], count[order], slot[order]
    cells = np.arange((1 << (64 - int(_CELL))) + 1, dtype=np.uint64)
    head = np.searchsorted((token >> _CELL), cells).astype(np.int32)
    mass = masses + 0.5 * (kinds + (np.arange(CLASSES * SLOTS) >= OWN * SLOTS))
    return Vocabulary(sums.n, sums.v, token, count, slot, mass, head)


class Model:
    """Weights: a row of ``CLASSES`` for each feature, and one of ``SLOTS`` for each feature and class."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        mass = vocabulary.mass.reshape(CLASSES, SLOTS) + 1e-3
        self.class_prior = (mass.sum(1) / mass.sum()).astype(np.float32)
        self.slot_prior = (mass / mass.sum(1, keepdims=True)).astype(np.float32)
        self.class_weights = np.zeros((BUCKETS, CLASSES), np.float32)
        self.slot_weights = np.zeros((BUCKETS, SLOTS), np.float32)

    def update(self, of_class: bool, bucket: np.ndarray, gradient: np.ndarray, expected: np.ndarray) -> None:
        """One step along the gradient, scaled for each weight by what was expected of it."""
        weights = self.class_weights if of_class else self.slot_weights
        step = np.log1p(np.maximum(gradient / (expected + _PRIOR), -0.9))
        weights[bucket] += np.clip(_STEP * step, -_MOST, _MOST).astype(np.float32)


def _features(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(feature, token): hashes of the words before each token, within its text."""
    before = []
    for back in (1, 2):
        shifted = np.full(len(hashes), back, np.uint64)
        shifted[back:] = hashes[:-back]
        for place in range(back):
            at = first[:-1] + place
            shifted[at[at < first[1:]]] = back
        before.append(shifted)
    one, two = before
    factors = words.draws(4, 57) | np.uint64(1)
    return np.stack([words.mix(one * factors[0]), words.mix(one * factors[1] + two * factors[2]), words.mix(two * factors[3])])


def _logits(prior: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> None:
    """``prior`` becomes the exponentials of its sums with weights; sums are within some tens, so nothing overflows."""
    row = np.empty(prior.shape, np.float32)
    for r in rows:
        prior += np.take(weights, r, axis=0, out=row, mode="clip")
    np.exp(prior, out=prior)


def _predict(model: Model, features: np.ndarray, slot: np.ndarray) -> Iterator[tuple]:
    """For ``_TOKENS`` at a time: (of class, rows of weights, probabilities times a sum, sums, outcome), first of the class, then of the slot."""
    salt = words.draws(CLASSES, 71)
    class_prior, slot_prior = np.log(model.class_prior), np.log(model.slot_prior)
    ones = np.ones(max(CLASSES, SLOTS), np.float32)
    for at in range(0, len(slot), _TOKENS):
        here = slice(at, at + _TOKENS)
        kind, inner = slot[here] // SLOTS, slot[here] % SLOTS
        rows = (features[:, here] & np.uint64(BUCKETS - 1)).astype(np.int64)
        # Arrays made here, not such as have come with the model: numpy adds those at places ten times slower.
        p = np.empty((len(kind), CLASSES), np.float32)
        p[:] = class_prior
        _logits(p, rows, model.class_weights)
        yield True, rows, p, p @ ones[:CLASSES], kind
        # The features of a slot are those of its class.
        rows = (words.mix(features[:, here] ^ salt[kind]) & np.uint64(BUCKETS - 1)).astype(np.int64)
        p = np.empty((len(kind), SLOTS), np.float32)
        np.take(slot_prior, kind, axis=0, out=p, mode="clip")
        _logits(p, rows, model.slot_weights)
        yield False, rows, p, p @ ones[:SLOTS], inner


def _gradients(texts: DataFrame, model: Model) -> DataFrame:
    """(of_class, bucket, gradient, expected): sums over all tokens of ``texts``, one row a bucket that has any.

    A task sends the rows it has touched once; they are dealt by bucket and summed as they
    come, so memory is bounded by the weights whatever the number of tasks.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    width = max(CLASSES, SLOTS)
    schema = "of_class boolean, bucket int, gradient binary, expected binary"

    def rows(of_class: bool, observed: np.ndarray, expected: np.ndarray) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(expected.any(1))
        for at in range(0, len(used), 4096):
            part = used[at : at + 4096]
            sums = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (observed[part] - expected[part], expected[part])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), of_class)), pa.array(part.astype(np.int32)), *sums], names=["of_class", "bucket", "gradient", "expected"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        columns = np.arange(width)
        sums = {k: [np.zeros((BUCKETS, width), np.float32) for _ in range(2)] for k in (True, False)}
        for batch in batches:
            for _, hashes, first in _tokens(batch):
                slot = model.vocabulary.slots(hashes, model.vocabulary.find(hashes))
                for of_class, buckets, p, total, outcome in _predict(model, _features(hashes, first), slot):
                    observed, expected = sums[of_class]
                    p /= total[:, None]
                    for r in buckets:
                        cells = r * width
                        np.add.at(observed.ravel(), cells + outcome, np.float32(1))
                        np.add.at(expected.ravel(), (cells[:, None] + columns[: p.shape[1]]).ravel(), p.ravel())
        for of_class, (observed, expected) in sums.items():
            yield from rows(of_class, observed, expected)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bool, list[np.ndarray]] = {}
        for batch in batches:
            of_class, bucket = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("of_class", "bucket"))
            for kind in np.unique(of_class):
                own = np.flatnonzero(of_class == kind)
                held = sums.setdefault(bool(kind), [np.zeros((BUCKETS, width), np.float32) for _ in range(2)])
                for total, name in zip(held, ("gradient", "expected"), strict=True):
                    values = words.buffers(batch.column(name))[0].view(np.float32).reshape(-1, width)[own]
                    np.add.at(total, bucket[own], values)
        for kind, (gradient, expected) in sums.items():
            yield from rows(kind, gradient + expected, expected)

    sent = texts.select("text").mapInArrow(run, schema)
    return sent.repartition("of_class", "bucket").mapInArrow(add, schema)


def train(texts: DataFrame, counts: DataFrame, shard: Column) -> Model:
    """The model of the ``text`` column of ``texts`` with the written ``counts`` of its tokens.

    ``shard``, from 0 to ``ROUNDS`` - 1, deals the texts over the rounds: every text is learned
    from once.  A round's gradient is summed by Spark; the driver holds the weights only.  What
    the tasks send grows with the tokens, not with the partitions they come in.
    """
    model = Model(_vocabulary(counts))
    tasks = -(-model.vocabulary.total // (ROUNDS * LEARNED)) or 1
    for k in range(ROUNDS):
        sums = _gradients(texts.where(shard == k).coalesce(tasks), model).toArrow()
        for of_class in (True, False):
            own = sums.filter(pc.equal(sums.column("of_class"), of_class))
            if own.num_rows:
                wide = max(CLASSES, SLOTS)
                gradient, expected = (np.frombuffer(b"".join(own.column(c).to_pylist()), np.float32).reshape(-1, wide) for c in ("gradient", "expected"))
                width = CLASSES if of_class else SLOTS
                model.update(of_class, own.column("bucket").to_numpy(), gradient[:, :width], expected[:, :width])
    return model


def _scored(texts: DataFrame, model: Model) -> DataFrame:
    """``texts`` with n_tokens, n_known, base and score, as far as frequent words tell, and the others as ``rare``."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        v = model.vocabulary
        own = np.arange(CLASSES * SLOTS) < OWN * SLOTS
        # log10 of a frequent token's part of its slot, and of what is left to join for any other.
        inside = np.where(own[v.slot], 0.0, np.log10(v.count + 0.5) - np.log10(np.maximum(v.mass[v.slot], 0.5)))
        outside = -np.log10(np.maximum(v.mass, 0.5))
        plain = np.log10(v.count + 0.5) - np.log10(v.floor)
        for batch in batches:
            for piece, hashes, first in _tokens(batch):
                place = v.find(hashes)
                slot = v.slots(hashes, place)
                known = place >= 0
                base, score = np.zeros(len(hashes)), outside[slot]
                base[known], score[known] = plain[place[known]], inside[place[known]]
                at = 0
                for of_class, _, p, total, outcome in _predict(model, _features(hashes, first), slot):
                    score[at : at + len(outcome)] += np.log10(p[np.arange(len(outcome)), outcome] / total)
                    at += 0 if of_class else len(outcome)
                n = np.diff(first)
                sums = [np.add.reduceat(x, first[:-1]) for x in (known.astype(np.int64), base, score)]
                text = np.repeat(np.arange(len(n)), n)[~known]
                rare = hashes[~known].view(np.int64)
                parts = np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *[piece.column(c) for c in kept], pa.array(n), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(parts), pa.array(rare)),
                ], names=[*kept, "n_tokens", "n_known", "base", "score", "rare"])

    made = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType()), ("rare", T.ArrayType(T.LongType()))]
    schema = T.StructType([*texts.select(*kept).schema.fields, *[T.StructField(*field) for field in made]])
    return texts.mapInArrow(run, schema)


def score_texts(docs: DataFrame, learned: Column, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_tokens, n_known, train_tokens, base_score and score of each whole text.

    Tokens are the words in lower case (A-Z), stretches of characters other than space and tab
    to carriage return, and one end; a null text is empty.  The model and the counts are learned
    from the rows where ``learned`` holds (null: not).  ``base_score`` sums log10 of the share of each
    token among all training tokens, half a count added to each and to one that is unseen;
    ``n_known`` counts tokens that are in the training texts; ``score`` is the log10 probability of the
    text under the model.

    Every row counts, repeated ones too; without training texts all tokens share what the prior gives.  Columns
    with the names of results are replaced, all others are kept.  An empty table gives none.
    """
    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in docs.columns if c not in (*names, text)]
    stages = Stages(docs.sparkSession)
    rows = docs.select(F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)]).alias("kept"), F.col(text).alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"))
    texts = rows.where("learned").select("text")
    counts = stages.keep("counts", token_counts(texts))
    model = train(texts, counts, F.pmod(F.xxhash64("text"), F.lit(ROUNDS)))
    scored = _scored(rows.select("kept", "text"), model).withColumn("row", F.monotonically_increasing_id())
    scored = stages.keep("scored", scored)
    floor = float(np.log10(model.vocabulary.floor))
    # The counts of what is not frequent: met by token, summed by row.
    rare = scored.select("row", F.explode("rare").alias("token")).groupBy("row", "token").agg(F.count(F.lit(1)).alias("times"))
    n = F.coalesce("n", F.lit(0))
    looked = rare.join(counts.hint("merge"), "token", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("more_known"),
        F.sum(F.col("times") * F.log10(n + 0.5)).alias("more"),
        F.sum(F.col("times") * (F.log10(n + 0.5) - floor)).alias("more_base"),
    )
    joined = scored.drop("rare").join(looked, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return joined.select(
        *[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(kept)],
        "n_tokens",
        plus("n_known", "more_known").alias("n_known"),
        F.lit(model.vocabulary.total).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"),
        plus("score", "more").alias("score"),
    )
