"""Token counts by a digest cache: only contents that no earlier run has counted are encoded."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.llm import pretokens, words
from coursewright.session import stage

#: Largest tokenizer file that is sent to the workers.
TOKENIZER_BYTES = 64 << 20


class Counter:
    """Counts of one tokenizer, as its library gives them without added special tokens."""

    def __init__(self, kind: str, content: bytes):
        self.kind = kind
        self.memo = pretokens.Memo()
        self.special: list[bytes] = []
        self.by_piece = False
        if kind == "model":
            import sentencepiece

            self.tokenizer = sentencepiece.SentencePieceProcessor(model_proto=content)
        else:
            import tokenizers

            self.tokenizer = tokenizers.Tokenizer.from_str(content.decode())
            self.tokenizer.no_padding()
            self.tokenizer.no_truncation()
            spec = json.loads(content)
            self.special = [t["content"].encode() for t in spec.get("added_tokens") or []]
            # Merges never cross pre-tokens, so where the split is known a text's count is a sum.
            split = spec.get("pre_tokenizer") or {}
            self.by_piece = (
                spec.get("normalizer") is None
                and split.get("type") == "ByteLevel"
                and not split.get("add_prefix_space")
                and split.get("use_regex", True)
            )

    def whole(self, texts: list[str]) -> list[int]:
        if self.kind == "model":
            return [len(ids) for ids in self.tokenizer.encode(texts, num_threads=1)] if texts else []
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null counts as empty."""
        if not self.by_piece:
            return np.asarray(self.whole([t or "" for t in texts.to_pylist()]), dtype=np.int64)
        pieces, index, first = pretokens.distinct(texts)
        own = np.asarray(self.memo.fill(pieces, lambda new: self.whole([p.decode() for p in new])), dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(own[index])]) if len(own) else np.zeros(1, np.int64)
        out = total[first[1:]] - total[first[:-1]]
        data, offsets = words.buffers(texts)
        joined = data.tobytes()
        if any(s in joined for s in self.special):  # such strings are tokens: the library counts these texts
            rows = [k for k in range(len(out)) if any(s in joined[offsets[k] : offsets[k + 1]] for s in self.special)]
            out[rows] = self.whole([joined[offsets[k] : offsets[k + 1]].decode() for k in rows])
        return out


_loaded: dict[str, Counter] = {}


def _counter(version: str, kind: str, content: bytes) -> Counter:
    if version not in _loaded:
        _loaded.clear()
        _loaded[version] = Counter(kind, content)
    return _loaded[version]


def _cached(docs: DataFrame, cache: str, version: str) -> DataFrame:
    """(content, n_tokens) stored for this tokenizer; a content stored twice is taken once."""
    schema = "tokenizer string, content binary, n_tokens long"
    try:
        stored = docs.sparkSession.read.schema(schema).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = docs.sparkSession.createDataFrame([], schema)
    return stored.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame, tokenizer: str, cache: str, *, id_col: str = "doc_id", text: str = "text",
    normalise: Callable[[Column], Column] = lambda text: F.coalesce(text, F.lit("")),
) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of ``docs``, by whole texts.

    ``tokenizer`` is a file of the tokenizers (.json) or sentencepiece (.model) library; its
    digest is the version.  ``cache`` is a table in a shared folder, (tokenizer, content,
    n_tokens), made when missing.  ``normalise`` maps a text to what is encoded and digested;
    by default a null text is empty and nothing else changes; where it gives null the content is empty.  Contents that the cache lacks
    are encoded once each, whatever the number of rows that hold them, and appended.

    Rows that repeat an id are counted each.  A null id stays null.  Other columns are
    ignored; an empty table appends nothing and gives an empty result.

    Digests alone are shuffled for the look-up.  A missing content is fetched by the id of one
    row that holds it, so no task gathers the copies of a text.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as file:
        raw = file.read(TOKENIZER_BYTES + 1)
    if len(raw) > TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer} is larger than {TOKENIZER_BYTES} bytes")
    version = hashlib.sha256(raw).hexdigest()
    kind = "model" if tokenizer.endswith(".model") else "json"
    sent = spark.sparkContext.broadcast(raw)

    body = F.coalesce(normalise(F.col(text)), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), body.alias("body"), F.unhex(F.sha2(body, 256)).alias("content"))
    rows = stage(source.select("id", "content", F.octet_length("body").cast("long").alias("n_bytes")))
    misses = rows.groupBy("content").agg(F.min("id").alias("id")).join(_cached(docs, cache, version), "content", "left_anti")
    fetched = source.alias("s").join(
        misses.alias("m").hint("shuffle_hash"), F.col("s.id").eqNullSafe(F.col("m.id")) & (F.col("s.content") == F.col("m.content")), "left_semi"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(version, kind, sent.value)
        for batch in batches:
            for part in words.pieces(batch, "body"):
                counts = pa.array(counter.counts(part.column("body")))
                yield pa.RecordBatch.from_arrays([part.column("content"), counts], names=["content", "n_tokens"])

    fresh = fetched.select("body", "content").mapInArrow(run, "content binary, n_tokens long")
    fresh.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    # Written first, so that Spark can split a content that very many rows share.
    counted = stage(_cached(docs, cache, version).join(rows.select("content").distinct(), "content", "left_semi"))
    return rows.join(counted, "content").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
