"""Token counts and byte-level BPE against the libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coursewright.llm import bpe, pretokens, queries, token_counts

RANK_FILE, JSON_FILE = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def vocabulary():
    with open(RANK_FILE, "rb") as file:
        return bpe.Vocabulary(file.read())


@pytest.fixture(scope="module")
def library():
    with open(RANK_FILE, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(8)
    parts = [*"'' \n\t sdtmrevl!?1²A é  \u0085\x1c　中😀\r", "'re", "'s", "ll", "  ", "<|endoftext|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(4000)] + ["", "'", " "]


def encoded(vocabulary, texts):
    flat, first = vocabulary.encode_batch(pa.array(texts, pa.string()))
    return [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]


def test_odd_texts(vocabulary, library, odd_texts):
    assert encoded(vocabulary, odd_texts) == library.encode_ordinary_batch(odd_texts)


def test_every_code_point_is_split_alike(vocabulary, library):
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}a 1{chr(c)}1 !{chr(c)}!  {chr(c)}" for c in points]
    assert encoded(vocabulary, texts) == library.encode_ordinary_batch(texts)


def test_very_long_pretokens(vocabulary, library):
    for text in ("ab" * 40_000 + "x", "a" * 70_001, "é" * 20_000, "".join(random.Random(1).choices("etaoin", k=50_000))):
        assert vocabulary.encode(text.encode()) == library.encode_ordinary(text)
    assert not vocabulary.buckets and not any(vocabulary.bitmap)


def test_pretokens_share_a_queue(vocabulary, library):
    rng = random.Random(2)
    texts = ["".join(rng.choices("etaoinshé", k=rng.randrange(1, 30))) for _ in range(6000)] + ["x" * 50_000, "", "é", "é"]
    got = [np.frombuffer(ids, np.int32).tolist() for ids in vocabulary.encode_all([t.encode() for t in texts])]
    assert got == library.encode_ordinary_batch(texts)
    assert not vocabulary.buckets and not any(vocabulary.bitmap)


def test_each_merge_looks_two_pairs_up_at_most(library):
    with open(RANK_FILE, "rb") as file:
        vocabulary = bpe.Vocabulary(file.read())
    asked = []

    class Counted(dict):
        def get(self, key, default=None):
            asked.append(key)
            return dict.get(self, key, default)

    vocabulary.ranks = Counted(vocabulary.ranks)
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("etaoinsh", k=9)) for _ in range(3000))
    got = encoded(vocabulary, [text])
    assert got == [library.encode_ordinary(text)]
    assert len(asked) <= 2 * (len(text) - len(got[0]))


def test_pairs_of_lower_rank_come_first():
    rng = random.Random(4)
    for alphabet, longest in (("ab", 6), ("abcd", 4), ("abcdef", 3)):
        tokens = list(alphabet) + list({"".join(rng.choices(alphabet, k=rng.randrange(2, longest + 1))) for _ in range(150)})
        rng.shuffle(tokens)
        ranks = {t.encode(): k for k, t in enumerate(tokens)}
        vocabulary = bpe.Vocabulary(b"\n".join(base64.b64encode(t) + b" %d" % k for t, k in ranks.items()))
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(rng.choices(alphabet, k=rng.choice([1, 3, 9, 30, 300]))) for _ in range(2000)]
        assert encoded(vocabulary, texts) == library.encode_ordinary_batch(texts)
        assert not vocabulary.buckets and not any(vocabulary.bitmap)


def test_a_byte_that_the_vocabulary_lacks_fails():
    vocabulary = bpe.Vocabulary(b"YQ== 0\nYWI= 1")  # a, ab
    assert encoded(vocabulary, ["aab", "", "ab"]) == [[0, 1], [], [1]]
    with pytest.raises(KeyError):
        vocabulary.encode(b"aba" + b"b" * 3)


def test_encode_query(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op9_bpe"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_encode_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x y", None), (3, "x y", "c"), (3, "x y", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(docs, RANK_FILE)
    assert out.columns == ["doc_id", "ids"]
    back = bpe.decode(out.withColumn("decoded", F.lit(1)), RANK_FILE)
    got = sorted((r.doc_id or 0, len(r.ids), bytes(r.decoded)) for r in back.collect())
    assert got == [(0, 2, b"x y"), (1, 0, b""), (2, 0, b""), (3, 2, b"x y"), (3, 2, b"x y")]
    assert bpe.encode(docs.limit(0), RANK_FILE).count() == 0
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(nulls, RANK_FILE).collect()] == [None, b""]


def test_count_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    tokenizer = Tokenizer.from_file(JSON_FILE)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.QUERIES["op3_token_counts"](spark, sf).collect()}
    assert len(got) == len(docs)
    for i, text in docs.items():
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert got[i] == (len(text.encode()), n, n > 1024)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_follow_each_library(name, odd_texts):
    with open(P.path(name), "rb") as file:
        counter = token_counts.Counter("model" if name.endswith("model") else "json", file.read())
    assert counter.by_piece == (name == "byte_bpe_50k.json")
    assert counter.counts(pa.array(odd_texts)).tolist() == counter.whole(odd_texts)


def test_cache_is_filled_once(spark, tmp_path):
    rows = [(1, "some words"), (2, "some words"), (2, "some words"), (3, None), (4, ""), (None, "a <|endoftext|> b")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_tokens", F.lit("old"))
    cache = str(tmp_path / "cache")
    count = lambda d: sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(d, JSON_FILE, cache).collect())
    want = [(0, 17, 5), (1, 10, 2), (2, 10, 2), (2, 10, 2), (3, 0, 0), (4, 0, 0)]
    library = Tokenizer.from_file(JSON_FILE)
    want[0] = (0, 17, len(library.encode(rows[-1][1], add_special_tokens=False).ids))
    assert count(docs) == want
    stored = lambda: spark.read.parquet(cache)
    assert stored().select("content").distinct().count() == 3
    before = stored().count()
    assert count(docs) == want and stored().count() == before
    more = docs.union(spark.createDataFrame([(9, "new", "old")], docs.schema))
    assert count(more) == [*want, (9, 3, 1)] and stored().count() == before + 1
    other = token_counts.token_counts(docs, P.path("word_bpe_49k.json"), cache)
    assert other.count() == 6 and stored().select("tokenizer").distinct().count() == 2
    assert token_counts.token_counts(docs.limit(0), JSON_FILE, str(tmp_path / "none")).count() == 0


def test_memo_stays_bounded():
    memo = pretokens.Memo(limit=5)
    for k in range(50):
        keys = [b"%d" % j for j in range(k, k + 3)]
        assert memo.fill(keys, lambda new: [int(x) for x in new]) == [k, k + 1, k + 2]
        assert len(memo.young) + len(memo.old) <= 2 * (5 + 3)


def test_memo_is_bounded_in_bytes():
    memo = pretokens.Memo()
    for k in range(1000):
        long, short = [b"%d" % k * (50_000 // len(b"%d" % k)), b"%d" % k]
        assert memo.fill([long, short], lambda new: [len(x) for x in new]) == [len(long), len(short)]
    assert sum(map(len, [*memo.young, *memo.old])) < 10_000
    memo = pretokens.Memo(size=100_000)
    for k in range(1000):
        key = b"%07d" % k * 200
        assert memo.fill([key], lambda new: [x[:7] for x in new]) == [key[:7]]
        assert sum(map(len, [*memo.young, *memo.old])) < 2 * 110_000
