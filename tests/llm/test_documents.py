"""Language, fingerprints, shards and packing against plain versions."""

import hashlib
import math
import zlib

import brute
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from coursewright.llm import fingerprints, language, packing, queries, sharding, words

SCHEMA = "doc_id long, text string"


def documents(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# ---- words -----------------------------------------------------------------------


def test_words_and_shingles():
    texts = ["a b", "", " \t\n", "one", "x\x0by\x0cz é", "end", "a b"]
    data, offsets = words.joined([t.encode() for t in texts])
    start, end, first = words.word_bounds(data, offsets)
    got = [[data[s:e].tobytes().decode() for s, e in zip(start[a:b], end[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [brute.words_of(t) for t in texts]
    hashes = words.word_hashes(data, start, end)
    flat = [w for ws in got for w in ws]
    assert len(set(hashes.tolist())) == len(set(flat)) and hashes[0] == hashes[flat.index("a", 2)]
    sets, parts = words.shingles(hashes, first, 2)
    assert np.diff(parts).tolist() == [1, 0, 0, 1, 3, 1, 1] and sets[0] == sets[-1]


# ---- language --------------------------------------------------------------------


def test_held_out_accuracy(spark, sf):
    got = queries.QUERIES["op4_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    tested = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in tested) >= 0.97 * len(tested)


def test_language_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    assert model.families == ["germanic", "romance"] and model.languages["romance"] == ["es", "fr"]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (None, "der die und"), (5, "é"), (6, "x" * 3_000_000)], SCHEMA)
    out = language.identify(odd.withColumn("score", F.lit("old")).withColumn("lang", F.lit(None).cast("string")), model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.select("doc_id", "lang_pred", "score").collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[None][0] == "de" and got[5][0] != "und" and got[6][0] != "und"
    none = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}
    one = language.fit(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in language.identify(docs.select("doc_id", "text"), one).collect()} == {"en"}
    assert language.identify(odd.limit(0), model).count() == 0


def test_sample_of_copied_and_unevenly_hashed_texts(spark):
    english = spark.range(900).select(F.concat(F.lit("the end of it "), "id").alias("text"), F.lit("en").alias("lang"))
    # Ten texts copied 2,000 times, and 1,000 texts with hashes in the upper tenth only.
    made = spark.range(40_000).select(F.concat(F.lit("und der die das "), "id").alias("text")).withColumn("draw", F.xxhash64("text"))
    high = made.where(F.col("draw") > int(0.8 * 2**63)).select("text")
    copied = high.limit(10).crossJoin(spark.range(2000)).select("text", F.lit("de").alias("lang"))
    model = language.fit(english.union(copied))
    assert model.families == ["germanic"] and model.languages["germanic"] == ["de", "en"]
    uneven = high.limit(1000).select("text", F.lit("de").alias("lang"))
    assert language.fit(english.union(uneven)).languages["germanic"] == ["de", "en"]
    # Copies do not change the model.
    once = language.fit(english.union(copied.distinct()))
    assert (once.within["germanic"] == model.within["germanic"]).all()


# ---- fingerprints ----------------------------------------------------------------


def test_fingerprint_query(spark, sf):
    rows = documents(spark, sf)
    want, texts = brute.edited(rows), dict(rows)
    got = {r.doc_id: r for r in queries.QUERIES["op5_fingerprints"](spark, sf).collect()}
    assert len(got) == len(rows)
    order = sorted(texts)
    errors, by_text = [], {}
    for n, i in enumerate(order):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == want[i][:2]
        assert by_text.setdefault(texts[i], r.fingerprint) == r.fingerprint
        own, changed = brute.shingle_set_exact(texts[i], 5), brute.shingle_set_exact(want[i][2], 5)
        ahead = brute.shingle_set_exact(texts[order[(n + 1) % len(order)]], 5)
        errors += [r.near_edited - brute.jaccard(own, changed), r.near_next - brute.jaccard(own, ahead)]
    assert abs(np.mean(errors)) < 0.02 and np.percentile(np.abs(errors), 95) < 0.1


def test_fingerprint_edges(spark):
    rows = [(3, "a b c d e f"), (1, None), (1, ""), (None, "zz"), (7, "é" * 9), (8, "long " * 200_000)]
    got = fingerprints.followed(spark.createDataFrame(rows, SCHEMA).withColumn("range", F.lit(1))).collect()
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert len(got) == 6 and by[(None, 2)].edited_fingerprint == by[(None, 2)].fingerprint
    assert by[(1, 0)].fingerprint == "" and by[(3, 11)].near_next == 0.0 and by[(8, 1_000_000)].near_edited > 0.1
    alone = fingerprints.followed(spark.createDataFrame([(4, "a b c d e f g h")], SCHEMA)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert fingerprints.followed(spark.createDataFrame([], SCHEMA)).count() == 0
    plain = fingerprints.fingerprint(spark.createDataFrame(rows, SCHEMA).withColumn("fingerprint", F.lit(0)))
    assert {(r.doc_id, r.fingerprint) for r in plain.collect()} == {(r.doc_id, r.fingerprint) for r in got}


def test_many_ranges_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "LEAST_ROWS", 3)
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 5)
    rows = [(i * i - 50, f"{'w%d ' % i * (i % 7)}{i}") for i in range(90)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.followed(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    assert got == {i: e[1] for i, e in brute.edited(rows).items()}


# ---- shards ----------------------------------------------------------------------


def test_shard_query(spark, sf):
    texts = dict(documents(spark, sf))
    got = queries.QUERIES["op6_sharding"](spark, sf).collect()
    assert len(got) == len(texts) and {r.law for r in got} == {"key"}
    for r in got:
        body = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body)) and 0 <= r.shard < 8
        assert r.grown_shard in (r.shard, 8)
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) > len(texts) / 8 / 2
    moved = sum(r.grown_shard == 8 for r in got)
    assert 0 < moved < len(texts) / 9 * 2


def test_shard_weights_and_edges(spark):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.shard_rows(keys, [1.0, 3.0], grown=[1.0, 3.0, 2.0], bucket_rows=300).collect()
    heavy = sum(r.shard == 1 for r in got)
    assert 0.70 * 4000 < heavy < 0.80 * 4000 and all(r.grown_shard in (r.shard, 2) for r in got)
    assert sorted(r.slot for r in got if r.shard == 1) == list(range(heavy))
    rows = [(None, None, "s"), (None, "t", "s"), (5, "", "s")] + [(6, "same", "s")] * 40
    odd = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string, shard string"), [1.0] * 8, bucket_rows=4).collect()
    assert len(odd) == 43 and len({r.shard for r in odd if r.doc_id == 6}) == 1 and len({r.shard for r in odd if r.doc_id is None}) == 1
    assert len({(r.shard, r.slot) for r in odd}) == 43
    assert sharding.shard_rows(keys.limit(0), [1.0] * 8).count() == 0


def test_pieces_are_bounded_by_bytes_and_rows():
    batch = pa.record_batch({"text": ["a"] * 700 + ["b" * 3000, None, "", "c" * 400]})
    cut = list(words.pieces(batch, "text", 1000, 256))
    assert [p.num_rows for p in cut] == [256, 256, 188, 1, 3]
    assert pa.Table.from_batches(cut).column("text").to_pylist() == batch.column("text").to_pylist()
    assert [p.num_rows for p in words.pieces(batch, "text", 1000)] == [700, 1, 3]


# ---- packing ---------------------------------------------------------------------


def plain_best_fit(lengths, capacities, balance):
    """The same rule with every bin looked at for every item: (room taken from or None, size opened or None), rooms left."""
    rooms, steps = [], []
    for k, n in enumerate(lengths):
        fitting = [room for room in rooms if room >= max(n, 1)]  # a full bin is closed
        if fitting:
            steps.append((min(fitting), None))
            rooms[rooms.index(min(fitting))] -= n
            continue
        later = lengths[k + 1 :]
        size = min(
            (c for c in sorted(capacities) if c >= n),
            key=lambda c: packing.cost(c, balance) / max(n + min(c - n, sum(x for x in later if x <= c - n)), 1),
        )
        steps.append((None, size))
        rooms.append(size - n)
    return steps, sorted(rooms)


def test_best_fit_against_plain():
    rng = np.random.default_rng(6)
    for _ in range(20):
        lengths = sorted(rng.integers(0, 60, 80).tolist(), reverse=True)
        steps, rooms = plain_best_fit(lengths, (16, 32, 64), 200)
        # Bins of equal room are interchangeable; the room each item takes and each size opened are not.
        left = {}
        for n, home, (room, size) in zip(lengths, packing.best_fit(lengths, (16, 32, 64), 200), steps, strict=True):
            if room is None:
                assert home == len(left)
                left[home] = size
            else:
                assert left[home] == room
            left[home] -= n
        assert sorted(left.values()) == rooms and rooms[0] >= 0


def check_packed(rows, lengths, capacities):
    """Every unit of every document once, no bin over its size, no smaller size possible."""
    bins, parts = {}, {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
        parts.setdefault(r.doc_id, []).append((r.start, r.length))
    for held in bins.values():
        total, at = sum(r.length for r in held), 0
        assert {r.capacity for r in held} == {min(c for c in capacities if c >= total)}
        for r in sorted(held, key=lambda r: (r.offset, r.length)):
            assert r.offset == at
            at += r.length
    for i, n in lengths.items():
        at = 0
        for start, length in sorted(parts.pop(i)):
            assert start == at
            at += length
        assert at == n
    assert not parts
    return bins


def test_pack_query(spark, sf):
    lengths = {i: len((t or "").encode()) + 1 for i, t in documents(spark, sf)}
    got = queries.QUERIES["op10_packing"](spark, sf).collect()
    bins = check_packed(got, lengths, packing.CAPACITIES)
    spent = sum(next(iter(b)).capacity for b in bins.values())
    assert sum(lengths.values()) / spent > 0.97


def test_pack_edges(spark):
    rows = [(1, 5, "a"), (2, None, "b"), (3, 0, "c"), (4, 70, "d"), (5, -3, "e")]
    table = spark.createDataFrame(rows, "doc_id long, n long, length string")
    got = packing.pack(table, "n", capacities=(8, 32)).collect()
    check_packed(got, {1: 5, 2: 0, 3: 0, 4: 70, 5: 0}, (8, 32))
    again = spark.createDataFrame([(None, 3), (7, 3), (7, 3)] * 50, "doc_id long, n long")
    many = packing.pack(again, "n", capacities=(8, 32), group_rows=20).collect()
    assert len(many) == 150 and sum(r.length for r in many) == 450 and sum(r.doc_id is None for r in many) == 50
    assert packing.pack(table.limit(0), "n").count() == 0


def test_sequences_rebuild_every_document(spark):
    rng = np.random.default_rng(8)
    texts = {i: rng.integers(0, 90, int(rng.choice([0, 1, 7, 8, 15, 31, 32, 33, 64, 500]))).tolist() for i in range(120)}
    rows = [(i, ids, "x", 1) for i, ids in texts.items()] + [(500, None, "x", 1), (None, [3, 4], "x", 1), (7, [5] * 40, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>, bin_id string, row int").withColumn("piece", F.lit(1))
    got = packing.sequences(docs, 99, capacities=(8, 32), group_rows=50).collect()
    assert all(r.capacity == (8 if len(r.ids) <= 8 else 32) for r in got)
    parts = {}
    for r in got:
        at = 0
        for g in r.segments:
            assert g.offset == at
            at += g.length
            parts.setdefault(g.doc_id, []).append((g.start, g.piece, r.ids[g.offset : at]))
        assert at == len(r.ids) == r.n_tokens
    twice = sorted(parts.pop(7))
    assert sorted(x for p in twice for x in p[2]) == sorted([*texts.pop(7), 99, *[5] * 40, 99])
    want = {**texts, 500: [], None: [3, 4]}
    assert set(parts) == set(want)
    for i, held in parts.items():
        assert [x for _, _, p in sorted(held) for x in p] == [*want[i], 99]
    assert packing.sequences(docs.limit(0), 99).count() == 0
    # One long document alone: pieces of the largest size and a rest.
    long = spark.createDataFrame([(1, list(range(100_000)))], "doc_id long, ids array<int>")
    sizes = sorted(r.n_tokens for r in packing.sequences(long, -1).collect())
    assert sizes == [100_001 - 3 * 32768, 32768, 32768, 32768]


def test_shard_of_every_key(spark):
    """The shard recomputed from digests, weights and the growth included."""

    def plain(key, weights):
        def score(shard):
            digest = hashlib.md5(f"{key}/{shard}".encode()).hexdigest()[:13]
            return -math.log((int(digest, 16) + 0.5) / 2**52) / weights[shard]

        return min(range(len(weights)), key=lambda s: (score(s), s))

    keys = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shard_rows(keys, [1.0, 3.0, 0.5], grown=[1.0, 3.0, 0.5, 2.0]).collect()
    assert {r.doc_id: (r.shard, r.grown_shard) for r in got} == {
        i: (plain(i, [1.0, 3.0, 0.5]), plain(i, [1.0, 3.0, 0.5, 2.0])) for i in range(2000)
    }


def test_ids_move_as_halves(spark):
    ids = [[0, 1, 65535], [], [65536, -1, 2**31 - 1, -(2**31)], [50256]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "doc_id long, ids array<int>")
    halved = df.select("doc_id", packing.halves(F.col("ids")).alias("h"))
    got = halved.select("doc_id", "h", packing.joined_halves(F.col("h")).alias("ids")).orderBy("doc_id").collect()
    assert [r.ids for r in got] == ids and [r.h.high is None for r in got] == [True, True, False, True]
    assert halved.schema["h"].dataType["low"].dataType.elementType.typeName() == "short"
    made = packing.sequences(df, 7, capacities=[4, 8])
    found = {(s.doc_id, s.start): r.ids[s.offset : s.offset + s.length] for r in made.collect() for s in r.segments}
    whole = {i: sum((found[k] for k in sorted(found) if k[0] == i), []) for i in range(len(ids))}
    assert whole == {i: [*v, 7] for i, v in enumerate(ids)}
