"""Registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

import uuid
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.llm import (
    bpe,
    fingerprints,
    language,
    language_model,
    line_dedup,
    merkle,
    near_dedup,
    packing,
    periodic,
    sharding,
    substring_dedup,
    token_counts,
    topk_search,
)
from coursewright.session import shared_folder
from coursewright.sources.tables import table


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without later copies of runs of three lines, or of eight words in fewer."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs)


def op2_topk_search(spark: SparkSession, sf: str) -> DataFrame:
    """The five best other vectors of every fiftieth vector."""
    vectors = topk_search.integer_vectors(table(spark, sf, "embeddings"))
    return topk_search.topk_search(vectors, vectors.where("id % 50 = 0"), 5)


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts of documents, by a cache that starts empty."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache = f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    counted = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """The language of each document, learned from documents that are not held out."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out()))
    judged = docs.select("doc_id", language.held_out().alias("held_out"), "text")
    return language.identify(judged, model).select("doc_id", "held_out", "lang_pred", "score")


def op5_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of documents, of the same with the last quarter replaced, and their likeness."""
    return fingerprints.followed(table(spark, sf, "documents").select("doc_id", "text"))


def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Documents over eight equal shards by rendezvous hashing, and over nine."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return sharding.shard_rows(docs, [1.0] * 8)


def op7_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate components of documents by two-word shingles."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, size=2)


def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each document that stay when 50-word passages of earlier documents go."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cut = substring_dedup.substring_dedup(docs)
    spaced = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return cut.select(
        "doc_id",
        F.col("word_count").cast("long").alias("n_words"),
        F.col("removed_count").cast("long").alias("n_removed"),
        F.sha2(spaced, 256).alias("kept_sha256"),
    )


def op9_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Documents encoded to token ids and decoded again."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, path, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in sequences of 2,048 to 32,768 byte tokens, one more for each document's end."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    sized = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("n_tokens"))
    return packing.pack(sized, "n_tokens")


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their places in a Merkle tree, and whether each still proves the root after some were changed."""
    docs = table(spark, sf, "documents")
    changed = {"text": F.translate("text", ascii_uppercase, ascii_lowercase)}
    tampered = merkle.leaf_digest(*[changed.get(c, F.col(c)) for c in merkle.FIELDS])
    hurt = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    proved = merkle.manifest(docs, carry={"tampered": F.when(hurt, tampered)})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    result = proved.select(
        "doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root")
    )
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Log probabilities of documents under a model of those that are not held out."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    judged = docs.withColumn("held_out", held)
    scored = language_model.score_texts(judged, ~held)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Periodic runs of documents; in one of ten a stretch up to the end is made periodic first."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    drawn = docs.select("doc_id", "text", (h % 10 == 0).alias("hurt"), F.floor(h / 10).alias("g"))
    split = drawn.withColumn("found", F.when(F.col("hurt"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n = F.size("found").cast("long")
    placed = split.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a, p, rest = F.col("a").cast("int"), F.col("p").cast("int"), (F.col("n") - F.col("a")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("found", a + 1, p), F.ceil(rest / p).cast("int")))
    edited = F.array_join(F.concat(F.slice("found", F.lit(1), a), F.slice(again, F.lit(1), rest)), " ")
    runs = periodic.periodic_runs(placed.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = periodic.longest("runs")
    return runs.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_topk_search, op3_token_counts, op4_language_id, op5_fingerprints, op6_sharding, op7_near_dedup,
    op8_substring_dedup, op9_bpe, op10_packing, op11_merkle_manifest, op12_lm_scoring, op13_periodic_runs,
)}

def _crc32(number: str) -> str:
    """CRC-32 of a decimal number: the bytes in turn, eight steps each with the reflected polynomial 0xEDB88320."""
    steps = "list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    given = f"list_transform(string_split({number}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {given}), lambda acc, b: {steps}), 4294967295)"


def _merkle_sql(levels: int = 6) -> str:
    """The manifest by levels, for at most 16 ** levels rows of a source and as many sources."""
    def h(value: str) -> str:
        return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(h(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lower = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
    ctes = [f"""leaves AS (SELECT doc_id, source, {leaf("text")} AS leaf,
  CASE WHEN {_crc32("doc_id")} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS given FROM documents),
l0 AS (SELECT coalesce('s' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS r, leaf AS node FROM leaves),
f0 AS (SELECT coalesce('s' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS r, doc_id, leaf,
  given AS folded, '' AS proof FROM leaves)"""]

    def climb(low: str, fold: str, up: str) -> None:
        for k in range(levels):
            ctes.append(f"""{low}{k}c AS (SELECT tree, count(*) AS n FROM {low}{k} GROUP BY tree),
{low}{k + 1} AS (SELECT tree, r // 16 AS r, CASE WHEN any_value(n) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY r)) END AS node
  FROM {low}{k} JOIN {low}{k}c USING (tree) GROUP BY tree, r // 16),
{fold}{k + 1} AS (SELECT f.tree, f.r // 16 AS r, f.doc_id, f.leaf{up}, f.proof || b.before || b.after AS proof,
  CASE WHEN c.n = 1 THEN f.folded ELSE sha256(b.before || f.folded || b.after) END AS folded
  FROM {fold}{k} f JOIN {low}{k}c c USING (tree) JOIN {low}{k}s b ON b.tree = f.tree AND b.r = f.r)""")
            ctes[-1] = f"""{low}{k}s AS (SELECT tree, r,
  coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {low}{k} WINDOW w AS (PARTITION BY tree, r // 16 ORDER BY r)),
""" + ctes[-1]

    climb("l", "f", "")
    ctes.append(f"""u0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS r, node, tree AS grp FROM l{levels}),
g0 AS (SELECT u.tree, u.r, f.doc_id, f.leaf, u.node AS subroot, f.proof, f.folded FROM f{levels} f JOIN u0 u ON u.grp = f.tree)""")
    climb("u", "g", ", f.subroot")
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified
FROM g{levels} JOIN u{levels} USING (tree)"""


SQL = {
    "op11_merkle_manifest": _merkle_sql(),
    "op1_line_dedup": """
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
every AS (SELECT doc_id, i, lines[i] AS line FROM split, unnest(range(1, len(lines) + 1)) AS t(i)),
dense AS (
  SELECT doc_id, i, trim(line) AS a, len(regexp_split_to_array(trim(line), ' +')) AS w,
         row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j
  FROM every WHERE trim(line) <> ''
),
ahead AS (
  SELECT doc_id, j, i, a, w, lead(i, 1) OVER d AS i1, lead(i, 2) OVER d AS i2,
         lead(a, 1) OVER d AS b, lead(a, 2) OVER d AS c, lead(w, 1) OVER d AS w1
  FROM dense WINDOW d AS (PARTITION BY doc_id ORDER BY j)
),
windows AS (
  SELECT doc_id, j, [i] AS places, [a] AS run FROM ahead WHERE w >= 8
  UNION ALL SELECT doc_id, j, [i, i1], [a, b] FROM ahead WHERE i1 IS NOT NULL AND w + w1 >= 8
  UNION ALL SELECT doc_id, j, [i, i1, i2], [a, b, c] FROM ahead WHERE i2 IS NOT NULL
),
firsts AS (
  SELECT *, first_value(doc_id) OVER w AS d0, first_value(j) OVER w AS j0
  FROM windows WINDOW w AS (PARTITION BY run ORDER BY doc_id, j)
),
gone AS (SELECT DISTINCT doc_id, unnest(places) AS i FROM firsts WHERE doc_id > d0 OR j - j0 >= len(run)),
cut AS (
  SELECT e.doc_id, count(*) AS line_count, count(g.i) AS removed_count,
         coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM every e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE c.text END AS text,
       coalesce(c.line_count, 0)::INTEGER AS line_count, coalesce(c.removed_count, 0)::INTEGER AS removed_count
FROM documents d LEFT JOIN cut c USING (doc_id)""",
    "op2_topk_search": """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS terms FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.terms, c.terms)::BIGINT AS score
  FROM sound q, sound c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.terms) = len(q.terms)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op8_substring_dedup": r"""
WITH found AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
every AS (SELECT doc_id, i, ws[i] AS word FROM found, unnest(range(1, len(ws) + 1)) AS t(i)),
windows AS (
  SELECT doc_id, i, md5(string_agg(word, ' ') OVER w) AS content, count(*) OVER w AS n
  FROM every WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, min(doc_id) OVER (PARTITION BY content) AS low FROM windows WHERE n = 50
  ) WHERE doc_id > low
),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM later, unnest(range(0, 50)) AS t(o)),
kept AS (
  SELECT e.doc_id, count(*) AS n_words, count(g.i) AS n_removed,
         coalesce(string_agg(e.word, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL), '') AS left_over
  FROM every e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(left_over, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)""",
}
