"""Concepts: from annotations and text patterns, merged, scored, related and mapped to units."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.functions import text as X

# Per category, two patterns; group 1 is the concept.  (?d): only \n ends a line.
_END = r"(?:\.|;|\n|$)"
CATEGORIES: dict[str, tuple[str, str]] = {
    "skill": (
        r"(?id)(?:learning\s+objective|you\s+will|students?\s+will|by\s+the\s+end|able\s+to)\s*[:\-]?\s*(.+?)" + _END,
        r"(?id)(?:skill|competency|ability\s+to)\s*[:\-]\s*(.+?)" + _END,
    ),
    "process": (
        r"(?id)(?:step\s+\d+|first|second|third|then|next|finally)\s*[:\-–—]\s*(.+?)" + _END,
        r"(?id)(?:process|procedure|method|algorithm)\s+(?:of|for|to)\s+(.+?)" + _END,
    ),
    "fact": (
        r"(?id)(?:fact|key\s+point|important|note\s+that)\s*[:\-–—]\s*(.+?)" + _END,
        # Anchored to the line or the last match: any later start on the line would fail too.
        r"(?id)(?:\G|(?<=\n))(.+?)\s+is\s+(?:always|never|defined\s+as)\s+.+?" + _END,
    ),
    "rule": (
        r"(?id)(?:rule|law|principle|theorem|axiom)\s*[:\-–—]\s*(.+?)" + _END,
        r"(?id)(?:must|shall|always|required\s+to)\s+(.+?)" + _END,
    ),
    "formula": (
        r"(?id)(?:formula|equation|expression)\s*[:\-–—]\s*(.+?)" + _END,
        r"(?id)([A-Za-z]\s*=\s*[A-Za-z0-9\s\+\-\*/\^\(\)]+)",
    ),
}

#: Concepts of one node that meet each other under one key of a join.
TILE = 256

# Raw concepts: doc_id, name, category, importance, mentions, node_id (null for text patterns), emit (order struct).
# A strategy may add unit_ids and aliases (arrays); the two below know of none.


def concept_id() -> Column:
    return F.md5(F.concat_ws("/", F.col("doc_id").cast("string"), F.lower("name")))


def concepts_from_annotations(annotations: DataFrame) -> DataFrame:
    """definition → definition, key term → vocab, objective → skill (0.8 of the confidence)."""
    kind = F.col("type")
    name = F.when(kind == "objective", X.strip(F.col("body"))).otherwise(X.strip(F.col("term")))
    category = F.when(kind == "definition", "definition").when(kind == "key_term", "vocab").otherwise("skill")
    late = F.when(kind == "key_term", 0).otherwise(F.floor(F.col("ord") / 1000000)).cast("int")
    rows = annotations.where(kind.isin("definition", "key_term", "objective")).select(
        "doc_id",
        name.alias("name"),
        category.alias("category"),
        (F.col("confidence") * F.when(kind == "objective", 0.8).otherwise(1.0)).alias("importance"),
        F.lit(1).cast("long").alias("mentions"),
        "node_id",
        F.struct(F.lit(0).alias("strategy"), F.col("emit"), late.alias("late"), "seq", "ord").alias("emit"),
    )
    return rows.where(F.col("name") != "")


def text_pattern_concepts(pages: DataFrame) -> DataFrame:
    """Pattern concepts of every page text, unique per (page, category); mentions counted on the page.

    ``pages``: doc_id, page, page_text.
    """
    found = []
    for rank, (category, patterns) in enumerate(CATEGORIES.items()):
        for which, pattern in enumerate(patterns):
            hits = F.regexp_extract_all(F.col("page_text"), F.lit(pattern), F.lit(1))
            found.append(_hits(hits, category, rank * 2 + which))
    # The outer form: for the plain one Spark first filters by the size of the array and so finds all hits again.
    rows = pages.select("doc_id", "page", "page_text", F.explode_outer(F.concat(*found)).alias("h")).where(F.length("h.name") >= 3)
    # The page text stays out of the shuffle: a page's mentions are counted before it.
    counted = rows.select(
        "doc_id", "page", "h.*", X.count_mentions(F.col("page_text"), F.col("h.name")).cast("long").alias("mentions")
    )
    first = counted.groupBy("doc_id", "page", "category", F.lower("name").alias("_key")).agg(
        F.min_by(F.struct("name", "mentions", "rank", "ord"), F.struct("rank", "ord")).alias("r")
    )
    return first.select(
        "doc_id",
        F.col("r.name").alias("name"),
        "category",
        F.least(F.lit(1.0), F.col("r.mentions") * 0.15).alias("importance"),
        F.col("r.mentions").alias("mentions"),
        F.lit(None).cast("string").alias("node_id"),
        F.struct(
            F.lit(1).alias("strategy"), F.col("page").cast("int").alias("emit"), F.col("r.rank").alias("late"),
            F.lit(0).alias("seq"), F.col("r.ord").alias("ord"),
        ).alias("emit"),
    )


def _hits(hits: Column, category: str, rank: int) -> Column:
    return F.transform(
        hits,
        lambda v, i: F.struct(
            X.strip(v).alias("name"),
            F.lit(category).alias("category"),
            F.lit(rank).alias("rank"),
            i.cast("int").alias("ord"),
        ),
    )


Strategy = Callable[..., DataFrame]


def run_strategies(strategies: Mapping[str, tuple[Strategy, DataFrame]]) -> DataFrame:
    """Raw concepts of every registered strategy, in registration order."""
    out: DataFrame | None = None
    for i, (fn, source) in enumerate(strategies.values()):
        raw = fn(source).withColumn("emit", F.col("emit").withField("strategy", F.lit(i)))
        out = raw if out is None else out.unionByName(raw)
    if out is None:
        raise ValueError("no strategy registered")
    return out


def merge_concepts(raw: DataFrame) -> DataFrame:
    """Per document and lower-case name: first name and category, mentions summed, importance maxed.

    ``node_ids``, ``unit_ids`` and ``aliases`` are the unions of the lists of all raw concepts of the name, each
    value at its first place.  Lists that no strategy gave are empty.
    """
    keyed = raw.withColumn("concept_id", concept_id())
    lists = {"node_ids": F.when(F.col("node_id").isNotNull(), F.array("node_id"))}
    lists |= {c: F.col(c) if c in raw.columns else F.lit(None).cast("array<string>") for c in ("unit_ids", "aliases")}
    return keyed.groupBy("doc_id", "concept_id").agg(
        F.min_by("name", "emit").alias("name"),
        F.min_by("category", "emit").alias("category"),
        F.sum("mentions").alias("mentions"),
        F.max("importance").alias("importance"),
        *[_union(values, F.col("emit")).alias(c) for c, values in lists.items()],
    )


def _union(values: Column, order: Column) -> Column:
    """Aggregate: the distinct values of all lists, in ``order``, then in that of each list."""
    some = F.when(F.size(values) > 0, F.struct(order.alias("o"), values.alias("v")))
    found = F.flatten(F.transform(F.array_sort(F.collect_list(some)), lambda e: e["v"]))
    return F.filter(F.array_distinct(found), lambda v: v.isNotNull())


def concept_nodes(raw: DataFrame) -> DataFrame:
    """Distinct (concept, source node) pairs; the array form of these is left to the sink."""
    rows = raw.where(F.col("node_id").isNotNull())
    return rows.select("doc_id", concept_id().alias("concept_id"), "node_id").distinct()


def score_importance(concepts: DataFrame) -> DataFrame:
    """ln(1 + mentions) over ln(1 + the document's largest), to three places."""
    top = concepts.groupBy("doc_id").agg(F.max("mentions").alias("_top"))
    top = top.withColumn("_top", F.when(F.col("_top") == 0, 1).otherwise(F.col("_top")))
    scored = F.bround(F.log(1 + F.col("mentions")) / F.log(1 + F.col("_top")), 3)
    return concepts.join(top, "doc_id").withColumn("importance", scored).drop("_top")


def map_concepts_to_units(links: DataFrame, unit_nodes: DataFrame) -> DataFrame:
    """(concept, unit) when a source node lies in the unit; a node's last unit counts."""
    last = unit_nodes.groupBy("doc_id", "node_id").agg(F.max_by("unit_id", "unit_seq").alias("unit_id"))
    return links.join(last, ["doc_id", "node_id"]).select("doc_id", "concept_id", "unit_id").distinct()


def concept_cooccurrence(links: DataFrame, min_shared: int = 1, tile: int = TILE) -> DataFrame:
    """Unordered pairs of concepts sharing nodes; weight min(1, shared / 4).

    The pairs are the result itself.  A node with m concepts is dealt as a triangle of tiles over
    ceil(m / ``tile``) strips of them: a row meets each strip in a tile of its own, so that no key
    of the join holds more than about ``tile`` rows a side, whatever the node.  Most nodes are one
    tile.  Concepts of fewer than ``min_shared`` nodes can be in no pair and stay out of the join.
    ``links`` are distinct and read several times; stage them.  Null ids are in no pair.
    """
    keys = ["doc_id", "node_id"]
    links = links.where(F.col("concept_id").isNotNull())
    if min_shared > 1:
        often = links.groupBy("doc_id", "concept_id").agg(F.count("*").alias("_nodes")).where(F.col("_nodes") >= min_shared)
        links = links.join(often, ["doc_id", "concept_id"], "left_semi")
    strips = links.groupBy(*keys).agg(F.ceil(F.count("*") / tile).cast("int").alias("_strips")).where(F.col("_strips") > 1)
    dealt = links.join(strips, keys, "left").withColumn("_strips", F.coalesce("_strips", F.lit(1)))
    dealt = dealt.withColumn("_strip", F.pmod(F.xxhash64("concept_id"), F.col("_strips")).cast("int"))
    own = F.col("_strip")
    a = dealt.select(*keys, F.col("concept_id").alias("a"), own.alias("_row"), F.explode(F.sequence(own, F.col("_strips") - 1)).alias("_column"))
    b = dealt.select(*keys, F.col("concept_id").alias("b"), F.explode(F.sequence(F.lit(0), own)).alias("_row"), own.alias("_column"))
    # Tiles off the diagonal meet each pair once, those on it both ways round and with itself.
    met = a.join(b, [*keys, "_row", "_column"]).where((F.col("_row") < F.col("_column")) | (F.col("a") < F.col("b")))
    pairs = met.select("doc_id", F.least("a", "b").alias("source_id"), F.greatest("a", "b").alias("target_id"))
    shared = pairs.groupBy("doc_id", "source_id", "target_id").agg(F.count("*").alias("shared"))
    return shared.where(F.col("shared") >= min_shared).select(
        "doc_id",
        "source_id",
        "target_id",
        F.lit("relates_to").alias("relation_type"),
        F.least(F.lit(1.0), F.col("shared") * 0.25).alias("weight"),
    )


def same_name_relation(raw: DataFrame) -> DataFrame:
    """Definitions and vocabulary of one name, before the merge: weight 1."""
    named = raw.select("doc_id", "category", F.lower("name").alias("name")).distinct()
    both = named.groupBy("doc_id", "name").agg(
        F.bool_or(F.col("category") == "definition").alias("d"), F.bool_or(F.col("category") == "vocab").alias("v")
    )
    return both.where(F.col("d") & F.col("v")).select("doc_id", "name", F.lit(1.0).alias("weight"))


def name_relations(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """Relations with both names; an unknown end has an empty one."""
    names = concepts.select("doc_id", "concept_id", "name")
    source = names.select("doc_id", F.col("concept_id").alias("source_id"), F.col("name").alias("source_name"))
    target = names.select("doc_id", F.col("concept_id").alias("target_id"), F.col("name").alias("target_name"))
    joined = relations.join(source, ["doc_id", "source_id"], "left").join(target, ["doc_id", "target_id"], "left")
    return joined.na.fill("", ["source_name", "target_name"])
