"""Keyed merges, deletes, filters, ordering and set operators over plain tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- merges ----------------------------------------------------------------------


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The row with the greatest ``order`` per key; rows with a null leading order are out.

    ``max_by`` aggregates map-side, so a hot key costs one row per task.
    """
    rest = [c for c in (columns or df.columns) if c not in keys]
    live = df.where(F.col(order[0]).isNotNull())
    picked = live.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def upsert_last_wins(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``base`` with ``changes`` merged by key, the change of greatest ``order`` winning."""
    value = [c for c in base.columns if c not in keys]
    both = base.withColumn("_at", F.lit(None).cast(changes.schema[order].dataType)).unionByName(
        changes.select(*keys, *value, F.col(order).alias("_at"))
    )
    rank = F.struct(F.col("_at").isNotNull().alias("changed"), F.col("_at"))
    merged = both.groupBy(*keys).agg(F.max_by(F.struct(*value), rank).alias("_row"))
    return merged.select(*keys, "_row.*")


def one_per_key(df: DataFrame, keys: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """The row with the smallest values of each key, nulls first."""
    if not rest:
        return df.select(*keys).distinct()
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(*keys, "_row.*")


def insert_if_absent(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` plus the rows of ``new`` whose key is absent; ``inserted`` marks them.

    Of several new rows with one key the one with the smallest values counts.
    """
    fresh = one_per_key(new, keys, [c for c in base.columns if c not in keys]).join(base.select(*keys), list(keys), "left_anti")
    return base.withColumn("inserted", F.lit(False)).unionByName(
        fresh.select(*base.columns).withColumn("inserted", F.lit(True))
    )


def conditional_upsert(
    base: DataFrame, new: DataFrame, keys: Sequence[str], guard: Column, update: Sequence[str]
) -> DataFrame:
    """Insert absent keys; on a clash set ``update`` only where ``guard`` (on base) holds.

    Of several new rows with one key the one with the smallest values counts.
    """
    rest = [c for c in base.columns if c not in keys]
    new = one_per_key(new, keys, rest)
    left = base.withColumn("_hit", guard).withColumn("_old", F.lit(True))
    right = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rest], F.lit(True).alias("_fresh"))
    joined = left.join(right, list(keys), "full")

    def merged(c: str) -> Column:
        value = F.when(F.col("_old").isNull(), F.col(f"_new_{c}"))
        if c in update:
            value = value.when(F.coalesce(F.col("_hit"), F.lit(False)) & F.col("_fresh"), F.col(f"_new_{c}"))
        return value.otherwise(F.col(c)).alias(c)

    return joined.select(*keys, *[merged(c) for c in rest])


def cascade_delete(
    doomed: DataFrame, key: str, children: Sequence[tuple[str, DataFrame, str, str]]
) -> dict[str, DataFrame]:
    """Delete rows reachable from ``doomed[key]``.

    ``children`` lists (name, table, own key, foreign key); a child's foreign key names
    the key column of its parent, which is ``key`` or an earlier child's own key.
    """
    gone = {key: doomed.select(key).distinct()}
    kept: dict[str, DataFrame] = {}
    for name, df, own, fk in children:
        keys = gone[fk]
        gone[own] = df.join(keys, fk, "left_semi").select(own)
        kept[name] = df.join(keys, fk, "left_anti")
    return kept


def promote_missing(src: DataFrame, dst: DataFrame, natural_key: str, order: str) -> DataFrame:
    """Rows of ``src`` whose natural key is not in ``dst``; of several with one key, the first by ``order``."""
    rest = [c for c in src.columns if c != natural_key]
    first = src.groupBy(natural_key).agg(F.min_by(F.struct(*rest), F.struct(order, *rest)).alias("_row"))
    missing = first.join(dst.select(natural_key).distinct(), natural_key, "left_anti")
    return missing.select(natural_key, "_row.*").select(*src.columns)


def rekey(links: DataFrame, src: DataFrame, dst: DataFrame, natural_key: str, surrogate: str) -> DataFrame:
    """Replace ``surrogate`` in ``links`` by the ``dst`` key of the same natural key."""
    mapping = src.select(F.col(surrogate).alias("_old"), natural_key).join(
        dst.select(F.col(surrogate).alias("_new"), natural_key), natural_key
    )
    out = links.withColumnRenamed(surrogate, "_old").join(mapping.select("_old", "_new"), "_old")
    return out.select(F.col("_new").alias(surrogate), *[c for c in links.columns if c != surrogate])


def snapshot_before_delete(df: DataFrame, key: str) -> DataFrame:
    """Undo step per row: its JSON, plus the row's own digest (sha256)."""
    body = F.to_json(F.struct(*df.columns))
    return df.select(key, body.alias("row_json"), F.sha2(body, 256).alias("row_sha"))


def snapshot_digest(snapshot: DataFrame, key: str) -> DataFrame:
    """Digest of each target over its sorted row digests.

    Rows are folded in 4096 buckets by digest prefix first, so a target holding a
    third of all rows is never gathered in one group.
    """

    def fold(column: str):
        return F.sha2(F.array_join(F.array_sort(F.collect_list(column)), ","), 256)

    buckets = snapshot.groupBy(key, F.substring("row_sha", 1, 3).alias("_bucket")).agg(
        F.count("*").alias("_n"), fold("row_sha").alias("_sha")
    )
    return buckets.groupBy(key).agg(F.sum("_n").alias("n_rows"), fold("_sha").alias("sha256"))


def restore_snapshot(snapshot: DataFrame, digests: DataFrame, current: DataFrame, key: str, own: str) -> DataFrame:
    """Rows of the targets whose digest still matches, less the rows already present."""
    intact = snapshot_digest(snapshot, key).join(digests.select(key, "sha256"), [key, "sha256"], "left_semi")
    rows = snapshot.join(intact.select(key), key, "left_semi").select(
        F.from_json("row_json", current.schema).alias("r")
    )
    back = rows.select("r.*").join(current.select(own), own, "left_anti")
    return current.unionByName(back)


# ---- filters ---------------------------------------------------------------------


def filter_in(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is listed; an empty list gives no rows."""
    return df.join(ids.select(key), key, "left_semi")


def optional_criteria(criteria: Mapping[str, object], null_means_null: Sequence[str] = ()) -> Column:
    """AND of the criteria that are given; ``None`` tests for null only where listed."""
    tests = []
    for name, value in criteria.items():
        if value is not None:
            tests.append(F.col(name) == F.lit(value))
        elif name in null_means_null:
            tests.append(F.col(name).isNull())
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def visible(owner: str, user: object, scope: str | None = None, scope_value: object = None) -> Column:
    """Own rows, or shared rows (no owner) in the same scope."""
    own = F.col(owner) == F.lit(user)
    if scope is None:
        return own
    return own | (F.col(owner).isNull() & (F.col(scope) == F.lit(scope_value)))


def filter_either_key(df: DataFrame, a: str, ids_a: DataFrame | None, b: str, ids_b: DataFrame | None) -> DataFrame:
    """Rows matching either id list; an absent side never matches."""
    flags = []
    out = df
    for name, ids in ((a, ids_a), (b, ids_b)):
        if ids is not None:
            flag = f"_in_{name}"
            out = out.join(ids.select(name).distinct().withColumn(flag, F.lit(True)), name, "left")
            flags.append(F.col(flag).isNotNull())
    return out.where(reduce(lambda x, y: x | y, flags, F.lit(False))).select(*df.columns)


def search_by_name(df: DataFrame, column: str, pattern: str, newest: str, tie: str, n: int) -> DataFrame:
    return df.where(F.col(column).ilike(pattern)).orderBy(F.col(newest).desc(), F.col(tie).desc()).limit(n)


def live(expires_at: Column, now: Column) -> Column:
    return expires_at > now


def stale(status: Column, updated_at: Column, created_at: Column, now: Column, seconds: int = 300) -> Column:
    """Active and without a heartbeat for ``seconds``."""
    beat = F.coalesce(updated_at, created_at)
    return status.isin("pending", "in_progress") & (beat < now - F.make_dt_interval(secs=F.lit(seconds)))


# ---- joins and flags -------------------------------------------------------------


def flag_exists(items: DataFrame, facts: DataFrame, key: str, flag: str) -> DataFrame:
    seen = facts.select(key).distinct().withColumn(flag, F.lit(True))
    return items.join(seen, key, "left").withColumn(flag, F.col(flag).isNotNull())


def distinct_through(users: DataFrame, roles: DataFrame, user: str, role: str, permission: str) -> DataFrame:
    """Distinct (user, permission) through roles.

    Assignments and grants are made distinct before the join, the result after it.
    """
    return users.select(user, role).distinct().join(roles.select(role, permission).distinct(), role).select(
        user, permission
    ).distinct()


def has_permission(permissions: DataFrame, user: str, permission: str, wanted: str) -> DataFrame:
    ok = (F.col(permission) == wanted) | (F.col(permission) == "*")
    return permissions.groupBy(user).agg(F.bool_or(ok).alias("granted"))


def nest_children(parents: DataFrame, links: DataFrame, key: str, child: str) -> DataFrame:
    """Each parent with the sorted array of its children (empty when none)."""
    lists = links.groupBy(key).agg(F.array_sort(F.collect_set(child)).alias("children"))
    return parents.join(lists, key, "left").withColumn(
        "children", F.coalesce("children", F.array().cast(lists.schema["children"].dataType))
    )


# ---- order and limits ------------------------------------------------------------


#: Offset from which a page is sought by counts, and ranges whose rows are counted.
SEEK, RANGES = 100_000, 256


def _ranges_of(df: DataFrame, key: str, offset: int, size: int) -> tuple[DataFrame, int]:
    """The rows of the key ranges that hold places ``offset`` to ``offset`` + ``size``, and how many rows lie before."""
    cuts = df.where(F.col(key).isNotNull()).agg(F.percentile_approx(key, [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()[0]
    cuts = sorted(set(cuts or []))
    # Nulls come first (range -1); a value is in the range of the last cut that is not above it.
    place = F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))) if cuts else F.lit(0))
    counts = sorted(df.groupBy(place.alias("place")).count().collect())
    before, held = 0, []
    for at, n in counts:
        if not held and before + n <= offset:
            before += n
        elif not held or sum(x[1] for x in held) < offset - before + size:
            held.append((at, n))
    if not held:
        return df.limit(0), offset
    low, high = held[0][0], held[-1][0]
    within = F.lit(True) if low < 1 else F.col(key) >= cuts[low - 1]
    within &= F.lit(True) if high >= len(cuts) else F.col(key) < cuts[high]
    return df.where(F.coalesce(within, F.lit(False)) | F.col(key).isNull() if low == -1 else within & F.col(key).isNotNull()), before


def paginate(df: DataFrame, key: str, offset: int, limit: int, max_page: int = 5000) -> DataFrame:
    """A page in key order with the total and the next offset (null on the last page).

    A page has ``limit`` rows, at least 1 and at most ``max_page``; next_offset counts the
    rows of the page as returned.

    A page far down is sought: rows are counted by ranges of the key, and only the ranges that
    hold the page are read and sorted, by a filter on the key that reaches the scan.  The key
    is a number or a time there.
    """
    size = max(1, min(limit, max_page))
    total = df.agg(F.count("*").alias("total"))
    source, before = _ranges_of(df, key, offset, size) if offset >= SEEK else (df, 0)
    page = source.orderBy(key).offset(offset - before).limit(size)
    more = F.when(F.col("total") > offset + size, F.lit(offset + size).cast("long"))
    return page.withColumn("total", total.scalar()).withColumn("next_offset", more)


def fifo_batch(df: DataFrame, status: Column, key: str, n: int = 10) -> DataFrame:
    return df.where(status).orderBy(key).limit(n)


def sample_rows(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows per key; Spark prunes to ``n`` per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


# ---- sets ------------------------------------------------------------------------


def coverage(expected: DataFrame, found: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Per key: expected and missing counts, and complete / empty / partial."""
    present = found.select(*keys, item).distinct().withColumn("_found", F.lit(1))
    counted = (
        expected.select(*keys, item).distinct().join(present, [*keys, item], "left")
        .groupBy(*keys)
        .agg(F.count("*").alias("expected"), F.count_if(F.col("_found").isNull()).alias("missing"))
    )
    return counted.withColumn(
        "verdict",
        F.when(F.col("missing") == 0, "complete")
        .when(F.col("missing") == F.col("expected"), "empty")
        .otherwise("partial"),
    )


def expand_ranges(ranges: DataFrame, keys: Sequence[str], start: str, end: str, order: str) -> DataFrame:
    """Distinct pages of the ranges with the first-seen range of each."""
    pages = ranges.where(F.col(start) <= F.col(end)).select(
        *keys, order, F.explode(F.sequence(start, end)).alias("page")
    )
    return pages.groupBy(*keys, "page").agg(F.min(order).alias("first_range"))
