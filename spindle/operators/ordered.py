"""Order-dependent work on groups of any size.

``lag``, running totals and ranks normally put a whole group into one task. Here the group
sizes are counted first. Groups up to ``spark.spindle.groupRows`` rows go through plain window functions. Larger
ones are range-partitioned, numbered, and cut into blocks of exactly that many rows, so that a device holding a
third of the trace is spread over many tasks:

* ``shifted`` gives every block copies of the few rows next to it (its halo), so bounded frames stay exact;
* ``running`` adds the totals of all earlier blocks to the block's own running total.

``order`` must be a total order within a group, otherwise the numbering is not repeatable.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spindle.session import group_rows, stable

_FIRST = Window.unboundedPreceding
_PART_BITS = 33  # monotonically_increasing_id keeps the partition number above bit 33

#: Tables of up to so many rows of keys and totals are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000

Total = tuple[str, Column]


def fits(staged: DataFrame) -> bool:
    """Whether a table that ``stable`` wrote may be broadcast; its rows are counted from the files' footers."""
    return staged.count() <= BROADCAST_ROWS


def key_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False, nulls: bool = True
) -> DataFrame:
    """Equi-join; ``small`` marks a right side of proven size.

    Null keys match too unless ``nulls`` says there are none: then the rows keep the partitioning by the keys that the
    window functions after the join need, and are shuffled once instead of twice.
    """
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    if small:
        renamed = F.broadcast(renamed)
    if not keys:
        return left.join(renamed)  # without keys the right side is a single row
    condition = F.lit(True)
    for k in keys:
        condition = condition & (F.col(k).eqNullSafe(F.col(f"__r_{k}")) if nulls else F.col(k) == F.col(f"__r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


@dataclass(frozen=True)
class Groups:
    """Which groups of ``keys`` hold more than ``limit`` rows (``hot`` is None when none do), if these are few enough to
    broadcast their keys, and if a key may be null."""

    keys: tuple[str, ...]
    limit: int
    hot: DataFrame | None
    nulls: bool = True
    few: bool = False

    @staticmethod
    def measure(df: DataFrame, keys: Sequence[str], limit: int | None = None, staged: bool = False) -> Groups:
        """``staged`` marks rows just written by ``stable``: their total is known from the files' footers."""
        limit = limit or group_rows(df.sparkSession)
        if staged and df.count() <= limit:
            return Groups(tuple(keys), limit, None)
        large, null_key = F.col("__n") > limit, F.lit(False)
        for k in keys:
            null_key = null_key | F.col(k).isNull()
        special = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(large | null_key)
        if special.isEmpty():
            return Groups(tuple(keys), limit, None, nulls=False)
        special = stable(special)
        n_large, n_null = special.agg(F.count_if(large), F.count_if(null_key)).first()
        hot = special.where(large)
        if keys:
            hot = hot.drop("__n")
        return Groups(tuple(keys), limit, hot if n_large else None, n_null > 0, n_large <= BROADCAST_ROWS)

    def cold_part(self, df: DataFrame) -> DataFrame | None:
        if self.hot is None:
            return df
        return key_join(df, self.hot, self.keys, "left_anti", small=self.few) if self.keys else None

    def hot_part(self, df: DataFrame) -> DataFrame | None:
        if self.hot is None:
            return None
        return key_join(df, self.hot, self.keys, "left_semi", small=self.few) if self.keys else df


    def join(self, rows: DataFrame, per_group: DataFrame, how: str = "inner") -> DataFrame:
        """Join a table of one row per group. Rows of large groups are not shuffled: they meet a broadcast of their few.

        More than ``BROADCAST_ROWS`` large groups are joined by a shuffle, whose skewed partitions Spark splits.
        """
        if self.hot is None or not self.keys:
            return key_join(rows, per_group, self.keys, how, small=not self.keys, nulls=self.nulls)
        cold = key_join(self.cold_part(rows), per_group, self.keys, how, nulls=self.nulls)
        few = key_join(per_group, self.hot, self.keys, "left_semi", small=self.few)
        return cold.unionByName(key_join(self.hot_part(rows), few, self.keys, how, small=self.few))

    def finer(self, df: DataFrame, keys: Sequence[str]) -> Groups:
        """Groups by more keys: they need measuring only if some group by fewer keys is large."""
        return Groups(tuple(keys), self.limit, None) if self.hot is None else Groups.measure(df, keys, self.limit)


def _window(keys: Sequence[str], order: Sequence[str], backward: bool = False) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*[F.col(o).desc() if backward else F.col(o).asc() for o in order])


def _number(rows: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """Add a group number, the 0-based position in the group and the block it falls into, without one task per group."""
    by = [*keys, *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = stable(ranged.withColumn("__pos", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__part", F.shiftright("__pos", _PART_BITS))
    pieces = ranged.groupBy(*keys, "__part").agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(_window(keys, ["__part"]).rowsBetween(_FIRST, -1))
    # the position of a group's first row serves as its number: a single non-null key for the shuffles to come
    number = F.min("__first").over(Window.partitionBy(*keys))
    shift = pieces.withColumns({"__gid": number, "__shift": F.coalesce(before, F.lit(0)) - F.col("__first")}).drop("__first", "__n")
    # one row per (large group, partition it touches): no more than groups + partitions
    shift = stable(shift)
    numbered = key_join(ranged, shift, [*keys, "__part"], small=fits(shift))
    numbered = numbered.withColumn("__rn", F.col("__pos") + F.col("__shift")).drop("__pos", "__part", "__shift")
    return numbered.withColumn("__blk", F.floor(F.col("__rn") / F.lit(limit)))


@dataclass(frozen=True)
class Ordered:
    """Rows of ordered groups: ``cold`` fits plain windows, ``hot`` carries ``__gid``, ``__rn`` and ``__blk``."""

    groups: Groups
    order: tuple[str, ...]
    cold: DataFrame | None
    hot: DataFrame | None

    @property
    def keys(self) -> tuple[str, ...]:
        return self.groups.keys

    @property
    def limit(self) -> int:
        return self.groups.limit

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Ordered:
        """Apply a row-wise change that keeps all rows, keys and order columns."""
        return replace(
            self,
            cold=None if self.cold is None else change(self.cold),
            hot=None if self.hot is None else change(self.hot),
        )

    def with_columns(self, columns: dict[str, Column]) -> Ordered:
        return self.map(lambda df: df.withColumns(columns))

    def where(self, condition: Column) -> Ordered:
        """Drop rows; what is left of the large groups is numbered again."""
        kept = self.map(lambda df: df.where(condition))
        if kept.hot is None:
            return kept
        bare = kept.hot.drop("__gid", "__rn", "__blk")
        return replace(kept, hot=_number(bare, self.keys, self.order, self.limit))

    def frame(self) -> DataFrame:
        parts = [] if self.cold is None else [self.cold]
        if self.hot is not None:
            parts.append(self.hot.drop("__gid", "__rn", "__blk"))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def shifted(self, columns: dict[str, Callable[[WindowSpec], Column]], before: int = 0, after: int = 0) -> Ordered:
        """Add window expressions that look at most ``before`` rows back and ``after`` rows ahead."""
        cold, hot = self.cold, self.hot
        if cold is not None:
            w = _window(self.keys, self.order)
            cold = cold.select("*", *[make(w).alias(name) for name, make in columns.items()])
        if hot is not None:
            if max(before, after) > self.limit:
                raise ValueError("the frame is longer than a block")
            at = F.col("__rn") % self.limit
            none = F.array().cast("array<bigint>")
            homes = F.concat(
                F.array("__blk"),
                F.when(at >= self.limit - before, F.array(F.col("__blk") + 1)).otherwise(none),
                F.when((at < after) & (F.col("__blk") > 0), F.array(F.col("__blk") - 1)).otherwise(none),
            )
            spread = hot.withColumn("__home", F.explode(homes))
            w = _window(["__gid", "__home"], ["__rn"])
            spread = spread.select("*", *[make(w).alias(name) for name, make in columns.items()])
            hot = spread.where(F.col("__home") == F.col("__blk")).drop("__home")
        return replace(self, cold=cold, hot=hot)

    def running(self, totals: dict[str, Total], exclusive: bool = False, backward: bool = False) -> Ordered:
        """Add running ``sum``/``min``/``max``/``last`` (last non-null) from the group's start, or end if ``backward``."""
        # backward is forward over the reversed order: a frame that ends at the last row would be summed anew per row
        frame = (_FIRST, -1 if exclusive else 0)
        value = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
        cold, hot = self.cold, self.hot
        if cold is not None:
            w = _window(self.keys, self.order, backward).rowsBetween(*frame)
            cold = cold.select("*", *[value[how](c).over(w).alias(name) for name, (how, c) in totals.items()])
        if hot is not None:
            by = ["__gid", "__blk"]
            w = _window(by, ["__rn"], backward).rowsBetween(*frame)
            local = hot.select("*", *[value[how](c).over(w).alias(name) for name, (how, c) in totals.items()])
            place = -F.col("__rn") if backward else F.col("__rn")
            in_block = {
                "sum": F.sum,
                "min": F.min,
                "max": F.max,
                "last": lambda c: F.max_by(c, F.when(c.isNotNull(), place)),
            }
            blocks = hot.groupBy(*by).agg(*[in_block[how](c).alias(name) for name, (how, c) in totals.items()])
            bw = _window(["__gid"], ["__blk"], backward).rowsBetween(_FIRST, -1)
            carry = blocks.select(*by, *[value[how](F.col(n)).over(bw).alias(f"__c_{n}") for n, (how, _) in totals.items()])
            joined = local.join(carry, by)  # the rows are already partitioned by these keys
            merge = {
                "sum": lambda own, far: F.coalesce(own + far, own, far),
                "min": F.least,
                "max": F.greatest,
                "last": F.coalesce,
            }
            merged = {n: merge[how](F.col(n), F.col(f"__c_{n}")) for n, (how, _) in totals.items()}
            # the rows feed both sides of the join, so a chain of totals would double its work at every step
            hot = stable(joined.withColumns(merged).drop(*[f"__c_{n}" for n in totals]))
        return replace(self, cold=cold, hot=hot)

    def numbered(self, name: str) -> Ordered:
        """Add the 1-based position in the group."""
        cold, hot = self.cold, self.hot
        if cold is not None:
            cold = cold.withColumn(name, F.row_number().over(_window(self.keys, self.order)).cast("long"))
        if hot is not None:
            hot = hot.withColumn(name, F.col("__rn") + 1)
        return replace(self, cold=cold, hot=hot)


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], groups: Groups | None = None) -> Ordered:
    """Group ``df`` by ``keys`` in ``order``. ``groups`` may be a measure of a superset of these rows."""
    groups = groups or Groups.measure(df, keys)
    if groups.keys != tuple(keys):
        raise ValueError("the groups were measured by other keys")
    hot = groups.hot_part(df)
    if hot is not None:
        hot = _number(hot, keys, order, groups.limit)
    return Ordered(groups, tuple(order), groups.cold_part(df), hot)


def asof(probes: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, value: str, ahead: bool = False, strict: bool = False) -> DataFrame:
    """Add ``value`` of the nearest fact at or before each probe (at or after, if ``ahead``), null if none.

    Both sides are merged into one ordered sequence and the last fact is carried along, so there is no join
    whose output could exceed the input, and long sequences are cut into blocks.
    """
    facts_first = not strict
    side = F.lit(0 if facts_first != ahead else 2)
    merged = (
        probes.withColumn("__probe", F.struct(*probes.columns))
        .select(*keys, at, F.lit(1).alias("__side"), F.lit(None).cast(facts.schema[value].dataType).alias("__fact"), "__probe")
        .unionByName(facts.select(*keys, at, side.alias("__side"), F.col(value).alias("__fact")), allowMissingColumns=True)
    )
    # rows equal in (at, side) are interchangeable for "last fact", bar equal facts: break ties by the fact
    rows = stable(merged.withColumn("__tie", F.xxhash64("__probe")))  # measured, then scanned
    order = [at, "__side", "__fact", "__tie"]
    groups = Groups.measure(rows, keys, staged=True)
    found = ordered(rows, keys, order, groups).running({"__found": ("last", F.col("__fact"))}, backward=ahead).frame()
    return found.where(F.col("__side") == 1).select("__probe.*", F.col("__found").alias(value))
