"""What the two ends of given pairs have in common, expanded from the smaller end.

The members of both ends are one long table. A pair is expanded by the end with fewer members and the
other end is only probed by (end, member), so a hub costs no more than its partner holds. The members
of an end that has very many are dealt into slices and its pairs are expanded slice by slice, so no
task holds all of them; many pairs of one end are a skewed join, which Spark splits at run time.

Pairs whose two ends both hold at most SLICE members meet as one row with both ends' members as arrays, so
what is sent is a pair with the smaller array and not a row for each of its members.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut_lineage

SLICE = 4096
_A, _B = 0, 1


class PairMembers:
    """Members of the two ends, ``left`` (a, mid, ...) and ``right`` (b, mid, ...), with distinct (end, mid) rows.

    The ends have one type. ``carry`` names columns of both tables that follow from ``mid`` alone.
    The table is written once; it is counted, expanded and probed.
    """

    def __init__(self, left: DataFrame, right: DataFrame, a: str, b: str, mid: str, carry: Sequence[str] = (), rows: int = SLICE):
        side = lambda df, end, kind: df.select(F.lit(kind).alias("__side"), F.col(end).alias("__end"), F.col(mid).alias("__mid"), *carry)
        self._keep(side(left, a, _A).unionByName(side(right, b, _B)), a, b, mid, carry, rows)

    @classmethod
    def of_nodes(cls, pairs: DataFrame, links: DataFrame, a: str, b: str, mid: str, carry: Sequence[str] = (), rows: int = SLICE) -> PairMembers:
        """Both ends are nodes of one table ``links`` (node, mid, ...), which is read once; only the ends of ``pairs`` are kept."""
        ends = cut_lineage(
            pairs.select(F.lit(_A).alias("__side"), F.col(a).alias("node")).distinct().unionByName(pairs.select(F.lit(_B).alias("__side"), F.col(b).alias("node")).distinct())
        )
        out = cls.__new__(cls)
        out._keep(links.join(ends, "node").select("__side", F.col("node").alias("__end"), F.col(mid).alias("__mid"), *carry), a, b, mid, carry, rows)
        return out

    def _keep(self, table: DataFrame, a: str, b: str, mid: str, carry: Sequence[str], rows: int) -> None:
        self.a, self.b, self.mid, self.carry, self.rows = a, b, mid, list(carry), rows
        self.table, self.packed = cut_lineage(table), None
        self.sizes = cut_lineage(self.table.groupBy("__side", "__end").agg(F.count("*").alias("__n")))

    def sized(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with size_a and size_b, 0 where an end has no members."""
        of = lambda kind, end, name: self.sizes.where(F.col("__side") == kind).select(F.col("__end").alias(end), F.col("__n").alias(name))
        zero = F.lit(0).cast("bigint")
        return (
            pairs.join(of(_A, self.a, "size_a"), self.a, "left").join(of(_B, self.b, "size_b"), self.b, "left")
            .withColumn("size_a", F.coalesce("size_a", zero)).withColumn("size_b", F.coalesce("size_b", zero))
        )

    def _slices(self, n: Column) -> Column:
        return F.ceil(n / self.rows).cast("int")

    def expanded(self, sized: DataFrame) -> DataFrame:
        """(__side, __end, __far, __mid, ...): the members of the smaller end of each distinct pair that has members at both."""
        by_a = F.col("size_a") <= F.col("size_b")
        asked = (
            sized.where("size_a > 0 AND size_b > 0").select(self.a, self.b, "size_a", "size_b").distinct()
            .select(
                F.when(by_a, _A).otherwise(_B).alias("__side"), F.when(by_a, F.col(self.a)).otherwise(F.col(self.b)).alias("__end"),
                F.when(by_a, F.col(self.b)).otherwise(F.col(self.a)).alias("__far"),
                F.explode(F.sequence(F.lit(0), self._slices(F.least("size_a", "size_b")) - 1)).alias("__slice"),
            )
        )
        dealt = self.table.join(self.sizes, ["__side", "__end"]).withColumn(
            "__slice", F.pmod(F.xxhash64("__mid"), self._slices(F.col("__n"))).cast("int")).drop("__n")
        return asked.join(dealt, ["__side", "__end", "__slice"]).drop("__slice")

    def _small(self) -> Column:
        return (F.col("size_a") <= self.rows) & (F.col("size_b") <= self.rows)

    def _arrays(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` of small ends with the members (with ``carry``) of a and b as ``__x`` and ``__y``."""
        if self.packed is None:
            member = F.struct("__mid", *self.carry) if self.carry else F.col("__mid")
            self.packed = cut_lineage(
                self.table.where(F.col("__mid").isNotNull()).groupBy("__side", "__end").agg(F.collect_list(member).alias("__m"), F.count("*").alias("__n"))
                .where(F.col("__n") <= self.rows).drop("__n")
            )
        of = lambda kind, end, name: self.packed.where(F.col("__side") == kind).select(F.col("__end").alias(end), F.col("__m").alias(name))
        by_a = pairs.where("size_a <= size_b").join(of(_A, self.a, "__x"), self.a).join(of(_B, self.b, "__y"), self.b)
        by_b = pairs.where("size_a > size_b").join(of(_B, self.b, "__y"), self.b).join(of(_A, self.a, "__x"), self.a)
        return by_a.unionByName(by_b)

    def _met(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` of small ends with ``__both``: the members (with ``carry``) that both ends hold."""
        return self._arrays(pairs).select(*pairs.columns, F.array_intersect("__x", "__y").alias("__both"))

    def meeting(self, sized: DataFrame) -> DataFrame:
        """(a, b): the pairs, which must be distinct, whose ends hold a member in common; no member is laid out for small ends."""
        wanted = cut_lineage(sized.where("size_a > 0 AND size_b > 0").select(self.a, self.b, "size_a", "size_b"))
        met = self._arrays(wanted.where(self._small())).where(F.arrays_overlap("__x", "__y")).select(self.a, self.b)
        large = wanted.where(~self._small())
        return met if large.isEmpty() else met.unionByName(self._probed(large).select(self.a, self.b).distinct())

    def counted(self, sized: DataFrame) -> DataFrame:
        """``sized`` with ``shared``, the number of members that both ends hold; ``sized`` must be cheap to read again."""
        zero = F.lit(0).cast("bigint")
        held = F.expr("size_a > 0 AND size_b > 0")
        small = self._met(sized.where(self._small() & held)).withColumn("shared", F.size("__both").cast("bigint")).drop("__both")
        none = sized.where(~held).withColumn("shared", zero)
        large = sized.where(~self._small() & held)
        if not large.isEmpty():
            n = self._probed(large).groupBy(self.a, self.b).agg(F.count("*").alias("shared"))
            small = small.unionByName(large.join(n, [self.a, self.b], "left").withColumn("shared", F.coalesce("shared", zero)))
        return small.unionByName(none)

    def common(self, sized: DataFrame) -> DataFrame:
        """(a, b, mid, ...): a row for each member that both ends of a distinct pair hold."""
        wanted = cut_lineage(sized.where("size_a > 0 AND size_b > 0").select(self.a, self.b, "size_a", "size_b").distinct())
        met = self._met(wanted.where(self._small())).select(self.a, self.b, F.explode("__both").alias("__m"))
        out = [F.col("__m.__mid").alias(self.mid), *[F.col(f"__m.{c}").alias(c) for c in self.carry]] if self.carry else [F.col("__m").alias(self.mid)]
        met = met.select(self.a, self.b, *out)
        large = wanted.where(~self._small())
        return met if large.isEmpty() else met.unionByName(self._probed(large))

    def least(self, sized: DataFrame) -> DataFrame:
        """(a, b, mid): the least member that both ends of a distinct pair hold; without ``carry``."""
        wanted = cut_lineage(sized.where("size_a > 0 AND size_b > 0").select(self.a, self.b, "size_a", "size_b").distinct())
        met = self._met(wanted.where(self._small())).select(self.a, self.b, F.array_min("__both").alias(self.mid)).where(F.col(self.mid).isNotNull())
        large = wanted.where(~self._small())
        return met if large.isEmpty() else met.unionByName(self._probed(large).groupBy(self.a, self.b).agg(F.min(self.mid).alias(self.mid)))

    def _probed(self, sized: DataFrame) -> DataFrame:
        """common() by rows: the smaller end laid out, the other one probed by (end, member)."""
        other = self.table.select((1 - F.col("__side")).alias("__side"), F.col("__end").alias("__far"), "__mid")
        by_a = F.col("__side") == _A
        return self.expanded(sized).join(other, ["__side", "__far", "__mid"]).select(
            F.when(by_a, F.col("__end")).otherwise(F.col("__far")).alias(self.a),
            F.when(by_a, F.col("__far")).otherwise(F.col("__end")).alias(self.b), F.col("__mid").alias(self.mid), *self.carry,
        )


def linked(pairs: DataFrame, members: PairMembers) -> DataFrame:
    """The pairs whose end b is itself a member of end a."""
    held = members.table.where(F.col("__side") == _A).select(F.col("__end").alias(members.a), F.col("__mid").alias(members.b))
    return pairs.join(held, [members.a, members.b], "left_semi")


def of_ends(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``left`` and ``right`` whose end is one of ``pairs``, which must be cheap to read again."""
    held = lambda df, end: df.join(cut_lineage(pairs.select(end).distinct()), end, "left_semi")
    return held(left, a), held(right, b)


def common_members(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, mid: str) -> DataFrame:
    """(a, b, mid) of the distinct pairs; members of other ends aren't sent."""
    pairs = cut_lineage(pairs.select(a, b).distinct())
    members = PairMembers(*of_ends(pairs, left, right, a, b), a, b, mid)
    return members.common(members.sized(pairs))
