"""Link graphs: what a root reaches, in which order it is discovered, and the addresses that pages get.

Each level of a search is one join of the frontier with the links, which are written once, and one anti join
with what was found before, a table to which every level adds its part. Ranks are carried from level to
level: a target's is the number of targets of earlier sources and of earlier links of its own source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbase.operators.stored import Scratch

#: Rows of one group that are put in order together; sums over blocks carry on from block to block.
BLOCK = 65_536


def running(rows: DataFrame, group: list[str], place: str, value: Column, name: str, *ties: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same group before this one, by ``place`` (a whole number) and ``ties``.

    A group may hold all rows: only rows whose places are in one block of ``BLOCK`` meet in a task, and a row a block carries the sum on.
    """
    staged = rows.withColumns({"_block": F.floor(F.col(place) / BLOCK), "_value": value})
    sums = staged.groupBy(*group, "_block").agg(F.sum("_value").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*group, "_block").orderBy(place, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = staged.join(sums, [*group, "_block"])
    return out.withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(inner), F.lit(0))).drop("_block", "_value", "_before")


def reach(edges: DataFrame, root: object, max_levels: int = 1_000_000) -> DataFrame:
    """(node, depth) of every node that ``root`` reaches, breadth first, the root included. Edges with a null end are left out; repeated
    edges and loops are allowed. The result lasts in the checkpoint folder; the links are deleted."""
    spark = edges.sparkSession
    with Scratch(spark) as scratch:
        links = scratch.keep(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
        start = spark.range(1).select(F.lit(root).cast(dict(edges.dtypes)["src"]).alias("node"), F.lit(0).alias("depth"))
        frontier, seen = scratch.append(start, "seen", 0)
        for level in range(1, max_levels):
            found = links.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
            frontier, seen = scratch.append(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)), "seen", level)
            if frontier.isEmpty():
                break
        return seen


def discover(links: DataFrame, root: object, max_levels: int = 1_000_000) -> DataFrame:
    """(node, rank, depth, slug): what a queue that starts with ``root`` meets, in order: all links of a node by ``pos``, then those of the next.

    ``links``: src, pos, dst, slug. ``rank`` counts from 0 over the targets; the root is among them only if a link leads back to it. ``slug``
    is that of the link by which the target was found. Links with a null end are left out; a null position comes last, and links of one
    source and position go by target.
    """
    spark = links.sparkSession
    with Scratch(spark) as scratch:
        held = scratch.keep(links.select("src", F.coalesce(F.col("pos").cast("long"), F.lit(1 << 62)).alias("pos"), "dst", "slug").where("src IS NOT NULL AND dst IS NOT NULL"))
        kind = dict(held.dtypes)["dst"]
        frontier = spark.range(1).select(F.lit(root).cast(kind).alias("node"), F.lit(-1).cast("long").alias("rank"))
        seen, base = spark.createDataFrame([], f"node {kind}, rank long, depth int, slug string"), 0
        for level in range(1, max_levels):
            met = held.join(frontier.select(F.col("node").alias("src"), F.col("rank").alias("from")), "src")
            first = met.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("from", "pos", "slug")).alias("by")).select("node", "by.*")
            fresh = scratch.keep(first.join(seen.select("node"), "node", "left_anti"))
            size = fresh.count()
            if not size:
                break
            sources = running(fresh.groupBy("from").agg(F.count(F.lit(1)).alias("n")), [], "from", F.col("n"), "earlier").select("from", "earlier")
            own = running(fresh, ["from"], "pos", F.lit(1), "own", "node").join(sources, "from")
            level_rows = own.select("node", (F.lit(base) + F.col("earlier") + F.col("own")).cast("long").alias("rank"), F.lit(level).alias("depth"), "slug")
            frontier, seen = scratch.append(level_rows, "found", level)
            base += size
        return seen


def assign_slugs(found: DataFrame) -> DataFrame:
    """(node, slug): each target's address. In order of ``rank``, a target takes its own slug, or the first of slug-2, slug-3 and so on, that
    no earlier target has. ``found``: node, rank (no two alike), slug; rows with a null slug are left out.

    The k-th candidate of ``s`` can be taken only by ``s`` itself or by a target whose own slug is "s-k", so conflicts are
    pairs of a slug and such a reserved one. What a pair comes to hangs on pairs of lesser k or of the
    shorter slug, and is found by rounds until none changes; all else is counting.
    """
    with Scratch(found.sparkSession) as scratch:
        rows = found.where("slug IS NOT NULL").select("node", "rank", F.col("slug").alias("base"))
        turns = scratch.keep(running(rows, ["base"], "rank", F.lit(1), "j").withColumn("j", F.col("j") + 1))
        bases = turns.where("j = 1").select("base", F.col("rank").alias("first"))
        suffix = F.regexp_extract("base", r"-([1-9]\d{0,17})$", 1)
        reserved = bases.where(suffix != "").select(F.regexp_extract("base", r"^(.*)-\d+$", 1).alias("base"), suffix.cast("long").alias("k"), F.col("base").alias("child"), "first")
        pairs = scratch.keep(reserved.where("k > 1").join(bases.select("base"), "base", "left_semi").withColumns({"skipped": F.lit(False), "taken": F.lit(False)}))
        if pairs.isEmpty():
            return scratch.keep(turns.select("node", _address(F.col("j"))), last=True)
        while True:
            before = _lost(pairs)
            at = running(pairs, ["base"], "k", F.col("skipped").cast("long"), "skips").join(before, "base", "left")
            at = at.withColumn("j", F.col("k") - F.col("skips") - F.coalesce("lost", F.lit(0)))
            now = at.join(turns.select("base", "j", "rank"), ["base", "j"], "left")
            later = F.coalesce(F.col("first") < F.col("rank"), F.lit(False))
            sooner = F.coalesce(F.col("rank") < F.col("first"), F.lit(False))
            after = scratch.keep(now.select("base", "k", "child", "first", later.alias("skipped"), sooner.alias("taken"), ((later != F.col("skipped")) | (sooner != F.col("taken"))).alias("changed")))
            pairs = after.drop("changed")
            if after.where("changed").isEmpty():
                break
        # the i-th place that a slug must leave out moves all its turns from that place less i - 1 on
        gone = pairs.where("skipped").select("base", "k").unionByName(_lost(pairs).select("base", F.lit(1).cast("long").alias("k")))
        moves = running(gone, ["base"], "k", F.lit(1), "i").select("base", (F.col("k") - F.col("i")).alias("j"), F.lit(0).alias("turn"), F.lit(1).alias("move"))
        both = moves.withColumns({"node": F.lit(None).cast(dict(turns.dtypes)["node"])}).unionByName(turns.select("base", "j", F.lit(1).alias("turn"), F.lit(0).alias("move"), "node"))
        moved = running(both, ["base"], "j", F.col("move"), "shift", "turn").where("turn = 1")
        return scratch.keep(moved.select("node", _address(F.col("j") + F.col("shift"))), last=True)


def _lost(pairs: DataFrame) -> DataFrame:
    """(base, lost): slugs whose plain form an earlier target of a shorter one has taken."""
    return pairs.where("taken").select(F.col("child").alias("base"), F.lit(1).alias("lost"))


def _address(k: Column) -> Column:
    return F.when(k > 1, F.concat_ws("-", "base", k.cast("string"))).otherwise(F.col("base")).alias("slug")
