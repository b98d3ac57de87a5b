"""MinHash near-duplicates by tensored banding, each link confirmed on full shingle sets.

Two small collections of ``tables`` group hashes are made, each group of ``per_group`` minhashes; a table
key combines group i of the first with group j of the second, so 2 * tables * per_group minhashes serve
tables ** 2 tables of 2 * per_group hashes each. Documents with equal sets form one class at once, and only
classes meet in tables. Two confirming passes lose no link between classes that share a table:

1. every class is compared with the best hub of its tables, the class with the fewest shingles that nobody
   else has; then, for two rounds, with the best one of about its size in another component;
2. what still lies in different components and shares a table is compared too, unless an exact bound on
   the shared part rules it out (see ``_possible`` and ``_open_pairs``).

So a table with thousands of copies costs a row for each, not for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbase.llm.common import cut, grams, mix64, scratch, slabs, small_enough_to_broadcast, trimmed, words_of
from quillbase.llm.components import components

#: Bytes of texts or sets that a task works on at once, of however large a batch Spark hands over.
BATCH_BYTES = 2_000_000
#: Tasks that the pairs of one class may be spread over.
SALTS = 64


@dataclass(frozen=True)
class Settings:
    """At similarity s a pair shares a table with probability (1 - (1 - s ** per_group) ** tables) ** 2: 0.9999 at 0.75."""

    words: int = 5
    percent: int = 75
    tables: int = 12
    per_group: int = 2
    hub_rounds: int = 3


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and each text's offset."""
    found = words_of(texts, lower_ascii=True)
    whole = grams(found.hashes, words)
    sets = []
    for a, b in zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist(), strict=True):
        if b - a >= words:
            sets.append(np.unique(whole[a : b - words + 1]))
        else:
            sets.append(grams(found.hashes[a:b], b - a) if b > a else whole[:0])
    return (np.concatenate(sets) if sets else whole[:0]), np.cumsum([0, *map(len, sets)])


def _set_names(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each set, the same in any order; none for an empty set."""
    full = np.flatnonzero(np.diff(offsets))
    out: list[bytes | None] = [None] * (len(offsets) - 1)
    if len(full):
        one = np.add.reduceat(mix64(hashes), offsets[full])
        two = np.add.reduceat(mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), offsets[full])
        both = np.stack([one, two], axis=1).tobytes()
        for k, i in enumerate(full.tolist()):
            out[i] = both[16 * k : 16 * k + 16]
    return out


def _signatures(hashes: np.ndarray, offsets: np.ndarray, settings: Settings) -> np.ndarray:
    """A row of 2 * tables group hashes for each non-empty set."""
    full = offsets[np.flatnonzero(np.diff(offsets))]
    draws = mix64(np.arange(1, 2 * 2 * settings.tables * settings.per_group + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    groups = np.zeros((len(full), 2 * settings.tables), dtype=np.uint64)
    for g in range(2 * settings.tables):
        for k in range(settings.per_group):
            p = 2 * (g * settings.per_group + k)
            least = np.minimum.reduceat(hashes * (draws[p] | np.uint64(1)) + draws[p + 1], full)
            groups[:, g] = groups[:, g] * np.uint64(0x9FB21C651E98DF25) + least
    return mix64(groups)


def _describe(settings: Settings):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for s in slabs(BATCH_BYTES, part["text"]):
                hashes, offsets = shingle_sets(part["text"][s].to_pylist(), settings.words)
                names = _set_names(hashes, offsets)
                seen: dict[bytes, int] = {}
                first = [i for i, x in enumerate(names) if x is not None and seen.setdefault(x, i) == i]
                groups: list[np.ndarray | None] = [None] * len(names)
                if first:  # copies inside a batch are described once
                    sizes = np.diff(offsets)[first]
                    own = np.concatenate([hashes[offsets[i] : offsets[i + 1]] for i in first])
                    for i, row in zip(first, _signatures(own, np.cumsum([0, *sizes]), settings).view(np.int64), strict=True):
                        groups[i] = row
                yield pa.RecordBatch.from_arrays(
                    [part["id"].slice(s.start, s.stop - s.start), pa.array(np.diff(offsets)), pa.array(names, pa.binary()), pa.array(groups, pa.list_(pa.int64()))], names=["id", "n", "name", "groups"]
                )

    return run


def _sets(settings: Settings):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for s in slabs(BATCH_BYTES, part["text"]):
                hashes, offsets = shingle_sets(part["text"][s].to_pylist(), settings.words)
                want = part["name"][s].to_pylist()
                right = [i for i, x in enumerate(_set_names(hashes, offsets)) if x == want[i]]  # another text may bear the same id
                packed = [hashes[offsets[i] : offsets[i + 1]].tobytes() for i in right]
                yield pa.RecordBatch.from_arrays([part["c"].slice(s.start, s.stop - s.start).take(pa.array(right, pa.int64())), pa.array(packed, pa.binary())], names=["c", "packed"])

    return run


def _shingle_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for s in slabs(BATCH_BYTES, part["packed"]):
            packed = part["packed"][s].to_pylist()
            counts = [len(x) // 8 for x in packed]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part["c"][s].to_numpy(), counts)), pa.array(np.frombuffer(b"".join(packed), dtype=np.int64))], names=["c", "shingle"])


_COMPARED = "a long, b long, size long, both long, linked boolean, outside binary"


def _compare(percent: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for s in slabs(BATCH_BYTES, part["set_a"], part["set_b"]):
                sizes, shared, linked, outside = [], [], [], []
                for x, y in zip(part["set_a"][s].to_pylist(), part["set_b"][s].to_pylist(), strict=True):
                    one, two = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                    apart = np.setdiff1d(one, two, assume_unique=True)
                    sizes.append(len(one))
                    shared.append(both := len(one) - len(apart))
                    linked.append(100 * both >= percent * (len(one) + len(two) - both))
                    outside.append(apart.tobytes())
                yield pa.RecordBatch.from_arrays([part["a"][s], part["b"][s], pa.array(sizes, pa.int64()), pa.array(shared, pa.int64()), pa.array(linked, pa.bool_()), pa.array(outside, pa.binary())], names=["a", "b", "size", "both", "linked", "outside"])

    return run


def _possible(n: Column, u: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m shingles, u of the n unshared, can reach the similarity: (100 + p)(n - u) >= p(n + m)."""
    return (n - u) * (100 + percent) >= (n + m) * percent


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Each pair (a, b) with both full sets; either may be in any number of pairs.

    A class's set is first sent to the salts that its pairs have, at most ``SALTS`` rows, and then joined
    on class and salt, so that the pairs of a popular hub are spread over as many tasks.
    """
    out = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt_a"), F.pmod(F.xxhash64("a"), F.lit(SALTS)).alias("salt_b"))
    for k in "ab":
        wanted = out.select(F.col(k).alias("c"), f"salt_{k}").distinct()
        sent = wanted.join(sets.select("c", F.col("packed").alias(f"set_{k}")), "c").withColumnRenamed("c", k)
        out = out.join(sent, [k, f"salt_{k}"])
    return out.select("a", "b", "set_a", "set_b")


def _shared_keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, c) in order of key, those whose key the row before or after them has too."""
    held: pa.RecordBatch | None = None  # the last row so far, and whether it is out already
    out_already = False
    for part in parts:
        if not part.num_rows:
            continue
        keys = part["key"].to_numpy()
        same = keys[1:] == keys[:-1]
        hit = np.append(False, same) | np.append(same, False)
        if held is not None and held["key"][0].as_py() == keys[0]:
            hit[0] = True
            if not out_already:
                yield held
        yield part.filter(pa.array(hit))
        held, out_already = part.slice(part.num_rows - 1), bool(hit[-1])


def _candidates(classes: DataFrame) -> DataFrame:
    """(key, c): the classes in tables' buckets that hold two classes or more, in one pass over rows sorted by key."""
    tables = F.posexplode(F.slice("groups", 1, (F.size("groups") / 2).cast("int")))
    rows = classes.select("c", "groups", tables.alias("i", "x"))
    rows = rows.select("c", "i", "x", F.posexplode(F.slice("groups", (F.size("groups") / 2).cast("int") + 1, F.size("groups"))).alias("j", "y"))
    rows = rows.select(F.xxhash64("i", "j", "x", "y").alias("key"), "c").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(_shared_keys, "key long, c long")


def _sized(table: DataFrame, bytes_per_row: int) -> DataFrame:
    """The table, written and counted, marked for broadcast if it is at most 32 MB; else it joins by shuffle."""
    table = cut(table)
    return F.broadcast(table) if small_enough_to_broadcast(table.count(), bytes_per_row, 32) else table


def _placed(live: DataFrame, links: DataFrame) -> DataFrame:
    """``live`` with each class's component so far."""
    place = _sized(components(links, "a", "b").select(F.col("node").alias("c"), "component"), 24)
    return live.join(place, "c", "left").withColumn("component", F.coalesce("component", "c"))


def _band_spokes(live: DataFrame, links: DataFrame, shift: float) -> DataFrame:
    """(a, b), a < b: each class with the best hub of another component among classes of its tables and of about its size."""
    banded = _placed(live, links).withColumn("band", F.floor(F.log("n") / math.log(1.2) + shift))
    hubs = _sized(banded.groupBy("key", "band").agg(F.min(F.struct("rank", "component")).alias("h")).select("key", "band", F.col("h.rank").alias("hub"), F.col("h.component").alias("hub_component")), 56)
    out = banded.join(hubs, ["key", "band"]).where(F.col("component") != F.col("hub_component")).groupBy("c").agg(F.min("hub").alias("hub"))
    return out.select(F.least("c", "hub.c").alias("a"), F.greatest("c", "hub.c").alias("b")).distinct()


def _rare_prefixes(loose: DataFrame, percent: int) -> DataFrame:
    """Of the shingles that a class has outside its hub, and others under it too, the rarest: as many as two classes must meet on one of.

    Classes of n and m shingles need p (n + m) / (100 + p) in common, of which the hub can give the lesser overlap with it at most. So a class of
    n must share t = p (n + p n / 100) / (100 + p) - both of its k shingles outside with any partner, and of two sets that have t in common,
    put in one order, the first k - t + 1 of each have one in common. ``loose`` has ``often``, the classes with the row's shingle. ``left``: how many of the class's follow the row's shingle.
    """
    own = Window.partitionBy("c")
    placed = loose.withColumns({"_at": F.row_number().over(own.orderBy("often", "shingle")), "_k": F.count(F.lit(1)).over(own)})
    partner = F.ceil(F.col("n") * percent / 100)
    needed = F.greatest(F.ceil((F.col("n") + partner) * percent / (100 + percent)) - F.col("both"), F.lit(1))
    return placed.where(F.col("_at") <= F.col("_k") - needed + 1).withColumn("left", F.col("_k") - F.col("_at")).drop("often", "_at", "_k")


def _open_pairs(live: DataFrame, links: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: the pairs in one table and in different components that the bounds leave open.

    Two classes with one hub H either share no shingle outside H, and then have at most the lesser of
    their overlaps with H in common, or share enough such shingles to meet on one of the rarest of each.
    """
    spoke = _sized(met.select(F.col("a").alias("c"), F.col("b").alias("hub"), F.col("both")), 32)
    placed = _placed(live, links).join(spoke, "c", "left")
    placed = placed.select("key", "c", "n", "u", "rank", "component", F.coalesce("hub", "c").alias("hub"), F.coalesce("both", "n").alias("both"))
    split = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("rank", "component")).alias("first"),
        F.min("n").alias("least"), (F.min("hub") == F.max("hub")).alias("one_hub"),
    )
    split = _sized(split.where("low < high").select("key", F.col("first.component").alias("main"), "least", "one_hub"), 40)
    bound = lambda n, most, m: most * (100 + percent) >= (n + m) * percent
    free = F.col("n") - F.col("u")
    open_ = placed.join(split, "key").where(bound(F.col("n"), free, F.col("least")))
    body = cut(open_.select("c", "n", "u", "component", "hub", "both").distinct())
    # in a table with one hub, a class that shares too little with it can only meet others on a shingle
    most = F.when(F.col("one_hub"), F.least("both", free)).otherwise(free)
    table = open_.where(bound(F.col("n"), most, F.col("least")))
    table = cut(table.select("key", "c", "n", "u", "component", "hub", "both", (F.col("component") != F.col("main")).alias("outer")))
    named = lambda df, k: df.select(*(F.col(x).alias(f"{x}_{k}") for x in ("c", "n", "u", "component", "hub", "both")), *[x for x in df.columns if x in ("key", "shingle")], *[F.col(x).alias(f"{x}_{k}") for x in df.columns if x == "left"])
    a, b = (lambda x: F.col(f"{x}_a")), (lambda x: F.col(f"{x}_b"))
    apart = (a("component") != b("component")) & bound(a("n"), a("n") - a("u"), b("n")) & bound(b("n"), b("n") - b("u"), a("n"))
    under_hub = (a("hub") != b("hub")) | bound(a("n"), F.least(a("both"), b("both")), b("n"))
    by_table = named(table.where("outer"), "a").join(named(table, "b"), "key").where(apart & under_hub)

    own = met.select(F.col("a").alias("c"), F.col("outside").alias("packed")).mapInArrow(_shingle_rows, "c long, shingle long")
    loose = own.join(body, "c")
    shared = loose.groupBy("hub", "shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("often")).where("low < high").select("hub", "shingle", "often")
    loose = cut(_rare_prefixes(loose.join(shared, ["hub", "shingle"]), percent))  # joined with itself: one plan, not two
    # the first shingle that two have in common is followed by the rest of what they have, so one with too little behind it isn't the first of a link
    enough = (F.least("both_a", "both_b") + 1 + F.least("left_a", "left_b")) * (100 + percent) >= (a("n") + b("n")) * percent
    by_shingle = named(loose, "a").join(named(loose, "b"), "shingle").where((a("hub") == b("hub")) & (a("c") < b("c")) & apart & enough)
    pairs = by_table.select("c_a", "c_b").unionByName(by_shingle.select("c_a", "c_b"))
    return pairs.select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).distinct()


def near_links(documents: DataFrame, id_col: str, text_col: str, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, n, name), classes (c, name, first: the least id) and confirmed links (a, b) that span each component."""
    plain = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(plain.dtypes)["id"]
    described = cut(plain.mapInArrow(trimmed(_describe(settings)), f"id {kind}, n long, name binary, groups array<long>"))
    rows = described.select("id", "n", "name")
    grouped = described.where("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("first"), F.max("n").alias("n"), F.max("groups").alias("groups"))
    classes = cut(grouped.withColumn("c", F.monotonically_increasing_id()))

    members = cut(_candidates(classes.select("c", "groups")))
    wanted = cut(members.select("c").distinct().join(classes, "c").select("c", "name", F.col("first").alias("id")))
    count = wanted.count()
    source = plain.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    chosen = source.join(F.broadcast(wanted) if small_enough_to_broadcast(count, 40) else wanted, "id")
    sets = cut(chosen.select("c", "name", "text").mapInArrow(trimmed(_sets(settings)), "c long, packed binary").dropDuplicates(["c"]))

    once = sets.mapInArrow(_shingle_rows, "c long, shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("c")).where("k = 1")
    alone = once.groupBy("c").agg(F.count(F.lit(1)).alias("u"))
    sizes = sets.select("c", (F.length("packed") / 8).cast("long").alias("n")).join(alone, "c", "left").select("c", "n", F.coalesce("u", F.lit(0)).alias("u"))
    least = F.ceil(F.col("n") * settings.percent / 100)  # the smallest set that can be a partner
    sizes = sizes.where(_possible(F.col("n"), F.col("u"), least, settings.percent))
    # what cannot have a link is out of the tables; the rest ranks by its unshared shingles
    live = cut(members.join(sizes.select("c", F.col("n").cast("int").alias("n"), F.col("u").cast("int").alias("u")), "c")).withColumn("rank", F.struct(F.col("u"), F.col("c")))

    hubs = _sized(live.groupBy("key").agg(F.min("rank").alias("hub")), 48)
    spokes = live.join(hubs, "key").where(F.col("rank") > F.col("hub")).groupBy("c").agg(F.min("hub").alias("hub"))
    spokes = cut(spokes.select(F.col("c").alias("a"), F.col("hub.c").alias("b")))
    # hubs have hubs; where these chains end is the hub that most of a group has in common
    chains = components(spokes, "a", "b")
    ranked = chains.join(live.select(F.col("c").alias("node"), "rank").distinct(), "node")
    ends = ranked.groupBy("component").agg(F.min("rank").alias("end")).select("component", F.col("end.c").alias("end"))
    aims = cut(spokes.join(chains.withColumnRenamed("node", "a").join(ends, "component"), "a").select("a", "b", "end"))
    pairs = aims.select("a", "b").unionByName(aims.where("a != end AND b != end").select("a", F.col("end").alias("b")))
    met = cut(_with_sets(pairs, sets).mapInArrow(trimmed(_compare(settings.percent)), _COMPARED))
    links = met.where("linked").select("a", "b")

    # the common end serves as hub for the bounds if it has half of a class, else the class's own hub
    worth = F.when(F.col("b") == F.col("end"), F.col("both") * 2 >= F.col("size")).otherwise(F.lit(False)).cast("int")
    seen = met.join(aims.select("a", "end"), "a").groupBy("a").agg(F.max_by(F.struct("b", "both", "outside"), F.struct(worth, F.col("b") != F.col("end"))).alias("m"))
    seen = cut(seen.select("a", "m.*"))
    tried = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for turn in range(settings.hub_rounds - 1):
        again = _with_sets(_band_spokes(live, links, turn / 2).join(tried, ["a", "b"], "left_anti"), sets).mapInArrow(trimmed(_compare(settings.percent)), _COMPARED)
        again = cut(again.select("a", "b", "linked"))
        links, tried = links.unionByName(again.where("linked").select("a", "b")), tried.unionByName(again.select("a", "b"))

    rest = _open_pairs(live, links, seen, settings.percent)
    more = _with_sets(rest.join(tried, ["a", "b"], "left_anti"), sets).mapInArrow(trimmed(_compare(settings.percent)), _COMPARED)
    return rows, classes.select("c", "name", "first"), cut(links.unionByName(more.where("linked").select("a", "b")))


def near_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id`` (least id reachable over links) and ``kept``.

    Words are lower-cased in A-Z; a text of fewer than five words is one shingle; an empty or null text has
    none, is linked with nothing and is its own component. Rows with equal sets are linked whatever their
    ids, so repeated rows share a component; a row with a null id is not kept unless its whole component
    has no id, when ``component_id`` is null and ``kept`` true. Other columns are ignored; an empty table
    gives an empty table. The result is a table in the shared folder; all tables before it are deleted.
    """
    with scratch(documents.sparkSession):
        rows, classes, links = near_links(documents, id_col, text_col, settings)
        reach = classes.join(components(links, "a", "b").withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
        least = reach.groupBy("component").agg(F.min("first").alias("component_id"))
        named = cut(reach.join(least, "component").select(F.col("name").alias("_name"), "component_id"))
        out = rows.join(named, F.col("name") == F.col("_name"), "left")
        component = F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("component_id"))
        out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").eqNullSafe(component)).alias("kept"))
        return cut(out, lasting=True)


def keep_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The input rows, all columns, of which ``near_dedup`` keeps the id; rows without an id stay.

    Columns may have any names; empty and null texts stay, as they are linked with nothing.
    """
    kept = near_dedup(documents, id_col, text_col, settings).where("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    return documents.join(kept, documents[id_col] == kept["_kept_id"], "left_semi").unionByName(documents.where(documents[id_col].isNull()))
