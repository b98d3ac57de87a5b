"""Interaction of filters: what each removes at each step of every order, from one pass over the documents.

A document's failures are a bit mask, and documents with the same mask, part and labels are one cell, so
the corpus shrinks to some cells a part. The orders are visited by single swaps of neighbours: a swap
leaves the set of filters before and after the pair as it was, so only its two steps are taken anew from
the cells, and the Shapley sums grow along the walk.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbase.llm.common import SPACE_CLASS, cut, scratch, small_enough_to_broadcast

#: More filters than this make more orders than a report should have.
MOST_FILTERS = 8


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on a text that isn't null: A short, B repetitive, C many capitals, D holds symbols of markup."""
    pieces = F.split(text, f"[{SPACE_CLASS}]+")
    empty = F.when(pieces[0] == "", 1).otherwise(0) + F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)
    n_words = F.size(pieces) - empty
    distinct = F.size(F.array_distinct(pieces)) - F.when(F.array_contains(pieces, ""), 1).otherwise(0)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n_words < 200, "B": 100 * distinct < 50 * n_words, "C": 100 * capitals > 3 * F.length(text), "D": text.rlike("[#$%&*|]")}


def swaps(n: int) -> Iterator[int]:
    """Places ``i`` whose swap with ``i + 1`` leads from each order of ``n`` things to the next, until all have been seen."""
    order, left = list(range(n)), [True] * n
    for _ in range(factorial(n) - 1):
        best, at = -1, -1
        for i, x in enumerate(order):
            j = i - 1 if left[x] else i + 1
            if 0 <= j < n and order[j] < x and x > best:
                best, at = x, i
        to = at - 1 if left[best] else at + 1
        order[at], order[to] = order[to], order[at]
        for x in range(best + 1, n):
            left[x] = not left[x]
        yield min(at, to)


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_ROWS = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)


def _walk(letters: str):
    n = len(letters)

    def run(cells: pa.Table) -> pa.Table:
        table = np.zeros((1 << n, 3), dtype=np.int64)  # documents, good ones, toxic ones of each mask
        np.add.at(table, cells["mask"].to_numpy(), np.column_stack([cells[c].to_numpy() for c in ("n", "good", "toxic")]))
        masks = np.arange(1 << n)
        fails = [int(table[(masks >> f) & 1 == 1, 0].sum()) for f in range(n)]
        alone = [int(table[1 << f, 0]) for f in range(n)]
        total = int(table[:, 0].sum())

        def step(order: list[int], i: int) -> tuple[int, int, int]:
            before = sum(1 << f for f in order[:i])
            return tuple(table[((masks >> order[i]) & 1 == 1) & (masks & before == 0)].sum(axis=0).tolist())

        order = list(range(n))
        steps = [step(order, i) for i in range(n)]
        seen, shapley = [], [0] * n

        def visit() -> None:
            seen.append((tuple(order), tuple(steps)))
            for f, lost in zip(order, steps, strict=True):
                shapley[f] += lost[0]

        visit()
        for i in swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            steps[i], steps[i + 1] = step(order, i), step(order, i + 1)
            visit()
        rows = []
        for visited, lost in seen:
            name, kept = "".join(letters[f] for f in visited), total
            for i, (f, (removed, good, toxic)) in enumerate(zip(visited, lost, strict=True)):
                kept -= removed
                rows.append((name, i + 1, kept, removed, fails[f] - removed, alone[f], good, toxic, shapley[f]))
        columns = list(zip(*rows, strict=True))
        part = pa.array([cells["part"][0].as_py()] * len(rows), pa.string())
        return pa.Table.from_arrays([part, pa.array(columns[0]), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["part", "filter_order", "step", *_COUNTS])

    return run


def failure_cells(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failures, bits 0 to 4 for filters A to E.

    Equal texts meet by a 256-bit digest, after rows of one task with the same digest, part and labels have
    become one, so a text that a third of all rows repeat moves a row a task and not a row a copy.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_filters(body).values())), F.lit(0))
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"), F.unhex(F.sha2(body, 256)).alias("digest"))
    rows = cut(rows)
    named = labels.where(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
    is_one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)))
    named = cut(named.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")))
    # rows without an id have no label; they stay out of the join, where they would all meet
    known = rows.where("id IS NOT NULL")
    known = known.join(F.broadcast(named) if small_enough_to_broadcast(named.count(), 24, 32) else named, F.col("id") == F.col("_id"), "left").drop("_id")
    marked = known.fillna(0, ["good", "toxic"]).unionByName(rows.where("id IS NULL").withColumns({"good": F.lit(0).cast("long"), "toxic": F.lit(0).cast("long")}))
    alike = ["digest", "part", "mask", "good", "toxic"]
    each = marked.groupBy(*alike, "id").agg(F.count(F.lit(1)).alias("n"))
    groups = each.groupBy(*alike).agg(F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    # a text has a row for each part and label here
    first = F.min("least.id").over(Window.partitionBy("digest"))
    fresh = F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0) + F.col("no_id")
    split = groups.withColumn("fresh", fresh).select("part", "mask", "good", "toxic", F.explode(F.array(F.struct(F.lit(0).alias("copy"), F.col("fresh").alias("k")), F.struct(F.lit(16).alias("copy"), (F.col("n") - F.col("fresh")).alias("k")))).alias("x"))
    one = split.where("x.k > 0").select("part", (F.col("mask") + F.col("x.copy")).alias("mask"), F.col("x.k").alias("n"), "good", "toxic")
    return one.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit_orders(cells: DataFrame, letters: str) -> DataFrame:
    """A row per part, order of the filters and step, from ``cells`` (part, mask, n, good, toxic) over at most eight filters."""
    if not 1 <= len(letters) <= MOST_FILTERS:
        raise ValueError(f"an audit takes 1 to {MOST_FILTERS} filters")
    return cells.groupBy("part").applyInArrow(_walk(letters), _ROWS)


def filter_audit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row per part, order of filters A to E and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``,
    ``toxic_lost`` and ``shapley`` (the removals of the step's filter, summed over all orders).

    E fails a text that a smaller id has too. A null text is an empty one, and a null part the empty string. A row without
    an id is no copy, makes none and has no label; rows that repeat an id count each, and are no copies of one another. An
    id is good (toxic) if one of its labels says so. An empty table gives an empty table. Other columns are not
    read and may have any names. Tables made on the way are deleted; the counts last.
    """
    with scratch(documents.sparkSession):
        cells = cut(failure_cells(documents, labels, id_col, text_col, part_col), lasting=True)
    return audit_orders(cells, "ABCDE")
