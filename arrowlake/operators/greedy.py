"""The two order-dependent kernels, streamed over sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def first_fit(pairs: DataFrame, group: list[str], left: str, right: str, order: list[str]) -> DataFrame:
    """One-to-one greedy choice: in ``order`` within each group, a pair is kept if both its ends are still free.

    ``pairs`` are candidates only, already cut down by joins. They are dealt by group and streamed in order, so a
    task holds no more than the ends used so far in the current group.
    """
    schema, keys = pairs.schema, list(group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, lefts, rights = None, set(), set()
        for rows in batches:
            keep = np.zeros(len(rows), bool)
            for i, (g, a, b) in enumerate(zip(rows[keys].itertuples(index=False, name=None), rows[left], rows[right], strict=True)):
                if g != current:
                    current, lefts, rights = g, set(), set()
                if a not in lefts and b not in rights:
                    keep[i] = True
                    lefts.add(a)
                    rights.add(b)
            yield rows[keep]

    return pairs.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def suppress(items: DataFrame, conflicts: DataFrame, group: list[str], item: str, rank: str) -> DataFrame:
    """Greedy suppression: by ``rank`` within a group, an item is dropped if it conflicts with an earlier kept one.

    ``conflicts`` holds (group, ``item``, ``earlier``) with the two in rank order. Items without conflicts never
    reach the kernel.
    """
    keys = list(group)
    spread = conflicts.join(items.select(*keys, item, rank), [*keys, item])
    schema = items.select(*keys, item).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, dropped = None, set()
        for rows in batches:
            out = []
            for row in rows[[*keys, item, "earlier"]].itertuples(index=False, name=None):
                if row[:-2] != current:
                    current, dropped = row[:-2], set()
                if row[-1] not in dropped and row[-2] not in dropped:
                    dropped.add(row[-2])
                    out.append(row[:-1])
            yield pd.DataFrame(out, columns=[*keys, item])

    lost = spread.repartition(*keys).sortWithinPartitions(*keys, rank).mapInPandas(run, schema)
    return items.join(lost, [*keys, item], "left_anti")
