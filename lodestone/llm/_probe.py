"""Histogram probes: exact weights below key boundaries, refined round by round until the targets are met."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Probes in one interval and round; what a round brings to the driver is bounded by this and the number of targets.
PROBES = 2048


def boundaries(rows: DataFrame, targets: list[int], tolerance: int, lower: bool = False) -> list[tuple[int, int]]:
    """For each target a key b and the exact weight of the rows whose key is less than b.

    rows: key (0 to 2**62 - 1) and weight, both long. Each round counts the weight between candidate keys, over all
    partitions, in the intervals that still hold a target, and then looks closer between the two nearest. It ends when
    the weight below is within the tolerance, or at single keys; there the nearer side is taken, or, with `lower`, the
    one that doesn't exceed the target.
    """
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return [(0, 0)] * len(targets)
    found: dict[int, tuple[int, int]] = {}
    spans = {i: (low, high + 1, 0) for i in range(len(targets))}  # first key, end, weight below the first
    while spans:
        todo = sorted(set(spans.values()))
        step = {s: max(1, -(-(s[1] - s[0]) // PROBES)) for s in todo}
        place, cell = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, s in enumerate(todo):
            inside = (F.col("key") >= s[0]) & (F.col("key") < s[1])
            place = F.when(inside, F.lit(i)).otherwise(place)
            cell = F.when(
                inside,
                F.floor(
                    (F.col("key") - F.lit(s[0])) / F.lit(1)
                ) if step[s] == 1 else F.expr(f"(key - {s[0]}L) div {step[s]}L"),
            ).otherwise(cell)
        counted = rows.select(
            place.alias("place"), cell.alias("cell"), "weight"
        ).where("place IS NOT NULL").groupBy("place", "cell").agg(F.sum("weight").alias("weight")).collect()
        bins: dict[tuple[int, int, int], dict[int, int]] = {s: {} for s in todo}
        for r in counted:
            bins[todo[r["place"]]][int(r["cell"])] = int(r["weight"])
        ahead: dict[int, tuple[int, int, int]] = {}
        for i, s in spans.items():
            below = s[2]
            best = (s[0], below)
            for c in sorted(bins[s]):
                begin, end, above = s[0] + c * step[s], s[0] + (c + 1) * step[s], below + bins[s][c]
                near = [(begin, below)] if lower else [(begin, below), (end, above)]
                best = min([best, *near], key=lambda x: abs(x[1] - targets[i]))
                if above >= targets[i]:
                    if lower and above == targets[i]:
                        best = (end, above)
                    elif abs(best[1] - targets[i]) > tolerance and step[s] > 1:
                        ahead[i] = (begin, min(end, s[1]), below)
                    break
                below = above
            if i not in ahead:
                found[i] = best
        spans = ahead
    return [found[i] for i in range(len(targets))]
