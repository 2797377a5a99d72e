"""Time association: band join, one-to-one matching, nearest as-of join.

Spark plans a condition on |a - b| as a nested loop; ``band_join`` turns it into
an equi-join on time buckets, each row of one side copied to the neighbouring
buckets, with the exact condition left as a filter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.metrics import percentile
from voxloom.operators.selection import ranged_places
from voxloom.session import saved


def time_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def band_join(left: DataFrame, right: DataFrame, left_t: str, right_t: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """All pairs with |left_t - right_t| <= width, with equal ``keys``.

    Buckets are twice as wide as the band, so rounding at a bucket's edge cannot
    part a pair.  Columns other than ``keys`` must differ in name.  Null and NaN
    times match nothing.
    """
    if not width >= 0:
        raise ValueError("the width is at least 0")
    span = F.lit(2.0 * width if width else 1.0)
    bucket = lambda t: F.floor(F.col(t).cast("double") / span)
    near = F.explode(F.array(bucket(left_t) - 1, bucket(left_t), bucket(left_t) + 1))
    one = left.filter(~F.isnan(F.col(left_t).cast("double"))).withColumn("__bucket", near)
    two = right.filter(~F.isnan(F.col(right_t).cast("double"))).withColumn("__bucket", bucket(right_t))
    pairs = one.join(two, [*(keys or []), "__bucket"])
    return pairs.filter(time_difference(F.col(left_t), F.col(right_t)) <= F.lit(width)).drop("__bucket")


def greedy_pairs(difference: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rows of candidates that a greedy pass keeps: by rising difference, then
    left and right, each side used once."""
    used_left: set[int] = set()
    used_right: set[int] = set()
    kept = []
    for k in np.lexsort((right, left, difference)).tolist():
        if left[k] not in used_left and right[k] not in used_right:
            used_left.add(left[k])
            used_right.add(right[k])
            kept.append(k)
    return np.array(kept, np.int64)


def match_greedy(candidates: DataFrame, seq: str, left: str, right: str, difference: str) -> DataFrame:
    """One-to-one matching by rising difference, a task for each sequence.

    The pass is sequential within a sequence; sequences run in parallel.  For a
    sequence too large for a worker use ``match_nearest``, or ``match_mutual`` on
    candidates that are not those of a band; both give the same rows.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return group.iloc[greedy_pairs(group[difference].to_numpy(), group[left].to_numpy(), group[right].to_numpy())]

    return candidates.groupBy(seq).applyInPandas(run, candidates.schema)


#: Entries of both sides that a task of ``match_nearest`` is given.
ENTRIES = 32_768


def nearest_pairs(t: np.ndarray, side: np.ndarray, idx: np.ndarray, width: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greedy pairs of a stretch of a sequence that hold whatever lies
    outside: rows of the left side (0), of the right (1), and the undecided rows.

    ``low`` and ``high`` are the nearest times outside (infinite: none).  The
    least difference left is between neighbours in time, so only neighbours are
    looked at and no candidates are listed.  A pair that something at or beyond
    an end could keep apart moves that end to its far side; what is then outside,
    or within ``width`` of it and unmatched, stays undecided.
    """
    order = np.lexsort((idx, side, t))
    at = t[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(at)])
    lefts = np.add.reduceat(side[order] == 0, first, dtype=np.int64) if len(at) else size
    both = np.minimum(lefts, size - lefts)
    # equal times: by place on either side
    place = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
    one = (np.repeat(first, both) + place).tolist()
    two = (np.repeat(first + lefts, both) + place).tolist()
    kept = size > 2 * both
    is_left = (lefts > both)[kept]
    head = np.where(is_left, first[kept] + both[kept], first[kept] + lefts[kept] + both[kept]).tolist()
    end = (first + np.where(lefts > both, lefts, size))[kept].tolist()
    gt, is_left, ids = at[first[kept]].tolist(), is_left.tolist(), idx[order].tolist()
    n = len(gt)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple] = []

    def meet(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and is_left[a] != is_left[b] and gt[b] - gt[a] <= width:
            l, r = (a, b) if is_left[a] else (b, a)
            heapq.heappush(heap, (gt[b] - gt[a], ids[head[l]], ids[head[r]], a, b))

    for a in range(n - 1):
        meet(a, a + 1)
    while heap:
        gap, left, right, a, b = heapq.heappop(heap)
        if head[a] == end[a] or head[b] == end[b] or after[a] != b or gt[a] <= low or gt[b] >= high:
            continue
        l, r = (a, b) if is_left[a] else (b, a)
        if ids[head[l]] != left or ids[head[r]] != right:
            meet(a, b)
        elif gap >= gt[a] - low:
            low = gt[b]
        elif gap >= high - gt[b]:
            high = gt[a]
        else:
            one.append(head[l])
            two.append(head[r])
            for g in (a, b):
                head[g] += 1
                if head[g] == end[g]:
                    p, q = before[g], after[g]
                    if p >= 0:
                        after[p] = q
                    if q >= 0:
                        before[q] = p
            if head[a] < end[a]:
                meet(a, after[a])
            elif head[b] < end[b]:
                meet(before[b], b)
            else:
                meet(before[b], after[b])
    rest = [k for g in range(n) if gt[g] - low <= width or high - gt[g] <= width for k in range(head[g], end[g])]
    return tuple(order[np.array(x, np.int64)] for x in (one, two, rest))


def stretch_pairs(seq: str, width: float, ends: dict[int, tuple]) -> Callable[[tuple, pa.Table], pa.Table]:
    """``nearest_pairs`` of the entries of one range, for each sequence in it:
    pairs, and undecided entries with nulls for the other side.  ``ends``: for
    each range the last (sequence, time) before it and the first after it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        low, high = ends.get(key[0].as_py(), (None, None))
        names = table[seq].combine_chunks().dictionary_encode()
        code = names.indices.to_numpy()
        side, idx, t = (table[c].to_numpy() for c in ("__side", "__idx", "__t"))
        found: list[list[np.ndarray]] = [[], [], []]
        for k, name in enumerate(names.dictionary.to_pylist()):
            own = np.flatnonzero(code == k)
            below = low[1] if low and low[0] == name else -math.inf
            above = high[1] if high and high[0] == name else math.inf
            for rows, x in zip(found, nearest_pairs(t[own], side[own], idx[own], width, below, above), strict=True):
                rows.append(own[x])
        left, right, rest = map(np.concatenate, found)
        columns = [table[seq].take(pa.array(np.r_[left, rest]))]
        for k, taken in enumerate((left, right)):
            rows, lacks = np.r_[taken, rest], np.r_[np.zeros(len(taken), bool), side[rest] != k]
            columns += [pa.array(idx[rows], mask=lacks), pa.array(t[rows], mask=lacks)]
        return pa.table(columns, names=[seq, "l", "lt", "r", "rt"])

    return run


def match_nearest(left: DataFrame, right: DataFrame, seq: str, left_idx: str, left_t: str, right_idx: str, right_t: str, width: float, rows: int = ENTRIES) -> DataFrame:
    """``match_greedy`` of the pairs within ``width``: seq, left_idx, right_idx
    and difference, without making the candidates.

    Entries of both sides are dealt by range of time, ``rows`` to a task, and
    each task takes the pairs that nothing outside its range can change
    (``nearest_pairs``).  The entries left, those near the ends of ranges, are
    dealt again to half as many ranges at most; the last round has one and
    decides the rest.  A chain of rising differences through a whole sequence
    would leave all its entries, not its candidates, to that round.

    Rows that repeat an entry count once.  Neighbours decide only where differences
    are exact: an index that is null or has several times, times that are not
    BIGINT or DOUBLE, or DOUBLE ones below the width, whose differences are
    rounded, go by their candidates.
    """
    if not width >= 0:
        raise ValueError("the width is at least 0")

    def side(df: DataFrame, k: int, idx: str, t: str) -> DataFrame:
        return df.select(seq, F.lit(k).alias("__side"), F.col(idx).alias("__idx"), F.col(t).alias("__t")).filter(f"{seq} is not null and __t is not null and not isnan(__t)")

    one, two = side(left, 0, left_idx, left_t), side(right, 1, right_idx, right_t)
    kind, types = one.schema["__t"].dataType.simpleString(), (dict(one.dtypes), dict(two.dtypes))
    entries = one.unionByName(two)
    exact = types[0] == types[1] and types[0]["__idx"] == "bigint" and kind in ("bigint", "double")
    if exact:
        each = entries.groupBy(seq, "__side", "__idx").agg(F.count("*").alias("n"), F.min("__t").alias("low"), F.max("__t").alias("high"))
        unclear = F.count_if(F.col("__idx").isNull() | (F.col("low") != F.col("high")))
        counts = each.agg(F.count("*").alias("n"), F.max("n").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"), unclear.alias("unclear")).first()
        n = counts["n"]
        exact = not n or not counts["unclear"] and (kind == "bigint" or counts["low"] >= width and counts["high"] < math.inf)
        if exact and n and counts["most"] > 1:
            entries = entries.distinct()
    if not exact:
        pairs = band_join(left, right, left_t, right_t, width, [seq])
        pairs = pairs.select(seq, left_idx, right_idx, time_difference(F.col(left_t), F.col(right_t)).alias("difference"))
        return match_greedy(pairs, seq, left_idx, right_idx, "difference")

    schema = f"{seq} {types[0][seq]}, l bigint, lt {kind}, r bigint, rt {kind}"
    taken, parts = [], 0
    while parts != 1:
        wanted = max(1, math.ceil(n / rows))
        parts = min(wanted, max(1, parts // 2)) if taken else wanted
        ends: dict[int, tuple] = {}
        if parts == 1:
            dealt = entries.withColumn("__part", F.lit(0))
        else:
            dealt = saved(entries.repartitionByRange(parts, seq, "__t").withColumn("__part", F.spark_partition_id()), "stretches")
            span = F.struct(seq, "__t")
            found = sorted(map(tuple, dealt.groupBy("__part").agg(F.min(span), F.max(span)).collect()))
            ends = {p: (found[k - 1][2] if k else None, found[k + 1][1] if k + 1 < len(found) else None) for k, (p, _, _) in enumerate(found)}

        out = saved(dealt.groupBy("__part").applyInArrow(stretch_pairs(seq, width, ends), schema), "matched")
        taken.append(out.filter("l is not null and r is not null"))
        rest = out.filter("l is null or r is null")
        entries = rest.select(seq, F.when(F.col("r").isNull(), 0).otherwise(1).alias("__side"), F.coalesce("l", "r").alias("__idx"), F.coalesce("lt", "rt").alias("__t"))
        n = entries.count() if parts > 1 else 0
    pairs = reduce(DataFrame.unionByName, taken)
    return pairs.select(seq, F.col("l").alias(left_idx), F.col("r").alias(right_idx), time_difference(F.col("lt"), F.col("rt")).alias("difference"))


def match_mutual(candidates: DataFrame, seq: str, left: str, right: str, difference: str, save, rounds: int = 50) -> DataFrame:
    """The greedy matching by rounds of mutually best candidates.

    In each round a candidate that is best for both its sides is taken and the
    candidates of those sides go.  ``save`` materialises a DataFrame (a written
    table or a checkpoint), so plans do not grow.  Most candidates go in a few
    rounds; a chain of rising differences would need a round for each pair, so
    what is left after ``rounds`` goes to ``match_greedy``, which ends the same
    way: rounds only ever take what the greedy pass takes.
    """
    order = F.struct(difference, left, right)
    rest, taken = save(candidates), None
    for _ in range(rounds):
        best = [F.min(order).over(Window.partitionBy(seq, side)) for side in (left, right)]
        marked = rest.withColumn("__l", best[0]).withColumn("__r", best[1])
        now = save(marked.filter((F.col("__l") == order) & (F.col("__r") == order)).drop("__l", "__r"))
        if now.isEmpty():
            return candidates.limit(0) if taken is None else taken
        taken = now if taken is None else save(taken.unionByName(now))
        for side in (left, right):
            rest = rest.join(now.select(seq, side), [seq, side], "left_anti")
        rest = save(rest)
    last = match_greedy(rest, seq, left, right, difference)
    return last if taken is None else taken.unionByName(last)


def in_depth_order(pairs: DataFrame, seq: str, depth_t: str, difference: str, left: str, right: str) -> DataFrame:
    """Numbers the pairs of a sequence by depth time: rec_idx from 0.  Pairs are
    dealt by range and written once, so a sequence may exceed a task."""
    placed = ranged_places(pairs, [seq], [depth_t, difference, left, right], "rec_idx")
    return placed.withColumn("rec_idx", F.col("rec_idx").cast("int"))


def nearest_asof(
    left: DataFrame, right: DataFrame, seq: str, left_id: str, left_t: str, right_idx: str, right_t: str, tolerance: float, clip: str = "file"
) -> DataFrame:
    """Each left row with the nearest right row no further than ``tolerance``,
    ties to the first; left rows without one are dropped.

    Equal left rows are answered each.  Left rows beyond the range of the right side go too: its first and last row
    by place in the file (``clip="file"``), its least and largest time ("time"),
    or none ("none").  The nearest within the tolerance is the nearest at all
    whenever that is within it, so a band join finds every candidate.
    """
    carried = [c for c in right.columns if c != seq]
    rows = left.withColumn("__row", F.monotonically_increasing_id())
    pairs = band_join(rows, right, left_t, right_t, tolerance, [seq])
    gap = time_difference(F.col(left_t), F.col(right_t))
    best = F.min_by(F.struct(*carried), F.struct(gap, F.col(right_idx)))
    found = pairs.groupBy("__row", *left.columns).agg(best.alias("__best"), F.min(gap).alias("__gap"))
    if clip != "none":
        ends = {
            "file": (F.min_by(right_t, right_idx), F.max_by(right_t, right_idx)),
            "time": (F.min(right_t), F.max(right_t)),
        }[clip]
        limits = right.groupBy(seq).agg(ends[0].alias("__low"), ends[1].alias("__high"))
        found = found.join(limits, seq).filter((F.col(left_t) >= F.col("__low")) & (F.col(left_t) <= F.col("__high"))).drop("__low", "__high")
    return found.select(*left.columns, "__best.*", F.col("__gap").alias("asof_gap"))


def nearest_entry(left: DataFrame, right: DataFrame, seq: str, left_id: str, left_t: str, right_idx: str, right_t: str) -> DataFrame:
    """seq, left_id, right_idx and gap: each left row with the nearest right row
    at any distance, ties to the smaller ``right_idx``; none where a sequence has
    no right rows.  Right rows without a time (null, NaN) are no neighbours; a
    left row without a time, or without neighbours, has a null gap and the
    smallest ``right_idx``, as in the SQL.

    Both sides are dealt by range of time and written once.  Each left row sees
    its neighbours in its range, or else the last one of the ranges before and
    the first of those after: no pairs are made and no task sees a sequence.
    """
    spark = left.sparkSession
    known = lambda t: F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double"))
    once = right.groupBy(seq, F.col(right_t).alias("__t")).agg(F.min(right_idx).alias("__idx"))
    rows = left.select(seq, F.col(left_t).alias("__t"), F.col(left_id).alias("__id"), F.lit(1).alias("__side"), F.lit(None).cast(once.schema["__idx"].dataType).alias("__idx"))
    marks = once.select(seq, "__t", F.lit(None).cast(left.schema[left_id].dataType).alias("__id"), F.lit(0).alias("__side"), "__idx")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.unionByName(marks).repartitionByRange(parts, seq, "__t", "__side", "__id").withColumn("__part", F.spark_partition_id())
    dealt = saved(dealt, "stretches").withColumn("__here", F.when((F.col("__side") == 0) & known("__t"), F.struct("__t", "__idx")))

    own, upto = Window.partitionBy("__part", seq), (Window.unboundedPreceding, Window.currentRow)
    here = F.last("__here", ignorenulls=True)  # a frame to the end would be read again for each row
    seen = dealt.withColumn("__before", here.over(own.orderBy("__t", "__side").rowsBetween(*upto)))
    seen = seen.withColumn("__after", here.over(own.orderBy(F.desc("__t"), "__side").rowsBetween(*upto))).filter("__side = 1")
    ends = dealt.groupBy("__part", seq).agg(F.min("__here").alias("__first"), F.max("__here").alias("__last"), F.min("__idx").alias("__least"))
    order = Window.partitionBy(seq).orderBy("__part")
    carried = ends.select(
        F.col("__part"), seq,
        F.last("__last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"),
        F.last("__first", ignorenulls=True).over(Window.partitionBy(seq).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)).alias("__later"),
        F.min("__least").over(Window.partitionBy(seq)).alias("__least"),
    )
    gap = lambda c: F.struct(time_difference(F.col("__t"), c["__t"]).alias("gap"), c["__idx"].alias("idx"))
    choice = lambda c: F.when(c.isNotNull() & known("__t"), gap(c))
    best = F.least(*[choice(F.coalesce(*map(F.col, c))) for c in (("__before", "__earlier"), ("__after", "__later"))])
    found = seen.drop("__idx").join(carried, ["__part", seq]).withColumn("__best", best).filter("__best is not null or __least is not null")
    return found.select(seq, F.col("__id").alias(left_id), F.coalesce(F.col("__best")["idx"], F.col("__least")).alias(right_idx), F.col("__best")["gap"].alias("gap"))


def ordered_matching(a: np.ndarray, b: np.ndarray, width: float) -> list[tuple[int, int]]:
    """Pairs of two sorted time lists within ``width`` that keep the order of
    both, as many as possible and then with the least total difference.

    Dynamic programming over the band only: outside it a row's values repeat,
    so time and memory go with the number of candidates.  Ties skip the first
    list, then the second, then match.
    """
    low = np.searchsorted(b, a - width, "left")
    high = np.searchsorted(b, a + width, "right")
    count, error = [0], [0.0]  # best of the first j of b; beyond the end the last value repeats
    moves: list[tuple[int, str]] = []
    for i, t in enumerate(a.tolist()):
        lo, hi = int(low[i]), int(high[i])
        grow = hi + 1 - len(count)
        count += [count[-1]] * max(0, grow)
        error += [error[-1]] * max(0, grow)
        row = []
        diagonal = (count[lo], error[lo])
        for j in range(lo + 1, hi + 1):
            above = (count[j], error[j])
            best, move = above, "a"
            side = (count[j - 1], error[j - 1])
            if side[0] > best[0] or side[0] == best[0] and side[1] < best[1]:
                best, move = side, "b"
            gap = abs(t - float(b[j - 1]))
            if gap <= width:
                pair = (diagonal[0] + 1, diagonal[1] + gap)
                if pair[0] > best[0] or pair[0] == best[0] and pair[1] < best[1]:
                    best, move = pair, "m"
            count[j], error[j] = best
            row.append(move)
            diagonal = above
        moves.append((lo, "".join(row)))
    pairs = []
    j = len(count) - 1
    for i in range(len(a) - 1, -1, -1):
        lo, row = moves[i]
        if not row:
            continue
        j = min(j, lo + len(row))
        while j > lo and row[j - lo - 1] == "b":
            j -= 1
        if j > lo and row[j - lo - 1] == "m":
            pairs.append((i, j - 1))
            j -= 1
    return pairs[::-1]


def match_ordered(left: DataFrame, right: DataFrame, seq: str, left_idx: str, left_t: str, right_idx: str, right_t: str, width: float) -> DataFrame:
    """``ordered_matching`` of each sequence: seq, left_idx, right_idx, difference."""

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        one, two = one.sort_values([left_t, left_idx]), two.sort_values([right_t, right_idx])
        pairs = np.array(ordered_matching(one[left_t].to_numpy(float), two[right_t].to_numpy(float), width), np.int64).reshape(-1, 2)
        if not len(pairs):
            return pd.DataFrame({seq: [], left_idx: [], right_idx: [], "difference": []})
        p, q = one.iloc[pairs[:, 0]], two.iloc[pairs[:, 1]]
        gap = np.abs(p[left_t].to_numpy(float) - q[right_t].to_numpy(float))
        return pd.DataFrame({seq: p[seq].to_numpy(), left_idx: p[left_idx].to_numpy(), right_idx: q[right_idx].to_numpy(), "difference": gap})

    kind = left.schema[seq].dataType.simpleString()
    schema = f"{seq} {kind}, {left_idx} bigint, {right_idx} bigint, difference double"
    return left.groupBy(seq).cogroup(right.groupBy(seq)).applyInPandas(run, schema)


def time_statistics(df: DataFrame, difference: str) -> DataFrame:
    """n, mean, max and exact median of a difference, one row."""
    d = F.col(difference)
    held = saved(df.select(difference), "differences")
    middle = percentile(held, difference, 0.5, "median")
    return held.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.max(d).alias("max")).join(middle)
