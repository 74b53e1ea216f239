"""Filling fixed-capacity containers: pattern packing by non-negative least squares.

Everything global happens on the histogram of item lengths, which has at most ``capacity`` entries however many items
there are. Patterns of few lengths that fill a container exactly are enumerated, their repeat counts are fitted to the
histogram by non-negative least squares and rounded down; what is left of the histogram is packed best-fit, long items
first, again by counts. The outcome is a plan of bounded size: intervals of ranks within a length and the containers they
go to. Items get their rank within their length, and look their container up in that plan by binary search.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.session import cut, ship

#: Patterns enumerated at most for each length, lengths of a pattern at most.
PATTERNS_EACH, DEEPEST = 3, 8
RANKED_AT_ONCE = 250_000  #: items of a length that are ranked in one part; a common length falls into as many as it takes
SCALES = (1.0, 0.9, 0.75, 0.5, 0.25)  #: of the fitted repeats, tried in turn


def patterns_of(counts: np.ndarray, capacity: int, each: int = PATTERNS_EACH, deepest: int = DEEPEST) -> list[tuple[int, ...]]:
    """Patterns of 1 to ``deepest`` lengths that occur and sum up to the capacity, ``each`` or so for every length.

    Each starts at one length and takes further ones by steps through the quantiles of the lengths that occur, so that
    common lengths take part often; the last one closes the pattern exactly.
    """
    present = np.flatnonzero(counts)
    if not len(present):
        return []
    quantiles = np.cumsum(counts[present]) / counts.sum()
    have = set(present.tolist())
    found: dict[tuple[int, ...], None] = {}
    golden, turn = 0.6180339887498949, 0.0
    for start in present[::-1].tolist():
        made = 0
        for _ in range(8 * each):
            chosen, room = [start], capacity - start
            while room and len(chosen) < deepest:
                if room in have and (len(chosen) >= 2 or room > capacity // 3):
                    chosen.append(room)
                    room = 0
                    break
                turn = (turn + golden) % 1.0
                length = int(present[min(int(np.searchsorted(quantiles, turn)), len(present) - 1)])
                if length > room:
                    at = int(np.searchsorted(present, room, "right")) - 1
                    if at < 0:
                        break
                    length = int(present[at])
                chosen.append(length)
                room -= length
            if room == 0:
                key = tuple(sorted(chosen, reverse=True))
                if key not in found:
                    found[key] = None
                    made += 1
            if made >= each or start == capacity:
                break
    return list(found)


def repeats_of(patterns: list[tuple[int, ...]], counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """How often to use each pattern: non-negative least squares against the histogram, by accelerated projected gradients.

    Misfits weigh by the inverse root of the count, so rare lengths are fitted as closely as common ones.
    """
    if not patterns:
        return np.zeros(0)
    width = max(map(len, patterns))
    slots = np.zeros((len(patterns), width), np.int64)  # length 0 is a slot that isn't used
    for n, p in enumerate(patterns):
        slots[n, : len(p)] = p
    target = counts.astype(float).copy()
    weight = 1.0 / np.maximum(target, 1.0)
    weight[0] = target[0] = 0.0
    size = len(counts)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(slots.ravel(), np.repeat(x, width), size)

    def gradient(x: np.ndarray) -> np.ndarray:
        return (weight * (forward(x) - target))[slots].sum(1)

    v = np.ones(len(patterns))  # the largest eigenvalue, for the step
    for _ in range(30):
        u = (weight * forward(v))[slots].sum(1)
        top = np.linalg.norm(u)
        v = u / top
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        x_new = np.maximum(0.0, y - gradient(y) / (1.05 * top))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = x_new + (t - 1) / t_new * (x_new - x)
        x, t = x_new, t_new
    return x


def plan_of(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that together hold exactly the items of the histogram ``counts`` (index 0 to capacity).

    The fitted repeats are rounded down at several scales, each with the rest packed best-fit, and the plan with the fewest
    containers is taken: where long items are many, some must be left for the short ones of the rest.
    """
    whole = counts.astype(np.int64).copy()
    whole[0] = 0
    patterns = patterns_of(whole, capacity)
    fitted = repeats_of(patterns, whole)
    plans = []
    for scale in SCALES:
        left, plan, times_of = whole.copy(), [], np.floor(scale * fitted + 1e-6).astype(np.int64)
        for k in np.argsort(-times_of, kind="stable"):
            if times_of[k] <= 0:
                break
            lengths, need = np.unique(patterns[k], return_counts=True)
            times = int(min(times_of[k], (left[lengths] // need).min()))
            if times > 0:
                plan.append((patterns[k], times))
                left[lengths] -= need * times
        plans.append(plan + _best_fit(left, capacity))
    return min(plans, key=lambda p: sum(t for _, t in p))


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The rest, longest first, each into the open containers with the least room that is enough; by counts of equal containers."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []
    full: list[tuple[tuple[int, ...], int]] = []

    def put(room: int, what: tuple[int, ...], times: int) -> None:
        if room == 0:
            full.append((what, times))
            return
        if not open_[room]:
            bisect.insort(rooms, room)
        open_[room].append((what, times))

    for length in range(len(left) - 1, 0, -1):
        n = int(left[length])
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                fits = capacity // length
                if n >= fits:
                    put(capacity - fits * length, (length,) * fits, n // fits)
                    n %= fits
                if n:
                    put(capacity - n * length, (length,) * n, 1)
                    n = 0
                break
            room = rooms[at]
            what, times = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
            fits = min(room // length, n)  # of this length into one container
            use = min(times, n // fits)
            if times > use:
                put(room, what, times - use)
            put(room - fits * length, what + (length,) * fits, use)
            n -= use * fits
    return full + [x for room in rooms for x in open_[room]]


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """key, piece, first, size, container, place: where each item, or each piece of it, lies.

    An item of at most ``capacity`` is one piece 0. A longer one is split into pieces of the capacity and a rest; a whole
    piece fills a container of its own. ``first`` is the piece's offset within its item, ``place`` that within its
    container. container is ``p<number>`` for packed containers and ``w<key>.<piece>`` for those of whole pieces. Items
    whose size is null or not positive are left aside; repeated keys are separate items; an empty table gives no rows.
    """
    sized = cut(items.where(items[size] > 0).select(items[key].alias("key"), items[size].cast("bigint").alias("n")))
    whole = F.floor(F.col("n") / capacity).cast("int")
    rest = F.col("n") % capacity
    loose = sized.where(rest > 0).select("key", whole.alias("piece"), (whole.cast("bigint") * capacity).alias("first"), rest.cast("int").alias("size"))
    # At most ``capacity`` counts reach the driver, then a count for each part that items are ranked in.
    histogram = np.zeros(capacity + 1, np.int64)
    for r in loose.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect():
        histogram[r["size"]] = r["n"]
    parts = np.maximum(1, -(-histogram // RANKED_AT_ONCE)).astype(int)
    many = [(F.col("size") == int(n), int(parts[n])) for n in np.flatnonzero(parts > 1)]
    salts = F.lit(1)
    for hit, n in many:
        salts = F.when(hit, n).otherwise(salts)
    loose = loose.withColumn("salt", F.pmod(F.xxhash64("key"), salts).cast("int"))
    counts = {(r["size"], r["salt"]): r["n"] for r in loose.where(F.col("size").isin(np.flatnonzero(parts > 1).tolist())).groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")).collect()} if many else {}
    begins = {n: np.concatenate([[0], np.cumsum([counts.get((n, k), 0) for k in range(parts[n])])[:-1]]) for n in np.flatnonzero(parts > 1).tolist()}
    # Ranks of a length are dealt to the slots of the plan in order.
    taken, number, intervals = defaultdict(int), 0, []
    for lengths, times in plan_of(histogram, capacity):
        place = 0
        for length in lengths:
            intervals.append((length << 40 | taken[length], number, place))
            taken[length] += times
            place += length
        number += times
    at, first_of, place_of = (np.array(c, np.int64) for c in zip(*sorted(intervals))) if intervals else (np.zeros(0, np.int64),) * 3
    rank = F.row_number().over(Window.partitionBy("size", "salt").orderBy("key", "piece")) - 1
    ship(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, salt = batch.column("size").to_numpy().astype(np.int64), batch.column("salt").to_numpy()
            ranks = batch.column("rank").to_numpy().astype(np.int64)
            for n, begin in begins.items():
                here = size == n
                ranks[here] += begin[salt[here]]
            rank_of = size << 40 | ranks
            on = np.searchsorted(at, rank_of, "right") - 1
            containers = pa.array((first_of[on] + rank_of - at[on]).astype(str))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "piece", "first", "size")], containers, pa.array(place_of[on].astype(np.int32))], names=["key", "piece", "first", "size", "container", "place"])

    kind = loose.schema["key"].dataType.simpleString()
    packed = loose.withColumn("rank", rank).mapInArrow(run, f"key {kind}, piece int, first bigint, size int, container string, place int")
    packed = packed.withColumn("container", F.concat(F.lit("p"), "container"))
    filled = sized.where(whole > 0).select("key", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    filled = filled.select(
        "key", "piece", (F.col("piece").cast("bigint") * capacity).alias("first"), F.lit(capacity).alias("size"),
        F.concat(F.lit("w"), F.col("key").cast("string"), F.lit("."), F.col("piece").cast("string")).alias("container"), F.lit(0).alias("place"),
    )
    return packed.unionByName(filled).withColumnRenamed("key", key)
