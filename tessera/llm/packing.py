"""Best-fit packing by bin completion over the histogram of piece lengths.

Only longer documents are cut, so a piece has one of ``capacity`` lengths and the number of pieces of each length
says all that packing needs. That histogram - at most ``capacity`` rows however large the corpus - goes to the
driver. Best-fit decreasing is the first incumbent; then bins are completed branch-and-bound: the largest piece left
branches over its undominated fillings, and a branch is cut where its waste leaves no packing with fewer bins than the
incumbent. Equal bins are made together, as often as the histogram allows and in shorter runs after that, so the work
follows the number of lengths and not of pieces. The problem is NP-hard: the search is exact where it ends by itself,
and ``STEPS`` steps bound it; the result is never worse than best-fit decreasing. Pieces then find their places from their rank among the pieces of their length,
which per-partition counts give without sorting or gathering equal lengths.

Defined cases: a null text is empty and is one piece with the end id alone; repeated rows and ids are packed as they
come; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import batch_rows, table, written
from tessera.llm.encoders import REMEMBER, encoder
from tessera.operators.kept import dealt

PIECE = "piece int, start long, length long, ids_crc32 long"
#: Search steps of a packing, and undominated fillings that a bin branches over.
STEPS, MOST = 2_000_000, 16


def _cut(path: str, capacity: int, end_id: int, keep_ids: bool, remember: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id")
            for i in range(0, len(texts), 64):
                out: list[tuple] = []
                for at, body in enumerate(encoder(path, True, remember).ids(texts[i : i + 64]), i):
                    body += end
                    for k, a in enumerate(range(0, len(body), 4 * capacity)):
                        part = body[a : a + 4 * capacity]
                        out.append((at, k, a // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
                cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                cols[0] = ids.take(cols[0])
                yield pa.RecordBatch.from_arrays(cols[: 6 if keep_ids else 5], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if keep_ids else 5])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, keep_ids: bool = False, remember: int = REMEMBER) -> DataFrame:
    """The pieces of each document: its ids and the end id, cut where longer than ``capacity``. ``remember``: chunks a worker keeps."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_cut(tokenizer, capacity, end_id, keep_ids, remember), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECE}" + ", ids binary" * keep_ids)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing, as (how often, piece lengths): each piece goes to the open bin with the least room for it.

    Equal bins are one entry: pieces of one length fill the tightest bins one after the other, each as far as it goes."""
    rooms: list[int] = []  # ascending, the rooms of ``open_bins``
    open_bins: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(times: int, own: tuple[int, ...], room: int) -> None:
        if room not in open_bins:
            insort(rooms, room)
            open_bins[room] = []
        open_bins[room].append((times, own))

    for n, c in sorted(((n, c) for n, c in histogram.items() if c > 0), reverse=True):
        while c:
            i = bisect_left(rooms, n)
            if i < len(rooms):
                room = rooms[i]
                times, own = open_bins[room].pop()
                if not open_bins[room]:
                    del rooms[i], open_bins[room]
            else:
                room, times, own = capacity, -(-c // (capacity // n)), ()
            each = room // n
            whole = min(times, c // each)
            if whole:
                put(whole, (*own, *[n] * each), room - each * n)
            c -= whole * each
            if whole < times:
                if c:  # fewer than ``each`` are left
                    put(1, (*own, *[n] * c), room - c * n)
                if own and times > whole + (c > 0):
                    put(times - whole - (c > 0), own, room)
                c = 0
    return [(times, list(own)) for room in rooms for times, own in open_bins[room]]


def least(histogram: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: Martello and Toth's bound L2, of which the volume bound is the case of no small piece left out."""
    pieces_of, volume = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    for n, c in histogram.items():
        pieces_of[n + 1], volume[n + 1] = c, n * c
    pieces_of, volume = pieces_of.cumsum(), volume.cumsum()  # [n]: of lengths under n
    found, half = 0, capacity // 2
    for k in {0, *(n for n in histogram if n <= half)}:
        big = int(pieces_of[capacity + 1] - pieces_of[half + 1])
        beside = int(pieces_of[capacity - k + 1] - pieces_of[half + 1]) * capacity - int(volume[capacity - k + 1] - volume[half + 1])
        found = max(found, big + max(0, -(-(int(volume[half + 1] - volume[k]) - beside) // capacity)))
    return found


def completions(left: dict[int, int], capacity: int, big: int, spare: int, steps: int, most: int) -> tuple[list[list[tuple[int, int]]], int, bool]:
    """Undominated fillings of the room beside ``big`` that waste no more than ``spare``, as (length, how many); steps made; whether those are all.

    A filling is dominated where a piece left out could take the place of some of its pieces, or of none, and fit:
    whatever packing has the filling has an equally good one with that piece in it. Least waste first, then fewest pieces."""
    lengths = sorted(n for n, c in left.items() if c > 0 and n <= capacity - big)
    sums = [0]
    for n in lengths:
        sums.append(sums[-1] + n * left[n])
    there = sum(1 << n for n in lengths)
    found: list[tuple[int, int, list[tuple[int, int]]]] = []
    chosen: list[tuple[int, int]] = []
    seen = 0

    def dominated(room_left: int) -> bool:
        any_sum, many, out = 1, 0, there  # bit s: some pieces, or two and more, are s long together
        for n, k in chosen:
            for _ in range(k):
                many |= (many | any_sum & ~1) << n
                any_sum |= any_sum << n
            if k == left[n]:
                out &= ~(1 << n)
        if many & out:
            return True
        return any((any_sum << d) & out for d in range(1, room_left + 1))

    def choices(top: int, room_left: int) -> Iterator[tuple[int, int]]:
        """Which length comes next, and how often; long lengths and long runs first."""
        for i in range(min(top, bisect_right(lengths, room_left) - 1), -1, -1):
            if room_left - sums[i + 1] > spare:  # all that is left fills too little
                return
            for k in range(min(left[lengths[i]], room_left // lengths[i]), 0, -1):
                yield i, k

    room, stack = capacity - big, []
    while seen < steps:
        if len(stack) == len(chosen):  # a filling not seen before
            seen += 1
            if room <= spare and not dominated(room):
                found.append((room, sum(k for _, k in chosen), chosen[:]))
                if not room and len(found) >= most:
                    break
            stack.append(choices(stack[-1][1] - 1 if stack else len(lengths) - 1, room))
            stack[-1] = [stack[-1], 0]
        step = next(stack[-1][0], None)
        if step is None:
            stack.pop()
            if not stack:
                break
            n, k = chosen.pop()
            room += n * k
            continue
        stack[-1][1] = step[0]
        n = lengths[step[0]]
        chosen.append((n, step[1]))
        room -= n * step[1]
    found.sort(key=lambda f: f[:2])
    return [f for _, _, f in found[:most]], seen, not stack and len(found) <= most


def branch(histogram: dict[int, int], capacity: int, best: list[tuple[int, list[int]]], bound: int, steps: int = STEPS, most: int = MOST) -> list[tuple[int, list[int]]]:
    """Bin completion: fewer bins than ``best`` if the search finds them, else ``best``.

    The largest piece left branches over its undominated fillings, and over how often each is repeated (the whole run
    first, then halves of it, then the rest). A branch is cut where its waste, over all bins so far, leaves no packing
    with fewer bins than the incumbent. Passes allow 0, 1, 2, 4, ... choices other than the first one, so that an early
    choice is undone as soon as a late one. It ends at ``bound``, when a pass leaves out nothing, or after ``steps``."""
    volume = sum(n * c for n, c in histogram.items())
    count = sum(t for t, _ in best)
    each_steps = max(256, min(20_000, 10 * steps // len(histogram)))
    made, allowed = 0, 0
    while count > bound and made < steps:
        left, wasted, whole = {n: c for n, c in histogram.items() if c > 0}, 0, True
        path: list[tuple[int, list[tuple[int, int]], int]] = []  # how often, (length, how many), waste

        def options(strays: int) -> Iterator[tuple[int, list[tuple[int, int]], int]]:
            nonlocal made, whole
            big = max(left)
            left[big] -= 1
            spare = (count - 1) * capacity - volume - wasted
            fill, seen, all_of = completions(left, capacity, big, spare, each_steps, most if strays else 1)  # where no other choice is open, the first one will do
            left[big] += 1
            made, whole = made + seen, whole and all_of
            runs = []
            for f in fill:
                own = dict(f)
                own[big] = own.get(big, 0) + 1
                waste = capacity - sum(n * k for n, k in own.items())
                times = min(left[n] // k for n, k in own.items())
                runs.append((min(times, spare // waste) if waste else times, list(own.items()), waste))
            halves = [(t >> h, own, w) for h in range(max((t for t, _, _ in runs), default=0).bit_length()) for t, own, w in runs if t >> h]
            yield from halves[: 1 if not strays else None]
            if not strays:
                whole = whole and len(halves) <= 1 and all(t <= 1 for t, _, _ in runs)
                return
            for t, own, w in runs:
                tried = {t >> h for h in range(t.bit_length())}
                yield from ((x, own, w) for x in range(t, 0, -1) if x not in tried)

        stack = [[options(allowed), allowed, 0]]  # the choices, other choices allowed, choices made
        while stack and made < steps:
            frame = stack[-1]
            if len(path) == len(stack):  # the last choice comes back
                times, own, waste = path.pop()
                wasted -= times * waste
                for n, k in own:
                    left[n] = left.get(n, 0) + k * times
            choice = next(frame[0], None)
            if choice is None:
                stack.pop()
                continue
            made += 1
            times, own, waste = choice
            frame[2] += 1
            path.append(choice)
            wasted += times * waste
            for n, k in own:
                left[n] -= k * times
                if not left[n]:
                    del left[n]
            if (count - 1) * capacity < volume + wasted:
                stack.append([iter(()), 0, 0])
            elif left:
                strays = frame[1] - (frame[2] > 1)
                stack.append([options(strays), strays, 0])
            else:
                best = [(t, [n for n, k in o for _ in range(k)]) for t, o, _ in path]
                count = sum(t for t, _ in best)
                if count <= bound:
                    return best
                stack.append([iter(()), 0, 0])
        if whole and not stack:
            return best
        allowed = max(1, 2 * allowed)
    return best


def solve(histogram: dict[int, int], capacity: int, steps: int = STEPS) -> list[tuple[int, list[int]]]:
    """The fewest bins found in ``steps`` steps, from best-fit decreasing on. The search ends where no packing has fewer."""
    if not histogram:
        return []
    bound = least(histogram, capacity)
    best = best_fit(histogram, capacity)
    return best if sum(t for t, _ in best) <= bound else branch(histogram, capacity, best, bound, steps)


def slots(bins: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs of ranks: first rank, first sequence, pieces of the length in a bin, and the offset of the first."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for times, own in bins:
        at = 0
        for n in dict.fromkeys(own):
            k = own.count(n)
            runs.setdefault(n, []).append((used.get(n, 0), first, k, at))
            used[n] = used.get(n, 0) + times * k
            at += n * k
        first += times
    return {n: tuple(np.asarray(c, np.int64) for c in zip(*r)) for n, r in runs.items()}


def _place(places: dict[int, tuple[np.ndarray, ...]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = b.column("length").to_numpy(), b.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                first, seq, k, begin = places[int(n)]
                i = np.searchsorted(first, ranks[at], "right") - 1
                within = ranks[at] - first[i]
                sequence[at], offset[at] = seq[i] + within // k[i], begin[i] + within % k[i] * n
            keep = [c for c in b.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, and each piece's rank among the partition's pieces of its length."""
    part, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
    for b in batches:
        lengths = b.column("length").to_numpy()
        order = np.argsort(lengths, kind="stable")
        kinds, start, count = np.unique(lengths[order], return_index=True, return_counts=True)
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths)) - np.repeat(start, count)
        if len(kinds) and kinds[-1] >= len(seen):
            seen = np.concatenate([seen, np.zeros(kinds[-1] + 1 - len(seen), np.int64)])
        rank += seen[lengths]
        seen[kinds] += count
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(lengths), part), pa.int32()), pa.array(rank)], [*b.schema.names, "__part", "__local"])


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """``cut`` (with a column length) plus sequence_id and offset."""
    numbered = cut.mapInArrow(_numbered, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", __part int, __local long")
    with batch_rows(cut.sparkSession):
        numbered = written(numbered, "pieces")  # a partition's ranks must not change if a lost executor's work is redone
    counts = written(numbered.groupBy("length", "__part").agg(F.count("*").alias("__n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most `capacity` rows
    places = slots(solve(histogram, capacity))
    before = counts.withColumn("__before", F.sum("__n").over(W.partitionBy("length").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("length", "__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    ranked = numbered.join(before, ["length", "__part"]).withColumn("__rank", F.col("__local") + F.col("__before"))
    ranked = ranked.select(*cut.columns, "__rank")
    return ranked.mapInArrow(_place(places), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, remember: int = REMEMBER) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity, end_id, remember=remember), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids of word_bpe_49k.json."""
    import public_tokenizers

    return pack_documents(dealt(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))
