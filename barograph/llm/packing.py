"""Best-fit packing of token sequences after dominance reduction.

The instance is reduced to how many pieces each length has: at most `capacity` numbers, whatever
the corpus size. The plan (which lengths share a sequence, and how often) is made on those counts
in the driver; the pieces then find their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices
from .tokens import default_path, encoder


#: Plans with sequences of just k pieces are tried up to this k.
NUMBERS = 12


def cut(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document's ids (its end id included).

    Columns: doc_id, piece, start, length, ids_crc32, part and seq (together a row key), and ids
    (binary, little-endian unsigned 32-bit) if with_ids. A very long text is encoded whole by one task. A null text counts as empty and gives the
    end id alone; a null doc_id stays null; repeated rows are packed as often as they occur; other
    columns of docs are ignored; an empty table gives no rows.
    """
    path = tokenizer or default_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, seq long" + ", ids binary" * with_ids

    def run(batches):
        from pyspark import TaskContext

        encode, end, part, seq, step = encoder(path), np.asarray([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0, 4 * capacity
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(column):
                out = []
                for doc_id, coded in zip(ids[a:b], encode(column[a:b]), strict=True):
                    coded += end
                    for k, at in enumerate(range(0, len(coded), step)):
                        piece = coded[at : at + step]
                        out.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece), part, seq, piece))
                        seq += 1
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "seq"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


@dataclass
class Plan:
    """Placements by length: rank r of a run falls into sequence first + (r - start) // each, at offset + (r - start) % each * length."""

    capacity: int
    sequences: int = 0
    used: dict = field(default_factory=dict)  # ranks given out, by length
    runs: list = field(default_factory=list)  # (length, start, first, each, offset)

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def place(self, length: int, first: int, count: int, each: int, offset: int) -> None:
        start = self.used.get(length, 0)
        self.runs.append((length, start, first, each, offset))
        self.used[length] = start + count * each

    def copy(self) -> Plan:
        return Plan(self.capacity, self.sequences, dict(self.used), list(self.runs))

    def arrays(self) -> tuple:
        runs = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 5)
        return tuple(np.ascontiguousarray(runs[:, k]) for k in range(5))


def reduce_by_dominance(counts: dict[int, int], plan: Plan) -> dict[int, int]:
    """Fixes the sets that dominate every alternative for their largest piece; returns what is left.

    For a piece j: a partner that fills the sequence exactly dominates; if nothing fits beside j, j
    alone does; if no two pieces fit beside it, the longest single partner does; if no three fit,
    the longest single partner does when it is at least as long as the best pair. Equal choices are
    fixed together, by counts.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    size = plan.capacity

    def fix(lengths: list[int], times: int) -> None:
        first, offset = plan.open(times), 0
        for x in lengths:
            plan.place(x, first, times, 1, offset)
            offset += x
            left[x] -= times
            if not left[x]:
                del left[x]

    for j in sorted(left, reverse=True):
        while left.get(j):
            room, own = size - j, left[j]
            ascending = sorted(left)
            small = []
            for x in ascending:
                small += [x] * min(3 - len(small), left[x] - (x == j))
                if len(small) == 3:
                    break
            if not small or small[0] > room:
                fix([j], own)
                continue
            if left.get(room, 0) - (room == j) > 0:
                fix([j, room], own // 2 if room == j else min(own, left[room]))
                continue
            fits = [x for x in ascending if x <= room and left[x] - (x == j) > 0]
            best = fits[-1]
            times = own // 2 if best == j else min(own, left[best])
            if len(small) < 2 or small[0] + small[1] > room:
                fix([j, best], times)
                continue
            if len(small) < 3 or sum(small) > room:
                pair, hi = 0, len(fits) - 1
                for lo, a in enumerate(fits):
                    while hi >= lo and a + fits[hi] > room:
                        hi -= 1
                    if hi < lo:
                        break
                    b = fits[hi]
                    if a == b and left[a] - (a == j) < 2:
                        b = fits[hi - 1] if hi - 1 >= lo + 1 else 0
                    pair = max(pair, a + b if b else 0)
                if best >= pair:
                    fix([j, best], times)
                    continue
            break
    return left


def best_fit(left: dict[int, int], plan: Plan) -> None:
    """Longest pieces first, each into the fullest sequence that still holds it; equal sequences move together."""
    by_room: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, count)]
    size = plan.capacity
    for length in sorted(left, reverse=True):
        todo = left[length]
        for room in sorted(r for r in by_room if r >= length):
            if not todo:
                break
            groups, each = by_room.pop(room), room // length
            while groups and todo:
                first, count = groups.pop()
                full = min(count, todo // each)
                if full:
                    plan.place(length, first, full, each, size - room)
                    by_room.setdefault(room - each * length, []).append((first, full))
                    first, count, todo = first + full, count - full, todo - full * each
                if count and todo:  # fewer pieces than one sequence takes
                    plan.place(length, first, 1, todo, size - room)
                    by_room.setdefault(room - todo * length, []).append((first, 1))
                    first, count, todo = first + 1, count - 1, 0
                if count:
                    groups.append((first, count))
            if groups:
                by_room.setdefault(room, []).extend(groups)
        if todo:
            each = size // length
            full, rest = divmod(todo, each)
            for count, k in ((full, each), (bool(rest), rest)):
                if count:
                    first = plan.open(int(count))
                    plan.place(length, first, int(count), k, 0)
                    by_room.setdefault(size - k * length, []).append((first, int(count)))


def fill_by_number(left: dict[int, int], plan: Plan, k: int) -> dict[int, int]:
    """Fixes sequences of k pieces each from the smallest pieces, as many as their sum allows; returns what is left.

    Where lengths crowd a little above or below capacity / k, best fit puts its longest pieces together and then finds
    too little room for k of the rest. Here the longest piece that is still to have k - 1 companions takes, one after the
    other, the longest that leave room for the smallest ones to fill up the number. Equal sequences are fixed together.
    """
    size, rest = plan.capacity, dict(left)
    pieces = total = 0
    own: dict[int, int] = {}
    for x in sorted(left):  # the smallest pieces whose mean is at most capacity / k
        n = left[x]
        if k * (total + n * x) > size * (pieces + n):
            n = max(0, min(n, (size * pieces - k * total) // (k * x - size))) if k * x > size else n
        if n:
            own[x] = n
            pieces, total = pieces + n, total + n * x
        if n < left[x]:
            break
    while own:
        lengths = sorted(own)
        chosen: list[int] = []
        room, have = size, own
        for slot in range(k - 1, -1, -1):  # slot pieces follow this one
            taken = {x: chosen.count(x) for x in set(chosen)}
            least, need = 0, slot
            for x in lengths:
                n = min(need, have[x] - taken.get(x, 0))
                least, need = least + n * x, need - n
                if not need:
                    break
            fits = [] if need else [x for x in lengths if x <= room - least and have[x] > taken.get(x, 0)]
            if not fits:
                break
            x = fits[-1]
            chosen.append(x)
            room -= x
        if len(chosen) < k:
            x = lengths[-1] if not chosen or chosen[0] != lengths[-1] else chosen[0]
            del own[x]  # it stays among the rest
            continue
        times = min(own[x] // chosen.count(x) for x in set(chosen))
        if chosen[0] != lengths[-1]:
            del own[lengths[-1]]  # too long for any k
            continue
        first, offset = plan.open(times), 0
        for x in chosen:
            plan.place(x, first, times, 1, offset)
            offset += x
            for counts in (own, rest):
                counts[x] -= times
                if not counts[x]:
                    del counts[x]
    return rest


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound on sequences: for every length a up to half the capacity, pieces too long for a companion of length a
    or more are alone, those over half do not meet, and the rest from a on fill at least what these leave, and more."""
    if not counts:
        return 0
    x = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in x.tolist()], np.int64)
    many, size = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    half = int(np.searchsorted(x, capacity // 2, "right"))
    bounds = [-(-int(size[-1]) // capacity)]
    for a in [0, *x[:half].tolist()]:
        low, high = int(np.searchsorted(x, a)), max(half, int(np.searchsorted(x, capacity - a, "right")))
        alone, apart = int(many[-1] - many[high]), int(many[high] - many[half])
        over = int(size[half] - size[low]) - (apart * capacity - int(size[high] - size[half]))
        bounds.append(alone + apart + max(0, -(-over // capacity)))
    return max(bounds)


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    """The dominance reduction, then best fit of what is left. Where that needs over a thousandth more than the lower bound
    (one sequence more, of few), also best fit after sequences of just k pieces each, for every k up to `NUMBERS` and for
    k and all numbers below it in turn; the plan with the fewest sequences counts, of equals the first."""
    plan = Plan(capacity)
    left = reduce_by_dominance(counts, plan)
    bound = plan.sequences + least_sequences(left, capacity)
    most = min(NUMBERS, capacity // min(left, default=capacity))
    best = None
    for numbers in [(), *((k,) for k in range(2, most + 1)), *(range(k, 1, -1) for k in range(3, most + 1))]:
        own, rest = plan.copy(), dict(left)
        for k in numbers:
            rest = fill_by_number(rest, own, k)
        best_fit(rest, own)
        if best is None or own.sequences < best.sequences:
            best = own
        if best.sequences <= bound + bound // 1000:
            break
    return best


def place(pieces: DataFrame, capacity: int = 4096, cells: int = 4000) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (as `cut` gives, read twice).

    Ranks within a length come from windows over (length, cell); a length with many pieces is dealt
    over as many cells as its share of `cells`, so one hot length never fills a task. At most
    capacity + cells cell counts and one run list bounded by capacity reach the driver.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values()) or 1
    deal = spark.createDataFrame([(k, -(-n * cells // total)) for k, n in counts.items()], "length long, dealt long")
    dealt = pieces.join(F.broadcast(deal), "length").withColumn("cell", (F.xxhash64("part", "seq") % F.col("dealt") + F.col("dealt")) % F.col("dealt"))
    before: dict[int, int] = {}
    offsets = []
    for r in sorted(dealt.groupBy("length", "cell").agg(F.count("*").alias("n")).collect()):
        offsets.append((r["length"], r["cell"], before.get(r["length"], 0)))
        before[r["length"]] = before.get(r["length"], 0) + r["n"]
    base = spark.createDataFrame(offsets, "length long, cell long, base long")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "cell").orderBy("part", "seq")).cast("long")).join(F.broadcast(base), ["length", "cell"]).withColumn("rank", F.col("rank") - 1 + F.col("base")).drop("cell", "dealt", "base")
    arrays = spark.sparkContext.broadcast(make_plan(counts, capacity).arrays())
    names = [c for c in pieces.columns if c not in ("part", "seq")]

    def run(batches):
        lengths, starts, firsts, each, offs = arrays.value
        keys = lengths * (1 << 45) + starts
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            at = np.searchsorted(keys, length * (1 << 45) + rank, side="right") - 1
            nth = rank - starts[at]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            cols += [pa.array(firsts[at] + nth // each[at]), pa.array(offs[at] + nth % each[at] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(names).schema.fields)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their sequence and offset; see `cut` for nulls, ties and repeats."""
    return place(materialize(cut(docs, tokenizer, end_id, capacity, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences as sequence_id, length, ids (binary): pieces joined by offset. Needs with_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select("sequence_id", "length", F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
