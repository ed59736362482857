"""A hidden Markov language model, trained by Baum-Welch over all partitions.

Symbols are the most frequent words, the end of a text, and classes of the remaining words by their
last letters; a rare word's probability is its class's, from the states, times its share of the
class, from counts of all training words. Training counts are made per partition and added up by
symbol in Spark, so nothing but the model (symbols by states, a fixed bound) and the KNOWN most
frequent words reach the driver. Counts of further words are joined to the texts that hold them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, slices

#: Words with a symbol of their own, classes of the others, states, rounds over all training texts.
WORDS, CLASSES, STATES, ROUNDS = 20_000, 64, 8, 17
#: Words whose counts are sent to every task; those of all others are joined.
KNOWN = 300_000
#: Weight of the corpus's own distribution in every state's, and its least share.
PRIOR, FLOOR = 200.0, 1e-5
#: Training reads longer texts in stretches of so many symbols, with so many more on either side that lead the
#: recursions in and out but are not counted.
STRETCH, HALO = 1024, 64
#: Symbols that a task holds at once.
HELD = 2_000_000


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)  # of one byte, from a register of 0


def classes_of(words: pa.Array) -> np.ndarray:
    """class_of every word of a binary array without nulls."""
    if not len(words):
        return np.zeros(0, np.int64)
    words = pa.concat_arrays([words])  # offsets from 0
    ends = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    crc, size = np.full(len(words), 0xFFFFFFFF, np.uint32), np.diff(ends)
    for back in (3, 2, 1):
        has = np.flatnonzero(size >= back)
        now = crc[has]
        crc[has] = _CRC[(now ^ data[ends[1:][has] - back]) & np.uint32(255)] ^ (now >> np.uint32(8))
    return (~crc % np.uint32(CLASSES)).astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    """The definition of a text's words; see `split` for many texts."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a column of texts: the distinct ones (binary), each token's place among them, and
    each token's text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    offsets = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    tokens, owner = coded.indices.to_numpy(), np.repeat(np.arange(len(lists)), np.diff(offsets))
    void = pc.index(coded.dictionary, "").as_py()  # beside leading and trailing white space
    if void >= 0:
        keep = tokens != void
        tokens, owner = tokens[keep], owner[keep]
    return coded.dictionary.cast(pa.binary()), tokens, owner


def by_time(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences of these lengths (longest first) laid out time by time: how many reach each time, and
    each symbol's place and time."""
    alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    time = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return alive, (np.cumsum(alive) - alive)[time] + np.repeat(np.arange(len(lengths)), lengths), time


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact probabilities by the scaled forward recursion over whole texts (none of them empty)."""
        out = np.zeros(len(texts))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            to = at + max(1, int(np.searchsorted(np.cumsum(lengths[order[at:]]), HELD, side="right")))
            own, at = order[at:to], to
            alive, place, _ = by_time(lengths[own])
            symbols = np.empty(len(place), np.int32)
            symbols[place] = np.concatenate([texts[i] for i in own])
            logs, now, e, edge, seen = np.zeros(len(own)), None, None, 0, 0
            alive = [*alive.tolist(), 0]
            for t, n in enumerate(alive[:-1]):
                if seen + n > edge:  # emissions of the next times
                    first, edge = seen, min(len(symbols), seen + max(n, 65_536))
                    e = np.take(self.emit, symbols[first:edge], 0)
                now = (self.start if now is None else np.dot(now[:n], self.move)) * e[seen - first : seen - first + n]
                seen += n
                if t % 8 == 7:
                    scale = now.sum(1)
                    logs[:n] += np.log10(scale)
                    now /= scale[:, None]
                if alive[t + 1] < n:
                    logs[alive[t + 1] : n] += np.log10(now[alive[t + 1] :].sum(1))
            out[own] = logs
        return out

    def expected(self, texts: list[np.ndarray], shares: np.ndarray | None = None, kind=np.float64, most: int = 1_000_000):
        """Baum-Welch counts of texts: of first states, moves, and emissions.

        Emissions are taken relative to shares (of the symbols), which changes no count and keeps
        numbers near 1, so a scale every fourth symbol is enough, in single precision too."""
        k, lengths = len(self.start), np.fromiter(map(len, texts), np.int64, len(texts))
        first, moves = np.zeros(k), np.zeros((k, k))
        emits = np.zeros((k, len(self.emit))) if k % 2 else np.zeros((k // 2, len(self.emit)), complex)  # two states in one number
        if not lengths.sum():
            return first, moves, np.zeros((len(self.emit), k))
        flat, end = np.concatenate(texts).astype(np.intp), np.cumsum(lengths)
        cuts = -(-lengths // STRETCH)
        owner = np.repeat(np.arange(len(texts)), cuts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        a = (end - lengths)[owner] + nth * STRETCH  # what is counted
        b = np.minimum(a + STRETCH, end[owner])
        lo, hi = a - np.where(nth > 0, HALO, 0), np.minimum(b + HALO, end[owner])
        order = np.argsort(lo - hi, kind="stable")
        lo, hi, a, b, nth = (x[order] for x in (lo, hi, a, b, nth))
        size = np.cumsum(hi - lo)
        most = max(most, int(hi[0] - lo[0]))
        ratio = np.ascontiguousarray((self.emit / (self.emit.mean(1) if shares is None else shares)[:, None]).astype(kind))
        move = self.move.astype(kind)
        usual = np.linalg.matrix_power(self.move, 4096).mean(0)
        tables, held = (ratio, move, np.ascontiguousarray(move.T)), min(most, int(size[-1]))
        room = np.empty(held, np.intp), np.empty((held, k), kind)
        at = 0
        while at < len(lo):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
            s = slice(at, to)
            begin = np.where(nth[s, None] == 0, self.start, usual).astype(kind)
            gamma, total = recursions(flat, lo[s], hi[s] - lo[s], (a - lo)[s], (b - lo)[s], begin, tables, room, emits)
            moves += total
            first += gamma[nth[s] == 0].sum(0, dtype=float)
            at = to
        return first, moves * self.move, np.ascontiguousarray(emits.T).view(float)

    def updated(self, first, moves, emits, shares: np.ndarray) -> Model:
        k, total, prior = len(first), moves.sum(1, keepdims=True), PRIOR + FLOOR * emits.sum(0)
        more = 1 + total * 1e-7
        return Model((first + 1) / (first.sum() + k), (moves + more) / (total + k * more), (emits + prior * shares[:, None]) / (emits.sum(0) + prior))


def recursions(flat, lo, lengths, since, until, begin, tables, room, emits) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward over the sequences of flat that begin at lo, longest first and laid out time by time:
    the state probabilities of their first symbols and the sums of alpha x weighted beta that the moves are counted
    from; every symbol's state probabilities are added to emits. Of each sequence, times from since to until count.

    Only symbols and alpha are kept for all times, and alpha gives way to the probabilities; emissions are looked up
    again on the way back, and all else is of a few times and stays in the processor's cache."""
    ratio, move, back = tables
    alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    ends, scales = np.cumsum(alive).tolist(), {}
    alive, ones = alive.tolist(), np.ones((ratio.shape[1], 1), ratio.dtype)
    n, most = ends[-1], alive[0]
    symbols, alpha = room[0][:n], room[1][:n]
    e, x, w = (np.empty((most, ratio.shape[1]), ratio.dtype) for _ in range(3))
    next_at = lo.astype(np.intp)
    for t, m in enumerate(alive):
        a, b = ends[t] - m, ends[t]
        after, at = alpha[a:b], next_at[:m]
        emitted = ratio.take(flat.take(at, 0, symbols[a:b], "clip"), 0, e[:m], "clip")
        at += 1
        if t:
            np.dot(now[:m], move, out=after)
            np.multiply(after, emitted, out=after)
            if t % 4 == 0:
                scales[t] = 1 / np.dot(after, ones)
                np.multiply(after, scales[t], out=after)
        else:
            np.multiply(emitted, begin, out=after)
        now = after
    cut = until[until < lengths]
    head, tail = int(since.max()), int(cut.min()) if len(cut) else len(alive)  # all times between count
    totals, later, added = np.zeros((len(alive), *move.shape), move.dtype), 0, n
    weighted = counts = None  # of the time after
    columns = (alpha.view(np.result_type(alpha.dtype, np.complex64)) if np.iscomplexobj(emits) else alpha).T
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        a, b = ends[t] - m, ends[t]
        beta, y = x[:m], alpha[a:b]
        if later < m:  # these end here; from here on alpha and beta have product 1
            np.divide(1, np.dot(y[later:], ones), out=beta[later:])
        if later:
            np.dot(weighted, back, out=beta[:later])
            if counts is not None:
                np.multiply(weighted, counts, out=weighted)
            np.dot(y[:later].T, weighted, out=totals[t])
        counts = None if head <= t < tail else ((since[:m] <= t) & (t < until[:m])).astype(ratio.dtype)[:, None]
        if t:
            emitted = ratio.take(symbols[a:b], 0, e[:m], "clip")
            weighted = np.multiply(emitted, beta, out=w[:m])
            if t in scales:
                np.multiply(weighted, scales[t], out=weighted)
        np.multiply(beta, y, out=y)
        if counts is not None:
            np.multiply(y, counts, out=y)
        if added - a >= 4096 or not t:
            for sums, column in zip(emits, columns, strict=True):
                np.add.at(sums, symbols[a:added], column[a:added].astype(sums.dtype))
            added = a
        later = m
    return alpha[:most], totals.sum(0, dtype=float)


def starting_model(texts: list[np.ndarray], shares: np.ndarray, states: int = STATES, rounds: int = ROUNDS, seed: int = 5) -> Model:
    """Noise on the corpus's distribution, then Baum-Welch over texts, if any are given."""
    rng = np.random.default_rng(seed)
    emit = shares[:, None] * rng.uniform(0.2, 1.8, (len(shares), states))
    move = np.full((states, states), 0.1 / states) + np.eye(states) * 0.9
    model = Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    for _ in range(rounds if texts else 0):
        model = model.updated(*model.expected(texts), shares)
    return model


def word_counts(rows: DataFrame) -> DataFrame:
    """word (binary), c of the column text; counted within tasks before the shuffle."""

    def run(batches):
        held, size = [], 0

        def added():
            total = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return pa.table({"word": total["word"], "n": total["n_sum"]})

        for batch in batches:
            texts = batch.column(0)
            for a, b in slices(texts):
                words, tokens, _ = split(texts[a:b])
                n = np.bincount(tokens, minlength=len(words))
                held.append(pa.table({"word": words, "n": pa.array(n)}).filter(pa.array(n > 0)))
                size += held[-1].num_rows
                if size > 600_000:
                    held = [added()]
                    size = held[0].num_rows
                    if size > 300_000:
                        yield from held[0].combine_chunks().to_batches()
                        held, size = [], 0
        if held:
            yield from added().combine_chunks().to_batches()

    return rows.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def frequent(counts: DataFrame, most: int = KNOWN) -> pa.Table:
    """word, c of the `most` words with the highest counts, highest first; ties by a hash of the word, then the word.

    The words are never sorted as a whole: a histogram of the counts (exact below 4096, then 256 bins an
    octave) gives the bin in which the last place falls; the counts of this bin and then a histogram
    of the hashes of the words with the last count narrow it down to what is taken in order."""
    c = F.col("c").cast("double")
    wide = F.when(c < 4096, c).otherwise(F.floor(F.log2(c) * 256) + 4096 - 12 * 256).cast("long")
    rows = counts.select("word", "c", wide.alias("bin"), F.xxhash64("word").alias("h"))
    rows, parts = rows.withColumn("cell", F.shiftrightunsigned("h", 52)), []
    for key, upwards in (("bin", False), ("c", False), ("cell", True)):
        last = None
        for r in sorted(rows.groupBy(key).agg(F.count("*").alias("n")).collect(), key=lambda r: r[key] if upwards else -r[key]):
            if r["n"] > most:
                last = r[key]
                break
            most -= r["n"]
        if last is None:
            parts, rows = [*parts, rows], None
            break
        parts.append(rows.filter(F.col(key) < last if upwards else F.col(key) > last))
        rows = rows.filter(F.col(key) == last)
    if rows is not None and most:
        parts.append(rows.orderBy("h", "word").limit(most))
    got = pa.concat_tables([p.select("word", "c", "h").toArrow() for p in parts])
    return got.sort_by([("c", "descending"), ("h", "ascending"), ("word", "ascending")]).select(["word", "c"])


@dataclass
class Vocabulary:
    """What every task knows of the KNOWN words: their symbols, logarithms of their probabilities in the base
    model and, for those without a symbol of their own, within their class."""

    words: pa.Array
    symbols: np.ndarray
    logs: np.ndarray
    within: np.ndarray
    own: int
    end_log: float
    end_known: int


def coded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The texts as symbols (unsigned 16-bit) with their end (0), the sums over their known words, and
    their other words: part and seq together are a row key."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
    names = ["doc_id", "held_out", "part", "seq", "n_tokens", "known", "logs", "within", "symbols", "rare"]

    def run(batches):
        from pyspark import TaskContext

        part, seq, v = TaskContext.get().partitionId(), 0, shared.value
        for held in bunches(batches, "text"):
            parts = [split(batch.column(2)) for batch in held]
            found = pc.fill_null(pc.index_in(pa.chunked_array([words for words, _, _ in parts], pa.binary()), value_set=v.words), -1).to_numpy()
            for batch, (words, tokens, owner), at in zip(held, parts, np.split(found, np.cumsum([len(words) for words, _, _ in parts])[:-1]), strict=True):
                n = len(batch)
                symbols = np.where(at >= 0, v.symbols[at], 0)
                rest = np.flatnonzero(symbols == 0)
                symbols[rest] = v.own + classes_of(words.take(pa.array(rest)))
                counts = np.bincount(owner, minlength=n)
                summed = lambda x: np.bincount(owner, weights=np.where(at >= 0, x, 0.0)[tokens], minlength=n)  # noqa: E731, B023
                stops = np.cumsum(counts + 1)
                flat = np.zeros(len(tokens) + n, "<u2")
                flat[np.arange(len(tokens)) + owner] = symbols[tokens]
                offsets = pa.py_buffer(np.append(0, 2 * stops).astype(np.int32))
                strange = (at < 0)[tokens]
                pairs, times = np.unique(owner[strange] * len(words) + tokens[strange], return_counts=True)
                of, word = np.divmod(pairs, max(1, len(words)))
                entries = pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array((symbols[word] - v.own).astype(np.int32)), pa.array(times)], ["word", "class", "n"])
                rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=n))).astype(np.int32)), entries)
                cols = [
                    batch.column(0), batch.column(1), np.full(n, part), np.arange(seq, seq + n), counts + 1,
                    summed(np.ones(len(at))).astype(np.int64) + v.end_known, summed(v.logs[at]) + v.end_log, summed(v.within[at]),
                    pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(flat)]),
                ]
                seq += n
                yield pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), rare], names=names)

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, part int, seq long, n_tokens long, known long, logs double, within double, symbols binary, rare array<struct<word binary, class int, n long>>")


def bunches(batches, name: str, most: int = 16_000_000):
    """Lists of batches of about 2 MB of texts each, at most `most` bytes together; a longer text is a list of its
    own. What is set up for a lookup, such as a hash table of all known words, is set up once for a list."""
    held, size = [], 0
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        for a, b in slices(column):
            n = pc.sum(pc.binary_length(column[a:b])).as_py() or 0
            if held and size + n > most:
                yield held
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += n + 16 * (b - a)
    if held:
        yield held


def sequences(batch: pa.RecordBatch, name: str = "symbols") -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def groups(batches, most: int = HELD):
    """Batches cut into rows of at most `most` symbols together; a longer text is a group of its own."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("symbols"))
        for a, b in slices(column, 2 * most):
            yield batch.slice(a, b - a)


def train(texts: DataFrame, shares: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch from noise on the corpus's distribution, over all rows of texts (symbols) whole. Each round is
    one pass: partitions emit their expected counts by symbol, Spark adds them up, and the driver gets a
    row per symbol."""
    spark, k = texts.sparkSession, states
    model = starting_model([], shares, states)
    names = [f"s{i}" for i in range(k)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            now = shared.value
            total = [np.zeros_like(now.start), np.zeros_like(now.move), np.zeros_like(now.emit)]
            for batch in groups(batches):
                for x, y in zip(total, now.expected(sequences(batch), shares, np.float32), strict=True):
                    x += y
            rows = np.vstack([total[2], total[1], total[0][None, :]])
            used = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(rows[used, i]) for i in range(k))], names=["row", *names])

        added = texts.select("symbols").mapInArrow(run, "row long, " + ", ".join(f"{n} double" for n in names)).groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        rows = np.zeros((len(shares) + k + 1, k))
        rows[added["row"].to_numpy()] = np.stack([added[n].to_numpy() for n in names], 1)
        shared.unpersist()
        model = model.updated(rows[-1], rows[len(shares) : -1], rows[: len(shares)], shares)
    return model


def score(docs: DataFrame, part: int = 1, parts: int = 5, states: int = STATES, rounds: int = ROUNDS, most_known: int = KNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Held out are the rows whose crc32(doc_id as text) mod parts is part (never those with a null
    id); the others train. A null text counts as empty and still has its end; repeated rows train
    and score as often as they occur; without training rows every token has probability 1 in the
    base; very long texts are scored by one recursion over all their words; other columns are
    ignored; an empty table gives no rows. Scores of equal texts are equal up to rounding.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id"), part, parts))
    n_train = rows.select("held_out").filter("not held_out").count()
    counts = materialize(word_counts(rows.filter("not held_out")), "counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, kinds = (sums["n"] or 0) + n_train, sums["v"] + (n_train > 0)
    top = frequent(counts, most_known)
    words, c = top["word"].combine_chunks(), top["c"].to_numpy().astype(float)
    own = min(WORDS, len(words))
    base = total + 0.5 * (kinds + 1)
    spellings = docs.sparkSession.sparkContext.broadcast(pa.concat_arrays([words[:own]]))

    def rest(batches):
        for batch in batches:
            names, n = batch.column(0), batch.column(1).to_numpy()
            keep = ~pc.is_in(names, value_set=spellings.value).to_numpy(zero_copy_only=False)
            of = classes_of(names).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(of[keep]), pa.array(n[keep])], names=["class", "c"])

    classes = counts.mapInArrow(rest, "class int, c long").groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    in_class, mass = np.zeros(CLASSES), np.full(CLASSES, 0.5)
    for r in classes:
        in_class[r["class"]] = r["c"]
        mass[r["class"]] += r["c"] + 0.5 * r["v"]
    shares = np.concatenate([[n_train], c[:own], in_class]) + 0.5
    shares /= shares.sum()
    ranks = np.arange(len(words))
    of = classes_of(words[own:])
    within = np.concatenate([np.zeros(own), np.log10((c[own:] + 0.5) / mass[of])])
    symbols = np.where(ranks < own, ranks + 1, 0)
    # the entry at -1 stands for words that are not known
    vocabulary = Vocabulary(words, np.append(symbols, 0), np.append(np.log10((c + 0.5) / base), 0.0), np.append(within, 0.0), own + 1, float(np.log10((n_train + 0.5) / base)), int(n_train > 0))
    table = materialize(coded(rows, vocabulary), "coded")
    model = train(table.filter("not held_out").select("symbols"), shares, states, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "part", "seq", "n_tokens", "known", "logs", "within"]

    def run(batches):
        for b in groups(batches):
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(shared.value.log10(sequences(b)))], names=[*names, "path"])

    main = table.select(*names, "symbols").mapInArrow(run, "doc_id long, held_out boolean, part int, seq long, n_tokens long, known long, logs double, within double, path double")
    rare = table.select("part", "seq", F.explode("rare").alias("r")).select("part", "seq", F.col("r.word").alias("w"), F.col("r.class").alias("class"), F.col("r.n").alias("n"))
    few = counts.filter(F.col("c") <= F.lit(int(c[-1]) if len(c) else 0))  # no other word is without a count by now
    rare = rare.join(few, rare["w"] == few["word"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    z = F.element_at(F.array(*[F.lit(float(x)) for x in mass]), F.col("class") + 1)
    rare = rare.groupBy("part", "seq").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(base))).alias("rare_logs"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / z)).alias("rare_path"),
    )
    none = lambda n: F.coalesce(F.col(n), F.lit(0))
    return main.join(rare, ["part", "seq"], "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + none("rare_known")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + none("rare_logs")).alias("base_score"),
        (F.col("path") + F.col("within") + none("rare_path")).alias("score"),
    )
