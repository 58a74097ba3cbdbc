"""Long passages that repeat within or across run logs, found by recompression.

Recompression renames a word sequence in rounds: a round replaces each run of equal
symbols and then each pair of a left-hand and a right-hand symbol by one symbol. A name is
a hash of what it stands for, so it is the same in all logs without a dictionary. Equal
stretches of words get equal symbols except near their ends, and which symbols are safe
from the ends can be told from the stretch alone. Each window of words is therefore
represented by its longest safe symbol, and windows can only be equal if their symbols are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popstat.session import cut_lineage

U = np.uint64
ROUNDS = 4
#: Words worked on at a time, and rows after which equal keys are gathered and sent off: both bound a worker's memory.
CHUNK, FLUSH = 200_000, 500_000
# Odd constants, so that multiplication modulo 2**64 can be undone
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
INVERSES = tuple(U(pow(int(b), -1, 1 << 64)) for b in BASES)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters all bits."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class Passages:
    """Hashes of any word stretch of a sequence, by differences of one running sum per base."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self.sums, self.undo = [], []
        for i, (base, inverse) in enumerate(zip(BASES, INVERSES, strict=True)):
            power = np.cumprod(np.concatenate((np.ones(1, U), np.full(n, base))), dtype=U)
            undo = np.cumprod(np.concatenate((np.ones(1, U), np.full(n, inverse))), dtype=U)
            terms = _mix(words + U(i)) * power[:n]
            self.sums.append(np.concatenate((np.zeros(1, U), np.cumsum(terms, dtype=U))))
            self.undo.append(undo)

    def of(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        return _mix((self.sums[which][end] - self.sums[which][start]) * self.undo[which][start])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))


def _names(symbols: np.ndarray, first: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Names of groups of one or two symbols, or of runs; a group of one keeps its name."""
    one = symbols[first]
    last = symbols[first + size - 1]
    made = _mix(_mix(one + U(seed)) + _mix(last ^ U(seed << 7)) * U(3) + size.astype(U))
    return np.where(size == 1, one, made)


def representatives(words: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Name and first word of the symbol that stands for each window of words.

    ``starts`` are the first words of the windows. The choice depends only on the words of
    the window: the longest symbol of the last round that has a safe symbol, of equal ones
    the one with the smallest name, of equal names the leftmost.
    """
    symbols, at, size = words, np.arange(len(words)), np.ones(len(words), np.int64)
    left, right = starts.copy(), starts + window - 1  # first and last safe symbol of each window
    name, place = np.zeros(len(starts), U), np.full(len(starts), -1)
    open_ = np.arange(len(starts))
    levels = [(symbols, at, size, left, right)]
    for k in range(1, ROUNDS + 1):
        # Runs: the run at either end may go on outside the window
        new = np.concatenate(([True], symbols[1:] != symbols[:-1]))
        symbols, at, size, left, right = _merge(symbols, at, size, new, left, right, 2 * k)
        left, right = left + 1, right - 1
        # Pairs of a left-hand symbol and a right-hand one: at the ends only the other kind is safe
        hand = (_mix(symbols + U(k)) >> U(40)) & U(1)
        lost = len(symbols) - 1
        safe = left <= right
        left = left + (safe & (hand[np.clip(left, 0, lost)] == 1))
        right = right - (safe & (hand[np.clip(right, 0, lost)] == 0))
        new = np.ones(len(symbols), bool)
        new[1:] = ~((hand[:-1] == 0) & (hand[1:] == 1))
        symbols, at, size, left, right = _merge(symbols, at, size, new, left, right, 2 * k + 1)
        levels.append((symbols, at, size, left, right))
    for symbols, at, size, left, right in reversed(levels):
        have = left[open_] <= right[open_]
        some = open_[have]
        if len(some):
            best = _best(symbols, size, left[some], right[some])
            name[some], place[some] = symbols[best], at[best]
        open_ = open_[~have]
        if not len(open_):
            break
    return name, place


def _merge(symbols, at, size, new, left, right, seed):
    """Symbols after groups that begin where ``new`` is true become one; windows keep to whole groups."""
    first = np.flatnonzero(new)
    members = np.diff(np.append(first, len(symbols)))
    group = np.cumsum(new) - 1
    lost = len(symbols) - 1
    safe = left <= right
    low, high = group[np.clip(left, 0, lost)], group[np.clip(right, 0, lost)]
    ends = np.append(at[first][1:], at[-1] + size[-1])
    return (
        _names(symbols, first, members, seed), at[first], ends - at[first],
        np.where(safe, low, 1), np.where(safe, high, 0),
    )


def _best(symbols: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The best symbol of each range: longest, then smallest name, then leftmost."""
    score = (np.minimum(size, 255).astype(U) << U(56)) | (~symbols >> U(8))
    table = [np.arange(len(symbols))]
    longest = int((right - left).max()) + 1
    while (1 << len(table)) <= longest:
        step, last = 1 << (len(table) - 1), table[-1]
        a, b = last[: len(last) - step], last[step:]
        table.append(np.where(score[a] >= score[b], a, b))
    level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    out = np.empty(len(left), np.int64)
    for j in np.unique(level):
        own = level == j
        a, b = table[j][left[own]], table[j][right[own] - (1 << int(j)) + 1]
        out[own] = np.where(score[a] >= score[b], a, b)
    return out


def blocks(words: np.ndarray, ends: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Runs of windows with the same symbol in logs laid end to end; ``ends`` are where logs end.

    ``log`` numbers the logs, ``start`` is the first window's first word within its log,
    ``windows`` how many windows follow; ``symbol`` and ``content`` name the symbol and the
    words of all windows of the block together with the symbol's place in them.
    """
    begins = np.concatenate(([0], ends[:-1]))
    counts = np.maximum(ends - begins - window + 1, 0)
    log = np.repeat(np.arange(len(ends)), counts)
    base = np.cumsum(counts) - counts
    starts = np.arange(len(log)) - base[log] + begins[log]
    if not len(starts):
        return {k: np.zeros(0, np.int64) for k in ("log", "start", "windows", "symbol", "content")}
    # Symbols may reach over the end of a log, but no window takes one of those for safe
    name, place = representatives(words, starts, window)
    # Symbols of different rounds may begin at the same word
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (name[1:] != name[:-1]) | (log[1:] != log[:-1])))
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(starts)))
    low = starts[first]
    high = low + many - 1 + window
    content = Passages(words).of(low, high, 0) + _mix((place[first] - low).astype(U))
    return {
        "log": log[first], "start": low - begins[log[first]], "windows": many,
        "symbol": name[first].view(np.int64), "content": content.view(np.int64),
    }


def _chunks(ids: list, texts: list[bytes | None]) -> Iterator[tuple[list, list[list[bytes]]]]:
    rows, chunk, held = [], [], 0
    for row, text in zip(ids, texts, strict=True):
        words = (text or b"").split()
        rows.append(row)
        chunk.append(words)
        held += len(words)
        if held >= CHUNK:
            yield rows, chunk
            rows, chunk, held = [], [], 0
    if rows:
        yield rows, chunk


def _laid_out(chunk: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    hashes = word_hashes([w for words in chunk for w in words])
    return hashes, np.cumsum([len(words) for words in chunk])


PLACES = "array<struct<row:long,start:int>>"
BLOCKS = f"symbol long, content long, windows int, places {PLACES}"
WINDOWS = f"k0 long, k1 long, places {PLACES}"
_PLACES = pa.list_(pa.struct([("row", pa.int64()), ("start", pa.int32())]))


def _gathered(keys: list[np.ndarray], rows: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], pa.ListArray]:
    """Each distinct key once, with the places where it occurs."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))
    first = np.flatnonzero(new)
    offsets = np.append(first, len(order)).astype(np.int32)
    places = pa.StructArray.from_arrays(
        [pa.array(rows[order], pa.int64()), pa.array(starts[order].astype(np.int32))], names=["row", "start"]
    )
    return [k[first] for k in keys], pa.ListArray.from_arrays(pa.array(offsets), places, type=_PLACES)


def _emit_blocks(window: int):
    def gathered(found: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        made = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
        keys, places = _gathered([made["symbol"], made["content"], made["windows"]], made["row"], made["start"])
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[0]), pa.array(keys[1]), pa.array(keys[2].astype(np.int32)), places],
            names=["symbol", "content", "windows", "places"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for rows, chunk in _chunks(batch.column("row").to_pylist(), _encoded(batch.column("_log"))):
                hashes, ends = _laid_out(chunk)
                made = blocks(hashes, ends, window)
                made["row"] = np.asarray(rows, np.int64)[made.pop("log")]
                found.append(made)
                held += len(made["row"])
                if held >= FLUSH:
                    yield gathered(found)
                    found, held = [], 0
            if held:
                yield gathered(found)

    return run


def _encoded(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _spans_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of spans of each row (none if NULL), and the starts and lengths of all."""
    counts = np.diff(column.offsets.to_numpy())
    spans = column.flatten()
    return counts, *(spans.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "windows"))


def _emit_windows(window: int):
    """128-bit names of the windows of the given blocks of each log."""

    def gathered(made: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        k0, k1, rows, start = (np.concatenate(x) for x in zip(*made, strict=True))
        keys, places = _gathered([k0, k1], rows, start)
        return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), places], names=["k0", "k1", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy()
            counts, starts, windows = _spans_of(batch.column("wanted"))
            span = np.concatenate(([0], np.cumsum(counts)))
            made, held = [], 0
            for logs, chunk in _chunks(list(range(len(row))), _encoded(batch.column("_log"))):
                hashes, ends = _laid_out(chunk)
                begins = np.concatenate(([0], ends[:-1]))
                own = slice(span[logs[0]], span[logs[-1] + 1])
                many = windows[own]
                log = np.repeat(np.repeat(np.arange(len(logs)), counts[logs]), many)
                start = np.repeat(starts[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                at, hashed = start + begins[log], Passages(hashes)
                names = [hashed.of(at, at + window, which).view(np.int64) for which in (0, 1)]
                made.append((*names, row[logs][log], start.astype(np.int32)))
                held += len(start)
                if held >= FLUSH:
                    yield gathered(made)
                    made, held = [], 0
            if held:
                yield gathered(made)

    return run


def _emit_kept(window: int):
    """The words of each log outside its repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, starts, windows = _spans_of(batch.column("found"))
            span = np.concatenate(([0], np.cumsum(counts)))
            n_words, n_removed, kept = [], [], []
            for i, text in enumerate(_encoded(batch.column("_log"))):
                words = (text or b"").split()
                n = len(words)
                if counts[i]:
                    own = slice(span[i], span[i + 1])
                    if (starts[own] + windows[own]).max() + window - 1 > n:
                        raise ValueError("the logs were not the same in every scan")
                    edges = np.bincount(starts[own], minlength=n + 1)
                    edges -= np.bincount(starts[own] + windows[own] - 1 + window, minlength=n + 1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(edges[:n]) == 0)]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_run"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                names=["_run", "n_words", "n_removed", "kept"],
            )

    return run


def _spans(found: DataFrame) -> DataFrame:
    """``row`` with the list of its stretches of windows."""
    return found.groupBy("row").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))


def _repeated_windows(texts: DataFrame, window: int) -> DataFrame:
    """``row``, ``start``, ``windows``: stretches of windows that occur more than once."""
    named = texts.mapInArrow(_emit_blocks(window), BLOCKS)
    here = F.size("places")
    per_symbol = Window.partitionBy("symbol")
    per_block = Window.partitionBy("symbol", "content", "windows")
    shared = named.repartition("symbol").select(
        "*", F.sum(here).over(per_symbol).alias("by_symbol"), F.sum(here).over(per_block).alias("by_block"),
        F.row_number().over(per_block.orderBy(F.element_at("places", 1))).alias("order"),
    ).where("by_symbol > 1")
    # Of equal blocks all windows repeat, and one of them stands for the others against partial matches
    places = shared.select(
        "windows", F.col("by_block") > 1, F.col("order") == 1, F.posexplode("places").alias("i", "place")
    ).toDF("windows", "repeated", "first", "i", "place")
    found = cut_lineage(places.select(
        "place.row", "place.start", "windows", "repeated",
        (~F.col("repeated") | (F.col("first") & (F.col("i") == 0))).alias("wanted"),
    ))
    wanted = _spans(found.where("wanted")).withColumnRenamed("spans", "wanted")
    met = texts.join(wanted, "row").mapInArrow(_emit_windows(window), WINDOWS)
    per_window = Window.partitionBy("k0", "k1")
    again = met.withColumn("n", F.sum(F.size("places")).over(per_window)).where("n > 1")
    single = again.select(F.explode("places").alias("place")).select("place.row", "place.start", F.lit(1).alias("windows"))
    return found.where("repeated").select("row", "start", "windows").unionByName(single)


def remove_repeated_passages(
    logs: DataFrame, window: int = 35, run_id: str = "run_id", log: str = "log"
) -> DataFrame:
    """Logs without the words of passages that occur more than once in the table.

    ``logs`` has one row per run: ``run_id`` and the whole text ``log``. Words are what
    ASCII white space divides, unchanged. A word goes if a window of ``window`` consecutive
    words of its log covers it whose words also start anywhere else, in the same log
    included; windows are judged on the input, so both copies go. Result, one row per input
    row: ``run_id``, ``n_words``, ``n_removed`` and ``kept``, the other words joined by one
    space. A NULL log has no words; logs shorter than the window stay whole; repeated rows
    are copies like any other; a NULL run_id stays NULL; other columns are ignored.

    Windows with the same representative symbol form blocks. Blocks that are equal as a
    whole are settled by one key; only blocks that share their symbol with others but not
    all their words are compared window by window, by 128-bit names, with one of each class
    of equal blocks. Tasks gather equal keys before the shuffle, so a passage that a
    third of all logs hold is a few rows there. Rows are numbered by partition and read three
    times, always with the same columns; ``logs`` must come the same each time, as a table does.
    """
    texts = logs.select(
        F.monotonically_increasing_id().alias("row"), F.col(run_id).alias("_run"), F.col(log).cast("string").alias("_log")
    )
    spans = _spans(_repeated_windows(texts, window)).withColumnRenamed("spans", "found")
    field = texts.schema["_run"].dataType
    whole = texts.join(spans, "row", "left")
    schema = f"_run {field.simpleString()}, n_words long, n_removed long, kept string"
    return whole.mapInArrow(_emit_kept(window), schema).withColumnRenamed("_run", run_id)

