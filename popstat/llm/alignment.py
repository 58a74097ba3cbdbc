"""Tokens of two vocabularies over the same run logs, grouped where both end, and how often their ids meet."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popstat.llm.encoding import ByteEncoder, PieceEncoder, UnitEncoder, bytes_of, of_worker, slices
from popstat.session import cut_lineage

#: An id pair is frequent if it is in this share of all links, so at most as many are.
HOT = 1 << 20
#: Links of a task that are counted before they are passed on.
FLUSH = 1 << 20


class _Bytes:
    """The bytes of a vocabulary's ids, and their digits in decimal with room for a separator."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.width = np.array([len(t) for t in tokens], np.int32)
        self.start = (np.cumsum(self.width) - self.width).astype(np.int32)
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        digits = [str(i) for i in range(len(tokens))]
        self.columns = max(map(len, digits)) + 1
        self.digits = np.frombuffer("".join(d.rjust(self.columns - 1) + " " for d in digits).encode(), np.uint8).reshape(-1, self.columns)
        self.shown = self.digits != 32
        self.shown[:, -1] = True

    def spell(self, ids: np.ndarray) -> np.ndarray:
        width = self.width[ids]
        ends = np.cumsum(width)
        place = np.repeat(self.start[ids] - (ends - width), width)
        return self.pool[place + np.arange(len(place))]


def group_numbers(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two rows of tokens that cover the same bytes, given where each token ends.

    Gives the group of each A token, of each B token, and the A and B token of each link
    in order. Every token points to its farthest-right overlapping token, itself if none
    ends later (of an A and a B token with one end, to the latter); pointers are doubled
    until they stand still, at the terminal token of each component.
    """
    if not len(ends_a):
        return (np.zeros(0, np.int64),) * 4
    marks = np.zeros((2, int(ends_a[-1]) + 1), bool)
    marks[0, ends_a], marks[1, ends_b] = True, True
    at = np.flatnonzero(marks[0] | marks[1])  # each stretch between two ends is one link
    is_a, is_b = marks[0, at], marks[1, at]
    a, b = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b
    n_a, n = len(ends_a), len(ends_a) + len(ends_b)
    target = np.empty(n, np.int32)
    target[:n_a] = n_a + b[is_a]
    target[n_a:] = np.where(is_a, n_a + b, a)[is_b]
    while True:
        further = target[target]
        if np.array_equal(further, target):
            break
        target = further
    number = np.cumsum(target == np.arange(n)) - 1
    return number[target[:n_a]], number[target[n_a:]], a, b


class _Aligner:
    def __init__(self, bytes_model: str, piece_model: str) -> None:
        self.a: UnitEncoder = of_worker(ByteEncoder, bytes_model, True)
        self.b: UnitEncoder = of_worker(PieceEncoder, piece_model)
        self.of_a, self.of_b = _Bytes(self.a.tokens()), _Bytes(self.b.tokens())
        self.code = np.uint64(len(self.of_b.width))

    def rows(self, texts: pa.Array, digest_only: bool) -> Iterator[tuple]:
        """n_a, n_b, n_groups, pair codes and groups of each text of a slice."""
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
        data, offsets = bytes_of(spaced)
        (ids_a, n_a), (ids_b, n_b) = self.a.flat(spaced), self.b.flat(spaced)
        fits = self._fits(data, offsets, self.of_a, ids_a, n_a) & self._fits(data, offsets, self.of_b, ids_b, n_b)
        fits &= np.diff(offsets) > 1
        ids_a, ids_b = ids_a[np.repeat(fits, n_a)], ids_b[np.repeat(fits, n_b)]
        n_a, n_b = np.where(fits, n_a, 0), np.where(fits, n_b, 0)
        ends_a, ends_b = (np.cumsum(v.width[i], dtype=np.int64) for v, i in ((self.of_a, ids_a), (self.of_b, ids_b)))
        group_a, group_b, a, b = group_numbers(ends_a, ends_b)
        codes = ids_a[a].astype(np.uint64) * self.code + ids_b[b]
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        text_of_b = np.repeat(np.arange(len(n_b)), n_b)
        edge = np.append(group_b[1:] != group_b[:-1], True) if len(group_b) else np.zeros(0, bool)
        n_groups = np.bincount(text_of_b[edge], minlength=len(n_b))
        links = n_a + n_b - n_groups
        last_link = np.cumsum(links)
        text, sizes = self._written(ids_a, ids_b, group_a, group_b, last_a, last_b)
        last = np.cumsum(sizes)
        raw = memoryview(text)
        for k in range(len(n_a)):
            own = raw[last[k] - sizes[k] : max(last[k] - 1, 0)] if sizes[k] else b""
            shown = (hashlib.sha256(own).hexdigest() if digest_only else bytes(own).decode()) if sizes[k] else ""
            yield int(n_a[k]), int(n_b[k]), int(n_groups[k]), codes[last_link[k] - links[k] : last_link[k]], shown

    @staticmethod
    def _fits(data: np.ndarray, offsets: np.ndarray, of: _Bytes, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Texts that their tokens spell byte by byte."""
        total = np.concatenate(([0], np.cumsum(of.width[ids], dtype=np.int64)))
        last = np.cumsum(counts)
        fits = total[last] - total[last - counts] == np.diff(offsets)
        if fits.all():
            other = np.concatenate(([0], np.cumsum(of.spell(ids) != data)))
            return other[offsets[1:]] == other[offsets[:-1]]
        for k in np.flatnonzero(fits).tolist():
            own = of.spell(ids[last[k] - counts[k] : last[k]])
            fits[k] = np.array_equal(own, data[offsets[k] : offsets[k + 1]])
        return fits

    def _written(self, ids_a, ids_b, group_a, group_b, last_a, last_b) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;`` for all groups in order as bytes, and how many bytes each text has."""
        n = int(group_b[-1]) + 1 if len(group_b) else 0
        ahead_a, ahead_b = (np.concatenate(([0], np.cumsum(np.bincount(g, minlength=n)))) for g in (group_a, group_b))
        at_a, at_b = np.arange(len(ids_a)) + ahead_b[group_a], np.arange(len(ids_b)) + ahead_a[group_b + 1]
        width = max(self.of_a.columns, self.of_b.columns)
        board, shown = np.zeros((len(at_a) + len(at_b), width), np.uint8), np.zeros((len(at_a) + len(at_b), width), bool)
        for of, ids, at, ahead, mark in ((self.of_a, ids_a, at_a, ahead_a, b"|"), (self.of_b, ids_b, at_b, ahead_b, b";")):
            board[at, width - of.columns :], shown[at, width - of.columns :] = of.digits[ids], of.shown[ids]
            board[at, -1] = ord(",")
            if n:
                board[at[ahead[1:] - 1], -1] = mark[0]
        sizes = np.concatenate(([0], np.cumsum(shown.sum(axis=1, dtype=np.int64))))
        last = last_a + last_b
        return board[shown], sizes[last] - sizes[np.concatenate(([0], last[:-1]))]


_aligners: dict[tuple, _Aligner] = {}


def _aligned(bytes_model: str, piece_model: str, digest_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (bytes_model, piece_model)
        own = _aligners[key] if key in _aligners else _aligners.setdefault(key, _Aligner(*key))
        for batch in batches:
            at = 0
            for texts in slices(batch.column("_log")):
                n_a, n_b, n_groups, codes, groups = zip(*own.rows(texts, digest_only), strict=True)
                numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, [len(c) for c in codes])]
                links = pa.array([_packed(c) for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row").slice(at, len(texts)), batch.column("_run").slice(at, len(texts)), *numbers, links, pa.array(groups)],
                    names=["_row", "_run", "n_a", "n_b", "n_groups", "n_links", "_links", "groups"],
                )
                at += len(texts)

    return run


def _packed(codes: np.ndarray) -> bytes:
    """Codes as little-endian numbers, the lower halves first: those repeat more."""
    wide = int(codes.max(initial=0)) >> 32 != 0
    return b"\1" + codes.astype("<u8").tobytes() if wide else b"\0" + codes.astype("<u4").tobytes()


def _unpacked(raw: memoryview) -> np.ndarray:
    return np.frombuffer(raw, "<u8" if raw[0] else "<u4", offset=1).astype(np.int64)


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how often each occurs."""
    codes.sort()
    edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[edge], np.diff(np.append(edge, len(codes)))


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        codes, n = _runs(np.concatenate(held) if held else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    for batch in batches:
        for links in batch.column(0):
            held.append(_unpacked(memoryview(links.as_buffer())))
            size += len(held[-1])
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
    yield flush()


def _frequencies(hot):
    """Rows of one log: its sums over frequent pairs under a key of its own, and its other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = hot.value
        for batch in batches:
            rows, keys, ns, sums, bests = [], [], [], [], []
            for row, links in zip(batch.column("_row").to_pylist(), batch.column("_links"), strict=True):
                own = _unpacked(memoryview(links.as_buffer()))
                at = np.minimum(np.searchsorted(codes, own), max(len(codes) - 1, 0))
                known = codes[at] == own if len(codes) else np.zeros(len(own), bool)
                rare, n = _runs(own[~known])
                rows.append(np.full(len(rare) + 1, row))
                keys.append(np.append(rare, -1 - row))
                ns.append(np.append(n, 0))
                sums.append(np.append(np.zeros(len(rare), np.int64), counts[at[known]].sum()))
                bests.append(np.append(np.zeros(len(rare), np.int64), best[at[known]].sum()))
            if rows:
                arrays = [pa.array(np.concatenate(x).astype(np.int64)) for x in (rows, keys, ns, sums, bests)]
                yield pa.RecordBatch.from_arrays(arrays, names=["_row", "pair", "n", "known_sum", "known_best"])

    return run


def align_log_tokens(
    logs: DataFrame, bytes_model: str, piece_model: str, run_id: str = "run_id", log: str = "log", digest_only: bool = False
) -> DataFrame:
    """Groups of tokens of two vocabularies over the captured output of each run, and how usual their links are.

    ``logs`` has one row per run: ``run_id`` and the whole text ``log``. ``bytes_model`` is
    a byte-level BPE file of the tokenizers library (A), given the text behind a space,
    ``piece_model`` a sentencepiece BPE model (B), which adds that space; both paths are
    on every machine. Special tokens are not added, their strings are plain text. Tokens
    are grouped between the byte offsets where tokens of both end. A and B token that share
    a byte are a link; the count of an id pair is how many links of all logs have it.

    The result has one row per input row, also for repeated rows and ids and a NULL id:
    ``run_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose count is
    the highest of all pairs with their B id), ``count_sum`` (of the counts of all links)
    and ``groups``, as in ``a1,a2|b1;a3|b2,b3``; with ``digest_only`` the SHA-256 of that.
    A log that is NULL or empty, or whose tokens do not spell it byte by byte behind the
    space, has no tokens: zeros and '' in both cases. Other columns are ignored.

    Logs are encoded once; their links are written to the shared folder. Pairs in at
    least 1/HOT of all links, at most HOT of them, are sent to the workers and summed where
    the links are read; the others meet their counts by a shuffle, in which none is hot.
    """
    texts = logs.select(F.monotonically_increasing_id().alias("_row"), F.col(run_id).alias("_run"), F.col(log).cast("string").alias("_log"))
    kind = texts.schema["_run"].dataType.simpleString()
    schema = f"_row long, _run {kind}, n_a long, n_b long, n_groups long, n_links long, _links binary, groups string"
    aligned = cut_lineage(texts.mapInArrow(_aligned(bytes_model, piece_model, digest_only), schema), compression="zstd")
    n_b = of_worker(PieceEncoder, piece_model).library.vocab_size()
    counted = aligned.select("_links").mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    counted = cut_lineage(counted.withColumn("b", F.col("pair") % n_b))
    top = counted.groupBy("b").agg(F.max("count").alias("top"))
    judged = cut_lineage(counted.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).cast("long").alias("best")))
    total = judged.agg(F.sum("count")).first()[0] or 0
    found = judged.where(F.col("count") * F.lit(HOT) >= F.lit(total)).orderBy("pair").toArrow()
    hot = logs.sparkSession.sparkContext.broadcast(tuple(found[c].to_numpy() for c in ("pair", "count", "best")))
    schema = "_row long, pair long, n long, known_sum long, known_best long"
    kept = aligned.select("_row", "_links").mapInArrow(_frequencies(hot), schema)
    sums = kept.join(judged, "pair", "left").groupBy("_row").agg(
        F.sum(F.col("known_sum") + F.coalesce(F.col("n") * F.col("count"), F.lit(0))).cast("long").alias("count_sum"),
        F.sum(F.col("known_best") + F.coalesce(F.col("n") * F.col("best"), F.lit(0))).cast("long").alias("n_best"),
    )
    named = aligned.join(sums, "_row").withColumnRenamed("_run", run_id)
    return named.select(run_id, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
