"""Token counts of run logs without tokenizing any log.

A piece vocabulary whose pieces never span a word end lets a log be cut into pre-tokens
that are encoded on their own. Each distinct pre-token is encoded once for the whole
table; a log's count is the sum over its pre-token frequencies.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popstat.session import cut_lineage

SPACE = "▁"
PRE_TOKEN = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: A pre-token is frequent if it makes up this share of all, so at most as many are; each is at most HOT_CHARS long.
HOT = 1 << 20
HOT_CHARS = 32
FLUSH = 200_000

_encoders: dict[str, object] = {}


def _encoder(model: str):
    """The sentencepiece model of this worker."""
    if model not in _encoders:
        import sentencepiece

        _encoders[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _encoders[model]


def check_model(model: str) -> None:
    """Raise ValueError unless pieces end where pre-tokens do, which makes counting by pre-token exact."""
    encoder = _encoder(model)
    for i in range(encoder.vocab_size()):
        piece = encoder.id_to_piece(i)
        if SPACE in piece.lstrip(SPACE) or "\n" in piece:
            raise ValueError(f"a piece spans words: {piece!r}")
    if "".join(encoder.encode(" a  b ", out_type=str)) != f"{SPACE * 2}a{SPACE * 2}b{SPACE}":
        raise ValueError("the model drops or rewrites white space")


def pre_tokens(text: str) -> list[str]:
    """The text with its added leading space, cut before each run of spaces and around line ends."""
    return PRE_TOKEN.findall((SPACE + text).replace(" ", SPACE)) if text else []


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"piece_key": list(seen), "n": list(seen.values())}, VOCABULARY)
        seen.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            seen.update(pre_tokens(text.as_py() or ""))
            if len(seen) >= FLUSH:
                yield flush()
    yield flush()


VOCABULARY = pa.schema([("piece_key", pa.string()), ("n", pa.int64())])


def _with_pieces(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        start = len(encoder.encode("\n"))
        for batch in batches:
            # A line end is a piece of its own, so what follows it is encoded as inside a text
            ids = encoder.encode(["\n" + k for k in batch.column("piece_key").to_pylist()], num_threads=1)
            pieces = pa.array([len(x) - start for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], names=["piece_key", "n", "n_pieces"])

    return run


def _frequencies(hot):
    """Rows of one log: its frequent part summed under a key of its own, and its other pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = hot.value
        for batch in batches:
            kind = batch.schema.field("_run").type
            rows, runs, sizes, keys, counts = [], [], [], [], []
            ids = zip(batch.column("_row").to_pylist(), batch.column("_run").to_pylist(), batch.column("_log"), strict=True)
            for row, run_id, text in ids:
                text, known = text.as_py() or "", 0
                rare = []
                for key, n in Counter(pre_tokens(text)).items():
                    if key in pieces:
                        known += n * pieces[key]
                    else:
                        rare.append((key, n))
                rare.append((f"\n{row}", known))  # no pre-token looks like this
                rows += [row] * len(rare)
                runs += [None] * (len(rare) - 1) + [run_id]
                sizes += [None] * (len(rare) - 1) + [len(text.encode())]
                keys += [k for k, _ in rare]
                counts += [n for _, n in rare]
                if len(rows) >= FLUSH:
                    yield _batch(kind, rows, runs, sizes, keys, counts)
                    rows, runs, sizes, keys, counts = [], [], [], [], []
            yield _batch(kind, rows, runs, sizes, keys, counts)

    return run


def _batch(kind: pa.DataType, rows: list, runs: list, sizes: list, keys: list, counts: list) -> pa.RecordBatch:
    columns = [(rows, pa.int64()), (runs, kind), (sizes, pa.int64()), (keys, pa.string()), (counts, pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=["_row", "_run", "_bytes", "piece_key", "n"])


def log_token_counts(logs: DataFrame, model: str, limit: int = 4096, run_id: str = "run_id", log: str = "log") -> DataFrame:
    """Bytes and tokens of the captured output of each run.

    ``logs`` has one row per run: ``run_id`` and the whole text ``log``. ``model`` is the
    path of a sentencepiece BPE model on every machine. The result has one row per input
    row, also for repeated rows and ids and for a NULL id: ``run_id``, ``n_bytes`` (UTF-8),
    ``n_tokens`` without begin, end or special tokens, ``over_limit`` (n_tokens > limit).
    A NULL log counts as empty: 0 bytes, 0 tokens. Other columns are ignored.

    The vocabulary of distinct pre-tokens is written to the shared folder with its piece
    counts. Pre-tokens that make up at least 1/HOT of all, at most HOT of them and each
    short, are sent to the workers and summed where the log is read; the others join the
    vocabulary by a shuffle, in which no key is hot any more.
    """
    check_model(model)
    texts = logs.select(F.col(run_id).alias("_run"), F.col(log).cast("string").alias("_log"))
    parts = texts.select("_log").mapInArrow(_vocabulary, "piece_key string, n long")
    distinct = parts.groupBy("piece_key").agg(F.sum("n").alias("n"))
    vocabulary = cut_lineage(distinct.mapInArrow(_with_pieces(model), "piece_key string, n long, n_pieces long"))
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    frequent = vocabulary.where((F.col("n") * F.lit(HOT) >= F.lit(total)) & (F.length("piece_key") <= HOT_CHARS))
    found = frequent.select("piece_key", "n_pieces").toArrow()
    hot = logs.sparkSession.sparkContext.broadcast(
        dict(zip(found["piece_key"].to_pylist(), found["n_pieces"].to_pylist(), strict=True))
    )
    numbered = texts.select(F.monotonically_increasing_id().alias("_row"), "_run", "_log")
    kind = numbered.schema["_run"].dataType.simpleString()
    counted = numbered.mapInArrow(_frequencies(hot), f"_row long, _run {kind}, _bytes long, piece_key string, n long")
    rest = vocabulary.select("piece_key", "n_pieces")
    sums = counted.join(rest, "piece_key", "left").groupBy("_row").agg(
        F.max("_run").alias(run_id),
        F.max("_bytes").alias("n_bytes"),
        F.sum(F.col("n") * F.coalesce("n_pieces", F.lit(1))).cast("long").alias("n_tokens"),
    )
    return sums.select(run_id, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
