"""Run logs that quote a scenario description, also with other numbers, names or units."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popstat.session import cut_lineage

WINDOW, LITERALS, COVERAGE = 8, 5, 0.5
#: Bits of the filter of scenario windows that every worker gets: its size is fixed.
FILTER_BITS = 1 << 27
KNOWN_WORDS = 300_000
NUMBER = re.compile(r"[-+]?\d[\d.,:/]*(?:e[-+]?\d+)?")
NUMBER_UNIT = re.compile(rf"([$€£¥]?{NUMBER.pattern})([a-zµ°%€$£]{{1,4}})?")
WORD_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
ENDS_SENTENCE = (".", "!", "?", ":", ";")
# Units that may follow a number as a word of their own
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb ml cl l gal ms s sec secs second seconds min mins minute minutes h hr hrs hour "
    "hours day days week weeks month months year years hz khz mhz ghz b kb mb gb tb kib mib gib bytes v w kw mw j kj cal kcal "
    "pa kpa bar c f k % percent usd eur gbp dollars euros pounds dollar euro cents bp kbp mbp morgans generations".split()
)
#: Characters of scripts without spaces: each is a word of its own.
SPACELESS = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u3400-\u9fff\uf900-\ufaff\uff01-\uff65\U00020000-\U0003ffff]")
LITERAL, NUM, UNIT, NAME = range(4)
#: Readings of a text: number and unit as one slot; runs of names, too; every token as a word.
VALUES, NAMES, WORDS = range(3)
#: Stands for a line end among tokens; if a text holds it as a word, that is read as a line end.
LINE = "\x00line"
CHUNK = 100_000
_SLOT = np.array([xxhash.xxh64_intdigest(f"<{kind}>", 1) for kind in ("literal", "number", "unit", "name")], np.uint64)
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


class Reader:
    """Turns texts into template tokens; what it keeps of words is bounded."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {LINE: 0}
        self.words = [""]
        room = KNOWN_WORDS * 2
        self.kind, self.hash = np.zeros(room, np.int8), np.zeros(room, np.uint64)
        self.ends, self.unit = np.zeros(room, bool), np.zeros(room, bool)
        self.ends[0] = True

    def learn(self, token: str) -> int:
        """Number of a token: its folded word, its kind as far as it shows by itself, and its hash; "" is no word."""
        core = token.rstrip(".,;:!?")
        if core.isalpha():
            word, kind = core.casefold(), NAME if core[0].isupper() else LITERAL
        else:
            core = WORD_EDGES.sub("", token) or ("%" if token.startswith("%") else "")
            word = token.strip("()[]{}\"'.,;:!?").casefold()
            kind = NUM if NUMBER_UNIT.fullmatch(word) else NAME if core[:1].isupper() else LITERAL
            word = word if kind == NUM else core.casefold()
        i = self.known[token] = len(self.words)
        self.words.append(word)
        if i == len(self.kind):
            grow = lambda a: np.concatenate((a, np.zeros_like(a)))
            self.kind, self.hash, self.ends, self.unit = (grow(a) for a in (self.kind, self.hash, self.ends, self.unit))
        self.kind[i], self.ends[i], self.unit[i] = kind, token.endswith(ENDS_SENTENCE), word in UNITS
        self.hash[i] = xxhash.xxh64_intdigest(word, 1) if word else 0
        return i

    def numbers(self, text: str | None) -> list[int]:
        """Numbers of a text's tokens; 0 stands before the text and for each line end."""
        text = text or ""
        if not text.isascii() and SPACELESS.search(text):
            text = SPACELESS.sub(r" \g<0> ", text)
        tokens = [LINE, *text.replace("\n", f" {LINE} ").split()]
        found = list(map(self.known.get, tokens))
        if None in found:
            found = [self.known[t] if t in self.known else self.learn(t) for t in tokens]
        return found

    def read(self, numbers: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the tokens are words, and the kinds of those; ``text`` tells the tokens' texts apart.

        A capitalised word is a name unless it opens a sentence; a unit is one after a number of its text.
        """
        kind = self.kind[numbers]
        opens = np.concatenate(([True], self.ends[numbers[:-1]]))
        kind[(kind == NAME) & opens] = LITERAL
        word = np.flatnonzero(self.hash[numbers] != 0)
        kind = kind[word]
        after = np.concatenate(([False], (kind[:-1] == NUM) & (text[word[1:]] == text[word[:-1]])))
        kind[after & self.unit[numbers[word]] & (kind != NUM)] = UNIT
        return word, kind


def tokens_of(reading: int, kinds: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Words at which the tokens of a reading begin; a number takes its unit along, a name the names after it."""
    if reading == WORDS:
        return np.arange(len(kinds))
    begins = kinds != UNIT
    if reading == NAMES:
        begins[1:] &= ~((kinds[1:] == NAME) & (kinds[:-1] == NAME) & (text[1:] == text[:-1]))
    return np.flatnonzero(begins)


def window_keys(reading: int, kinds: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and key of a reading's windows.

    Those with slots need LITERALS literals. Windows of words only count where the first reading
    has slots or too few words; all others it has already, with the same keys.
    """
    n = len(kinds) - size + 1
    if n <= 0 or size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    of = lambda mask: (c := np.concatenate(([0], np.cumsum(mask))))[size:] - c[:-size]
    if reading == WORDS:
        free = np.zeros(len(kinds), bool)
        fit = (of((kinds == NUM) | (kinds == UNIT)) > 0) | (size < LITERALS)
    else:
        free = np.isin(kinds, (NUM, NAME) if reading == NAMES else (NUM,))
        fit = size - of(free) >= LITERALS
        if reading == NAMES:
            fit &= of(kinds == NAME) > 0
    start = np.flatnonzero(fit)
    values = np.where(free, _SLOT[kinds], hashes)
    values ^= values >> np.uint64(29)
    key = np.full(len(start), size * 3, np.uint64)
    for k in range(size):
        key += values[start + k] * _FACTORS[k]
    return start, (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _slots(words: list[str], kinds: np.ndarray, reading: int) -> list[str]:
    """The values in a window's slots; a number with its unit is one, so is a run of names, and they never equal each other."""
    out: list[str] = []
    before = LITERAL
    for word, kind in zip(words, kinds.tolist(), strict=True):
        if kind == NUM and reading != WORDS:
            out.append("n" + word)
        elif kind == UNIT and reading != WORDS and before == NUM:
            out[-1] += word
        elif kind == NAME and reading == NAMES:
            if before == NAME:
                out[-1] += " " + word
            else:
                out.append("a" + word)
        before = kind
    return out


COLUMNS = ["_id", "key", "start", "end", "size", "total", "slots"]


def _windows(sizes: list[int] | None, held=None):
    """Windows of each text by their first word and the one after the last; with a filter only those that may match a scenario."""

    def of_texts(reader: Reader, ids: list, numbers: list[list[int]], bits: np.ndarray | None, out: list[list]) -> None:
        laid = np.array([i for text in numbers for i in text], np.int64)
        text = np.repeat(np.arange(len(numbers)), [len(t) for t in numbers])
        word, kinds = reader.read(laid, text)
        laid, text = laid[word], text[word]
        total = np.bincount(text, minlength=len(ids))
        first = np.cumsum(total) - total
        for reading in (VALUES, NAMES, WORDS):
            begin = tokens_of(reading, kinds, text)
            end = np.append(begin[1:], len(laid))
            for size in sizes or [min(WINDOW, len(begin))]:
                start, key = window_keys(reading, kinds[begin], reader.hash[laid[begin]], size)
                if bits is not None:
                    place = key & np.uint64(FILTER_BITS - 1)
                    met = (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)
                    start, key = start[met == 1], key[met == 1]
                lo, hi = begin[start], end[start + size - 1]
                inside = text[lo] == text[hi - 1]
                lo, hi, key = lo[inside], hi[inside], key[inside]
                own = text[lo]
                values = (
                    [ids[t] for t in own], key.view(np.int64).tolist(), (lo - first[own]).tolist(), (hi - first[own]).tolist(),
                    [size] * len(own), total[own].tolist(),
                    [_slots([reader.words[i] for i in laid[s:e]], kinds[s:e], reading) for s, e in zip(lo, hi, strict=True)],
                )
                for column, more in zip(out, values, strict=True):
                    column += more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        bits = held.value if held is not None else None
        for batch in batches:
            out: list[list] = [[] for _ in COLUMNS]
            ids, numbers, tokens = [], [], 0
            for name, text in zip(batch.column("_id").to_pylist(), batch.column("_text"), strict=True):
                ids.append(name)
                numbers.append(reader.numbers(text.as_py()))
                tokens += len(numbers[-1])
                if tokens >= CHUNK or sizes is None or len(reader.words) > KNOWN_WORDS:
                    of_texts(reader, ids, numbers, bits, out)
                    ids, numbers, tokens = [], [], 0
                    if len(reader.words) > KNOWN_WORDS:
                        reader.forget()
            if ids:
                of_texts(reader, ids, numbers, bits, out)
            kinds = [batch.schema.field("_id").type, pa.int64(), *[pa.int32()] * 4, pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=COLUMNS)

    return run


def _found_windows(texts: DataFrame, sizes: list[int] | None, held=None) -> DataFrame:
    kind = texts.schema["_id"].dataType.simpleString()
    return texts.mapInArrow(_windows(sizes, held), f"_id {kind}, key long, start int, end int, size int, total int, slots array<string>")


def _filter_of(windows: DataFrame) -> np.ndarray:
    """A bit for each key of the scenarios' windows; at most FILTER_BITS / 64 words reach the driver."""
    place = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = windows.groupBy(F.shiftright(place, 6).alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("w")
    ).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words["i"].to_numpy()] = words["w"].to_numpy().view(np.uint64)
    return out


def _pieces(windows: list[dict]) -> list[tuple[int, list[dict]]]:
    """Runs of overlapping windows of one shift, without the windows whose slots contradict others of their run."""
    runs: list[tuple[int, list[dict]]] = []
    reach = 0
    for shift, w in sorted(((w["start"] - w["at"], w) for w in windows), key=lambda x: (x[0], x[1]["at"], x[1]["until"])):
        if runs and runs[-1][0] == shift and w["at"] <= reach:
            runs[-1][1].append(w)
        else:
            runs.append((shift, [w]))
            reach = 0
        reach = max(reach, w["until"])
    out = []
    for shift, run in runs:
        theirs: dict[str, set] = {}
        ours: dict[str, set] = {}
        for w in run:
            for o, s in zip(w["own"], w["slots"], strict=True):
                theirs.setdefault(o, set()).add(s)
                ours.setdefault(s, set()).add(o)
        fine = [w for w in run if all(len(theirs[o]) == 1 == len(ours[s]) for o, s in zip(w["own"], w["slots"], strict=True))]
        if fine:
            out.append((shift, fine))
    return out


def judge_windows(windows: list[dict], total: int, least: float) -> tuple[float, bool] | None:
    """Largest share of a description that ordered, consistent windows of a text cover, and whether all such have changed values.

    Each run of windows is tried as the core of a quotation; runs before and after it, as far as
    they are shifted by no more than the length of the description, are added in order of size,
    without windows whose slots contradict what is there.
    """
    pieces = _pieces(windows)
    shifts = [shift for shift, _ in pieces]
    found: list[tuple[float, bool]] = []
    for i, (shift, core) in enumerate(pieces):
        near = range(bisect_left(shifts, shift - total), bisect_right(shifts, shift + total))
        theirs: dict[str, str] = {}
        ours: dict[str, str] = {}
        blocks: list[tuple[int, int, int, int]] = []
        covered: set[int] = set()
        for k in [i, *sorted((k for k in near if k != i), key=lambda k: -len(pieces[k][1]))]:
            taken = []
            for w in core if k == i else pieces[k][1]:
                s, a = w["start"], w["at"]
                ordered = all((s < s0 and a < a0) or (s > s1 and a > a1) for s0, s1, a0, a1 in blocks)
                if ordered and all(theirs.get(o, v) == v and ours.get(v, o) == o for o, v in zip(w["own"], w["slots"], strict=True)):
                    taken.append(w)
            if not taken:
                continue
            for w in taken:
                theirs.update(zip(w["own"], w["slots"], strict=True))
                ours.update(zip(w["slots"], w["own"], strict=True))
                covered.update(range(w["at"], w["until"]))
            starts, ats = [w["start"] for w in taken], [w["at"] for w in taken]
            blocks.append((min(starts), max(starts), min(ats), max(ats)))
        if len(covered) / total >= least:
            found.append((len(covered) / total, any(o != v for o, v in theirs.items())))
            if found[-1] == (1.0, False):
                break
    return (max(c for c, _ in found), min(x for _, x in found)) if found else None


def quoted_scenarios(
    logs: DataFrame, scenarios: DataFrame, run_id: str = "run_id", log: str = "log",
    scenario: str = "scenario_name", description: str = "scenario_description", coverage: float = COVERAGE,
) -> DataFrame:
    """Pairs of ``run_id`` and ``scenario_name`` whose log quotes the description, with ``coverage`` and ``changed``.

    Texts become templates: a number with its unit and a run of capitalised words within a
    sentence are slots. Windows of eight template tokens, or the whole of a shorter description,
    are joined by hash; those with slots need five literal words. Names also count as plain words,
    so that a text in another case still matches, and so do numbers and units, without a least
    number of words, so that what is quoted word for word is found whatever it consists of; a
    description of one word is found wherever that word stands. Characters of scripts without
    spaces are words. Windows are a quotation if they are in the same order in both texts, the
    slots map one to one and the windows together cover at least ``coverage`` of the
    description's words; windows that contradict others fall out. ``coverage`` is the largest
    share and ``changed`` tells that even the closest quotation has another value in some slot.

    A fixed-size bit filter of the descriptions' windows keeps all other windows of the logs
    from being shuffled; it lets false ones through, which the join drops. NULL texts are
    empty; other columns are ignored; empty tables give no pairs. ``run_id`` tells texts apart,
    so each row needs its own: windows of rows that share one, or NULL, are taken for those of
    one text. :func:`with_quotations` numbers rows itself.
    """
    known = scenarios.select(F.col(scenario).alias("_id"), F.col(description).cast("string").alias("_text"))
    texts = logs.select(F.col(run_id).alias("_id"), F.col(log).cast("string").alias("_text"))
    wanted = cut_lineage(_found_windows(known, None).withColumnRenamed("_id", "_scenario"))
    sizes = [r[0] for r in wanted.select("size").distinct().orderBy("size").collect()]
    if not sizes:
        sizes = [WINDOW]
    held = logs.sparkSession.sparkContext.broadcast(_filter_of(wanted))
    met = cut_lineage(_found_windows(texts, sizes, held).drop("size", "total").distinct())
    theirs = wanted.select(
        "_scenario", "key", F.col("start").alias("at"), F.col("end").alias("until"), "total", F.col("slots").alias("own")
    ).distinct()
    pairs = met.join(theirs, "key").where(F.size("slots") == F.size("own"))
    gathered = pairs.groupBy("_id", "_scenario", "total").agg(
        F.collect_list(F.struct("start", "at", "until", "own", "slots")).alias("windows")
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [judge_windows(w.as_py(), n, coverage) for n, w in zip(batch.column(2).to_pylist(), batch.column(3), strict=True)]
            kept = [k for k, j in enumerate(judged) if j is not None]
            columns = [batch.column(0).take(pa.array(kept, pa.int64())), batch.column(1).take(pa.array(kept, pa.int64()))]
            columns += [pa.array([judged[k][0] for k in kept], pa.float64()), pa.array([judged[k][1] for k in kept], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_scenario", "coverage", "changed"])

    kinds = [gathered.schema[c].dataType.simpleString() for c in ("_id", "_scenario")]
    judged = gathered.mapInArrow(judge, f"_id {kinds[0]}, _scenario {kinds[1]}, coverage double, changed boolean")
    return judged.groupBy("_id", "_scenario").agg(
        F.max("coverage").alias("coverage"), F.min("changed").alias("changed")
    ).toDF(run_id, scenario, "coverage", "changed")


def with_quotations(
    logs: DataFrame, scenarios: DataFrame, run_id: str = "run_id", log: str = "log",
    scenario: str = "scenario_name", description: str = "scenario_description",
) -> DataFrame:
    """Every row's ``run_id`` with ``contaminated``, the sorted ``scenarios`` it quotes, the best ``coverage`` and ``changed``.

    One row per input row, judged by its own text, whatever its id: NULL, repeated or shared
    by different texts. ``changed`` tells that no description is quoted unchanged. Rows are
    numbered in a table that is written to the shared folder.
    """
    texts = logs.select(F.col(run_id), F.col(log).cast("string").alias("_log"), F.monotonically_increasing_id().alias("_number"))
    numbered = cut_lineage(texts)
    pairs = quoted_scenarios(numbered, scenarios, "_number", "_log", scenario, description)
    found = pairs.groupBy("_number").agg(
        F.array_sort(F.collect_set(scenario)).alias("scenarios"), F.max("coverage").alias("coverage"), F.min("changed").alias("changed")
    )
    none = F.array().cast(found.schema["scenarios"].dataType)
    return numbered.select(run_id, "_number").join(found, "_number", "left").select(
        run_id, F.col("coverage").isNotNull().alias("contaminated"), F.coalesce("scenarios", none).alias("scenarios"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("changed", F.lit(False)).alias("changed"),
    )
