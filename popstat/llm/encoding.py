"""Token ids of texts by public vocabularies, each distinct unit of a worker encoded once.

A text of Latin letters and single spaces is cut where its vocabulary's own
pre-tokenization cuts, too. The units of many texts are told apart by a table of
hashes and bytes, and those not seen before are encoded by the vocabulary's library. Any
other text, and one that holds a special token's string, goes to the library as a whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Half the units kept by a worker; beyond it they are learned anew. The table of their hashes has twice the room.
MAX_WORDS = 1 << 19
SLICE = 1 << 20
SPACE = 32
_POWER = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_POWER), -1, 1 << 64))
_LETTER = np.random.default_rng(7).integers(1, 1 << 63, 256).astype(U)


def _table(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_WHITE = _table((9, 10, 13, SPACE))
# Bytes of ASCII text and of the letters U+00A1 .. U+00FF in UTF-8, soft hyphen excepted
_KNOWN = _table([9, 10, 13, *range(32, 127), 0xC2, 0xC3, *range(0x80, 0xC0)])
_NOT_AFTER_C2 = _table([*range(0x80, 0xA1), 0xAD])
_PLAIN_LETTER = _table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_SECOND_OF_LETTER = _table(set(range(0x80, 0xC0)) - {0x97, 0xB7})
_MARK = _table(c for c in range(33, 127) if not chr(c).isalnum())
_ONE_PRE_TOKEN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


class UnitEncoder:
    """Ids of texts from ids of their units; a vocabulary says how units are cut and encoded."""

    special: list[bytes] = []

    def __init__(self) -> None:
        self.power = self.undo = np.zeros(0, U)
        self.forget()

    def learn(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit."""
        raise NotImplementedError

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text by the library alone."""
        raise NotImplementedError

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places at which a unit starts, besides the beginnings of texts."""
        return data == SPACE

    def forget(self) -> None:
        self.slots = max(MAX_WORDS * 4 - 1, 1 << 16).bit_length()
        self.keys, self.values, self.n = np.zeros(1 << self.slots, U), np.zeros(1 << self.slots, np.int32), 0
        self.start, self.count, self.pool, self.used = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint32), 0
        self.text, self.length, self.texts, self.written = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint8), 0

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a string array; NULL is an empty text."""
        for part in slices(texts):
            ids, counts = self.flat(part)
            ends = np.cumsum(counts)
            yield from (ids[a:b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True))

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of one slice, one after another, and how many each has."""
        data, offsets = bytes_of(texts)
        plain = self._plain(data, offsets)
        if plain.all():
            return self._units(data, offsets)
        own = np.flatnonzero(plain)
        ids, sizes = self._units(*bytes_of(texts.take(pa.array(own))))
        parts = [self.whole(texts[i].as_py()) if not p else None for i, p in enumerate(plain.tolist())]
        counts = np.zeros(len(parts), np.int64)
        counts[own] = sizes
        ends = np.cumsum(sizes)
        for k, i in enumerate(own.tolist()):
            parts[i] = ids[ends[k] - sizes[k] : ends[k]]
        counts[~plain] = [len(parts[i]) for i in np.flatnonzero(~plain)]
        return np.concatenate(parts).astype(np.uint32), counts

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts whose units can be taken one by one."""
        begin, end = offsets[:-1], offsets[1:]
        bad = ~_KNOWN[data]
        space, white = data == SPACE, _WHITE[data]
        bad[:-1] |= (space[:-1] & white[1:]) | (white[:-1] & space[1:]) | ((data[:-1] == 0xC2) & _NOT_AFTER_C2[data[1:]])
        some = end > begin
        bad[end[some] - 1] |= space[end[some] - 1]
        before = np.concatenate(([0], np.cumsum(bad, dtype=np.int64)))
        plain = before[end] == before[begin]
        raw = data.tobytes() if self.special else b""
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                plain[np.searchsorted(begin, at, side="right") - 1] = False
                at = raw.find(token, at + 1)
        return plain

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts, one after another, and how many each has."""
        sizes = np.diff(offsets)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(sizes), np.int64)
        starts = self.cuts(data)
        some = sizes > 0
        starts[offsets[:-1][some]] = True
        edges = np.append(np.flatnonzero(starts), len(data))
        first = np.searchsorted(edges, offsets[:-1][some])
        number = self._numbers(data, edges)
        count = self.count[number].astype(np.int64)
        ends = np.cumsum(count)
        place = np.repeat((self.start[number] - (ends - count)).astype(np.int32), count)
        place += np.arange(ends[-1], dtype=np.int32)
        ids = self.pool[place]
        counts = np.zeros(len(sizes), np.int64)
        counts[some] = np.add.reduceat(count, first)
        return ids, counts

    def _numbers(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The number of each unit between the edges; those not seen before are learned."""
        start, stop = edges[:-1], edges[1:]
        if self.n + len(start) > MAX_WORDS * 2 and self.n:
            self.forget()
        if len(self.power) <= len(data):
            self.power, self.undo = (np.cumprod(np.full(len(data) + SLICE, x), dtype=U) for x in (_POWER, _INVERSE))
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(_LETTER[data] * self.power[: len(data)], out=sums[1:])
        key = (sums[stop] - sums[start]) * self.undo[start]
        key = (key ^ (key >> U(32))) * U(0xFF51AFD7ED558CCD)
        key = np.maximum(key ^ (key >> U(29)), U(1))
        number = self._find(key)
        if (new := np.flatnonzero(number < 0)).size:
            _, one = np.unique(key[new], return_index=True)
            new = new[one]
            self._insert(key[new], self._learned(data, start[new], stop[new]))
            number = self._find(key)
        # Equal keys of other units are told apart by their bytes
        place = np.repeat((self.text[number] - start).astype(np.int32), stop - start)
        place += np.arange(len(data), dtype=np.int32)
        held = self.texts.take(place, mode="clip")
        other = self.length[number] != stop - start
        if other.any() or not np.array_equal(held, data):
            other |= np.add.reduceat(held != data, start, dtype=np.int64) > 0
            number[other] = self._learned(data, start[other], stop[other])
        return number

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The number held under each key, or -1."""
        slot = (key >> U(64 - self.slots)).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], -1)
        open_ = np.flatnonzero((there != key) & (there != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.slots) - 1)
            there = self.keys[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
        return out

    def _insert(self, key: np.ndarray, value: np.ndarray) -> None:
        slot = (key >> U(64 - self.slots)).astype(np.int64)
        while len(slot):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = key[put], value[put]
            rest = np.ones(len(slot), bool)
            rest[put] = False
            key, value, slot = key[rest], value[rest], (slot[rest] + 1) & ((1 << self.slots) - 1)

    def _learned(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """New numbers for these units."""
        raw = memoryview(data)
        units = [bytes(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        found = self.learn([u.decode() for u in units])
        n, sizes, letters = self.n, np.array([len(x) for x in found], np.int64), stop - start
        ids = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        self.n = n + len(units)
        self.start, self.count, self.text, self.length = (_room(x, self.n) for x in (self.start, self.count, self.text, self.length))
        self.pool, self.texts = _room(self.pool, self.used + len(ids)), _room(self.texts, self.written + int(letters.sum()))
        self.start[n : self.n], self.count[n : self.n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.text[n : self.n], self.length[n : self.n] = self.written + np.cumsum(letters) - letters, letters
        self.pool[self.used : self.used + len(ids)] = ids
        self.texts[self.written : self.written + int(letters.sum())] = np.frombuffer(b"".join(units), np.uint8)
        self.used, self.written = self.used + len(ids), self.written + int(letters.sum())
        return np.arange(n, self.n)


class ByteEncoder(UnitEncoder):
    """A byte-level BPE vocabulary of the tokenizers library, without special tokens added.

    Strings of special tokens inside a text are handled as the library's default does,
    or with ``ordinary`` as any other text.
    """

    def __init__(self, path: str, ordinary: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = ordinary
        held = self.library.get_added_tokens_decoder()
        self.special = [] if ordinary else [t.content.encode() for t in held.values()]
        self.byte_of = _byte_letters()
        self.letter_of = {b: c for c, b in self.byte_of.items()}
        self.added = {i: t.content.encode() for i, t in held.items()}
        super().__init__()

    def tokens(self) -> list[bytes]:
        """The bytes of each id."""
        out = [b""] * (max(self.library.get_vocab().values()) + 1)
        for token, i in self.library.get_vocab().items():
            out[i] = self.added[i] if i in self.added else bytes(self.byte_of[c] for c in token)
        return out

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Spaces, and marks behind a letter or digit: both begin a pre-token whatever follows."""
        letter = _PLAIN_LETTER[data]
        letter[1:] |= _SECOND_OF_LETTER[data[1:]] & (data[:-1] == 0xC3)
        out = data == SPACE
        out[1:] |= _MARK[data[1:]] & letter[:-1]
        return out

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def learn(self, units: list[str]) -> list[list[int]]:
        # A run of letters with its space is one pre-token, which the library's model takes by itself
        one = [_ONE_PRE_TOKEN.fullmatch(u) is not None for u in units]
        rest = iter(self.library.encode_batch_fast([u for u, o in zip(units, one, strict=True) if not o], add_special_tokens=False))
        model, letters = self.library.model.tokenize, self.letter_of
        return [
            [t.id for t in model(u.encode().decode("latin-1").translate(letters))] if o else next(rest).ids
            for u, o in zip(units, one, strict=True)
        ]


class PieceEncoder(UnitEncoder):
    """A sentencepiece BPE model with byte fallback, for texts that begin with the space which the model adds.

    Pieces hold the mark of a space only at their beginning or in runs, so what stands
    between single spaces is encoded by itself.
    """

    MARK = "▁"

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.library.vocab_size()):
            if self.MARK in self.library.id_to_piece(i).lstrip(self.MARK):
                raise ValueError(f"a piece spans words: {self.library.id_to_piece(i)!r}")
        super().__init__()

    def tokens(self) -> list[bytes]:
        """The bytes of each id."""
        own = self.library
        return [
            bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace(self.MARK, " ").encode()
            for i in range(own.vocab_size())
        ]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text[1:]), np.uint32)

    def learn(self, units: list[str]) -> list[list[int]]:
        return self.library.encode([u[1:] for u in units], num_threads=1)


_encoders: dict[tuple, UnitEncoder] = {}


def of_worker(make: Callable[..., UnitEncoder], *arguments) -> UnitEncoder:
    """The encoder of this worker for a vocabulary file."""
    key = (make, *arguments)
    if key not in _encoders:
        _encoders[key] = make(*arguments)
    return _encoders[key]


def encoder(path: str) -> ByteEncoder:
    """The byte-level encoder of this worker for a vocabulary file."""
    return of_worker(ByteEncoder, path)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive parts of about SLICE bytes, at least one text each; NULL becomes an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets = bytes_of(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield texts.slice(at, min(end, len(texts)) - at)
        at = end


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large string array and the offset at which each text begins, and the end."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}


def _room(array: np.ndarray, n: int) -> np.ndarray:
    return array if n <= len(array) else np.concatenate((array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)))
