import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import numpy as np
from popstat.llm.alignment import align_log_tokens, group_numbers

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    return table | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


LETTERS = byte_letters()


class Reference:
    """Plain Python over whole texts by the libraries."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(LETTERS[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        want = (" " + text).encode()
        if b"".join(t for _, t in a) != want or b"".join(t for _, t in b) != want:
            return [], []
        return a, b

    @staticmethod
    def spans(tokens):
        out, at = [], 0
        for i, t in tokens:
            out.append((i, at, at + len(t)))
            at += len(t)
        return out

    def rows(self, logs):
        held = []
        for run_id, text in logs:
            a, b = map(self.spans, self.tokens(text))
            links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
            ends = sorted({e for *_, e in a} & {e for *_, e in b})
            groups = []
            for low, high in zip([0, *ends], ends):
                groups.append("|".join(",".join(str(i) for i, s, e in t if low < e <= high) for t in (a, b)))
            held.append((run_id, len(a), len(b), links, groups))
        counts = Counter(p for r in held for p in r[3])
        top = {}
        for (_, y), n in counts.items():
            top[y] = max(top.get(y, 0), n)
        for run_id, n_a, n_b, links, groups in held:
            best = sum(counts[p] == top[p[1]] for p in links)
            yield run_id, n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), ";".join(groups)


LOGS = [
    (1, "neutral mutations 0.25 at the locus; neutral fixation"), (2, None), (3, ""), (4, "a"), (5, " "), (6, "  two  spaces "),
    (7, "mark ▁ lost"), (8, "<|endoftext|> and </s>"), (9, "日本語 漢字 é naïve"), (None, "neutral"), (1, "neutral mutations"),
    (10, "\n\n tab\there\x00"), (11, "qxzqxzvv wordwordword " * 40), (12, "😀 ok"), (13, "café, Été."),
]


def test_equals_the_libraries_and_brute_force(spark):
    logs = spark.createDataFrame([(i, t, "x", 7) for i, t in LOGS], "run_id long, log string, groups string, n_a int")
    got = [tuple(r) for r in align_log_tokens(logs, A, B).collect()]
    assert sorted(got, key=str) == sorted(Reference().rows(LOGS), key=str)


def test_rare_pairs_are_counted_as_frequent_ones_are(spark, monkeypatch):
    monkeypatch.setattr("popstat.llm.alignment.HOT", 30)
    monkeypatch.setattr("popstat.llm.alignment.FLUSH", 50)
    logs = spark.createDataFrame(LOGS, "run_id long, log string")
    got = [tuple(r) for r in align_log_tokens(logs, A, B).collect()]
    assert sorted(got, key=str) == sorted(Reference().rows(LOGS), key=str)


def test_digest_and_empty_table(spark):
    logs = spark.createDataFrame(LOGS[:3], "run_id long, log string")
    got = {r.run_id: r.groups for r in align_log_tokens(logs, A, B, digest_only=True).collect()}
    text = next(iter(Reference().rows(LOGS[:1])))[-1]
    assert got == {1: hashlib.sha256(text.encode()).hexdigest(), 2: "", 3: ""}
    assert align_log_tokens(logs.limit(0), A, B).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30))
def test_groups_end_where_both_end(a, b):
    a, b = np.cumsum(a), np.cumsum(b)
    total = max(a[-1], b[-1])
    a, b = (np.append(x, total) if x[-1] < total else x for x in (a, b))
    both = sorted(set(a.tolist()) & set(b.tolist()))
    group_a, group_b, left, right = group_numbers(a, b)
    assert group_a.tolist() == [sum(e < x for e in both) for x in a]
    assert group_b.tolist() == [sum(e < x for e in both) for x in b]
    starts_a, starts_b = np.append(0, a[:-1]), np.append(0, b[:-1])
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if starts_a[i] < b[j] and starts_b[j] < a[i]}
    assert len(left) == len(want) and set(zip(left.tolist(), right.tolist())) == want
