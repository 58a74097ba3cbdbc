import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from popstat.llm import spelling
from popstat.llm.spelling import Trie, log_words, near_words, one_edit, spelling_variants

FOLDER = "/root/testdata/sf0.001"


def words_of(logs, slips, least_letters=6, least_n=5):
    counts = Counter()
    for i, text in logs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if slips and h % slips == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_n}


def edits(word, letters):
    for i in range(len(word) + 1):
        yield word[:i] + word[i + 1 :]
        for c in letters:
            yield word[:i] + c + word[i:]
            yield word[:i] + c + word[i + 1 :]


def near_of(words):
    letters = sorted({c for w in words for c in w})
    return {w: ({*edits(w, letters)} - {w}) & words.keys() for w in words}


def variants_of(words, ratio=5):
    near = near_of(words)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_documents_equal_brute_force(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    logs = [(r.doc_id, r.text) for r in documents.collect()]
    found = log_words(documents, 199, run_id="doc_id", log="text")
    want = words_of(logs, 199)
    assert rows(found) == set(want.items()) and len(want) > 300
    assert rows(spelling_variants(found)) == variants_of(want)


def test_words_of_odd_logs(spark):
    logs = [(None, "Éclair éclair ECLAIR abcdef-abcdef"), (1, None), (2, ""), (1, "abcdef \u00d7abcdef"), (3, "漢字 abcdefghij" * 40), (2, "x" * 50_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in logs], "run_id long, log string, word int")
    for slips in (None, 1, 2, 3):
        assert rows(log_words(df, slips, least_n=1)) == set(words_of(logs, slips, least_n=1).items())


@pytest.fixture(scope="module")
def vocabulary():
    draw = random.Random(2)
    words = {"".join(draw.choices("abcdeé", k=draw.choice([6, 6, 7, 8]))): draw.choice([5, 6, 25, 30, 700, 20_000]) for _ in range(1500)}
    for w in list(words)[:400]:
        at = draw.randrange(len(w))
        words.setdefault(draw.choice([w[:at] + w[at + 1 :], w[:at] + draw.choice("abxé") + w[at:], w[:at] + "z" + w[at + 1 :]]), draw.randint(5, 200))
    return words


@pytest.mark.parametrize(("largest", "searches"), [(4096, 1 << 16), (40, 20), (3, 5)])
def test_any_cut_of_the_trie_finds_the_same(spark, monkeypatch, vocabulary, largest, searches):
    monkeypatch.setattr("popstat.llm.spelling.LARGEST", largest)
    monkeypatch.setattr("popstat.llm.spelling.SEARCHES", searches)
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long").repartition(3)
    want = {(w, vocabulary[w], o, vocabulary[o]) for w, others in near_of(vocabulary).items() for o in others}
    got = [tuple(r) for r in near_words(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert rows(spelling_variants(df)) == variants_of(vocabulary)


def test_chains_ties_repeats_and_empty_tables(spark):
    words = {"mutations": 5, "mutation": 25, "mutatio": 125, "mutati": 3125, "locuses": 5, "focuses": 25, "pocuses": 25, "alone": 9, "": 7, "x": 40}
    df = spark.createDataFrame([(w, n, 0) for w, n in words.items()] + [(None, 3, 0)], "word string, n long, root int")
    found = rows(spelling_variants(df))
    assert found == variants_of(words)
    assert {r[:3] for r in found} >= {("mutations", "mutation", "mutati"), ("locuses", "focuses", "focuses"), ("", "x", "x")}
    assert rows(spelling_variants(df.union(df))) == variants_of({w: 2 * n for w, n in words.items()})
    assert rows(spelling_variants(df.limit(0))) == set()


def test_long_words(spark):
    words = {"a" * 40_000: 5, "a" * 39_999: 50, "a" * 20_000 + "b" + "a" * 19_999: 50, "a" * 16_384: 5, "a" * 16_383: 25}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {(len(r.word), "b" in r.word, len(r.form or ""), r.n_near) for r in spelling_variants(df).collect()}
    assert got == {(40_000, False, 39_999, 2), (39_999, False, 0, 2), (40_000, True, 0, 2), (16_384, False, 16_383, 1), (16_383, False, 0, 1)}


@pytest.mark.parametrize("few", [0, 8192])
@settings(max_examples=200, deadline=None)
@given(words=st.lists(st.text("abm", min_size=1, max_size=5), min_size=1, max_size=12, unique=True), asked=st.lists(st.text("abm", min_size=1, max_size=5), max_size=6))
def test_trie_and_verification(few, words, asked):
    spelling.FEW = few
    found = sorted(zip(*(x.tolist() for x in Trie(words).search(asked)), strict=True)) if asked else []
    assert found == sorted((k, e) for k, a in enumerate(asked) for e, w in enumerate(words) if one_edit(a, w))
    for a in asked:
        for w in words:
            assert one_edit(a, w) == (a != w and w in set(edits(a, "abm")))
