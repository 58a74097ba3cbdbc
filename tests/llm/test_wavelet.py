import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from popstat.llm.encoding import encoder
from popstat.llm.wavelet import (
    WaveletMatrix, count_mutations, locate_mutation, mutations_at, read_packed_population, texts_as_ids, unpack_population,
    write_packed_population,
)

MODEL = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 2**31)), max_size=1500))
def test_matrix_answers_like_the_list(ids):
    a = np.array(ids, np.uint32)
    built = WaveletMatrix.build(a)
    m = WaveletMatrix(built.n, built.symbols, [p.tobytes() for p in built.planes], [r.tobytes() for r in built.ranks])
    assert (m.decode() == a).all()
    if ids:
        assert (m.access(range(len(ids))) == a).all()
    for s in [*sorted(set(ids))[:5], 7]:
        assert m.locate(s).tolist() == np.flatnonzero(a == s).tolist()
        assert m.count(s) == ids.count(s) and m.count(s, len(ids) // 2) == ids[: len(ids) // 2].count(s)


@pytest.fixture(scope="module")
def population(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    lists = {i: rng.integers(0, 40, rng.integers(0, 30)).tolist() for i in range(50)}
    lists[11], lists[12] = [], None
    rows = [(k, v, 1) for k, v in lists.items()] + [(None, [3, 3], 1), (20, [99], 1)]
    path = str(tmp_path_factory.mktemp("shards") / "out")
    df = spark.createDataFrame(rows, "haplotype_id long, mutation_ids array<long>, shard int").repartition(5)
    write_packed_population(df, path, shard_size=100)
    flat = [*[3, 3], *[x for i in range(20) for x in lists[i] or []]]
    return rows, flat, read_packed_population(spark, path)


def test_population_round_trip(population):
    rows, flat, shards = population
    got = unpack_population(shards).orderBy("start", "n_ids").collect()
    assert sorted((r.haplotype_id is None, r.haplotype_id, r.mutation_ids) for r in got) == sorted(
        (k is None, k, v or []) for k, v, _ in rows
    )
    ids = [x for r in got for x in r.mutation_ids]
    assert ids[: len(flat)] == flat and shards.count() > 3
    assert all(ids[r.start : r.start + r.n_ids] == r.mutation_ids for r in got)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.mutation_ids, "<u4").tobytes()) for r in got)


def test_lookups_over_all_shards(population):
    _, _, shards = population
    ids = [x for r in unpack_population(shards).orderBy("start", "n_ids").collect() for x in r.mutation_ids]
    assert {r.mutation_id: r.n for r in count_mutations(shards, [3, 99, 1000]).collect()} == {3: ids.count(3), 99: 1, 1000: 0}
    assert sorted(r.position for r in locate_mutation(shards, 3).collect()) == [i for i, x in enumerate(ids) if x == 3]
    places = [0, 1, len(ids) - 1, len(ids) // 2, len(ids)]
    assert {r.position: r.mutation_id for r in mutations_at(shards, places).collect()} == {p: ids[p] for p in places[:-1]}


def test_empty_population(spark, tmp_path):
    write_packed_population(spark.createDataFrame([], "haplotype_id long, mutation_ids array<long>"), str(tmp_path / "out"))
    assert unpack_population(read_packed_population(spark, str(tmp_path / "out"))).collect() == []


TEXTS = [
    None, "", " ", "a", "a  b", " a", "a ", "a\n b", "x\ny z\n", "x y\n\n", "<|endoftext|> a", "ünï cödé", "日本 語", "a b c",
    "a­b c", "don't we'll  x\t\ty", "b\x0bc d", "q" * 5_000, "word, Word. " * 3_000,
]


def test_encoder_equals_the_library():
    own = encoder(MODEL)
    want = [own.library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert [x.tolist() for x in own.encode(pa.array(TEXTS))] == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeé ß\n\t'1!._\r漢\x0b  "), max_size=25), max_size=8))
def test_encoder_equals_the_library_on_any_text(texts):
    own = encoder(MODEL)
    want = [own.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in own.encode(pa.array(texts, pa.string()))] == want


def test_words_are_learned_anew_beyond_the_bound(monkeypatch):
    monkeypatch.setattr("popstat.llm.encoding.MAX_WORDS", 10)
    own = encoder(MODEL)
    own.forget()
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)]
    for t in texts:
        assert next(own.encode(pa.array([t]))).tolist() == own.library.encode(t).ids


def test_texts_get_an_end_id(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    write_packed_population(df, str(tmp_path / "out"), "doc_id", "text", texts_as_ids(MODEL, 2))
    got = unpack_population(read_packed_population(spark, str(tmp_path / "out"))).collect()
    want = {i: [*encoder(MODEL).library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    assert {r.haplotype_id: r.mutation_ids for r in got} == want
