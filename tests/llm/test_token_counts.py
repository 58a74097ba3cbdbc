import public_tokenizers
import pytest
import sentencepiece

from popstat.llm.token_counts import check_model, log_token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "\n", "a\n\nb  c ", "  Ünïcödé 漢字 😀\t<s>hi</s> ▁x ▁▁ y▁z", "x" * 50_000, "word, Word. " * 5_000,
    " 　 \x00 \x0b", "same", "same",
]


def test_counts_equal_the_library(spark):
    rows = [(i if i != 3 else None, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(4, "other", "clash", 2)]
    logs = spark.createDataFrame(rows, "run_id long, log string, piece_key string, n long").repartition(3)
    got = sorted(map(tuple, log_token_counts(logs, MODEL, limit=3).collect()), key=repr)
    encoder = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for run, text, *_ in rows:
        n = len(encoder.encode(text or ""))
        want.append((run, len((text or "").encode()), n, n > 3))
    assert got == sorted(want, key=repr)


def test_rare_pre_tokens_join_the_vocabulary(spark, monkeypatch):
    monkeypatch.setattr("popstat.llm.token_counts.HOT_CHARS", 3)
    logs = spark.createDataFrame([("a", "the longest words and the the"), ("b", "longest")], "run_id string, log string")
    encoder = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.run_id: r.n_tokens for r in log_token_counts(logs, MODEL).collect()}
    assert got == {r.run_id: len(encoder.encode(r.log)) for r in logs.collect()}


def test_empty_table(spark):
    logs = spark.createDataFrame([], "run_id long, log string")
    assert log_token_counts(logs, MODEL).collect() == []


def test_a_model_whose_pieces_span_words_is_refused(monkeypatch):
    check_model(MODEL)
    monkeypatch.setattr("popstat.llm.token_counts.SPACE", "e")
    with pytest.raises(ValueError, match="spans words"):
        check_model(MODEL)
