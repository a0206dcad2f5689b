import math

import numpy as np

from regiotally.llm import piece_language
from tests.llm.cases import PIECES, documents, empty, prose, row


def brute(word, vocabulary, chances):
    """Sum over all segmentations, one by one."""
    text = piece_language.START + word

    def ways(at):
        if at == len(text):
            return np.ones(chances.shape[1])
        total = np.zeros(chances.shape[1])
        for end in range(at + 1, len(text) + 1):
            piece = vocabulary.ids.get(text[at:end], vocabulary.unknown if end == at + 1 else None)
            if piece is not None:
                total = total + chances[piece] * ways(end)
        return total

    return np.log(ways(0))


def test_scores_sum_all_segmentations():
    vocabulary = piece_language.vocabulary(PIECES)
    chances = np.random.default_rng(1).random((vocabulary.size, 3)) / 1000
    words = ["a", "the", "house", "straße", "日本x", "windows", "the"]
    assert np.allclose(vocabulary.scores(words, chances), [brute(w, vocabulary, chances) for w in words])
    long = "thehouse" * 12
    parts = vocabulary.scores([long], chances)[0]
    assert np.allclose(parts, vocabulary._long(long, chances)) and np.isfinite(parts).all()
    assert np.allclose(vocabulary._long("windows", chances), brute("windows", vocabulary, chances))


def test_expected_counts_cover_every_character():
    vocabulary = piece_language.vocabulary(PIECES)
    words = ["the", "house", "straßen", "日本"]
    total = vocabulary.expected(words, np.ones((len(words), 1)))[:, 0]
    lengths = np.array([len(p) for p in vocabulary.pieces] + [1])
    assert math.isclose((total * lengths).sum(), sum(len(w) + 1 for w in words), rel_tol=1e-9)


def test_languages_are_told_apart(spark):
    more = [row(100 + k, prose(60, 20 + k, lang), lang) for k, lang in enumerate(["en", "de"] * 6)]
    docs = documents(spark, more)
    model = piece_language.learn(docs, PIECES)
    assert model.languages == ["de", "en"]
    got = {(r.doc_id, r.text): r.p for r in docs.select("doc_id", "text", piece_language.predicted(model, "text").alias("p")).collect()}
    for (doc_id, text), p in got.items():
        if text is None or not any(map(str.isalpha, text)):
            assert (p.lang_pred, p.score) == ("und", 0.0)
        else:
            assert 0 < p.score <= 1
        if doc_id in (1, 2, 3, 4, 10):
            assert p.lang_pred == "en"
        if doc_id in (11, 12):
            assert p.lang_pred == "de"


def test_no_labelled_row_gives_no_language(spark):
    model = piece_language.learn(empty(spark), PIECES)
    assert model.languages == []
    assert {r.p.lang_pred for r in documents(spark).select(piece_language.predicted(model, "text").alias("p")).collect()} == {"und"}


def test_held_out_accuracy(spark, small):
    from regiotally.llm.queries import op8_piece_language

    found = op8_piece_language(spark, small)
    lang = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    rows = found.filter("held_out").join(lang, "doc_id").filter("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) > 0
