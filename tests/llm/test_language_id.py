import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.language_id import BLOCK, build_model, fold, identify_languages, suffix_automaton, train_languages
from millrace.llm.queries import op9_language_id
from millrace.sources.tables import table

from .conftest import SMALL, TRICKY


def plain_phrases(symbols, training):
    """Greedy longest-match phrases by substring search, block by block."""
    total = 0
    for at in range(0, len(symbols), BLOCK):
        block, i = symbols[at : at + BLOCK], 0
        while i < len(block):
            n = 1
            while i + n < len(block) and block[i : i + n + 1] in training:
                n += 1
            total, i = total + 1, i + n
    return total


def test_phrases_agree_with_substring_search():
    rng = random.Random(4)
    samples = {"x": "".join(rng.choices("abc ", k=700)), "y": "".join(rng.choices("bcdé", k=300)), "z": "q"}
    model = build_model({k: v.encode() for k, v in samples.items()})
    code = lambda b: "".join(chr(100 + x) for x in fold(b, model.symbols))
    texts = ["".join(rng.choices("abcdé ,Bü漢", k=rng.choice([1, 5, 255, 256, 257, 900]))) for _ in range(60)]
    got = model.phrases([t.encode() for t in texts])
    for text, row in zip(texts, got):
        for k, name in enumerate(model.languages):
            assert row[k] == pytest.approx(plain_phrases(code(text.encode()), code(samples[name].encode())) * model.weights[k])


def test_automaton_spells_substrings_only():
    text = [1, 2, 1, 1, 3, 2, 1, 2]
    edges = suffix_automaton(text)
    spelled, stack = set(), [(0, ())]
    while stack:
        state, word = stack.pop()
        spelled.add(word)
        stack += [(to, (*word, c)) for c, to in edges[state].items()]
    assert spelled == {tuple(text[i:j]) for i in range(9) for j in range(i, 9)}


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in table(spark, SMALL, "documents").collect()}
    rows = op9_language_id(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.lang_pred != "und" and len(docs[r.doc_id].text) > 40]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97


def test_tricky_rows(spark, docs_of):
    model = build_model({"en": b"the word of a row without an id one two", "de": "Straße naïve und der".encode()})
    docs = docs_of([*TRICKY, (50, "1234 !? 5"), (51, "漢字")])
    rows = identify_languages(docs, model, keep=("doc_id", "lang", "source")).collect()
    assert len(rows) == len(TRICKY) + 2 and rows[0].lang == "clash-lang"
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 50))
    assert by[7].lang_pred == by[None].lang_pred == "en" and by[51].lang_pred in ("en", "de")
    assert {r.lang_pred for r in identify_languages(docs, build_model({})).collect()} == {"und"}
    assert identify_languages(docs_of([]), model).collect() == []


def test_training_takes_labelled_rows_only(spark):
    docs = spark.createDataFrame([(1, "aaa", "x"), (2, "bbb", None), (None, "ccc", "y"), (4, None, "z"), (5, "ddd", "w"), (5, "ddd", "w")], "doc_id long, text string, lang string")
    assert train_languages(docs).languages == ["w", "x"]
    assert train_languages(docs, F.col("doc_id") != 5).languages == ["x"]
    assert train_languages(docs.limit(0)).languages == []
