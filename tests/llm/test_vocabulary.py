"""Forced-boundary splitting against whole-text encoding."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm.vocabulary import FOLDER, vocabulary

SAMPLES = [
    "", " ", "a", "Don't stop: it's 3.5% off!\n\n\n  Next   line\t\there 's 'll", "数据处理引擎在夜间运行，然后停止。第二句！" * 50,
    "naïve café — déjà vu… 'quoted' don’t", "x" * 5000, "ab'cd'ef" * 300, "🚀📉 sell-off 🇪🇸 " * 80, "<|endoftext|> is text <|endoftext|>" * 20,
    "　全角　空白　 mixed blanks \u0085 end" * 60, "0123456789" * 200, "\x1c\x1d a \x1f b" * 50, "हिन्दी में पाठ। 한국어 텍스트 עברית" * 40, "﻿bom​zero" * 40,
]


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
@pytest.mark.parametrize("i", range(len(SAMPLES)))
def test_fragments_give_the_same_ids(i, size):
    v, text = vocabulary(), SAMPLES[i]
    parts = v.fragments(text, size)
    assert "".join(parts) == text
    assert v.encode_by_fragments(text, size).tolist() == v.encode(text).tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sStlLrREeVvDdMm.,0123　中é")), max_size=300), st.integers(1, 12))
def test_fragments_of_any_text(text, size):
    v = vocabulary()
    assert v.encode_by_fragments(text, size).tolist() == v.encode(text).tolist()


def test_cuts_are_found():
    v = vocabulary()
    assert len(v.fragments("word and more words, again. " * 400, 100)) > 50
    assert len(v.fragments("数据处理引擎在夜间运行" * 400, 100)) > 50


def test_same_ids_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in SAMPLES:
        assert t.encode(text, add_special_tokens=False).ids == vocabulary().encode(text).tolist()


def test_texts_of_ordinary_length_are_cut():
    v = vocabulary()
    text = "word and more words, again. " * 60
    assert len(text) < 2000 and len(v.fragments(text)) > 2
    assert v.encode_by_fragments(text).tolist() == v.encode(text).tolist()


def test_nearly_every_text_with_a_cut_is_cut():
    v = vocabulary()
    for text in ("Note: all fine.", "Sell-off, then calm", "2024-05-01 07:30 ERROR x"):
        assert len(v.fragments(text)) > 1 and v.encode_by_fragments(text).tolist() == v.encode(text).tolist()


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_blocks_find_the_same_cuts(block, monkeypatch):
    from panelspark.llm import vocabulary as module

    v = vocabulary()
    want = [v.cuts(t.encode()).tolist() for t in SAMPLES]
    monkeypatch.setattr(module, "BLOCK", block)
    assert [v.cuts(t.encode()).tolist() for t in SAMPLES] == want


def test_what_is_remembered_stays_bounded(monkeypatch):
    from panelspark.llm import vocabulary as module

    v = vocabulary()
    monkeypatch.setattr(module, "REMEMBERED", 50)
    v.remembered.clear()
    text = "".join(f"{i}, word{i * 7919} " for i in range(2000))
    assert v.encode_by_fragments(text).tolist() == v.encode(text).tolist() and len(v.remembered) <= 50
