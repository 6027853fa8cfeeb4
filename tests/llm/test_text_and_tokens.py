import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollforge.llm import textkit
from rollforge.llm.tokens import WordBpe, word_bpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [None, "", " ", "a", "A b", "one two three four five", "One two  three\tfour\nfive six", "é É ß ẞ", "x" * 5000, " lead", "trail "]


def model(text, k=5):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def test_set_sizes_are_those_of_word_tuples():
    got = {row: len(s) for row, s in textkit.shingle_sets(pa.array(TEXTS, pa.string()))}
    assert got == {i: len(model(t)) for i, t in enumerate(TEXTS)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbB \n\t\x0bé,.", max_size=60), min_size=1, max_size=6))
def test_equal_sets_have_equal_hashes(texts):
    sets = dict(textkit.shingle_sets(pa.array(texts, pa.string())))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(model(a) & model(b))


def test_rows_do_not_run_into_each_other_and_slices_work():
    column = pa.array(["a b c d", "e f g h i", "j"], pa.string())
    whole = dict(textkit.shingle_sets(column))
    part = dict(textkit.shingle_sets(column.slice(1, 2)))
    assert np.array_equal(whole[1], part[0]) and np.array_equal(whole[2], part[1])
    assert [len(s) for s in whole.values()] == [1, 1, 1]


@pytest.fixture(scope="module")
def coder():
    return word_bpe()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeé ABC'stdmvrlß ÀÖ12²½.,!<|>…Σσς\u0301\x1c\t\n中文ñ_-#\u0085", max_size=80))
def test_ids_are_the_librarys(text):
    coder = word_bpe()
    assert coder.encode([text])[0] == np.array(coder.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_of_words_seen_again_and_special_strings(coder):
    texts = ["it's we'll I'd don't", "<|endoftext|> hi", "a" * 3000, "", None, "The the THE the."]
    for _ in range(2):
        got = coder.encode(texts)
        assert got == [np.array(coder.library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_a_full_cache_keeps_giving_the_same_ids(monkeypatch):
    from rollforge.llm import tokens

    monkeypatch.setattr(tokens, "KEPT", 5)
    small = WordBpe()
    texts = [" ".join(f"word{i}x{j}" for j in range(20)) for i in range(10)] * 2
    assert [small.encode([t])[0] for t in texts] == word_bpe().encode(texts)
