"""Words that a worker has merged are not merged again while it may remember them."""

from rollforge.llm import tokens


def test_words_of_many_kinds_are_merged_once(monkeypatch):
    coder, merged = tokens.WordBpe(), []
    real = coder.merged
    monkeypatch.setattr(coder, "merged", lambda pieces: merged.extend(pieces) or real(pieces))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"q{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters[:10]]
    for _ in range(2):
        for begin in range(0, len(words), 20_000):
            coder.encode([" ".join(words[begin : begin + 20_000])])
    assert len(merged) == len(set(merged)) == len(words)
