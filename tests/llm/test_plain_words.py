"""Chunks of letters alone are one piece, without the pattern; the ids stay those of the vocabulary's library."""

from rollforge.llm import tokens


class Watched:
    def __init__(self, pattern):
        self.pattern, self.seen = pattern, []

    def findall(self, text):
        self.seen.append(text)
        return self.pattern.findall(text)


def test_words_of_letters_skip_the_pattern(monkeypatch):
    watched = Watched(tokens.PIECES)
    monkeypatch.setattr(tokens, "PIECES", watched)
    coder = tokens.WordBpe(tokens.default_vocabulary())
    texts = ["Plain words plain Grün ªº it's 3rd x-y", None, "plain again, again"]
    ids = coder.encode(texts)
    assert sorted(watched.seen) == ["3rd", "again,", "it's", "x-y"]
    for text, found in zip(texts, ids, strict=True):
        assert memoryview(found).cast("I").tolist() == coder.library.encode(text or "", add_special_tokens=False).ids
