"""Ids by word (op4) against the plain tokenizer, and which words the whole tokenizer is asked for."""

import struct

from revforge.llm import tokens


def _plain(tok, text):
    return tokens._packed(tok.encode(text, add_special_tokens=False).ids) + tokens._END


class Counted:
    def __init__(self, tok):
        self.tok, self.words = tok, []

    def __getattr__(self, name):
        return getattr(self.tok, name)

    def encode_batch_fast(self, words, **kw):
        self.words += words
        return self.tok.encode_batch_fast(words, **kw)


def test_ids_equal_the_plain_ones():
    w = tokens.WordTokenizer()
    texts = ["can't they'd'll -- 's 'S x'ree 12ab3'v", "\u00c0\u00c9 \u00dftra\u00dfe na\u00efve\u00f7\u00d7\u00aa \u00ba", "a\x00b \x7f\x80 \x85 x\x1fy", "\u0130 \u0131 \u0149 \u01c5",
             "e\u0301 \u00e9", "<|x|> <|EndOfText|>", "``~^_[]{}\\ | \xad x\xady", "", "\u00bc\u00b23 \u00bdx", "\u65e5\u672c ABC's",
             " ".join(chr(c) + "a'" + chr(c) + "'s" + chr(c) for c in range(33, 0x250))]
    assert list(w.encode(texts)) == [_plain(w.tok, t) for t in texts]


def test_plain_words_ask_the_model_alone():
    w = tokens.WordTokenizer()
    w.tok = Counted(w.tok)
    got = list(w.encode(["raco.### atan*** \u00fc\u00fcsch it's 10% \u03b1\u03b2"]))
    assert w.tok.words == ["\u03b1\u03b2"]
    assert got == [_plain(w.tok, "raco.### atan*** \u00fc\u00fcsch it's 10% \u03b1\u03b2")]


def test_texts_of_more_words_than_are_kept(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 3)
    w = tokens.WordTokenizer()
    texts = ["a b c d e f g h", "e f g h i j k l", "a b c d e f g h i j k l m", "a m z", "b c"]
    assert list(w.encode(texts)) == [_plain(w.tok, t) for t in texts]
    assert struct.unpack("<I", tokens._END) == (tokens.END_ID,)
