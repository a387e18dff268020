"""Token ids of whole texts, one lookup per word.

The tokenizer splits at white space before anything else, so a text's ids are its words' ids in a row.
Words repeat; each worker keeps the ids of the words it has met (the older half goes when full) and asks the
tokenizer for new words only: the byte-pair model itself where a word's pieces are plain to see (lower-case
letters of Latin-1, digits and ASCII marks), else the whole tokenizer. A text with separators on which Python and
the tokenizer disagree, or with the literal of an added token such as <|endoftext|>, is encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

END_ID = 1
KEPT_WORDS = 300_000
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
# beyond Latin letters lower-casing depends on context, and composition may change a word
_BEYOND = re.compile("[^\x00-\u024f]|\u0130")
# what may stand in a text whose words are met in one form: lower-case letters, blanks, full stops and commas
_PLAIN = bytes([*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100), *b" \t\n\r.,"])
_END = struct.pack("<I", END_ID)
# a new word of these characters only needs neither normalizing nor the tokenizer's own splitting, given these two
_DIRECT = re.compile("[!-@\\[-~\u00df-\u00f6\u00f8-\u00ff]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_NORMALIZER = 'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\\s+"), content=" "), Lowercase()])'
_SPLITTER = ("Sequence(pretokenizers=[Split(pattern=Regex(\"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+\"), "
             "behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level model: itself if it prints, else the next one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(0x100)]


_LETTERS = _byte_letters()


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _words(text: str) -> list[str]:
    """Words whose ids, in a row, are the text's: split at white space and, in plain Latin text, around
    lone full stops and commas, so that a word is met in one form."""
    if text.isascii() or not _BEYOND.search(text):
        text = text.lower()
        try:
            plain = not text.encode("latin-1").translate(None, _PLAIN)
        except UnicodeEncodeError:
            plain = False
        if plain and not (".." in text or ",," in text or ".," in text or ",." in text):
            text = text.replace(".", " . ").replace(",", " , ")
    return text.split()


class WordTokenizer:
    def __init__(self, path: str | None = None) -> None:
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks run side by side already
        self.tok = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tok.get_added_tokens_decoder().values()]  # lower-casing words could make a literal
        assert all("<|" in x for x in self.added)
        plain = str(self.tok.normalizer) == _NORMALIZER and str(self.tok.pre_tokenizer) == _SPLITTER
        self.model = self.tok.model if plain else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece by the model alone."""
        letters = piece if piece.isascii() else "".join([_LETTERS[b] for b in piece.encode()])
        return _packed([t.id for t in self.model.tokenize(letters)])

    def _direct(self, word: str) -> bytes:
        """Ids of a word that ``_DIRECT`` matches: its pieces' in a row, marks and digits met before looked up."""
        if word.isalpha():
            return self._piece(word)
        out = []
        for p in _PIECES.findall(word):
            ids = self.known.get(p)
            if ids is None:
                ids = self.known[p] = self._piece(p)
            out.append(ids)
        return b"".join(out)

    def _learn(self, words: set[str]) -> None:
        new = []
        for w in words:
            if w in self.older:
                self.known[w] = self.older[w]
            elif self.model and _DIRECT.fullmatch(w):
                self.known[w] = self._direct(w)
            else:
                new.append(w)
        for at in range(0, len(new), 10_000):
            part = new[at:at + 10_000]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                self.known[w] = _packed(e.ids)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end token."""
        for text in texts:
            # every added token holds "<|", whatever the case
            if any(x in text for x in _SEPARATORS) or "<|" in text and any(x in text.lower() for x in self.added):
                yield _packed(self.tok.encode(text, add_special_tokens=False).ids) + _END
                continue
            words = _words(text)
            need = set(words)
            new = need.difference(self.known)
            if new:
                if len(self.known) > KEPT_WORDS:
                    self.older, self.known, new = self.known, {}, need
                self._learn(new)
            yield b"".join(map(self.known.__getitem__, words)) + _END


@lru_cache(maxsize=2)
def tokenizer(path: str | None = None) -> WordTokenizer:
    """One tokenizer, with the words it knows, for all tasks of a Python worker."""
    return WordTokenizer(path)
