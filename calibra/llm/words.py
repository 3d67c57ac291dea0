"""White-space chunks and pre-tokens as the lower-casing word vocabulary sees them."""

from __future__ import annotations

import json
import re
import unicodedata

import regex

#: Python counts these four control characters as white space, Unicode's White_Space property doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def chunks(text: str) -> list[str]:
    """Runs without Unicode white space. No token of the word vocabulary crosses white space: its normaliser makes
    each run of it one space, and its pre-tokenizer keeps no space."""
    if _SEPARATORS.search(text):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it's visible, else the next one from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    names, spare = [], 256
    for b in range(256):
        names.append(chr(b if b in visible else spare))
        spare += b not in visible
    return names


class PreTokens:
    """Normalises a chunk and splits it into pre-tokens, written in the byte alphabet.

    Latin text takes a short way. Anything else goes to the library's own normaliser and splitter, whose tables of
    Unicode need not be of the same version as Python's.
    """

    _LATIN = re.compile("[!-~\xa1-\u024f]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.find = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")).findall
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_specials = re.compile(f"({'|'.join(map(re.escape, specials))})").split
        self.letters = byte_alphabet()

    def of(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk that holds no special string."""
        if chunk.isascii() and chunk.isprintable():
            return self.find(chunk.lower())
        if self._LATIN.fullmatch(chunk):
            return [self.spell(w) for w in self.find(unicodedata.normalize("NFC", chunk).lower())]
        normal = self.library.normalizer.normalize_str(chunk)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def spell(self, word: str) -> str:
        return word if word.isascii() else "".join([self.letters[b] for b in word.encode()])

    def parts(self, chunk: str) -> list[str]:
        """The chunk cut at special strings, which stand at the odd places."""
        return self.split_specials(chunk) if "<|" in chunk else [chunk]
