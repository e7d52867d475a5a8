"""Token ids of whole texts by a public tokenizer file, word by word through a cache."""

from __future__ import annotations

import hashlib
import json

import regex

#: A generation of the cache has so many words; the last one is kept beside it. It only saves time.
CACHE_WORDS = 200_000

_UNSAFE = regex.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f̀-\U0010ffff]|<\|")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_LOADED: dict[str, Encoder] = {}


class Encoder(dict):
    """Little-endian unsigned 32-bit ids per word between white space.

    The fast way holds for a lower-casing tokenizer whose words end at white space (``lowercase`` below) and for texts of
    code points under U+0300 without control characters, for which its normaliser only lowers the case; all other texts
    and tokenizers go through the library whole.
    """

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        model = json.loads(spec)
        steps = [x["type"] for x in (model.get("normalizer") or {}).get("normalizers", [])]
        self.fast = steps == ["NFC", "Replace", "Lowercase"] and model["model"].get("end_of_word_suffix") == "</w>"
        self.model = self.whole.model
        self.letters = str.maketrans(dict(enumerate(_byte_letters())))
        self.last: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.last = dict(self)
            self.clear()
        out = self.last.get(word)
        if out is None:
            pieces = [word] if word.isalpha() and word.isascii() else _PIECE.findall(word)
            if len(pieces) == 1:
                spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                out = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelt)])
            else:
                out = b"".join([self[p] for p in pieces])
        if len(word) <= 64:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` without special tokens, as the library gives them."""
        if not self.fast or (not text.isascii() and _UNSAFE.search(text)) or (text.isascii() and _UNSAFE.search(text)):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return b"".join([i.to_bytes(4, "little") for i in ids])
        return b"".join([self[w] for w in text.lower().split()])


def _byte_letters() -> list[str]:
    """The printable letter that byte-level tokenizers write for each byte: itself where printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def encoder(spec: str) -> Encoder:
    """One encoder per Python worker and tokenizer."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Encoder(spec)
    return _LOADED[key]


def load_spec(path: str | None = None) -> str:
    """The tokenizer file, read on the driver; about 2 MB whatever the input."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()
