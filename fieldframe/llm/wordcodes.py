"""Token ids of whole texts by a public tokenizer, as little-endian unsigned 32-bit integers.

White space of ASCII never lies within a token and never changes its
neighbours (the tokenizer's own splitting drops it), so a text's ids are the
ids of its white-space-free pieces in a row. Pieces repeat, so their ids are
kept in bounded dictionaries per Python worker. The tokenizer lower-cases, so
ASCII letters are lower-cased first (unless a special token's opening is near),
and it parts letters, digits and signs. Pieces of printable characters below
U+0250, which its normal form leaves as they are, are parted here by the same
pattern and go to the tokenizer's BPE model part by part; all others go
through the whole tokenizer. So do whole texts where a tokenizer file
normalizes or parts text in another way.
"""

from __future__ import annotations

import codecs
import gc
import json
import os
import struct

import numpy as np
import regex

from .common import sole

#: Pieces in one generation of a worker's dictionary. When it is full it
#: becomes the old one, from which pieces still in use are taken over.
CACHE_PIECES = 300_000

# How the tokenizer file that is understood here normalizes and parts texts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

PARTS = regex.compile(SPLIT)
#: Printable characters below U+0250 without the capital dotted I, whose small form is two characters.
PLAIN = regex.compile("[\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]+")


def _symbols() -> str:
    """The character by which byte-level models write each byte: itself if visible, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return "".join(chr(b if b in visible else next(hidden)) for b in range(256))


SYMBOLS = _symbols()

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of texts by the tokenizer file at `path`."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)  # without offsets, if it can
        self._model = self.tokenizer.model
        form = [json.loads(part.__getstate__()) if part else None for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        self.by_words = form == [NORMALIZER, PRE_TOKENIZER] and not getattr(self._model, "dropout", None)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.cache_pieces = cache_pieces

    def _word(self, part: str) -> bytes:
        """Ids of a run of letters, a digit or a run of signs, by the tokenizer's own model."""
        symbols = part if part.isascii() else codecs.charmap_decode(part.encode(), "strict", SYMBOLS)[0]
        ids = [token.id for token in self._model.tokenize(symbols)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, pieces: list[bytes]) -> None:
        """Ids of new pieces: plain ones part by part, the others by the whole tokenizer."""
        new, take, word, plain = self.new, self.old.get, self._word, PLAIN.fullmatch
        rest: list[tuple[bytes, str]] = []
        for piece in pieces:
            text = piece.decode("utf-8", "replace")
            if not plain(text) or "<|" in text:
                rest.append((piece, text))
                continue
            lower = text.lower()
            parts = [lower] if lower.isalpha() else PARTS.findall(lower)
            if len(parts) == 1:
                new[piece] = word(parts[0])
                continue
            found = []
            for part in parts:
                key = part.encode()
                ids = new.get(key) or take(key)
                if ids is None:
                    ids = word(part)
                new[key] = ids
                found.append(ids)
            new[piece] = b"".join(found)
        for first in range(0, len(rest), 20_000):
            some = rest[first : first + 20_000]
            for (piece, _), found in zip(some, self._batch([text for _, text in some], add_special_tokens=False)):
                new[piece] = np.array(found.ids, "<u4").tobytes()

    def learn(self, pool: set[bytes]) -> None:
        """Put the ids of all pieces in the pool into the new dictionary."""
        if len(self.new) > self.cache_pieces:
            self.old, self.new = self.new, {}
        missing: list[bytes] = []
        take = self.old.get
        for piece in pool.difference(self.new):
            known = take(piece)
            if known is None:
                missing.append(piece)
            else:
                self.new[piece] = known
        self._encode(missing)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Each text's ids, four bytes an id; null is an empty text."""
        collecting = gc.isenabled()
        gc.disable()  # millions of objects and no cycles: the collector would walk them again and again
        try:
            return self._encode_texts(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_texts(self, texts: list[bytes | None]) -> list[bytes]:
        if not self.by_words:
            return [np.array(x.ids, "<u4").tobytes() for x in self._batch([(t or b"").decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        out: list = []
        gaps: list[tuple[int, list[tuple[int, bytes]]]] = []
        get = self.new.get
        for text in texts:  # text by text: its pieces are looked up while they are still in the processor's cache
            words = (text if b"<|" in text else text.lower()).split() if text else []
            ids = list(map(get, words))
            if None in ids:
                gaps.append((len(out), [(i, words[i]) for i, x in enumerate(ids) if x is None]))
                out.append(ids)
            else:
                out.append(b"".join(ids))
        self.learn({piece for _, own in gaps for _, piece in own})
        for k, own in gaps:
            for i, piece in own:
                out[k][i] = self.new[piece]
            out[k] = b"".join(out[k])
        return out


def encoder(path: str, cache_pieces: int = CACHE_PIECES) -> Encoder:
    """The worker's encoder for a tokenizer file, made once and kept until another operator needs the memory."""
    sole("wordcodes", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].cache_pieces = cache_pieces
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
