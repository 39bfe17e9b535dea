"""Public tokenizers in tasks: ids and character spans of whole texts.

Both vocabularies split a text into pre-tokens and encode each on its own. Texts of
common characters are split here and the encoding of every pre-token is kept, which
is many times faster than encoding texts; any other text goes to the tokenizer
whole. Both ways give the same ids and spans; the tests compare them.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Collection
from itertools import chain

import numpy as np

from ledgerline.llm.common import process_cache

# Letters and numbers among the common characters: ASCII, Latin-1 and Latin
# Extended-A and -B, without the dotted capital I, whose lower case is two characters.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ"
NUMBERS = "0-9²³¹¼-¾"
COMMON = re.compile("[\t\n\r\x20-\x7e¡-įı-ɏ‐-‧]*")
#: strings that a tokenizer may read as one special token
SPECIAL = re.compile(r"<\|(startoftext|endoftext)\|>")
#: kept pre-tokens per process
KEPT = 400_000

WORD_PRETOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\t\n\r {LETTERS}{NUMBERS}]+")
BYTE_PRETOKENS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\t\n\r {LETTERS}{NUMBERS}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"
)

# Byte-level vocabularies write a byte as a printable character: itself, or one from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Encoder:
    """One tokenizer file with its kept pre-tokens."""

    def __init__(self, path: str, special_is_text: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_is_text
        self.model = self.tokenizer.model
        self.lowers = self.tokenizer.normalizer is not None
        self.pretokens = WORD_PRETOKENS if self.lowers else BYTE_PRETOKENS
        self.special_is_text = special_is_text
        self.ids: dict[str, bytes] = {}
        self.spans: dict[str, tuple[bytes, bytes]] = {}

    def _split(self, text: str) -> list[str] | None:
        """Pre-tokens of a text of common characters, else None."""
        if not COMMON.fullmatch(text) or (not self.special_is_text and SPECIAL.search(text)):
            return None
        return self.pretokens.findall(text.lower() if self.lowers else text)

    def _missing(self, words: Collection[str], kept: dict) -> list[str]:
        if len(kept) > KEPT:
            kept.clear()
        return [w for w in set(words) if w not in kept]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        words = self._split(text)
        if words is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        kept = self.ids
        try:
            return b"".join(map(kept.__getitem__, words))
        except KeyError:
            for w in self._missing(words, kept):
                tokens = self.model.tokenize(w.encode("utf-8").decode("latin-1").translate(_BYTE_CHARACTERS))
                kept[w] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            return b"".join(map(kept.__getitem__, words))

    def _keep_spans(self, missing: list[str]) -> None:
        plain = [w for w in missing if w.isascii()]
        for w in plain:  # a character is a byte and every token has its characters
            sizes = [len(t.value) for t in self.model.tokenize(w.translate(_BYTE_CHARACTERS))]
            ends = np.cumsum(sizes, dtype="<u4")
            self.spans[w] = (ends - np.array(sizes, "<u4")).tobytes(), ends.tobytes()
        others = [w for w in missing if not w.isascii()]
        for w, e in zip(others, self.tokenizer.encode_batch(others, add_special_tokens=False)):
            both = np.array(e.offsets, "<u4").reshape(-1, 2)
            self.spans[w] = both[:, 0].tobytes(), both[:, 1].tobytes()

    def block_spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end character of every token of the texts set end to end, and the tokens of each text.

        For tokenizers that keep all characters. Every text is split once.
        """
        split = [self._split(t) for t in texts]
        kept = self.spans
        self._keep_spans(self._missing(set(chain.from_iterable(filter(None, split))), kept))
        found, lengths, words = [], [], []
        for text, own in zip(texts, split):
            if own is None:
                both = np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, "<u4").reshape(-1, 2)
                found.append((both[:, 0].tobytes(), both[:, 1].tobytes()))
                lengths.append(len(text))
                words.append(1)
            else:
                found += map(kept.__getitem__, own)
                lengths += map(len, own)
                words.append(len(own))
        sizes = np.array(lengths, np.int64)
        tokens = np.fromiter((len(s) // 4 for s, _ in found), np.int64, len(found))
        shift = np.repeat(np.cumsum(sizes) - sizes, tokens)
        starts, ends = (np.frombuffer(b"".join([f[i] for f in found]), "<u4") for i in (0, 1))
        before = np.concatenate(([0], np.cumsum(tokens)))[np.cumsum([0, *words])]
        return starts + shift, ends + shift, np.diff(before)

    def token_spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of every token of one text."""
        return self.block_spans([text])[:2]


def encoder(path: str, special_is_text: bool = False) -> Encoder:
    """The encoder of a file, built once per Python process."""
    return process_cache(f"encoder:{path}:{special_is_text}", lambda: Encoder(path, special_is_text))
