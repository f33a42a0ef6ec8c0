"""Encoding of whole texts with a public tokenizer file, each distinct word once.

The tokenizer's normaliser and splitter never look across ASCII white space, so a text's ids are the ids of its
white-space separated pieces, one after another. A worker remembers the ids of pieces it has met. Pieces of plain ASCII
letters, with at most one full stop or comma at the end, skip the normaliser; all others go through the whole tokenizer.
"""

from __future__ import annotations

import array
import functools
import re
import sys

#: Pieces that a worker remembers; then it starts afresh.
REMEMBERED = 1_000_000
PLAIN = re.compile(rb"([a-z]+)([.,]?)")
JOINED = 1000


class WordEncoder:
    """Texts to bytes of little-endian unsigned 16-bit ids, for vocabularies of the word-end kind below 65,536 ids."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.last = {i for t, i in self.full.get_vocab().items() if t.endswith("</w>")}
        if self.full.get_vocab_size() >= 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.known: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return _pack(self.full.encode(text, add_special_tokens=False).ids)

    def _learn(self, pieces: set[bytes]) -> None:
        found = {p: m for p in pieces if (m := PLAIN.fullmatch(p))}
        stems = list({m[1] for m in found.values()}.difference(self.known))
        for i in range(0, len(stems), JOINED):
            part = stems[i : i + JOINED]
            own: list[list[int]] = [[]]
            for x in self.bare.encode(b" ".join(part).decode(), add_special_tokens=False).ids:
                own[-1].append(x)
                if x in self.last:
                    own.append([])
            if len(own) != len(part) + 1 or own[-1]:  # a word without an ending id: take each by itself
                own = [self.full.encode(s.decode(), add_special_tokens=False).ids for s in part]
            self.known.update((s, _pack(x)) for s, x in zip(part, own))
        end = {b"": b"", b".": self._whole("."), b",": self._whole(",")}
        self.known.update([(p, self.known[m[1]] + end[m[2]]) for p, m in found.items()])
        self.known.update((p, self._whole(p.decode())) for p in pieces if p not in found)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        raw = [(t or "").encode() for t in texts]
        # A special token is matched before lower-casing, so a text that may hold one keeps its case.
        pieces = [(t if b"<|" in t else t.lower()).split() for t in raw]
        known = self.known
        if unknown := set().union(*pieces).difference(known):
            self._learn(unknown)
        return [b"".join([known[p] for p in x]) for x in pieces]


def _pack(ids: list[int]) -> bytes:
    packed = array.array("H", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, kept between tasks."""
    return WordEncoder(path)
