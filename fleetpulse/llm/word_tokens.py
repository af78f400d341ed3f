"""Token ids of whole texts by a word-level BPE file, with repeated words looked up once."""

from __future__ import annotations

import os
from array import array

import numpy as np
import regex

from fleetpulse.llm.common import worker_cache

#: Fixed values of the tokenizer files: the pieces that a word is split into, each merged on its own.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these characters are their own NFC form and hold no white space, so they may be split here.
PLAIN = regex.compile(r"[!-~¡-¬®-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: visible Latin-1 characters for themselves, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordTokenizer:
    """``encode`` gives the ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives.

    Words are cut at ASCII white space, which no token crosses. Ids of short words are kept
    in a dictionary of at most ``most`` entries; plain new words go straight to the merge model,
    all others through the whole tokenizer.
    """

    @classmethod
    def shared(cls, file: str) -> WordTokenizer:
        """The one of this process, kept from task to task."""
        kept = worker_cache()
        if ("words", file) not in kept:
            kept["words", file] = cls(file)
        return kept["words", file]

    def __init__(self, file: str, most: int = 700_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if not os.path.exists(file):
            import public_tokenizers

            file = public_tokenizers.path(file)
        self.whole = Tokenizer.from_file(file)
        self.model = self.whole.model
        self.pieces = regex.compile(PIECE)
        self.letters = byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.known_pieces: dict[str, list[int]] = {}
        self.most = most

    def piece_ids(self, piece: str) -> list[int]:
        ids = self.known_pieces.get(piece)
        if ids is None:
            spelled = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            ids = [t.id for t in self.model.tokenize(spelled)]
            if len(self.known_pieces) >= self.most // 2:
                self.known_pieces.clear()
            self.known_pieces[piece] = ids
        return ids

    def word_ids(self, word: bytes) -> bytes:
        text = word.decode()
        core = text[:-1] if text[-1] in ".,;:!?" else text
        if core.isalpha() and len(word) <= 64 and (core.isascii() or max(core) <= "ÿ"):
            ids = self.piece_ids(core.lower())
            if len(core) < len(text):
                ids = ids + self.piece_ids(text[-1])
        elif len(word) <= 64 and b"<|" not in word and PLAIN.fullmatch(text):
            ids = [i for piece in self.pieces.findall(text.lower()) for i in self.piece_ids(piece)]
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        words, known = text.encode().split(), self.known
        if len(known) > self.most:
            known.clear()
        found = list(map(known.get, words))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    word = words[k]
                    ids = found[k] = known.get(word) or self.word_ids(word)
                    if len(word) <= 64:
                        known[word] = ids
        return np.frombuffer(b"".join(found), dtype=np.uint32)
