"""Token ids by the tokenizers library, with each distinct word encoded once.

A byte-level BPE never merges over the place before a single space, or around a single line feed, that stands
between two characters that aren't white space. So a text is cut there, distinct pieces go through the library
in batches, and the pieces' ids are joined. A text with any other white space, or with a special token's mark,
goes through the library whole. Either way the ids are the library's for the whole text.
"""

from __future__ import annotations

import functools
import os
import sys
from itertools import accumulate, chain

import numpy as np
import public_tokenizers

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of distinct pieces, with their ids, that a worker keeps, what an entry takes besides its objects, and the longest piece.
KEPT_BYTES, ENTRY_BYTES, KEPT_LENGTH = 128 << 20, 104, 48


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


class _Pieces(dict):
    """Piece to ids; notes the pieces that it doesn't have. None: the piece can't stand alone."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> None:
        self.new.append(piece)
        self[piece] = None


class IdEncoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task slots are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pieces = _Pieces()
        self.kept = 0
        #: Bytes of each id: a byte-level token has a character for each byte.
        self.lengths = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.lengths[i] = len(token)

    def _encode(self, texts: list[str]) -> list[bytes]:
        ids = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        ends = list(accumulate((4 * len(x) for x in ids), initial=0))
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """One call for many pieces: a line feed keeps those without a space apart, and bytes tell whose an id is."""
        if not pieces:
            return []
        apart = np.fromiter((p[0] not in " \n" for p in pieces), np.int64, len(pieces))
        ids = self._encode(["".join(p if p[0] in " \n" else "\n" + p for p in pieces)])[0]
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, pieces)), np.int64, len(pieces)) + apart)
        at = np.concatenate([[0], np.searchsorted(np.cumsum(self.lengths[np.frombuffer(ids, "<u4")]), ends) + 1])
        return [ids[4 * a : 4 * b] for a, b in zip((at[:-1] + apart).tolist(), at[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        cuts = list(map(_cut, texts))
        look, new = self.pieces.__getitem__, self.pieces.new
        found = [list(map(look, cut)) for cut in cuts]
        good = [p for p in new if p == "\n" or p.strip(" ") and not p[-1].isspace() and not p[p[0] == " "].isspace()]
        for i in range(0, len(good), 5000):
            part = good[i : i + 5000]
            self.pieces.update(zip(part, self._encode_pieces(part), strict=True))
        out: list[bytes] = []
        for text, cut, ids in zip(texts, cuts, found, strict=True):
            i = -1
            for _ in range(ids.count(None)):
                i = ids.index(None, i + 1)
                if (piece := look(cut[i])) is None:
                    break
                ids[i] = piece
            out.append(b"".join(ids) if text and ids and None not in ids else b"")
        whole = [i for i, text in enumerate(texts) if text and not out[i]]
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        for p in new:
            if self.kept > KEPT_BYTES or len(p) > KEPT_LENGTH:
                del self.pieces[p]
            else:
                self.kept += ENTRY_BYTES + sys.getsizeof(p) + sys.getsizeof(look(p))
        new.clear()
        return out


def _cut(text: str) -> list[str]:
    """Pieces with their leading space; line feeds alone. None of them: the text can't be cut."""
    if not text or "\x00" in text or "<|" in text or text[0].isspace() or text[-1].isspace():
        return []
    return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")


@functools.cache
def encoder(path: str) -> IdEncoder:
    """One for each worker process."""
    return IdEncoder(path)
