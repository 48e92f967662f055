"""Cached encoding by the tokenizers library: texts are cut where no token can reach over, cut pieces are encoded once."""

from __future__ import annotations

import numpy as np

#: Bytes of cached cut pieces a worker keeps; when full, the cache starts again.
CACHE_BYTES = 96 << 20


class Encoder:
    """ids of cut pieces by the library, many new pieces a call."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and the number of ids of each piece."""
        got = self.library.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        owners = np.array(got.word_ids, np.float64)  # None becomes not a number
        if np.isnan(owners).any():  # special strings inside a piece have no owner
            lists = [e.ids for e in self.library.encode_batch(pieces, add_special_tokens=False)]
            return np.array([i for x in lists for i in x], "<u4"), np.array(list(map(len, lists)), np.int64)
        return np.array(got.ids, "<u4"), np.bincount(owners.astype(np.int64), minlength=len(pieces))
