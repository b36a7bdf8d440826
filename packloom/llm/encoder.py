"""Token ids of whole texts by the tokenizers library, one library call per group of new words.

Every text is cut at ASCII white space, where a tokenizer whose pre-tokenizer drops white space never
merges; equal words (A-Z lowered, as the tokenizer lowers them itself) are encoded once per worker and
looked up by a 64-bit hash. Texts that may hold the string of a special token go to the library whole.
"""
from __future__ import annotations

import functools
import os
import unicodedata

import numpy as np

from packloom.llm import words as W

_GROUP, _KEPT = 4096, 1_000_000


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size()
        self.n_ids = size
        self.length = np.zeros(size, np.int64)
        for token, i in self.tok.get_vocab().items():
            self.length[i] = len(token.removesuffix("</w>"))
        closed = np.zeros(size, bool)
        closed[[i for token, i in self.tok.get_vocab().items() if token.endswith("</w>")]] = True
        self.inner = ~closed if closed.any() else closed  # ids that leave their word open, where ids tell
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.n, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)  # without the offsets that encode works out

    def _encode(self, missing: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids one after another."""
        counts, parts = np.zeros(len(missing), np.int64), [None] * len(missing)
        plain, other = [], []
        for i, w in enumerate(missing):
            if w.isascii():
                ok = min(w) > 31
            else:
                s = w.decode()
                ok = len(s.split()) == 1 and s == s.strip() and len(unicodedata.normalize("NFC", s).lower().encode()) == len(w) and min(s) > "\x1f"
            (plain if ok else other).append(i)
        for g in range(0, len(plain), _GROUP):
            group = plain[g: g + _GROUP]
            ids = self.whole(b" ".join(missing[i] for i in group).decode())
            ends = np.cumsum(self.length[ids])
            want = np.cumsum([len(missing[i]) for i in group])
            cut = np.searchsorted(ends, want, "left")
            if not len(ids) or ends[-1] != want[-1] or (ends[np.minimum(cut, len(ends) - 1)] != want).any():
                other += group
                continue
            cut += 1
            for i, a, b in zip(group, np.concatenate(([0], cut[:-1])), cut):
                counts[i], parts[i] = b - a, ids[a:b]
        for i in other:
            parts[i] = self.whole(missing[i].decode())
            counts[i] = len(parts[i])
        return counts, np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def _places(self, data, starts, ends, key) -> np.ndarray:
        """Index of every word in the cache."""
        unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > _KEPT:
            self._clear()
        j = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        if len(self.keys):
            known = self.keys[np.minimum(j, len(self.keys) - 1)] == unique
        new = np.flatnonzero(~known)
        if len(new):
            low = W.LOWER[data].tobytes()
            n, ids = self._encode([low[starts[k]: ends[k]] for k in first[new]])
            base = len(self.n)
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(n) - n])
            self.n, self.flat = np.concatenate([self.n, n]), np.concatenate([self.flat, ids])
            keys = np.concatenate([self.keys, unique[new]])
            place = np.concatenate([self.place, base + np.arange(len(new))])
            order = np.argsort(keys, kind="stable")
            self.keys, self.place = keys[order], place[order]
            j = np.searchsorted(self.keys, unique)
        return self.place[j][inverse] if len(unique) else np.zeros(0, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray, found: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text). ``found``: (text index, start, end, hash) of the words, if known."""
        n_texts = len(offsets) - 1
        if found is None:
            doc, starts, ends = W.spans(data, offsets, W.NOT_SPACE)
            key = W.hashes(data, starts, ends)
        else:
            doc, starts, ends, key = found
        special = np.zeros(n_texts, bool)
        if len(data) > 1:
            hit = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
            special[np.searchsorted(offsets, hit, "right") - 1] = True
        if special.any():
            keep = ~special[doc]
            doc, starts, ends, key = doc[keep], starts[keep], ends[keep], key[keep]
        place = self._places(data, starts, ends, key)
        n = self.n[place] if len(place) else np.zeros(0, np.int64)
        total = int(n.sum())
        step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        ids = self.flat[np.repeat(self.at[place], n) + step] if total else np.zeros(0, np.int32)
        per = np.bincount(doc, weights=n, minlength=n_texts).astype(np.int64)
        if special.any():
            cut, parts = np.split(ids, np.cumsum(per)[:-1]), []
            for i in range(n_texts):
                parts.append(self.whole(data[offsets[i]: offsets[i + 1]].tobytes().decode()) if special[i] else cut[i])
            per = np.array([len(p) for p in parts], np.int64)
            ids = np.concatenate(parts)
        return ids, per


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder, with its cache of words, per worker."""
    return WordEncoder(path)
