"""Subword ids of whole texts, by the tokenizers library.

Byte-level BPE with the usual pattern cuts a text at its white space: of a run of blanks before a word, all but the last
are one part; the last one joins the word if it is a space, else it stands alone; a run that ends the text is one part.
Words are cut further where a letter, a digit and a sign meet, but not beside an apostrophe or a character whose kind takes
more than its bytes to tell. Parts are encoded apart, so the encoder finds the parts of a few megabytes of text at once with numpy, gives the library only those that
it has not met yet, and copies the ids of all others from a table (of up to ``CACHED`` parts, by a 64-bit code of the bytes).
Texts with white space outside ASCII, with a part above ``LONGEST`` bytes or with the name of an added token, and all texts
of any other kind of tokenizer, go to the library whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .words import buffers, chunks, mix, powers

CACHED = 2_000_000
LONGEST = 255
IDS = np.dtype("<u4")
#: White space outside ASCII, and control characters that some patterns take for white space.
_OTHER_BLANK = "[\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Bytes that can begin such a character.
_RARE = np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_GROUP = 2000


def _kinds() -> np.ndarray:
    """Letters 1, digits 2, signs 3 of ASCII; all else 0, and the apostrophe too, since it may begin a part with the letters after it."""
    out = np.zeros(256, np.uint8)
    for i in range(128):
        out[i] = 0 if chr(i) == "'" or _BLANK[i] else 1 if chr(i).isalpha() else 2 if chr(i).isdigit() else 3
    return out


_KIND = _kinds()


def _changes(data: np.ndarray) -> np.ndarray:
    """Whether each byte but the first is of another known kind than the one before it. Latin letters with accents (lead byte C3) are letters."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs of multiplication and division
    kind[lead] = kind[lead + 1] = 1
    return (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, so that what it keeps serves all of the worker's tasks."""
    return Encoder(path)


def encoded(column: pa.Array, path: str, end_id: int | None = None):
    """For groups of texts of an Arrow column: number of the first, all ids one text after the other (with ``end_id`` after each), and each text's number of ids."""
    for first, _, offs in chunks(column):
        ids, each = encoder(path)(column.slice(first, len(offs) - 1))
        if end_id is not None:
            ids, each = np.insert(ids, np.cumsum(each), end_id), each + 1
        yield first, ids, each


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        line = self._whole("\n")
        self.parts = before.get("type") == "ByteLevel" and before.get("use_regex") is True and not before.get("add_prefix_space") and spec.get("normalizer") is None and len(line) == 1
        self.line = int(line[0]) if len(line) == 1 else -1
        self.codes, self.starts, self.sizes, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, IDS)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, IDS)

    def _learn(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the library, the ids of parts: an order of the parts, their ids in that order, and how many each has.

        Parts that begin alike are given together, one a line.
        """
        blank, spaced = _BLANK[data[at + size - 1]], data[at] == 32
        order, ids, counts = [], [], []
        for alike in (np.flatnonzero(spaced & ~blank), np.flatnonzero(~spaced & ~blank)):
            groups = [alike[i : i + _GROUP] for i in range(0, len(alike), _GROUP)]
            texts = []
            for g in groups:
                upto = np.cumsum(size[g] + 1)
                lines = data[np.minimum(np.repeat(at[g] - (upto - size[g] - 1), size[g] + 1) + np.arange(upto[-1]), len(data) - 1)]
                lines[upto - 1] = 10
                texts.append(lines.tobytes().decode())
            for g, e in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                found = np.array(e.ids, IDS)
                cuts = np.flatnonzero(found == self.line)
                if len(cuts) == len(g):
                    order.append(g)
                    ids.append(np.delete(found, cuts))
                    counts.append(np.diff(cuts, prepend=-1) - 1)
                else:  # a part holds the id of a line break: each alone
                    blank[g] = True
        for i in np.flatnonzero(blank).tolist():
            ids.append(self._whole(data[at[i] : at[i] + size[i]].tobytes().decode()))
            order.append(np.array([i]))
            counts.append(np.array([len(ids[-1])]))
        return np.concatenate(order), np.concatenate(ids), np.concatenate(counts)

    def _apart(self, column: pa.Array, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Which texts go to the library whole."""
        if not self.parts:
            return np.ones(len(column), bool)
        out = np.zeros(len(column), bool)
        if _RARE[data].any():
            out |= pc.match_substring_regex(column, _OTHER_BLANK).to_numpy(zero_copy_only=False)
        for name in self.added:
            out |= pc.match_substring(column, name).to_numpy(zero_copy_only=False)
        return out

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and how many each has; null counts as empty."""
        column = pc.fill_null(column, "") if column.null_count else column
        data, offs = buffers(column)
        data, offs = data[offs[0] : offs[-1]], offs - offs[0]
        n, m = len(data), len(column)
        if not n:
            return np.empty(0, IDS), np.zeros(m, np.int64)
        apart = self._apart(column, data, offs)
        blank = _BLANK[data]
        head = np.zeros(n + 1, bool)
        head[offs] = True
        cut = head[:-1].copy()
        cut[1:] |= blank[1:] & ~blank[:-1]
        cut[1:] |= ~blank[1:] & blank[:-1] & (data[:-1] != 32)
        cut[1:-1] |= blank[1:-1] & blank[:-2] & ~blank[2:] & ~head[2:-1]
        cut[1:] |= _changes(data)
        at = np.flatnonzero(cut)
        size = np.diff(at, append=n)
        text = np.repeat(np.arange(m), np.diff(np.searchsorted(at, offs)))
        apart[text[size > LONGEST]] = True
        up, down = powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        codes = mix((total[at + size] - total[at]) * down[at] + size.astype(np.uint64))
        if apart.any():
            mine = ~apart[text]
            at, size, text, codes = at[mine], size[mine], text[mine], codes[mine]
        which, names = pd.factorize(codes)
        place = np.searchsorted(self.codes, names)
        new = np.flatnonzero(self.codes[np.minimum(place, len(self.codes) - 1)] != names) if len(self.codes) else np.arange(len(names))
        codes_, starts, sizes, ids = self.codes, self.starts, self.sizes, self.ids
        if len(new):
            first = np.empty(len(names), np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            order, learnt, counts = self._learn(data, at[first[new]], size[first[new]])
            begin = len(ids) + np.cumsum(counts) - counts
            sort = np.argsort(names[new][order])
            order = order[sort]
            spot = np.searchsorted(codes_, names[new][order])
            codes_, starts, sizes = np.insert(codes_, spot, names[new][order]), np.insert(starts, spot, begin[sort]), np.insert(sizes, spot, counts[sort])
            ids = np.concatenate((ids, learnt))
            if len(codes_) <= CACHED:  # else what is new is used once
                self.codes, self.starts, self.sizes, self.ids = codes_, starts, sizes, ids
            place = np.searchsorted(codes_, names)
        if len(names):
            start, count = starts[place][which], sizes[place][which]
        else:
            start = count = np.empty(0, np.int64)
        each = np.bincount(text, weights=count, minlength=m).astype(np.int64)
        upto = np.cumsum(count)
        out = ids[np.repeat(start - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)]
        if not apart.any():
            return out, each
        whole = np.flatnonzero(apart)
        parts = np.split(out, np.cumsum(each)[:-1])
        for i, e in zip(whole.tolist(), self.library.encode_batch_fast(column.take(pa.array(whole)).to_pylist(), add_special_tokens=False), strict=True):
            parts[i] = np.array(e.ids, IDS)
            each[i] = len(parts[i])
        return np.concatenate(parts), each
