"""Ids of whole texts under a SentencePiece model of the merge type, and texts of ids.

Merging the best-ranked neighbours until none is left has one result, and a row of pieces is that result exactly if merging each two
neighbours alone gives them back. So the encoder takes the longest piece at a place (Aho-Corasick), asks whether it stands beside the
last one when the two are merged again, else tries the next shorter piece, and steps back where none fits. Places that were left
that way are kept in a bitfield: only one row of pieces leads to a place, so no other try may pass it. Pieces that merging never makes don't take part.

No piece crosses two neighbouring bytes that stand together in no piece, so texts are cut there, and a part that was met before
is copied from a table (by a 64-bit code of its bytes, up to ``CACHED`` parts). No library takes part in the encoding.

Models: merge type with byte fallback and the identity normaliser that keeps white space, with or without the blank in front;
user-defined or unused pieces and other models raise. Cases: null and empty texts have no ids; a NUL byte, a name of a control piece and the
mark U+2581 (read as a blank) are ordinary text; repeated rows are encoded each; an empty table gives no rows; a very long part
without a cut takes time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .store import fresh
from .words import buffers, chunks, mix, powers

MARK = "▁"
CACHED = 2_000_000
#: Longer parts (bytes) are encoded each time.
LONGEST = 255
PAIRS = 2_000_000
# fixed values of the file format
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGE_TYPE = 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes):
    """(number, value) of a message of the wire format: integers, floats and bytes."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        elif key & 7 == 2:
            size, i = varint(i)
            value, i = raw[i : i + size], i + size
        elif key & 7 == 5:
            value, i = struct.unpack_from("<f", raw, i)[0], i + 4
        else:
            value, i = struct.unpack_from("<d", raw, i)[0], i + 8
        yield key >> 3, value


class Model:
    """Pieces of a model file: their texts, ranks (the lowest merges first) and kinds."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        rows = [dict(_fields(v)) for k, v in fields if k == 1]
        trainer, normaliser = (dict(_fields(next((v for k, v in fields if k == n), b""))) for n in (2, 3))
        self.texts = [r[1].decode() for r in rows]
        self.kinds = [r.get(3, NORMAL) for r in rows]
        self.prefix = bool(normaliser.get(3, 1))
        plain = not normaliser.get(2) and not normaliser.get(4, 1) and normaliser.get(5, 1) and not trainer.get(24, 0)
        if trainer.get(3, 1) != MERGE_TYPE or not trainer.get(35, 0) or not plain or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge-type models with byte fallback, the identity normaliser and plain pieces can be used")
        self.unknown = trainer.get(44, " ⁇ ".encode())
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == NORMAL}
        self.rank = {self.texts[i]: -rows[i].get(2, 0.0) for i in self.ids.values()}
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == BYTE}

    def merged(self, text: str) -> list[str]:
        """Merge the best-ranked neighbours, the leftmost of equal ones, until none is left."""
        parts, rank = list(text), self.rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Backtracker:
    def __init__(self, model: Model):
        self.model = model
        self.made = {t for t in model.ids if model.merged(t) == [t]}
        self.automaton = ahocorasick.Automaton()
        for t in self.made:
            self.automaton.add_word(t, t)
        self.automaton.make_automaton()
        self.shorter = {t: next((t[:n] for n in range(len(t) - 1, 1, -1) if t[:n] in self.made), t[0]) for t in self.made if len(t) > 1}
        self.beside: dict[tuple[str, str], bool] = {}

    def fit(self, left: str, right: str) -> bool:
        found = self.beside.get((left, right))
        if found is None:
            if len(self.beside) >= PAIRS:
                self.beside.clear()
            found = self.beside[left, right] = self.model.merged(left + right) == [left, right]
        return found

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text whose blanks are marks; a character that is in no piece stands alone."""
        longest = list(text)
        for end, t in self.automaton.iter(text):  # a later match from the same place is longer
            longest[end - len(t) + 1] = t
        failed, out, at, n = bytearray(len(text) // 8 + 1), [], 0, len(text)
        piece = longest[0] if text else ""
        while at < n:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.fit(out[-1], piece)):
                out.append(piece)
                at, piece = end, longest[end] if end < n else ""
            elif len(piece) > 1:
                piece = self.shorter[piece]
            else:  # nothing fits here
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
        return out

    def ids(self, text: str) -> list[int]:
        known, by_byte = self.model.ids, self.model.bytes
        return [i for p in self.pieces(text) for i in ([known[p]] if p in known else [by_byte[b] for b in p.encode()])]


def _with(codes, starts, sizes, known, names, counts, found):
    """A table (sorted codes, where their ids begin, how many, all ids) and more parts."""
    order = np.argsort(names)
    spot = np.searchsorted(codes, names[order])
    begin = len(known) + np.cumsum(counts) - counts
    return np.insert(codes, spot, names[order]), np.insert(starts, spot, begin[order]), np.insert(sizes, spot, counts[order]), np.concatenate((known, found))


class Encoder:
    def __init__(self, path: str):
        self.model = Model(path)
        self.backtracker = Backtracker(self.model)
        #: Whether two bytes (a mark counts as a blank) stand together in some piece.
        self.inside = np.zeros((256, 256), bool)
        for t in self.model.ids:
            b = np.frombuffer(t.replace(MARK, " ").encode(), np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self._begin()

    def _begin(self) -> None:
        self.codes, self.starts, self.sizes, self.known = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _keep(self, names: np.ndarray, counts: np.ndarray, found: np.ndarray) -> None:
        self.codes, self.starts, self.sizes, self.known = _with(self.codes, self.starts, self.sizes, self.known, names, counts, found)

    def _learn(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, counts = [], []
        for a, s, f in zip(at.tolist(), size.tolist(), first.tolist()):
            ids = self.backtracker.ids(MARK * f + data[a : a + s].tobytes().decode().replace(" ", MARK))
            found += ids
            counts.append(len(ids))
        return np.array(found, np.int32), np.array(counts, np.int64)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and how many each has; null counts as empty."""
        column = pc.fill_null(column, "") if column.null_count else column
        if pc.any(pc.match_substring(column, MARK)).as_py():
            column = pc.replace_substring(column, MARK, " ")
        data, offs = buffers(column)
        data, offs = data[offs[0] : offs[-1]], offs - offs[0]
        n, m = len(data), len(column)
        if not n:
            return np.empty(0, np.int32), np.zeros(m, np.int64)
        cut = np.ones(n, bool)
        cut[1:] = ~self.inside[data[:-1], data[1:]] & (data[1:] & 0xC0 != 0x80)
        cut[offs[offs < n]] = True
        at = np.flatnonzero(cut)
        size = np.diff(at, append=n)
        text = np.repeat(np.arange(m), np.diff(np.searchsorted(at, offs)))
        first = (at == offs[text]) & self.model.prefix
        up, down = powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        codes = mix((total[at + size] - total[at]) * down[at] + size.astype(np.uint64))
        codes[first] = mix(codes[first] + np.uint64(1))
        which, names = pd.factorize(codes)
        place = np.searchsorted(self.codes, names)
        new = np.flatnonzero(self.codes[np.minimum(place, len(self.codes) - 1)] != names) if len(self.codes) else np.arange(len(names))
        codes_, starts, sizes, known = self.codes, self.starts, self.sizes, self.known
        if len(new):
            where = np.empty(len(names), np.int64)
            where[which[::-1]] = np.arange(len(which))[::-1]
            new = new[np.argsort(size[where[new]] > LONGEST, kind="stable")]  # long ones last
            found, counts = self._learn(data, at[where[new]], size[where[new]], first[where[new]])
            short = np.count_nonzero(size[where[new]] <= LONGEST)
            if len(codes_) + short > CACHED:  # begin anew; what this call needs of the full table stays at hand for it
                self._begin()
            else:
                self._keep(names[new[:short]], counts[:short], found[: counts[:short].sum()])
            codes_, starts, sizes, known = _with(codes_, starts, sizes, known, names[new], counts, found)
            place = np.searchsorted(codes_, names)
        start, count = starts[place][which], sizes[place][which]
        each = np.bincount(text, weights=count, minlength=m).astype(np.int64)
        upto = np.cumsum(count)
        return known[np.repeat(start - (upto - count), count) + np.arange(upto[-1])], each


class Decoder:
    def __init__(self, path: str):
        self.model = model = Model(path)
        words = {NORMAL: lambda t: t.replace(MARK, " ").encode(), UNKNOWN: lambda t: model.unknown, CONTROL: lambda t: b"", BYTE: lambda t: bytes([int(t[3:5], 16)])}
        table = [words[k](t) for t, k in zip(model.texts, model.kinds)]
        self.data = np.frombuffer(b"".join(table), np.uint8)
        self.sizes = np.array([len(t) for t in table], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.shown = np.array([k != CONTROL for k in model.kinds])
        self.led = np.array([k == NORMAL and t[:1] == MARK for t, k in zip(model.texts, model.kinds)])
        self.byte = np.array([k == BYTE for k in model.kinds])

    def __call__(self, ids: np.ndarray, each: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Texts of lists of ids, one after the other, and where each begins (and the last one ends)."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes)):
            raise ValueError("an id is outside the model")
        bounds = np.concatenate(([0], np.cumsum(each)))
        size, start = self.sizes[ids].copy(), self.starts[ids].copy()
        if self.model.prefix:  # the blank in front of a text's first piece goes
            shown = np.flatnonzero(self.shown[ids])
            head = np.searchsorted(shown, bounds[:-1])
            head = shown[head[(head < len(shown)) & (shown[np.minimum(head, len(shown) - 1)] < bounds[1:])]] if len(shown) else shown
            head = head[self.led[ids[head]]]
            size[head] -= 1
            start[head] += 1
        upto = np.concatenate(([0], np.cumsum(size)))
        raw = self.data[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        offs = upto[bounds]
        try:
            raw.decode()
        except UnicodeDecodeError:
            texts = [self._repaired(ids[a:b], start[a:b], size[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            return b"".join(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        return raw, offs

    def _repaired(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
        """A text in which each byte that belongs to no character is U+FFFD; characters do not reach over pieces of other kinds."""
        out = []
        for change in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(self.byte[ids])) + 1):
            raw = b"".join(self.data[start[i] : start[i] + size[i]].tobytes() for i in change)
            while raw:
                try:
                    raw.decode()
                    break
                except UnicodeDecodeError as e:
                    out.append(raw[: e.start] + "�".encode())
                    raw = raw[e.start + 1 :]
            out.append(raw)
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that what it keeps serves all of the worker's tasks."""
    return Encoder(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, text: str = "text", name: str = "ids", model: str | None = None) -> DataFrame:
    """``docs`` with ``name``, the ids of each text as a list."""
    path = model or default_path()
    kept = [c for c in docs.columns if c != name]
    rows = docs.select(*kept, F.col(text).alias(given := fresh("_text", kept)))
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(name, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        for batch in batches:
            for first, _, offs in chunks(texts := batch.column(batch.schema.names.index(given))):
                ids, each = encoder(path)(texts.slice(first, len(offs) - 1))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(each))).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[c.slice(first, len(each)) for c in batch.columns[:-1]], lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, ids: str = "ids", name: str = "decoded", model: str | None = None) -> DataFrame:
    """``rows`` with ``name``, the text of each list of ids; a null list is empty, a null id or one outside the model raises."""
    path = model or default_path()
    kept = [c for c in rows.columns if c != name]
    given = rows.select(*kept, F.coalesce(F.col(ids), F.array().cast("array<int>")).cast("array<int>").alias(fresh("_ids", kept)))
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField(name, T.StringType())])

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("an id is null")
            raw, offs = decoder(path)(flat.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64))
            texts = pa.array([raw[a:b].decode() for a, b in zip(offs.tolist(), offs[1:].tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=schema.names)

    return given.mapInArrow(run, schema)


def _joined(size: int) -> np.ndarray:
    """A row of bytes for each id: its decimal digits and a comma, filled up with zeros."""
    width = len(str(size - 1)) + 1
    return np.frombuffer(b"".join(f"{i},".encode().ljust(width, b"\0") for i in range(size)), np.uint8).reshape(size, width)


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; the text is decoded from the ids."""
    path = model or default_path()
    rows = docs.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def hashes(raw: bytes, offs: np.ndarray, less: int = 0) -> pa.Array:
        view, at = memoryview(raw), offs.tolist()
        return pa.array([hashlib.sha256(view[a : max(a, b - less)]).hexdigest() for a, b in zip(at, at[1:])], pa.string())

    def run(batches):
        encoding, decoding = encoder(path), decoder(path)
        digits = _joined(len(decoding.sizes))
        wide = np.count_nonzero(digits, axis=1)
        for batch in batches:
            for first, _, offs in chunks(batch.column(1)):
                ids, each = encoding(batch.column(1).slice(first, len(offs) - 1))
                shown = digits[ids].ravel()
                ends = np.concatenate(([0], np.cumsum(wide[ids])))[np.concatenate(([0], np.cumsum(each)))]
                columns = [batch.column(0).slice(first, len(each)), pa.array(each), hashes(shown[shown > 0].tobytes(), ends, 1), hashes(*decoding(ids, each))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
