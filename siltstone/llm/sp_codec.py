"""SentencePiece encoding that keeps the way back to the original bytes.

The normaliser is written here: it replaces the longest prefix that the
model's compiled character map (a double-array trie) knows, trims, adds and
escapes white space, and records the source byte of every byte it puts out.
The library then only segments normalised text; the byte lengths of its pieces
and the recorded alignment give every piece's span of the original.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .columns import narrow
from .kernels import slices
from .scratch import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁".encode()


class CharacterMap:
    """A precompiled character map: the trie's units, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]
        self._first: dict[str, bool] = {}

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that ``data`` has at ``at``."""
        units = self.units
        if not units:
            return None
        node, best = units[0] >> 10 << ((units[0] & 0x200) >> 6), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= unit >> 10 << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.texts[best[1] : self.texts.index(b"\0", best[1])]

    def begins(self, char: str) -> bool:
        """Whether some key begins with this character."""
        if char not in self._first:
            units, known = self.units, bool(self.units)
            node = units[0] >> 10 << ((units[0] & 0x200) >> 6) if known else 0
            for byte in char.encode():
                node ^= byte
                if not known or node >= len(units) or units[node] & 0x800000FF != byte:
                    known = False
                    break
                node ^= units[node] >> 10 << ((units[node] & 0x200) >> 6)
            self._first[char] = known
        return self._first[char]


class Codec:
    """One model: normalisation with alignment, encoding with spans, decoding."""

    def __init__(self, path: str = MODEL):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        kind = type(model.pieces[0])
        self.user = [p.piece for p in model.pieces if p.type == kind.USER_DEFINED]
        self._user = re.compile("|".join(map(re.escape, sorted(self.user, key=len, reverse=True)))) if self.user else None
        self.table, self.unknown = [], -1
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.table.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kind.CONTROL:
                self.table.append(b"")
            else:
                self.table.append(p.piece.encode())
            if p.type == kind.UNKNOWN:
                self.unknown = i
        if self.unknown >= 0:
            self.table[self.unknown] = model.trainer_spec.unk_surface.encode()
        self.lengths = np.array([len(t) for t in self.table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.table), np.uint8)
        # The library gets normalised text, so its own normaliser does nothing.
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def _mapped(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Bytes after the character map, and the source byte of each."""
        data = text.encode()
        raw = np.frombuffer(data, np.uint8)
        start = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(raw)), 0)) if len(raw) else np.zeros(0, np.int64)
        active = "".join(c for c in set(text) if self.map.begins(c)) if self.map.units else ""
        if not active:
            return raw, start
        skip = [(m.start(), m.end()) for m in self._user.finditer(text)] if self._user else []
        out, origin, done, pos, k, chars = [], [], 0, 0, 0, 0
        for m in re.finditer(f"[{re.escape(active)}]", text):
            pos += len(text[chars : m.start()].encode())
            chars = m.start()
            while k < len(skip) and skip[k][1] <= m.start():
                k += 1
            if pos < done or (k < len(skip) and skip[k][0] <= m.start()):
                continue
            found = self.map.longest(data, pos)
            if found is None:
                continue
            out += [raw[done:pos], np.frombuffer(found[1], np.uint8)]
            origin += [start[done:pos], np.full(len(found[1]), pos)]
            done = pos + found[0]
        out.append(raw[done:])
        origin.append(start[done:])
        return np.concatenate(out), np.concatenate(origin)

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised text in UTF-8, and for each of its bytes and its end the byte of ``text`` that it comes from."""
        value, origin = self._mapped(text)
        end = len(text.encode())
        space = value == 32
        if self.trim and len(value):
            keep = ~(space & np.concatenate([[True], space[:-1]]))
            solid = np.flatnonzero(~space)
            if len(solid) and solid[-1] + 1 < len(value):
                end = int(origin[solid[-1] + 1])
                keep[solid[-1] + 1 :] = False
            value, origin = value[keep], origin[keep]
            space = value == 32
        if not len(value):
            return b"", np.array([end])
        if self.prefix:
            at = len(value) if self.suffix else 0
            value, origin = np.insert(value, at, 32), np.insert(origin, at, end if self.suffix else origin[0])
            space = value == 32
        if self.escape and space.any():
            times = np.where(space, 3, 1)
            origin = np.repeat(origin, times)
            full = np.repeat(value, times)
            at = np.cumsum(times)[space] - 3
            for j in range(3):
                full[at + j] = SPACE[j]
            value = full
        return value.tobytes(), np.append(origin, end)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, bounds) of each text: piece ``i`` stands for the bytes ``bounds[i]:bounds[i + 1]`` of the original."""
        normal = [self.normalize(t) for t in texts]
        out = []
        for (text, origin), ids in zip(normal, self.library.encode([t for t, _ in normal], num_threads=1, return_type="numpy"), strict=True):
            ids = np.asarray(ids, np.int32)
            if self.unknown >= 0 and (ids == self.unknown).any():
                pieces = self.library.encode(text, return_type="proto").pieces
                size = np.array([len(p.surface.encode()) for p in pieces], np.int64)
            else:
                size = self.lengths[ids]
            out.append((ids, origin[np.concatenate([[0], np.cumsum(size)])].astype(np.int32)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't valid UTF-8 become U+FFFD."""
        size = self.lengths[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        text = self.bytes[at].tobytes().decode("utf-8", "replace")
        if self.escape:
            text = text.replace("▁", " ")
        if self.prefix:
            text = text[:-1] if self.suffix and text.endswith(" ") else text[1:] if not self.suffix and text.startswith(" ") else text
        return text


@cache
def codec(path: str = MODEL) -> Codec:
    """The codec of a model, one in a process."""
    return Codec(path)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, ids, bounds, n_tokens, decodes)`` for each row of ``docs``.

    Piece ``i`` stands for the bytes ``bounds[i]`` up to ``bounds[i + 1]`` of the
    text; ``decodes`` tells whether the ids decode to the text itself. A null
    text has null ids and bounds and no tokens; an empty one has no ids and the
    bounds [0]. A null doc_id keeps its row, repeated rows are rows again, no
    documents: no rows. Other columns aren't read, whatever their names. Texts of
    any length are encoded whole. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts = batch.column("text").to_pylist()
                missing = np.array([t is None for t in texts], bool)
                found = c.encode([t or "" for t in texts])
                size = np.array([len(ids) for ids, _ in found], np.int64)
                flat_ids = np.concatenate([ids for ids, _ in found])
                flat_bounds = np.concatenate([b for _, b in found])
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), mask=np.append(missing, False)), pa.array(v))
                    for v, n in ((flat_ids, size), (flat_bounds, size + 1))
                ]
                same = [t is not None and c.decode(ids) == t for t, (ids, _) in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists, pa.array(size), pa.array(same, mask=missing)], names=["doc_id", "ids", "bounds", "n_tokens", "decodes"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, bounds array<int>, n_tokens long, decodes boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids are a null text, ids that the model lacks raise an error."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            texts = [None if ids is None else c.decode(np.array(ids, np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return narrow(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")
