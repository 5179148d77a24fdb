"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A text gets one leading space, spaces become the white-space marker, and the path of
pieces with the greatest sum of log scores wins (of equal paths the one whose last
piece is longest). Characters without a piece of their own cost UNKNOWN below the least
score and fall back to byte pieces; so does a marker that the text itself spells, which
keeps decoding exact. Decoding joins pieces and bytes, turns markers into spaces and
drops the leading one.

The public vocabulary file ranks its pieces instead of giving probabilities, and tokenizers
are not trained here: log scores follow from rank r by Zipf's law, -log((r + 1) * H)
with H the harmonic sum over all pieces. The file's own text normaliser is not applied, for decoding is to give
the text back exactly: no Unicode folding, and spaces stay as many as they are.

No piece crosses the boundary before a marker that follows something else, nor one next
to a line break, so paths of the units between such boundaries join to the path of the
whole text; units repeat, and each worker keeps a bounded cache of them. Edge cases: null
and empty texts have no ids; repeated rows get equal ids; extra columns pass through
encode() unless they bear the name of a result column, which replaces them; an empty table
gives an empty result. Texts are encoded whole; memory is linear in the longest unit.
"""

from __future__ import annotations

import math
import re
import string
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, plain_names, slices

MARKER = "▁"
#: Below the least score of a piece.
UNKNOWN = 10.0
CACHE_UNITS = 500_000
_LONGEST_CACHED = 64
_UNITS = re.compile(r"\n| *[^ \n]+| +")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class DoubleArray:
    """A static trie of byte strings: child of node s by byte c is t = base[s] + c + 1 where check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in keys.items():
            at = 0
            for c in key:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    values.append(-1)
                at = children[at][c]
            values[at] = value
        self.base, self.check, self.value = [0], [-2], [values[0]]
        room = 1 << 12
        self._grow(room)
        scan, place = 1, {0: 0}
        queue = [0]
        for node in queue:
            codes = sorted(children[node])
            if not codes:
                continue
            first, at, taken = codes[0] + 1, max(scan, codes[0] + 1), 0
            while True:
                if at + 257 >= len(self.check):
                    self._grow(len(self.check))
                if self.check[at] != -1:
                    taken += 1
                elif all(self.check[at - first + c + 1] == -1 for c in codes):
                    break
                at += 1
            if taken >= 0.9 * (at - scan + 1):  # nearly full up to here: later searches start behind
                scan = at
            base, here = at - first, place[node]
            self.base[here] = base
            for c in codes:
                t = base + c + 1
                self.check[t] = here
                child = children[node][c]
                self.value[t] = values[child]
                place[child] = t
                queue.append(child)
        # a walk may step 256 past the end without a bounds test
        self._grow(257)

    def _grow(self, n: int) -> None:
        self.base += [0] * n
        self.check += [-1] * n
        self.value += [-1] * n


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, self.byte_ids, self.raw = {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.raw.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.raw.append(b"")
            else:
                pieces[i] = -model.get_score(i)
                self.raw.append(piece.replace(MARKER, " ").encode())
        h = sum(1 / (k + 1) for k in range(len(pieces)))
        self.score = [0.0] * len(self.raw)
        for i, rank in pieces.items():
            self.score[i] = -math.log((rank + 1) * h)
        self.unknown = min(self.score) - UNKNOWN
        self.trie = DoubleArray({self.raw[i]: i for i in pieces})
        #: Characters that are pieces, bytes of each piece, bytes of the longest.
        self.alone = {self.raw[i] for i in pieces if len(self.raw[i].decode()) == 1}
        self.size = list(map(len, self.raw))
        self.longest = max(self.size)
        #: Ids of marks that no piece holds behind a letter: paths never cross the boundary between the two.
        joined = {b for i in pieces for a, b in pairwise(self.raw[i].decode()) if a.isalpha()}
        self.known: dict[str, bytes] = {}
        self.ends = {m: self.viterbi(m.encode()) for m in string.punctuation if m not in joined}
        if any(re.search(r"[^ ] |\n", self.raw[i].decode()) for i in pieces):
            raise ValueError("a piece crosses a unit's boundary")

    def viterbi(self, s: bytes) -> bytes:
        """Ids (little-endian unsigned 32-bit integers) of the best path over s, where a space stands for the marker."""
        base, check, value, score, longest = self.trie.base, self.trie.check, self.trie.value, self.score, self.longest
        alone, unknown = self.alone, self.unknown
        n = len(s)
        best = [-math.inf] * (n + 1)
        best[0] = 0.0
        #: The piece that ends the best path to each place; minus the bytes of a character without one.
        last = [0] * (n + 1)
        i = 0
        while i < n:
            c = s[i]
            here, node, j = best[i], 0, i
            for x in s[i : i + longest]:
                j += 1
                t = base[node] + x + 1
                if check[t] != node:
                    break
                node = t
                p = value[t]
                if p >= 0:
                    total = here + score[p]
                    if total > best[j]:
                        best[j], last[j] = total, p
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            i += width
            if here + unknown > best[i] and s[i - width : i] not in alone:
                best[i], last[i] = here + unknown, -width
        out: list[int] = []
        size = self.size
        while n:
            p = last[n]
            if p >= 0:
                out.append(p)
                n -= size[p]
            else:
                out.extend([self.byte_ids[c] for c in reversed(s[n + p : n])])
                n += p
        out.reverse()
        return struct.pack(f"<{len(out)}I", *out)

    def _unit(self, u: str) -> bytes:
        """Ids of one unit; a mark behind a letter is a path of its own, so words share theirs with and without it."""
        if u[-1:] in self.ends and u[-2:-1].isalpha():
            stem = self.known.get(u[:-1])
            if stem is None:
                stem = self.viterbi(u[:-1].encode(errors="surrogatepass"))
                if len(u) <= _LONGEST_CACHED:
                    self.known[u[:-1]] = stem
            return stem + self.ends[u[-1]]
        return self.viterbi(u.encode(errors="surrogatepass"))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if "  " in text or "\0" in text or text[0] == " " or " \n" in text:
            units = _UNITS.findall(" " + text)
        else:
            units = (" " + text).replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        found = list(map(self.known.get, units))
        try:
            return b"".join(found)
        except TypeError:  # units not seen before
            new = {u: self._unit(u) for u in {u for u, ids in zip(units, found, strict=True) if ids is None}}
        out = b"".join([new[u] if ids is None else ids for u, ids in zip(units, found, strict=True)])
        self.known.update(new if len(text) <= _LONGEST_CACHED else (x for x in new.items() if len(x[0]) <= _LONGEST_CACHED))
        if len(self.known) > CACHE_UNITS:
            self.known = {}
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()]).decode(errors="surrogatepass").removeprefix(" ")


@cache
def codec(path: str) -> Codec:
    """One codec per worker and vocabulary file."""
    return Codec(path)


def encode(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """docs without text, with ids, n_tokens, n_byte_tokens, ids_crc32 and exact (decoding gives the text back)."""
    path = vocabulary or default_path()
    made = ["ids"] * with_ids + ["n_tokens", "n_byte_tokens", "ids_crc32", "exact"]
    carried = [f for f in docs.schema if f.name != "text" and f.name not in {*made, "ids"}]
    kinds = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "n_byte_tokens": T.LongType(), "ids_crc32": T.LongType(), "exact": T.BooleanType()}
    plain = plain_names(docs.select("text", *[F.col(f"`{f.name}`") for f in carried]), "text")
    held = plain.schema.fields[1:]
    schema = T.StructType([*held, *(T.StructField(c, kinds[c]) for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        is_byte = np.zeros(len(c.raw), bool)
        is_byte[c.byte_ids] = True
        for batch in slices(batches):
            packed, rows = [], []
            for text in batch.column("text").to_pylist():
                data = c.encode(text)
                ids = np.frombuffer(data, "<u4")
                packed.append(ids)
                rows.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(data), c.decode(ids) == (text or "")))
            columns = [batch.column(f.name) for f in held]
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in packed]))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*packed, np.empty(0, "<u4")]).astype(np.int32))))
            n, b, crc, exact = zip(*rows, strict=True)
            columns += [pa.array(n, pa.int64()), pa.array(b, pa.int64()), pa.array(crc, pa.int64()), pa.array(exact, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return plain.mapInArrow(run, schema).toDF(*[f.name for f in carried], *made)


def decode(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """rows with a column text decoded from ids."""
    path = vocabulary or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [None if x is None else c.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield batch.append_column("text", pa.array(texts, pa.string()))

    kept = rows.drop("text")
    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField("text", T.StringType())]))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir).select("doc_id", "text"))
