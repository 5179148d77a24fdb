"""Byte-level BPE ids of whole texts through the tokenizers library, each distinct word of a batch once.

Byte-level BPE works on pre-tokens alone. A space before a non-space always begins a
pre-token, and a line break between non-spaces is one, so a text without two white-space
characters in a row falls into units (a word with the space before it, or a line break)
whose ids do not depend on their neighbours. The distinct units of a batch are encoded
once, as columns without an object per word; any other text, and one that spells a special token,
goes through the library whole. Memory is linear in a batch, nothing is kept between batches.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402
from tokenizers.pre_tokenizers import CharDelimiterSplit  # noqa: E402

_MARKS = string.punctuation
#: A pre-token of letters (of ranges that are settled in every version of Unicode), and at most one of marks behind it.
_LETTERS = r"\A ?[A-Za-zÀ-ÖØ-öø-ɏ]+[!-/:-@\[-`{-~]*\z"
# Byte-level BPE writes printable Latin-1 bytes as themselves, and the others, in order, from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_WRITTEN = np.arange(256, dtype="<u2")
_WRITTEN[[b for b in range(256) if b not in _PRINTABLE]] = np.arange(256, 512 - len(_PRINTABLE))
#: The words of a line stay apart.
_WRITTEN[ord("\n")] = ord("\n")
#: Words that go through the library as one line; a few thousand characters suit it best.
_LINE = 256


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each of many stretches, one after another."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes).astype(starts.dtype), sizes)
    at += np.arange(len(at), dtype=at.dtype)
    return at


class UnitEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Found in texts that do not fall into units whose ids are independent of their neighbours.
        self.together = "|".join([r"\x00", r"[\t-\r\x1c-\x1f\x85\p{Z}]{2}", *map(re.escape, self.special)])
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each token: byte-level tokens are written with one character per byte.
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(token)
        #: The merges alone, without splitting: words come written as bytes, a line break between them.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = CharDelimiterSplit("\n")
        self.mark_id = np.zeros(256, np.uint32)
        for mark in _MARKS:
            self.mark_id[ord(mark)] = self.whole([mark])[0][0]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, straight from the library."""
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, tokenizer: Tokenizer, lines: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all lines, end of each stretch of sizes bytes therein)."""
        ids = np.concatenate([np.empty(0, np.uint32), *(np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False))])
        return ids, np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(sizes)) + 1

    def _stems(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of distinct pre-tokens of letters."""
        listed = stems.to_pylist()
        lines = ["\n".join(listed[at : at + _LINE]) for at in range(0, len(listed), _LINE)]
        written = [_WRITTEN[np.frombuffer(line.encode(), np.uint8)].tobytes().decode("utf-16-le") for line in lines]
        ids, stops = self._joined(self.words, written, pc.binary_length(stems).to_numpy())
        return ids, np.diff(stops, prepend=0)

    def _others(self, units: list[str]) -> list[np.ndarray]:
        """Ids of each unit. Those that begin and end in non-spaces, but for a space in front, go through as lines of one text."""
        able = [u for u in units if u and not u[-1].isspace() and not (u[1:2] if u[0] == " " else u[0]).isspace() and u.isprintable()]
        out = {}
        for at in range(0, len(able), _LINE):
            part = able[at : at + _LINE]
            sizes = np.array([len(u.encode()) + 1 for u in part])
            ids, stops = self._joined(self.tokenizer, ["\n".join([*part, ""])], sizes)
            if len(ids) and self.widths[ids].sum() == sizes.sum():
                out.update(zip(part, (x[:-1] for x in np.split(ids, stops[:-1])), strict=True))
        rest = [u for u in units if u not in out]
        out.update(zip(rest, self.whole(rest), strict=True))
        return [out[u] for u in units]

    def units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes) of distinct units, each encoded alone."""
        lettered = pc.match_substring_regex(units, _LETTERS)
        words = units.filter(lettered)
        stems = pc.utf8_rtrim(words, _MARKS)
        coded = stems.dictionary_encode()
        ids, sizes = self._stems(coded.dictionary)
        code = coded.indices.to_numpy()
        behind = pc.subtract(pc.binary_length(words), pc.binary_length(stems)).to_numpy()
        run = behind > 1
        tails = [w[-k:] for w, k in zip(words.filter(pa.array(run)).to_pylist(), behind[run].tolist(), strict=True)]
        marks = dict.fromkeys(tails)
        marks = dict(zip(marks, self.whole(list(marks)), strict=True))
        behind = behind.astype(np.int64)
        behind[run] = [len(marks[t]) for t in tails]
        n = sizes[code] + behind
        ends = np.cumsum(n)
        flat = np.append(ids, np.uint32(0))[np.minimum(ragged((np.cumsum(sizes) - sizes)[code], n), len(ids))]
        one = (behind == 1) & ~run
        letters = np.frombuffer("".join(words.to_pylist()).encode(), np.uint8)
        flat[ends[one] - 1] = self.mark_id[letters[np.cumsum(pc.binary_length(words).to_numpy())[one] - 1]]
        flat[ragged((ends - behind)[run], behind[run])] = np.concatenate([np.empty(0, np.uint32), *(marks[t] for t in tails)])
        lettered = lettered.to_numpy(zero_copy_only=False)
        others = self._others(units.filter(pa.array(~lettered)).to_pylist())
        total = np.zeros(len(units), np.int64)
        total[lettered] = n
        total[~lettered] = list(map(len, others))
        # words first, then the others
        order = np.argsort(~lettered, kind="stable")
        starts = np.empty(len(units), np.int64)
        starts[order] = np.cumsum(total[order]) - total[order]
        return np.concatenate([flat, *others]), starts.astype(np.int32), total.astype(np.int32)

    def encode_many(self, texts: list[str | None] | pa.Array, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, counts) of stretches of texts: the ids one text after another, and how many each has; null is empty.

        Each distinct unit of all texts is encoded once; ids are put together for about at_once of them at a time.
        """
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "").cast(pa.large_string())
        together = pc.match_substring_regex(column, self.together)
        whole = np.flatnonzero(together.to_numpy(zero_copy_only=False)).tolist()
        apart = dict(zip(whole, self.whole(column.take(pa.array(whole, pa.int64())).to_pylist()), strict=True))
        column = pc.if_else(together, "", column)
        lines = pc.replace_substring(pc.replace_substring(column, " ", "\0 "), "\n", "\0\n\0")
        parts = pc.split_pattern(lines, "\0")
        coded = parts.flatten().dictionary_encode()
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        ids, starts, sizes = self.units(coded.dictionary)
        unit = coded.indices.to_numpy()
        del lines, parts, coded, texts
        reached = np.concatenate(([0], np.cumsum(sizes[unit], dtype=np.int64)))[bounds]
        for k, x in apart.items():
            reached[k + 1 :] += len(x)
        groups = np.flatnonzero(np.diff(reached[1:] // at_once)) + 1
        for first, last in zip([0, *groups.tolist()], [*groups.tolist(), len(column)], strict=True):
            own = unit[bounds[first] : bounds[last]]
            n = sizes[own]
            flat = ids[ragged(starts[own], n)]
            counts = np.diff(np.concatenate(([0], np.cumsum(n)))[bounds[first : last + 1] - bounds[first]])
            there = [k for k in range(first, last) if k in apart]
            if there:
                pieces, done = [], 0
                for k in there:
                    stop = int(counts[: k - first].sum()) - sum(map(len, pieces[1::2]))
                    pieces += [flat[done:stop], apart[k]]
                    done = stop
                    counts[k - first] = len(apart[k])
                flat = np.concatenate([*pieces, flat[done:]])
            yield flat, counts


@cache
def encoder(path: str) -> UnitEncoder:
    """One encoder per worker and vocabulary file."""
    return UnitEncoder(path)
