"""Token counts that follow edits: a segment tree of pre-tokens per document.

count_document() splits a text into pre-tokens of byte-level BPE, whose ids do not depend on
each other, and keeps a tree over them with the characters and tokens below each node.
An edit replaces text[start:end]. Splitting is a scan from left to right without
state, whose match reads at most LOOKAHEAD characters past its end, so it restarts at the
last boundary that the edit cannot reach and stops at the first old boundary behind the
edit that the new scan meets too. Only the pre-tokens between are encoded again; the
first leaf of that stretch takes them over, its other leaves become empty, and sums change
along their paths to the root. A leaf that comes to hold more than LEAF pre-tokens shares them, counts and
all, with the leaves of the smallest subtree that has room; if none has, the tree grows. So no leaf stays
long, and later edits in a long insert again touch little.

Edits are (start, end, replacement) in code points of the text as it then is, ends
clipped to it. Edge cases: null text is empty; null replacements delete; an edit may
hit an empty document; an empty edit changes nothing; strings that spell special tokens
are ordinary text; repeated rows get equal counts; extra columns are ignored; an empty table
gives an empty result. Texts are counted whole; memory is linear in the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import UnitEncoder, default_path
from .common import documents, slices

#: Characters past a match's end that the pre-token pattern may read.
LOOKAHEAD = 3
# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most pre-tokens that a leaf keeps, and, on average, the leaves of a subtree that shares them anew.
LEAF, SHARED = 16, 8
#: Pre-tokens to a leaf of a new tree.
PLANTED = 4
#: Pre-tokens whose counts a worker keeps; a full cache is emptied.
KNOWN = 600_000
EDITS = 3
SEED = 31
_split = regex.compile(PATTERN)
_encoders: dict[str, Counter] = {}


class Counter:
    """Token counts of pre-tokens, kept in a bounded cache."""

    def __init__(self, path: str):
        self.encoder = UnitEncoder(path)
        self.encoder.tokenizer.encode_special_tokens = True
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        try:
            return list(map(self.known.__getitem__, pieces))
        except KeyError:
            return list(map(self.learn(pieces).__getitem__, pieces))

    def learn(self, pieces: Iterable[str]) -> dict[str, int]:
        """Counts of at least these pre-tokens; many new ones are encoded as columns, the few of an edit as they are."""
        known = self.known
        pieces = set(pieces)
        new = [p for p in pieces if p not in known]
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = list(pieces)
        sizes = self.encoder.units(pa.array(new, pa.string()))[2].tolist() if len(new) > 64 else map(len, self.encoder.whole(new))
        known.update(zip(new, sizes, strict=True))
        return known


def counter(path: str) -> Counter:
    if path not in _encoders:
        _encoders[path] = Counter(path)
    return _encoders[path]


class TokenTree:
    """Sums of characters and tokens over a text's pre-tokens."""

    def __init__(self, text: str, counter: Counter, pieces: list[str] | None = None):
        self.counter = counter
        self.reencoded = 0
        pieces = _split.findall(text) if pieces is None else pieces
        self._plant(pieces, counter.counts(pieces))

    def _plant(self, pieces: list[str], counts: list[int]) -> None:
        """The tree over these pre-tokens, PLANTED of them to a leaf."""
        starts = range(0, len(pieces), PLANTED)
        #: A leaf holds a list of pre-tokens, more, fewer or none after edits. Their counts stand beside.
        self.leaves = [pieces[k : k + PLANTED] for k in starts] or [[]]
        self.counts = [counts[k : k + PLANTED] for k in starts] or [[]]
        sums = [np.add.reduceat(np.array(x, np.int64), starts) if pieces else np.zeros(1, np.int64) for x in (list(map(len, pieces)), counts)]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        # room to share: every leaf of the lowest level exists
        self.leaves += [[] for _ in range(self.size - len(self.leaves))]
        self.counts += [[] for _ in range(self.size - len(self.counts))]
        self.chars, self.tokens = ([*np.zeros(self.size, np.int64).tolist(), *x.tolist(), *[0] * (self.size - len(x))] for x in sums)
        self._add(self.size, 2 * self.size)

    def _sum(self, first: int, last: int) -> None:
        """Sums of leaves first to last, an aligned stretch, of the subtree over them, and of its path to the root."""
        for leaf in range(first, last):
            self.chars[leaf + self.size], self.tokens[leaf + self.size] = sum(map(len, self.leaves[leaf])), sum(self.counts[leaf])
        self._add(first + self.size, last + self.size)

    def _add(self, low: int, high: int) -> None:
        """Sums above nodes low to high of one level, and on the path to the root."""
        while high - low > 1:
            for sums in (self.chars, self.tokens):
                sums[low // 2 : high // 2] = map(add, sums[low:high:2], sums[low + 1 : high : 2])
            low, high = low // 2, high // 2
        node = low // 2
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            node //= 2

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pieces(self) -> int:
        return sum(map(len, self.leaves))

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` and the leaf's first character; the last leaf at the text's end."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def _set(self, leaf: int, pieces: list[str], counts: list[int]) -> None:
        self.leaves[leaf], self.counts[leaf] = pieces, counts
        if len(pieces) <= LEAF:
            self._sum(leaf, leaf + 1)
            return
        width, held = 1, len(pieces)
        while held > SHARED * width and width < self.size:
            width *= 2
            first = leaf // width * width
            held = sum(map(len, self.leaves[first : first + width]))
        first = leaf // width * width
        own = [p for x in self.leaves[first : first + width] for p in x]
        own_counts = [c for x in self.counts[first : first + width] for c in x]
        if held > SHARED * width:
            self._plant(own, own_counts)
            return
        for k in range(width):
            a, b = held * k // width, held * (k + 1) // width
            self.leaves[first + k], self.counts[first + k] = own[a:b], own_counts[a:b]
        self._sum(first, first + width)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put new in place of characters start to end, and count what that touches again."""
        total = self.chars[1]
        start = max(0, min(start, total))
        end = max(start, min(end, total))
        # left: the leaf with the last boundary out of the edit's reach; right: leaves joined until both scans agree
        first, at = self._find(max(0, start - LOOKAHEAD))
        if at > start - LOOKAHEAD and first:
            first, at = self._find(max(0, at - 1))
        skip = 0
        for p in self.leaves[first]:
            if at + len(p) > start - LOOKAHEAD:
                break
            at += len(p)
            skip += 1
        head, head_counts = self.leaves[first][:skip], self.counts[first][:skip]
        last, old, old_counts, bounds, reach = first, [], [], set(), at
        shift = len(new) - (end - start)
        text = ""
        while True:
            # old text of whole leaves up to some way behind the edit
            while last < len(self.leaves) and reach < end + 16 * (1 + len(text) // 8):
                for p in self.leaves[last][skip if last == first else 0 :]:
                    reach += len(p)
                    bounds.add(reach)
                    old.append(p)
                old_counts += self.counts[last][skip if last == first else 0 :]
                last += 1
            before = "".join(old)
            text = before[: start - at] + new + before[end - at :]
            at_end = last == len(self.leaves)
            pieces, pos, agreed = [], at, False
            for m in _split.finditer(text):
                pos = at + m.end()
                if not at_end and pos + LOOKAHEAD > at + len(text):
                    break  # this match might read past what was joined
                pieces.append(m[0])
                if pos - shift >= end and pos - shift in bounds and pos >= start + len(new):
                    agreed = True
                    break
            if agreed or at_end:
                break
        rest, rest_counts = [], []
        if agreed:
            # the rest of the stretch keeps its old pre-tokens
            stop, k, seen = pos - shift, 0, at
            while seen < stop:
                seen += len(old[k])
                k += 1
            rest, rest_counts = old[k:], old_counts[k:]
        self.reencoded += len(pieces)
        counts = self.counter.counts(pieces)
        for leaf in range(first + 1, last):
            if self.leaves[leaf]:
                self._set(leaf, [], [])
        self._set(first, head + pieces + rest, head_counts + counts + rest_counts)


Edit = tuple[int, int, str]


def count_document(text: str | None, edits: list[Edit], counter: Counter, pieces: list[str] | None = None) -> tuple[int, int, int, int, int]:
    """(tokens, pre-tokens, tokens after all edits, pre-tokens after them, pre-tokens encoded again); pieces, if given, are the text's."""
    tree = TokenTree(text or "", counter, pieces)
    before = tree.n_tokens, tree.n_pieces
    for start, end, new in edits:
        tree.replace(start, end, new)
    return *before, tree.n_tokens, tree.n_pieces, tree.reencoded


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Counts for docs (doc_id, text, edits array<struct<start, end, new>>) before and after the edits."""
    path = vocabulary or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in slices(batches, 256):
            texts = batch.column("text").to_pylist()
            pieces = [_split.findall(t or "") for t in texts]
            own.learn(set().union(*pieces))  # new pre-tokens of all texts at once
            rows = [
                count_document(t, [(e["start"] or 0, e["end"] or 0, e["new"] or "") for e in edits or []], own, p)
                for t, edits, p in zip(texts, batch.column("edits").to_pylist(), pieces, strict=True)
            ]
            del texts, pieces
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_tokens", "n_pieces", "edited_tokens", "edited_pieces", "n_reencoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "edits").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_pieces long, edited_tokens long, edited_pieces long, n_reencoded long")


def seeded_edits(text: Column, doc_id: Column, edits: int = EDITS, seed: int = SEED) -> Column:
    """An edit script per document: stretches of up to 12 characters at hashed places replaced by hashed snippets."""
    n = F.length(F.coalesce(text, F.lit(""))) + 1
    snippets = F.array(*map(F.lit, ["", " and", "\n", "'re ", "2024", " the revised part", "é", "  "]))

    def edit(k: int) -> Column:
        h = lambda what, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.lit(k), doc_id), m.cast("long") if isinstance(m, Column) else F.lit(m))
        start = h("start", n)
        return F.struct(start.alias("start"), (start + h("length", 13)).alias("end"), F.get(snippets, h("snippet", 8).cast("int")).alias("new"))

    return F.array(*map(edit, range(edits)))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return count_tokens(docs.withColumn("edits", seeded_edits(F.col("text"), F.col("doc_id"))))
