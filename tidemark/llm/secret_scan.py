"""Secret scans: fixed patterns plus dictionary-primed zstandard novelty.

Three patterns give base spans (assign, access, hex). The method adds spans of kind
"novel": a candidate is a run of key characters in a sensitive context: a cue word anywhere
in the text, on either side, whatever lines are between, or a PEM block around it.
A compressor primed with a dictionary of identifier parts and with the text around the candidate,
other occurrences of it removed, packs it; the bytes beyond those of the frame without it
are its marginal cost. Nothing but this cost decides: all letters, all digits and mixtures are
judged alike, without regard to case. Costs are measured in windows that are too short for the compressor
to entropy-code their literals. The limit for a window's length lies half way between what composed
identifiers cost and what random letters cost, both drawn with a seed and measured by the same compressor.

The identifier dictionary holds, in turns, the most frequent words of the documents, ranked language by language, and the most
frequent letter pieces of a public vocabulary file. The words come from one aggregate over all documents: whole tokens of 4 to
15 letters in MIN_DOCS documents or more, so that no part of a longer string gets in. Limits are drawn from the words
that follow those of the dictionary. Candidates that the dictionary explains are settled with it alone; only the rest are
primed with their surroundings too.

Rows are scanned one Arrow batch at a time on the executors, each text whole and alone:
no shuffle and no state between rows but the mined words, of which the driver holds MINED at most. Edge cases: null text is empty and has no spans;
repeated rows get equal results; overlapping finds of different kinds are all kept; an
empty table gives an empty result; clashing or extra columns are carried by redact() untouched.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
from collections.abc import Iterator
from functools import cache
from itertools import zip_longest

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_path
from .common import documents, plain_names, slices

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_CUES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
#: A maximal run of 16 or more is what the pattern [0-9a-f]+ leaves after short matches go.
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_CUES = re.compile(r"key|secret|token|passw|pwd|auth|cred|bearer|private|signature|session|access", re.ASCII | re.IGNORECASE)
_PART = re.compile(r"[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_-]))?")
#: A PEM block and the body of it; one that is cut short goes on to the end.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----(.*?)(?:-----END \1-----|\Z)", re.DOTALL)
_PEM_LINE = re.compile(r"^[\x20\t>]*([A-Za-z0-9+/]+={0,2})[\x20\t\r]*$", re.MULTILINE)
#: Characters around a candidate that prime the compressor.
AROUND = 2048
#: Most characters of a candidate that are measured at once.
WINDOW = 30
#: Bytes of the identifier dictionary, and of its most frequent part that is used together with surroundings.
DICTIONARY, NEAR = 1 << 16, 1 << 14
#: Most words that are mined, and the documents that a mined word is in at least.
MINED, MIN_DOCS = 1 << 14, 3
#: Level at which the compressor looks for the cheapest parse; with its strategy fixed it leaves under 32 literals as they are.
LEVEL = 15
#: Drawn strings of each kind and length that set a limit.
DRAWN = 200
#: Known to every dictionary and in front of every window, so that a frame is always a compressed one.
_ANCHOR = bytes(range(128, 192))

_Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[_Span]:
    """Spans of the three patterns; leftmost and non-overlapping for each kind."""
    found: list[_Span] = []
    low = text.lower()
    if any(cue in low for cue in _ASSIGN_CUES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Novelty:
    """Marginal compressed bytes of strings, primed with words and with the identifier parts of a vocabulary file."""

    def __init__(self, path: str, words: tuple[str, ...] = ()):
        with open(path, encoding="utf-8") as f:
            ranks = json.load(f)["model"]["vocab"]
        pieces = dict.fromkeys(w.lower() for w in (t.lstrip("\u0120") for t in sorted(ranks, key=ranks.get)) if len(w) >= 4 and w.isascii() and w.isalpha())
        both = list(dict.fromkeys(w for pair in zip_longest(words, pieces) for w in pair if w))
        taken, size = 0, 0
        while taken < len(both) and size + len(both[taken]) + 1 <= DICTIONARY:
            size += len(both[taken]) + 1
            taken += 1
        self.parts, self.held = both[:taken], both[taken : 2 * taken]
        if len(self.held) < DRAWN:
            self.held = self.parts
        # the most frequent last: near matches are cheap
        self.prime = " ".join(reversed(self.parts)).encode()
        self.packer, self.frame = self._packer(self.prime)
        self.limits: dict[int, float] = {}

    @staticmethod
    def _packer(prime: bytes, level: int = LEVEL) -> tuple[zstandard.ZstdCompressor, int]:
        """A compressor primed with prime, and the bytes of its frame of the anchor alone."""
        words = zstandard.ZstdCompressionDict(prime + _ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(level, source_size=len(_ANCHOR) + WINDOW, dict_size=len(prime) + len(_ANCHOR), strategy=zstandard.STRATEGY_BTOPT, write_checksum=False, write_content_size=False)
        words.precompute_compress(compression_params=settings)
        packer = zstandard.ZstdCompressor(dict_data=words, compression_params=settings)
        return packer, len(packer.compress(_ANCHOR))

    def cost(self, window: str, packer: zstandard.ZstdCompressor | None = None, frame: int = 0) -> float:
        """Marginal bytes per byte of a window, by the identifier dictionary unless another packer is given."""
        raw = window.lower().encode()
        return (len((packer or self.packer).compress(_ANCHOR + raw)) - (frame if packer else self.frame)) / len(raw)

    def limit(self, n: int) -> float:
        """The cost from which a window of n characters is incompressible."""
        if n not in self.limits:
            rng = random.Random(n)
            known, chance = [], []
            for _ in range(DRAWN):
                known.append(self.cost("".join(rng.choices(self.held, k=1 + n // 4))[:n]))
                chance.append(self.cost("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))))
            known.sort()
            chance.sort()
            self.limits[n] = (known[DRAWN * 95 // 100] + chance[DRAWN // 20]) / 2
        return self.limits[n]

    def novel(self, text: str, start: int, end: int) -> bool:
        """Whether neither identifiers nor its surroundings explain some window of text[start:end]."""
        word = text[start:end]
        count = -(-len(word) // WINDOW)
        sides = None
        for i in range(count):
            at, to = i * len(word) // count, (i + 1) * len(word) // count
            window = word[at:to]
            if self.cost(window) < self.limit(to - at):
                continue
            if sides is None:
                sides = [text[max(0, start - AROUND) : start].replace(word, ""), text[end : end + AROUND].replace(word, "")]
            around = f"{sides[1]} {(sides[0] + ' ' + word[max(0, at - AROUND) : at])[-AROUND:]} "
            if self.cost(window, *self._packer(self.prime[-NEAR:] + around.lower().encode(errors="replace"))) >= self.limit(to - at):
                return True
        return False


@cache
def measure(path: str, words: tuple[str, ...] = ()) -> Novelty:
    """One measure per worker, vocabulary file and words."""
    return Novelty(path, words)


def mine(docs: DataFrame, most: int = MINED) -> tuple[str, ...]:
    """The words in most documents of docs (text and perhaps lang): the first of each language, then the second ones, and so on."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    each = docs.select(lang.alias("lang"), F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9+/_=-]+"))).alias("word"))
    counts = each.where(F.length("word").between(4, 15)).groupBy("lang", "word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    ranked = counts.where(F.col("word").rlike("^[a-z]+$")).withColumn("rank", rank).where(F.col("rank") <= most)
    return tuple(dict.fromkeys(r["word"] for r in ranked.orderBy("rank", "lang").limit(most).collect()))


def _known(text: str, start: int, end: int, spans: list[_Span]) -> bool:
    """Whether base spans already say what text[start:end] is: an assignment there, or a span that covers it, but for a name before "="."""
    return any(s < end and start < e and (k == 0 or (e >= end and (s <= start or text[s - 1] == "="))) for s, k, e in spans)


def _runs(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, in a PEM block) of each candidate run: all of the text, parts around "=" apart, in order."""
    blocks = [m.span(2) for m in _PEM.finditer(text)] if "-----BEGIN " in text else []
    found = [(s + m.start(1), s + m.end(1)) for s, e in blocks for m in _PEM_LINE.finditer(text[s:e]) if len(m[1]) < 16]
    for m in _CANDIDATE.finditer(text):
        parts = [x.span() for x in _PART.finditer(text, *m.span()) if len(x[0]) >= 16]
        found += parts or [m.span()]
    found.sort()
    out, k = [], 0
    for start, end in found:
        while k < len(blocks) and blocks[k][1] <= start:
            k += 1
        out.append((start, end, k < len(blocks) and blocks[k][0] < end))
    return out


def scan(text: str, novelty: Novelty | None = None) -> list[_Span]:
    """All spans of a text, by start, then kind; without a measure that of the default vocabulary alone judges.

    A string that stands both behind and only in front of cues is reported behind them; redact() masks its copies too.
    """
    base = base_spans(text)
    runs = _runs(text)
    cues = [m.span() for m in _CUES.finditer(text)] if runs else []
    novel = (novelty or measure(default_path())).novel
    found, words, ahead, near, k = [], set(), [], [], 0
    for start, end, pem in runs:
        while k < len(base) and base[k][0] < end:
            near.append(base[k])
            k += 1
        near = [x for x in near if x[2] > start]
        if not (pem or cues) or _known(text, start, end, near):
            continue
        if pem or cues[0][0] < end:
            if novel(text, start, end):
                found.append((start, 3, end))
                words.add(text[start:end])
        else:
            ahead.append((start, end))
    found += [(s, 3, e) for s, e in ahead if text[s:e] not in words and novel(text, s, e)]
    return sorted(base + found)


def with_copies(text: str, spans: list[_Span]) -> list[_Span]:
    """spans and the other occurrences of their novel strings of 16 or more characters."""
    words = {text[s:e] for s, k, e in spans if k == 3 and e - s >= 16}
    return sorted({*spans, *((s, 3, e) for s, e, _ in _runs(text) if text[s:e] in words)}) if words else spans


def _joined(spans: list[_Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan_batches(path: str, words: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = measure(path, words)
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                spans = scan(text or "", novelty)
                base = [x for x in spans if x[1] < 3]
                n = [sum(x[1] == k for x in spans) for k in range(4)]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return run


def find_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, counts by kind, base_sha256, spans) for docs with doc_id and text, and lang if there is one."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(_scan_batches(vocabulary or default_path(), mine(docs)), schema)


def mask(text: str | None, spans: list[_Span], mark: str = "[SECRET]") -> str | None:
    """The text with each maximal stretch of overlapping spans replaced by mark."""
    if not spans:
        return text
    out, at, until = [], 0, -1
    for start, _, end in spans:
        if start >= until:
            out += [text[at:start], mark]
            at = until = end
        else:
            at = until = max(until, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs with every secret in text masked; n_chars, where present, follows the text.

    Columns keep their names and places, whatever they are called.
    """
    path, words = vocabulary or default_path(), mine(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = measure(path, words)
        for batch in slices(batches):
            i = batch.schema.get_field_index("text")
            texts = [mask(t, with_copies(t or "", scan(t or "", novelty))) for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    plain = plain_names(docs, "text")
    out = plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))
