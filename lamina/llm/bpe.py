"""Byte-level BPE as a streaming transducer with a bounded lookahead.

A token of the final split may depend on bytes to its right: a merge of a lower rank
can take its last part away. How far that reaches follows from the merge list alone.
Let reach(x, r) be the number of bytes after the end of token x that decide whether x
stands there once all merges below rank r are done. Merge r joins a and b, so

    reach(b, r) decides b, hence a is decided by len(b) + reach(b, r) bytes if r may take it,
    and the token ab is decided by max(reach(b, r), reach(a, r) - len(b)) bytes.

One pass over the merges in rank order gives the largest reach of any token, the
sufficient lookahead. A window that holds more bytes than that after a token's end can
emit the token at once: no later byte changes it. The encoder splits a text into words as it
comes and passes each word's bytes through the transducer, words met before through a
memo in front of it; it keeps one window and the unfinished end of the text, whatever the
text's length.

Edge cases: a null text encodes as the empty text; the special token's string in a
text becomes its id, as the reference library does by default; ids that are not in the
vocabulary raise; bytes that are not UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: Characters read per step, and the longest end of text kept for the fast path.
SLICE = 32_768
HELD = 4_096
#: Chunks, and words that are no chunk, whose ids a worker remembers in each of two generations.
CHUNKS, WORDS = 200_000, 20_000
#: Texts whose ids a worker holds at once.
STEP = 500
#: Characters that are neither letters, digits nor white space, without the apostrophe.
MARKS = "!#$%&*+,-./:;<=>?@|"

# Letters and digits that Unicode 16 added to version 15.1, which the
# vocabulary's library knows and Python's character table does not.
NEW_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B "
    "1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D "
    "16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"
)
NEW_DIGITS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"


def _ranges(stated: str) -> list[tuple[int, int]]:
    return [tuple(int(end, 16) for end in pair.split("-")) for pair in stated.split()]


def _kind(first: str, stated: str) -> str:
    """A character class of all code points whose category starts so, as ranges."""
    known = np.zeros(sys.maxunicode + 2, bool)
    for code in range(sys.maxunicode + 1):
        known[code] = unicodedata.category(chr(code))[0] == first
    for low, high in _ranges(stated):
        known[low : high + 1] = True
    edges = np.flatnonzero(np.diff(known.astype(np.int8), prepend=0))
    return "".join(rf"\U{low:08x}-\U{high - 1:08x}" for low, high in edges.reshape(-1, 2))


@lru_cache(1)
def _patterns() -> dict[str, regex.Pattern]:
    letter, digit = _kind("L", NEW_LETTERS), _kind("N", NEW_DIGITS)
    other = rf"[^\s{letter}{digit}]"
    return {
        # Fixed value: the pattern that splits a text before the merges.
        "words": regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?{other}+|\s+(?!\S)|\s+"
        ),
        "runs": [regex.compile(run) for run in (rf"[{letter}]*", rf"[{digit}]*", rf"{other}*", r"\s*")],
        "boundary": regex.compile(r"(?r)(?<=\S) (?=\S)"),
    }


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token's end that settle whether it is in the final split."""
    reach: dict[bytes, int] = {}
    for a, b in merges:
        of_a, of_b = reach.get(a, 0), reach.get(b, 0)
        reach[a + b] = max(reach.get(a + b, 0), of_b, of_a - len(b))
        reach[a] = max(of_a, len(b) + of_b)
    return max(reach.values(), default=0)


class Merges:
    """The vocabulary: ids of bytes, ranked merges, bytes of ids, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        alphabet = byte_alphabet()
        as_bytes = lambda shown: bytes(alphabet[c] for c in shown)
        vocabulary = {as_bytes(shown): i for shown, i in stored["model"]["vocab"].items()}
        pairs = [(as_bytes(a), as_bytes(b)) for a, b in stored["model"]["merges"]]
        self.single = [vocabulary[bytes([b])] for b in range(256)]
        self.ranked = {
            vocabulary[a] << 32 | vocabulary[b]: rank << 32 | vocabulary[a + b] for rank, (a, b) in enumerate(pairs)
        }
        # The same for two single bytes, by both as one number.
        self.of_bytes = [self.ranked.get(a << 32 | b, NONE) for a in self.single for b in self.single]
        self.bytes_of = {i: b for b, i in vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.length_of = {i: len(b) for i, b in self.bytes_of.items()}
        self.lookahead = sufficient_lookahead(pairs)

    def split(self, data: bytes) -> list[int]:
        """The ids of some bytes, all at once: lowest rank first, leftmost first."""
        ids = [self.single[b] for b in data]
        return self._split_short(data, ids) if len(ids) <= 40 else self._split_long(ids)

    def _split_short(self, data: bytes, ids: list[int]) -> list[int]:
        ranked, of_bytes = self.ranked.get, self.of_bytes
        found = [of_bytes[a << 8 | b] for a, b in pairwise(data)]
        while found and (best := min(found)) < NONE:
            i = found.index(best)
            ids[i] = joined = best & ID
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = ranked(ids[i - 1] << 32 | joined, NONE)
            if i < len(found):
                found[i] = ranked(joined << 32 | ids[i + 1], NONE)
        return ids

    def _split_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for long runs."""
        n, ranked = len(ids), self.ranked
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        pairs = [a << 32 | b for a, b in pairwise(ids)]
        heap = [(ranked[pair], i, pair) for i, pair in enumerate(pairs) if pair in ranked]
        heapq.heapify(heap)
        while heap:
            best, i, pair = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j < 0 or ids[i] << 32 | ids[j] != pair:
                continue
            ids[i], ids[j] = best & ID, -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0:
                    pair = ids[k] << 32 | ids[right[k]]
                    if pair in ranked:
                        heapq.heappush(heap, (ranked[pair], k, pair))
        return [i for i in ids if i >= 0]


#: No merge; the part of a ranked merge that is the joined id.
NONE, ID = 1 << 62, (1 << 32) - 1


class Transducer:
    """Bytes of one run in, final ids out, as soon as the lookahead settles them."""

    def __init__(self, merges: Merges, window: int = 0):
        self.merges = merges
        self.window = max(window, 2 * merges.lookahead, merges.lookahead + 2)
        self.kept = b""

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for start in range(0, len(data), self.window):
            self.kept += data[start : start + self.window]
            if len(self.kept) > self.window:
                out += self._settled()
        return out

    def _settled(self) -> list[int]:
        ids, end, n = self.merges.split(self.kept), 0, 0
        for i in ids:
            if end + self.merges.length_of[i] + self.merges.lookahead > len(self.kept):
                break
            end, n = end + self.merges.length_of[i], n + 1
        self.kept = self.kept[end:]
        return ids[:n]

    def finish(self) -> list[int]:
        ids, self.kept = self.merges.split(self.kept), b""
        return ids

    def run(self, data: bytes) -> list[int]:
        """The ids of a run that is there as a whole."""
        return self.feed(data) + self.finish()


class Remembered(dict):
    """Ids, as packed 32-bit integers, by the string that they were found for.

    Two generations: when the young one is full it becomes the old one, and what is
    met again moves over, so frequent strings stay and the size stays bounded.
    """

    def __init__(self, find, size: int):
        super().__init__()
        self.find, self.size, self.old = find, size, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key) or self.find(key)
        if self.size:
            self[key] = found
        return found


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Encoder:
    """Text in by slices, packed ids out; what it keeps does not grow with the text."""

    def __init__(self, merges: Merges, held: int = HELD):
        self.merges, self.held = merges, held
        self.patterns = _patterns()
        self.words = Remembered(self._word, WORDS)
        self.chunks = Remembered(self._chunk, CHUNKS)
        self.special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None
        self.longest = max(map(len, merges.special), default=1)
        self.rest, self.run = "", None
        self.transducer = Transducer(merges)

    def _split(self, text: str) -> list[str]:
        return self.patterns["words"].findall(text)

    def _word(self, word: str) -> bytes:
        return packed(self.transducer.run(word.encode()))

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of one space and the text up to the next; none if white space meets the space."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        letters = chunk.rstrip(MARKS)
        if letters.isalpha():
            marks = chunk[len(letters) :]
            return self.chunks[letters] + self.words[marks] if marks else self._word(" " + letters)
        return self._joined(" " + chunk)

    def _joined(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self._split(text)))

    def encode(self, text: str) -> Iterator[bytes]:
        for start in range(0, len(text), SLICE):
            yield from self.feed(text[start : start + SLICE])
        yield from self.finish()

    def feed(self, text: str) -> Iterator[bytes]:
        text, self.rest = self.rest + text, ""
        if any(special in text for special in self.merges.special):
            while found := self.special.search(text):
                yield from self._plain(text[: found.start()])
                yield from self._end()
                yield packed([self.merges.special[found[0]]])
                text = text[found.end() :]
        yield from self._plain(text)

    def finish(self) -> Iterator[bytes]:
        yield from self._end()

    def _end(self) -> Iterator[bytes]:
        """All that is kept, as nothing follows."""
        text, self.rest = self.rest, ""
        if self.run:
            text = yield from self._continue(text, last=True)
        yield from self._all(text)

    def _all(self, text: str) -> Iterator[bytes]:
        """Ids of a text that nothing can follow: chunk by chunk where spaces stand alone."""
        first, *others = text.split(" ")
        if others and not first[-1:].isspace():
            try:
                yield self._joined(first) + b"".join(map(self.chunks.__getitem__, others))
                return
            except TypeError:  # a chunk that has no ids of its own
                pass
        yield self._joined(text)

    def _plain(self, text: str) -> Iterator[bytes]:
        """Ids that no following text can change; the rest is kept."""
        if self.run:
            text = yield from self._continue(text, last=False)
            if self.run:
                return
        if cut := self.patterns["boundary"].search(text, max(0, len(text) - self.held)):
            yield from self._all(text[: cut.start()])
            self.rest = text[cut.start() :]
        elif len(text) <= self.held:
            self.rest = text
        else:
            yield from self._without_boundary(text)

    def _without_boundary(self, text: str) -> Iterator[bytes]:
        """No lone space near the end: settle all words but those at the end, stream a long one."""
        starts = [m.start() for m in self.patterns["words"].finditer(text)]
        # The last three words may still change: an apostrophe waits for two letters, a
        # special token for its end. White space goes with what follows it.
        n = len(starts) - 3
        while n > 0 and (starts[n] > len(text) - self.longest or text[starts[n] - 1].isspace()):
            n -= 1
        n = max(n, 0)
        yield b"".join(map(self.words.__getitem__, self._split(text)[:n]))
        self.rest = text[starts[n] :]
        if len(self.rest) > 2 * self.held and len(word := self._split(self.rest)[0]) > self.held:
            self.run = (self._run_of(word), Transducer(self.merges))
            text, self.rest = self.rest, ""
            lead = 1 if word[0] == " " and not word.isspace() else 0
            yield packed(self.run[1].feed(text[:lead].encode()))
            yield from self._plain(text[lead:])

    def _run_of(self, word: str) -> int:
        return next(i for i, run in enumerate(self.patterns["runs"]) if run.fullmatch(word.removeprefix(" ") or " "))

    def _continue(self, text: str, last: bool) -> Iterator[bytes]:
        """Feed the run on; returns the text after it, once it has ended."""
        kind, transducer = self.run
        text, self.rest = self.rest + text, ""
        end = self.patterns["runs"][kind].match(text).end()
        ended = last or len(text) - end >= self.longest  # else a special token may begin there
        if not ended:
            end = max(min(end, len(text) - self.longest) - 1, 0)
        elif kind == 3 and end < len(text):
            end = max(end - 1, 0)  # the last white space goes with what follows, or alone
        yield packed(transducer.feed(text[:end].encode()))
        if ended:
            yield packed(transducer.finish())
            self.run = None
            return text[end:]
        self.rest = text[end:]
        return ""


class Decoder:
    """Ids in, text out as soon as its bytes are whole characters."""

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        text = self.state.decode(b"", True)
        self.state.reset()
        return text

    def decode(self, ids: np.ndarray) -> str:
        steps = range(0, len(ids), SLICE)
        return "".join([self.feed(ids[i : i + SLICE].tolist()) for i in steps] + [self.finish()])


@lru_cache(2)
def merges_of(path: str) -> Merges:
    return Merges(path)


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    return Encoder(merges_of(path))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the text's ids, replacing a column of that name. ``vocabulary`` is a path on every executor."""

    @F.pandas_udf("array<int>")
    def ids_of(texts: pd.Series) -> pd.Series:
        encoder = encoder_of(vocabulary)
        return pd.Series([np.frombuffer(b"".join(encoder.encode(t)), np.int32) for t in texts], dtype=object)

    return df.withColumn(ids, ids_of(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the text of the ids, replacing a column of that name; null ids give the empty text."""

    @F.pandas_udf("string")
    def text_of(rows: pd.Series) -> pd.Series:
        decoder = Decoder(merges_of(vocabulary))
        return pd.Series([decoder.decode(row) if row is not None else "" for row in rows], dtype=object)

    return df.withColumn(text, text_of(F.col(ids)))


def encode_and_decode(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns to keep, the text's ids, and the text ``decoded`` from them, in one pass.

    Rows leave in slices, so a worker holds the ids of STEP texts, not of a whole batch.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = encoder_of(vocabulary), Decoder(merges_of(vocabulary))
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                rows = batch.slice(start, STEP)
                ids = [
                    np.frombuffer(b"".join(encoder.encode(t)), np.int32) for t in rows.column(len(keep)).to_pylist()
                ]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                decoded = pa.array([decoder.decode(row) for row in ids], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[: len(keep)], lists, decoded], [*keep, "ids", "decoded"]
                )

    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text to encode"))
    schema = T.StructType(df.select(*keep).schema.fields)
    schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())
    return rows.mapInArrow(of, schema)


def round_trip(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The digests of each text's ids and of the text decoded from them.

    Ids are hashed and decoded as they come, so of a text's ids and decoded text no more than a slice is held.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests(vocabulary)
        for batch in batches:
            rows = [digests.of(text.as_py()) for text in batch.column(1)]
            columns = [pa.array(column) for column in zip(*rows)] if rows else [pa.array([], pa.null())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *DIGESTS])

    rows = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = T.StructType(rows.schema.fields[:1])
    for name, kind in zip(DIGESTS, (T.LongType(), T.StringType(), T.StringType())):
        schema = schema.add(name, kind)
    return rows.mapInArrow(of, schema)


DIGESTS = ["n_tokens", "ids_sha256", "decoded_sha256"]


class Digests:
    """Counts and hashes a text's ids and the text decoded from them, slice by slice."""

    def __init__(self, vocabulary: str):
        merges = merges_of(vocabulary)
        self.encoder, self.decoder = encoder_of(vocabulary), Decoder(merges)
        self.decimal = [str(i) for i in range(max(merges.bytes_of) + 1)]

    def of(self, text: str) -> tuple[int, str, str]:
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self._slices(text):
            shown = ",".join(map(self.decimal.__getitem__, ids))
            of_ids.update(f",{shown}".encode() if n else shown.encode())
            of_text.update(self.decoder.feed(ids).encode())
            n += len(ids)
        of_text.update(self.decoder.finish().encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()

    def _slices(self, text: str) -> Iterator[list[int]]:
        pieces, size = [], 0
        for piece in self.encoder.encode(text):
            pieces.append(piece)
            size += len(piece)
            if size > 4 * SLICE:
                yield np.frombuffer(b"".join(pieces), np.int32).tolist()
                pieces, size = [], 0
        if size:
            yield np.frombuffer(b"".join(pieces), np.int32).tolist()
