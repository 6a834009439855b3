"""Quality rules: compression bands.

A text is compressed with Zstandard as a whole and in fixed chunks. Text that repeats
itself compresses far better than prose, noise far worse, and both depend on the length:
the frame's fixed cost weighs on short texts, and long ones find more to refer back to.
Each length therefore has its own band of ratios (plain bytes over compressed bytes). A
document is rejected if its whole ratio leaves the band of its length, or if more than
half of its bytes lie in chunks whose ratios leave the band of the chunk's length.

Words are runs of characters that are not ASCII white space. The base rules, which
reject on their own, ask for fifty words and for at most half of the words in three-word
windows that occur twice or more.

Edge cases: a null text is the empty one and fails the base rules; a text of white space
has no words; chunks are cut between bytes, also inside a character; the same text always
gets the same verdict, whatever rows stand beside it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVEL = 3
CHUNK = 4096
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_BAD_CHUNKS = 0.5
SYMBOLS = b"#*$%&|<>"
LETTERS_AND_REST = bytes(b for b in range(256) if b not in SYMBOLS)
SPACES = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Band:
    """The ratios that texts below so many bytes may have."""

    below: float
    low: float
    high: float


#: Wide enough for prose of any language with some boilerplate: prose lies near 0.8 at 50
#: bytes, 1.6 at 500, 2.1 at 4 KB and 2.5 at 100 KB; random letters and base64 at 1.3 from
#: 1 KB on; a phrase said over and over above 5 from 500 bytes on.
BANDS = (
    Band(64, 0.0, 2.5),
    Band(256, 0.7, 2.75),
    Band(1024, 1.05, 3.0),
    Band(4096, 1.4, 3.5),
    Band(16384, 1.5, 4.0),
    Band(65536, 1.6, 4.5),
    Band(float("inf"), 1.7, 5.0),
)

MEASURES = T.StructType(
    [
        *[
            T.StructField(name, T.LongType())
            for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        ],
        T.StructField("whole_ratio", T.DoubleType()),
        T.StructField("bad_chunk_share", T.DoubleType()),
        T.StructField("whole_in_band", T.BooleanType()),
    ]
)


def in_band(size: int, ratio: float, bands: tuple[Band, ...] = BANDS) -> bool:
    band = next(b for b in bands if size < b.below)
    return band.low <= ratio <= band.high


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    total, covered = 0, 0  # words before `covered` are counted
    for i, window in enumerate(windows):
        if found[window] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def repeated_lines(data: bytes) -> int:
    lines = [line for line in data.split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def measure(text: str, compressor: zstandard.ZstdCompressor, bands: tuple[Band, ...] = BANDS) -> tuple:
    data = text.encode()
    words = data.split()
    size = len(data)
    ratio = size / len(compressor.compress(data)) if size else 0.0
    outside = 0
    if size <= CHUNK:
        outside = 0 if in_band(size, ratio, bands) else size
    else:
        for start in range(0, size, CHUNK):
            chunk = data[start : start + CHUNK]
            if not in_band(len(chunk), len(chunk) / len(compressor.compress(chunk)), bands):
                outside += len(chunk)
    return (
        len(words),
        len(text) - (size - sum(map(len, words))),
        len(data.translate(None, LETTERS_AND_REST)),
        repeated_lines(data),
        repeated_words(words),
        ratio,
        outside / size if size else 0.0,
        in_band(size, ratio, bands),
    )


def measured(documents: DataFrame, bands: tuple[Band, ...] = BANDS, level: int = LEVEL) -> DataFrame:
    """Adds the struct ``measures`` of each text, replacing a column of that name."""

    @F.pandas_udf(MEASURES)
    def of(texts: pd.Series) -> pd.DataFrame:
        compressor = zstandard.ZstdCompressor(level=level)
        return pd.DataFrame([measure(t, compressor, bands) for t in texts], columns=MEASURES.names)

    return documents.withColumn("measures", of(F.coalesce(F.col("text"), F.lit(""))))


def verdicts(documents: DataFrame, bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """``doc_id``, the measures, ``base_failed`` and ``kept`` per document."""
    rows = measured(documents.select("doc_id", "text"), bands).select("doc_id", "measures.*")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    accepted = F.col("whole_in_band") & (F.col("bad_chunk_share") <= MAX_BAD_CHUNKS)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & accepted)


def accepted(documents: DataFrame, bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    rows = measured(documents.select(F.struct(*documents.columns).alias("document"), "text"), bands)
    m = F.col("measures")
    enough = (m.n_words >= MIN_WORDS) & (100 * m.n_repeat_words <= MAX_REPEATED_PERCENT * m.n_words)
    return rows.where(enough & m.whole_in_band & (m.bad_chunk_share <= MAX_BAD_CHUNKS)).select("document.*")
