"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line is labelled good or bad. A line's features are its own and those of the lines
before and after it; the chain adds weights for the labels of neighbours. The marginals
of forward-backward, weighted by the lines' lengths, average into the document's raw
score, and a logistic curve fitted on the training documents turns it into a probability.

Labels are given per document. Training starts with each line bearing its document's
label, then lets the lines of bad documents that look good be good, and trains again. It
uses at most ``per_class`` documents per label (by a hash of their ids), of at most
MAX_BYTES each, and never a held-out id. Scoring covers whole texts: documents of few lines
in batches, with one vectorised step per line position; a document of more than BLOCK_LINES
lines by itself, its features block by block and its chain as a scan over pieces of the chain
that step side by side, which gives the same marginals.

Edge cases: a null text is the empty one, which is one empty line, scored like any other;
a document with contradicting labels is not learned from; without labels of both kinds
every score is the share of label 1, or 0.5 without any; rows that repeat an id are scored
one by one, and learned from once, by the least of their texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.tables import settle

#: Training documents per label, and the longest that are taken.
PER_CLASS = 500
MAX_BYTES = 200_000
#: Share of ids, by hash, that are held out of training: one in so many.
FOLDS = 5
THRESHOLD = 0.3
#: Bytes and lines of text that are turned into features at once.
STEP_BYTES, BLOCK_LINES = 1_000_000, 20_000
#: Lines of one chain in training; longer documents are trained in pieces.
PIECE = 256
ITERATIONS = 70
RATE = 0.15
L2 = 1e-4

# Classes of bytes; a character outside ASCII counts once, by its first byte.
UPPER, LOWER, DIGIT, SPACE, SYMBOL, PIPE, STOP, SHOUT, OTHER, REST = range(10)
CLASSES = 10


def _byte_classes() -> np.ndarray:
    classes = np.full(256, OTHER, np.uint8)
    for members, name in (
        (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER),
        (b"abcdefghijklmnopqrstuvwxyz", LOWER),
        (b"0123456789", DIGIT),
        (b" \t\r\x0b\x0c", SPACE),
        (b"#*$%&<>", SYMBOL),
        (b"|", PIPE),
        (b".,;:?", STOP),
        (b"!", SHOUT),
    ):
        classes[list(members)] = name
    classes[0x80:0xC0] = REST  # continuation bytes
    classes[0xC0:] = LOWER  # letters of other scripts
    return classes


BYTE_CLASSES = _byte_classes()
WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+")
OWN = [
    "upper", "digit", "space", "symbol", "pipe", "stop", "shout", "other",
    "length", "word_length", "distinct", "repeated", "ends", "empty",
]
#: Own features, the same of both neighbours, whether there are neighbours, and a constant.
N_FEATURES = 3 * len(OWN) + 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass(frozen=True)
class Lines:
    """The lines of some documents: features, characters, and each document's first line."""

    features: np.ndarray
    chars: np.ndarray
    offsets: np.ndarray


def lines_of(texts: list[str] | list[bytes], seen: frozenset[bytes] | set[bytes] = frozenset()) -> Lines:
    """Features of all lines of the texts, from one pass over their bytes.

    ``seen`` are the lines that the first text had before what is given of it.
    """
    encoded = [t.encode() if isinstance(t, str) else t for t in texts]
    data = b"\n".join(encoded)
    raw = np.frombuffer(data, np.uint8)
    breaks = np.flatnonzero(raw == 10)
    n = len(breaks) + 1
    per_text = np.array([e.count(b"\n") + 1 for e in encoded])
    offsets = np.concatenate([[0], np.cumsum(per_text)])

    classes = BYTE_CLASSES[raw]
    if len(raw) > 1:  # capitals of Latin-1, whose second byte tells the case
        capital = (raw[:-1] == 0xC3) & (raw[1:] < 0x9F)
        classes[:-1][capital] = UPPER
    classes[breaks] = REST
    ends = np.concatenate([breaks, [len(raw)]])
    starts = np.concatenate([[0], breaks + 1])
    counts = np.zeros((n, CLASSES))
    before = 0
    for i in range(0, len(raw), STEP_BYTES):  # a line may be as long as the text
        ended = np.cumsum(raw[i : i + STEP_BYTES] == 10)
        line = ended - (raw[i : i + STEP_BYTES] == 10)
        some = np.bincount(line * CLASSES + classes[i : i + STEP_BYTES]).astype(np.float64)
        some.resize(-(-len(some) // CLASSES) * CLASSES)
        some = some.reshape(-1, CLASSES)
        counts[before : before + len(some)] += some
        before += int(ended[-1])
    chars = counts.sum(1) - counts[:, REST]

    words, distinct, repeated = np.zeros(n), np.ones(n), np.zeros(n)
    i = 0
    for number, text in enumerate(encoded):
        met = set(seen) if number == 0 else set()
        for part in text.split(b"\n"):
            total, different = _words_of(part)
            if total:
                words[i] = total
                distinct[i] = different / total
                repeated[i] = part in met
                met.add(part)
            i += 1
    last = np.where(ends > starts, raw[np.maximum(ends - 1, 0)] if len(raw) else 0, 0)

    letters = counts[:, UPPER] + counts[:, LOWER]
    whole = np.maximum(chars, 1)
    of_words = np.maximum(words, 1)
    own = np.column_stack(
        [
            counts[:, UPPER] / np.maximum(letters, 1),
            counts[:, DIGIT] / whole,
            counts[:, SPACE] / whole,
            np.minimum(counts[:, SYMBOL] / of_words, 2),
            np.minimum(counts[:, PIPE] / of_words, 2),
            np.minimum(counts[:, STOP] / of_words, 2),
            np.minimum(counts[:, SHOUT] / of_words, 2),
            counts[:, OTHER] / whole,
            np.log1p(chars) / 10,
            np.minimum(chars / of_words, 30) / 30,
            # Long lines of prose say some words again: compare with what their length lets expect.
            np.minimum(distinct * np.maximum(words, 1) ** 0.25, 3),
            repeated,
            np.isin(last, list(b".!?")),
            chars == 0,
        ]
    )
    first = np.zeros(n, bool)
    first[offsets[:-1]] = True
    final = np.zeros(n, bool)
    final[offsets[1:] - 1] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[final] = 0, 0
    features = np.column_stack([own, before, after, first, final, np.ones(n)])
    return Lines(features, chars, offsets)


def _words_of(line: bytes) -> tuple[int, int]:
    """Words, and different ones; of a very long line without a list of them."""
    if len(line) <= STEP_BYTES:
        found = line.split()
        return len(found), len(set(found))
    n, different = 0, set()
    for word in WORD.finditer(line):
        different.add(word[0])
        n += 1
    return n, len(different)


@dataclass(frozen=True)
class Model:
    """Weights of a line's features for good, of label pairs, and the logistic curve."""

    weights: np.ndarray
    pairs: np.ndarray
    curve: tuple[float, float]
    constant: float | None = None


def forward_backward(emissions: np.ndarray, pairs: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of bad and good per line, expected label pairs, and the log of all partition sums.

    All chains step together; the longest come first, so those that go on are a prefix.
    """
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = offsets[:-1][order], lengths[order]
    good = np.clip(emissions, -30, 30)
    local = np.exp(np.column_stack([np.minimum(0, -good), np.minimum(0, good)]))
    log_scale = np.maximum(good, 0).sum()
    step = np.exp(pairs)
    forward, scale = np.empty_like(local), np.empty(len(local))
    longest = int(lengths[0]) if len(lengths) else 0
    going = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(longest)]  # chains longer than t
    for t in range(longest):
        at = first[: going[t]] + t
        alpha = local[at] if t == 0 else (forward[at - 1] @ step) * local[at]
        total = alpha.sum(1)
        forward[at], scale[at] = alpha / total[:, None], total
    backward = np.ones_like(local)
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = first[: going[t + 1]] + t
        onward = local[at + 1] * backward[at + 1] / scale[at + 1][:, None]
        backward[at] = onward @ step.T
        expected += np.einsum("ni,ij,nj->ij", forward[at], step, onward)
    marginals = forward * backward
    marginals /= marginals.sum(1, keepdims=True)
    return marginals, expected, float(np.log(scale).sum() + log_scale)


def chain_marginals(good: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Marginals of good along one long chain, from the emissions.

    The chain is cut into pieces that step side by side. The product of each piece's steps
    gives what enters the next from either end, so these are known before the pieces are
    stepped through again.
    """
    n = len(good)
    length = math.isqrt(n) + 1
    pieces = -(-n // length)
    padded = np.zeros(pieces * length)
    padded[:n] = np.clip(good, -30, 30)
    local = np.exp(np.stack([np.minimum(0, -padded), np.minimum(0, padded)], 1)).reshape(pieces, length, 2)
    there = (np.arange(pieces * length) < n).reshape(pieces, length)
    step, first = np.exp(pairs), np.zeros(pieces, bool)
    first[0] = True

    def moved(at: int) -> np.ndarray:
        """The step to each piece's line ``at``; none before the chain and behind its end."""
        through = step[None] * local[:, at, None, :]
        if at == 0:
            through[0] = np.diag(local[0, 0])
        return np.where(there[:, at, None, None], through, np.eye(2))

    product = np.broadcast_to(np.eye(2), (pieces, 2, 2))
    for at in range(length):
        product = product @ moved(at)
        product = product / product.max((1, 2), keepdims=True)
    enters, leaves = np.ones((pieces, 2)), np.ones((pieces, 2))
    for i in range(1, pieces):
        enters[i] = enters[i - 1] @ product[i - 1]
        enters[i] /= enters[i].sum()
    for i in range(pieces - 2, -1, -1):
        leaves[i] = product[i + 1] @ leaves[i + 1]
        leaves[i] /= leaves[i].sum()
    forward = np.empty((pieces, length, 2))
    alpha = enters
    for at in range(length):
        alpha = (alpha[:, None, :] @ moved(at))[:, 0]
        alpha = alpha / alpha.sum(1, keepdims=True)
        forward[:, at] = alpha
    beta = leaves
    for at in range(length - 1, -1, -1):
        both = forward[:, at] * beta
        forward[:, at] = both / both.sum(1, keepdims=True)
        beta = (moved(at) @ beta[:, :, None])[:, :, 0]
        beta = beta / beta.sum(1, keepdims=True)
    return forward[:, :, 1].ravel()[:n]


def train(features: np.ndarray, labels: np.ndarray, offsets: np.ndarray, start: Model | None = None) -> Model:
    """Maximise the labels' likelihood by full-batch gradient steps with momentum (Adam)."""
    n_features = features.shape[1]
    theta = np.zeros(n_features + 4)
    if start is not None:
        theta[:n_features], theta[n_features:] = start.weights, start.pairs.ravel()
    inside = np.ones(len(labels), bool)
    inside[offsets[:-1]] = False
    at = np.flatnonzero(inside)
    observed_pairs = np.bincount(labels[at - 1] * 2 + labels[at], minlength=4).astype(float)
    observed = features.T @ labels
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, ITERATIONS + 1):
        pairs = theta[n_features:].reshape(2, 2)
        marginals, expected, _ = forward_backward(features @ theta[:n_features], pairs, offsets)
        slope = np.concatenate([observed - features.T @ marginals[:, 1], observed_pairs - expected.ravel()])
        slope = slope / len(labels) - L2 * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta += RATE * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
    return Model(theta[:n_features], theta[n_features:].reshape(2, 2), (1.0, 0.0))


def raw_scores(model: Model, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Length-weighted means of the lines' marginals per document, and the marginals."""
    marginals, _, _ = forward_backward(lines.features @ model.weights, model.pairs, lines.offsets)
    good = marginals[:, 1]
    return weighted(good, lines.chars, lines.offsets), good


def logistic(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve through labels over raw scores, by Newton steps."""
    x = np.column_stack([raw, np.ones(len(raw))])
    w = np.array([6.0, -3.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - p) - 0.05 * w
        curvature = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        w = w + np.linalg.solve(curvature, slope)
    return float(w[0]), float(w[1])


def fit_lines(texts: list[str], qualities: list[int]) -> Model:
    """A model from labelled texts; both labels must occur."""
    lines = lines_of(texts)
    quality = np.array(qualities)
    lengths = np.diff(lines.offsets)
    of_document = np.repeat(quality, lengths)
    cuts = [np.arange(a, b, PIECE) for a, b in zip(lines.offsets[:-1], lines.offsets[1:])]
    pieces = np.append(np.concatenate(cuts), lines.offsets[-1])
    model = train(lines.features, of_document, pieces)
    _, good = raw_scores(model, lines)
    labels = np.where((of_document == 0) & (good > 0.5), 1, of_document)
    # A bad document keeps at least its worst line bad.
    for a, b in zip(lines.offsets[:-1], lines.offsets[1:]):
        if of_document[a] == 0 and labels[a:b].all():
            labels[a + np.argmin(good[a:b])] = 0
    model = train(lines.features, labels, pieces, model)
    raw, _ = raw_scores(model, lines)
    return Model(model.weights, model.pairs, logistic(raw, quality))


def sample(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, text, quality`` of at most ``per_class`` documents per label, none held out."""
    agreed = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .select("doc_id", F.col("quality").cast("int").alias("quality"))
    )
    # Labels may cover a larger corpus: only ids that are there are chosen from.
    present = documents.where("doc_id is not null").select("doc_id").distinct()
    agreed = settle(agreed.join(present, "doc_id", "left_semi"), "crf-labels")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [agreed.where(F.col("quality") == q).orderBy(*order).limit(per_class).collect() for q in (0, 1)]
    rows = [(int(r.doc_id), r.quality) for part in chosen for r in part]
    # 2 * per_class ids, whatever the input's size: small enough to send to every task.
    few = F.broadcast(documents.sparkSession.createDataFrame(rows, "doc_id long, quality int"))
    taken = documents.select("doc_id", "text").join(few, "doc_id").where(F.octet_length("text") <= MAX_BYTES)
    # An id may stand on any number of rows; combined before the few texts are shuffled.
    return taken.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Trains on the driver from the bounded sample: 2 * per_class texts of MAX_BYTES at most."""
    rows = sorted((r.doc_id, r.quality, r.text) for r in sample(documents, labels, per_class).collect())
    qualities = [r[1] for r in rows]
    if len(set(qualities)) < 2:
        share = sum(qualities) / len(qualities) if qualities else 0.5
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), (0.0, 0.0), share)
    return fit_lines([r[2] for r in rows], qualities)


def _batches(texts: Iterator[str]) -> Iterator[list[bytes]]:
    """Texts of few lines together, one of many lines alone."""
    batch, size, lines = [], 0, 0
    for text in texts:
        encoded = text.encode()
        more = encoded.count(b"\n") + 1
        if batch and (size + len(encoded) > STEP_BYTES or lines + more > BLOCK_LINES):
            yield batch
            batch, size, lines = [], 0, 0
        batch.append(encoded)
        size, lines = size + len(encoded), lines + more
    if batch:
        yield batch


def _blocks(text: bytes) -> Iterator[Lines]:
    """The lines of one text, block by block, each with the features that it has in the whole text."""
    lines, seen = text.split(b"\n"), set()
    for start in range(0, len(lines), BLOCK_LINES):
        stop = min(start + BLOCK_LINES, len(lines))
        low, high = max(start - 1, 0), min(stop + 1, len(lines))
        found = lines_of([b"\n".join(lines[low:high])], seen)
        inner = slice(start - low, start - low + stop - start)
        features = found.features[inner]
        yield Lines(features, found.chars[inner], np.array([0, stop - start]))
        # The next block begins with this one's last line, which it has not seen before.
        seen.update(line for line in lines[low : stop - 1] if line.split())


def marginals_of(model: Model, texts: Iterator[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of some texts at a time each line's marginal and characters, and each text's first line."""
    for batch in _batches(texts):
        if len(batch) == 1 and batch[0].count(b"\n") >= BLOCK_LINES:
            blocks = [(block.features @ model.weights, block.chars) for block in _blocks(batch[0])]
            emissions, chars = (np.concatenate(column) for column in zip(*blocks))
            yield chain_marginals(emissions, model.pairs), chars, np.array([0, len(chars)])
        else:
            lines = lines_of(batch)
            marginals, _, _ = forward_backward(lines.features @ model.weights, model.pairs, lines.offsets)
            yield marginals[:, 1], lines.chars, lines.offsets


def weighted(good: np.ndarray, chars: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each text's mean of its lines' marginals, weighted by their lengths."""
    weights = np.maximum(chars, 1e-3)
    return np.add.reduceat(good * weights, offsets[:-1]) / np.add.reduceat(weights, offsets[:-1])


def scores_of(model: Model, texts: Iterator[str], n: int) -> np.ndarray:
    """The scores of ``n`` texts."""
    if model.constant is not None:
        return np.full(n, model.constant)
    a, b = model.curve
    raw = [weighted(*found) for found in marginals_of(model, texts)]
    return 1 / (1 + np.exp(-np.clip(a * np.concatenate([np.zeros(0), *raw]) + b, -30, 30)))


def scored(documents: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """Adds each text's probability of being good, replacing a column of that name."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(scores_of(model, iter(texts), len(texts)))

    return documents.withColumn(score, of(F.coalesce(F.col("text"), F.lit(""))))


def labelled_lines(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, line, n_chars, good``: every line's number, length and marginal."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "line", "n_chars", "good"]
        for batch in batches:
            done = 0
            for good, chars, offsets in marginals_of(model, (t.as_py() or "" for t in batch.column(1))):
                lengths = np.diff(offsets)
                ids = batch.column(0).take(pa.array(done + np.repeat(np.arange(len(lengths)), lengths)))
                number = np.arange(len(good)) - np.repeat(offsets[:-1], lengths)
                done += len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(number), pa.array(chars.astype(np.int64)), pa.array(good)], names
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        of, "doc_id long, line long, n_chars long, good double"
    )


def classify(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    model = fit(documents, labels, per_class)
    rows = scored(documents.select("doc_id", "text"), model)
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents predicted good, with the columns they came with."""
    model = fit(documents, labels, per_class)
    rows = documents.select(F.struct(*documents.columns).alias("document"), "text")
    return scored(rows, model).where(F.col("score") >= THRESHOLD).select("document.*")
