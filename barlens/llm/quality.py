"""Quality rules: line labels from a linear-chain conditional random field.

Every line with a word is content or boilerplate. A CRF over the lines of a text
scores each line's features and each pair of neighbouring labels; Viterbi decoding
gives the best labels, and the share of words in content lines decides whether the
document stays. Two base rules reject a document before that: fewer than
`min_words` words, or over half of the words in repeated 3-word windows.

The CRF is trained on at most `MAX_TRAIN_DOCS` labelled documents (those with the
smallest hash of the id), `MAX_SEGMENTS` segments of each: lines of documents of quality 1
count as content, of quality 0 as boilerplate. Half of the training sequences change their
label once, the start of a segment of one kind before the end of one of the other, so that the weights of changes are learnt from changes.
One task fits the model on that bounded sample; only its weights reach the driver.

Defined results: a null or empty text has no words and fails the base rules; a
null id is kept as it is and never used for training; labels that are null or
missing train nothing; with no labels of one kind, only the base rules reject;
repeated rows are judged alike; extra columns pass through the stage.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.llm.common import add_columns, bounded_sample, fresh, table

MAX_TRAIN_DOCS = 2_000
MIN_WORDS = 50
MIN_CONTENT_SHARE = 0.5
# A training sequence; longer documents give several.
SEGMENT_LINES = 16
# Segments of a document that are trained on, spread evenly over it.
MAX_SEGMENTS = 8

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_NOT_END = bytes(b for b in range(256) if b not in b".!?,;:")

# Bin edges of each measure of a line; one indicator feature a bin.
BINS = (
    np.array([2, 4, 8, 16, 32, 64]),            # words
    np.array([3, 4, 5, 6, 8, 12]),              # bytes a word
    np.array([0.02, 0.1, 0.3, 0.6, 1.0]),       # symbols a word
    np.array([0.05, 0.2, 0.5, 0.8]),            # upper-case letters a byte of words
    np.array([0.02, 0.1, 0.3]),                 # digits a byte of words
    np.array([0.02, 0.1, 0.3, 0.6, 1.0]),       # sentence marks a word
    np.array([0.02, 0.1, 0.3]),                 # exclamation marks a word
    np.array([0.3, 0.5, 0.7, 0.9]),             # distinct words a word
    np.array([0.5]),                            # equal to an earlier line
)
OFFSETS = np.concatenate(([0], np.cumsum([len(b) + 1 for b in BINS])))
N_FEATURES = int(OFFSETS[-1])


class Measured:
    """Base counts of a text and the binned measures of its lines."""

    __slots__ = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features", "weights")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more. Exact: windows are compared by word numbers."""
    n = len(words)
    if n < 4:
        return 0
    numbers = defaultdict(count().__next__)
    ids = np.array([numbers[w] for w in words], dtype=np.int64)
    size = len(numbers)
    pair = ids[:-2] * size + ids[1:-1]
    if size >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * size + ids[2:]
    order = np.argsort(key, kind="stable")
    equal = np.diff(key[order]) == 0
    if not equal.any():
        return 0
    twice = np.zeros(len(key), dtype=bool)
    twice[order[:-1][equal]] = True
    twice[order[1:][equal]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k:k + len(key)] |= twice
    return int(covered.sum())


def measure(text: bytes | None) -> Measured:
    out = Measured()
    text = text or b""
    words, rows, seen, dup = [], [], set(), 0
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            continue
        again = line in seen
        dup += again
        seen.add(line)
        words += own
        n, size = len(own), len(line)
        letters = max(1, size - n + 1)
        marks = len(line.translate(None, _NOT_END))
        rows.append((n, letters / n, len(line.translate(None, _NOT_SYMBOL)) / n,
                     len(line.translate(None, _NOT_UPPER)) / letters,
                     len(line.translate(None, _NOT_DIGIT)) / letters,
                     marks / n, line.count(b"!") / n, len(set(own)) / n, float(again)))
    out.n_words = len(words)
    joined = b"".join(words)
    # Code points: bytes that don't continue a character.
    out.word_chars = len(joined.decode("utf-8", "replace"))
    out.n_symbols = len(joined.translate(None, _NOT_SYMBOL))
    out.n_dup_lines = dup
    out.n_repeat_words = repeated_words(words)
    measures = np.array(rows, dtype=np.float64).reshape(len(rows), len(BINS))
    out.weights = measures[:, 0]
    out.features = np.stack(
        [np.searchsorted(b, measures[:, k], side="right") + OFFSETS[k] for k, b in enumerate(BINS)], axis=1)
    return out


def base_failed(m: Measured, min_words: int = MIN_WORDS) -> bool:
    return m.n_words < min_words or 100 * m.n_repeat_words > 50 * m.n_words


def viterbi(emissions: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels (0 boilerplate, 1 content) for line scores `emissions` (n, 2) and `moves` (2, 2).

    Ties go to content.
    """
    n = len(emissions)
    score0, score1 = emissions[0]
    back = []
    (m00, m01), (m10, m11) = moves.tolist()
    for e0, e1 in emissions[1:].tolist():
        a0, b0, a1, b1 = score0 + m00, score1 + m10, score0 + m01, score1 + m11
        back.append((int(b0 >= a0), int(b1 >= a1)))
        score0, score1 = max(a0, b0) + e0, max(a1, b1) + e1
    labels = np.empty(n, dtype=np.int8)
    at = int(score1 >= score0)
    labels[-1] = at
    for i in range(n - 2, -1, -1):
        at = back[i][at]
        labels[i] = at
    return labels


def content_share(m: Measured, model: dict | None) -> float:
    """Share of words in the lines that Viterbi decoding marks as content."""
    if model is None or not len(m.features):
        return 1.0
    emissions = model["emit"][m.features].sum(axis=1)
    return float((viterbi(emissions, model["move"]) * m.weights).sum() / m.weights.sum())


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 100, ridge: float = 1.0) -> dict | None:
    """CRF weights by full-batch gradient ascent on the log-likelihood (Adam), all sequences at once.

    `sequences`: (line features, line labels) of at most 2 * SEGMENT_LINES lines each.
    """
    if len({int(y) for _, labels in sequences for y in labels}) < 2:
        return None
    n, longest = len(sequences), max(len(y) for _, y in sequences)
    features = np.zeros((n, longest, len(BINS)), dtype=np.int64)
    labels = np.zeros((n, longest), dtype=np.int64)
    mask = np.zeros((n, longest))
    for i, (x, y) in enumerate(sequences):
        features[i, :len(y)], labels[i, :len(y)], mask[i, :len(y)] = x, y, 1
    pair_mask = mask[:, 1:] * mask[:, :-1]
    truth = np.eye(2)[labels] * mask[..., None]
    # Both kinds weigh alike, however rare one is among the labelled lines.
    share = truth.sum(axis=(0, 1)) / mask.sum()
    weight = ((0.5 / share)[labels] * mask).sum(axis=1) / mask.sum(axis=1)
    emit, move = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (emit, move)]
    total, flat = (mask * weight[:, None]).sum(), features.ravel()
    for step in range(1, steps + 1):
        e = emit[features].sum(axis=2)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(alpha[:, t - 1, :, None] + move, axis=1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None] > 0, new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)[:, None, None]
        node = np.exp(np.minimum(alpha + beta - z, 0)) * mask[..., None]
        edge = np.exp(np.minimum(alpha[:, :-1, :, None] + move + (e + beta)[:, 1:, None, :] - z[..., None], 0))
        edge *= pair_mask[..., None, None]
        gap = (truth - node) * weight[:, None, None]
        grad_emit = np.stack([np.bincount(flat, np.repeat(gap[..., y].ravel(), len(BINS)), N_FEATURES)
                              for y in (0, 1)], axis=1)
        true_edge = truth[:, :-1, :, None] * truth[:, 1:, None, :]
        grad_move = ((true_edge - edge) * weight[:, None, None, None]).sum(axis=(0, 1))
        for p, g, (m1, m2) in zip((emit, move), (grad_emit, grad_move), state, strict=True):
            g = (g - ridge * p) / total
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.99
            m2 += 0.01 * g * g
            p += 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return {"emit": emit, "move": move}


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
          label_id: str = "doc_id", quality: str = "quality", max_docs: int = MAX_TRAIN_DOCS) -> dict | None:
    """CRF weights from a bounded sample of labelled documents; None with labels of one kind only."""
    wanted = labels.where(F.col(quality).isin(0, 1) & F.col(label_id).isNotNull()).groupBy(
        F.col(label_id).alias("sample_id")).agg(F.max(F.col(quality)).cast("int").alias("sample_label"))
    # Half of the sample for either label, so that a rare one is learnt as well.
    each = [bounded_sample(wanted.where(F.col("sample_label") == y), "sample_id", max_docs // 2) for y in (0, 1)]
    sample = F.broadcast(each[0].unionByName(each[1]))
    rows = docs.select(F.col(doc_id).alias("sample_id"), F.col(text).alias("sample_text")).join(sample, "sample_id")
    kind = pa.list_(pa.list_(pa.list_(pa.int16())))

    def maker():
        return lambda texts: [pa.array([[p.tolist() for p in segments(measure(t).features)] for t in texts], type=kind)]

    field = T.StructField("segments", T.ArrayType(T.ArrayType(T.ArrayType(T.ShortType()))))
    found = add_columns(rows, "sample_text", [field], maker, keep=["sample_id", "sample_label"])
    # An id that several rows share must not widen the sample: of its rows the one with the least segments counts.
    found = found.groupBy("sample_id").agg(F.min(F.struct("segments", "sample_label")).alias("x"))
    found = found.orderBy("sample_id").limit(max_docs).select("x.segments", "x.sample_label")

    def fitted(batches):
        parts = [(np.array(lines, dtype=np.int64).reshape(len(lines), len(BINS)), label) for batch in batches
                 for own, label in zip(*(c.to_pylist() for c in batch.columns)) for lines in own]
        yield pa.RecordBatch.from_pydict({"model": [cloudpickle.dumps(fit(training_sequences(parts)))]})

    model = found.coalesce(1).mapInArrow(fitted, "model binary").first()
    return None if model is None else cloudpickle.loads(model[0])


def segments(features: np.ndarray) -> list[np.ndarray]:
    """At most `MAX_SEGMENTS` runs of at most `SEGMENT_LINES` lines of a document, spread evenly."""
    starts = range(0, len(features), SEGMENT_LINES)
    chosen = sorted({round(k * (len(starts) - 1) / max(1, MAX_SEGMENTS - 1)) for k in range(MAX_SEGMENTS)}) if len(starts) > MAX_SEGMENTS \
        else range(len(starts))
    return [features[starts[k]:starts[k] + SEGMENT_LINES] for k in chosen]


def training_sequences(parts: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of every segment, and as many that change their label once, either way in turn.

    A changing one is the start of a segment and the end of one of the other label, cut at every share of it in turn."""
    out = [(x, np.full(len(x), label)) for x, label in parts]
    of = {y: [x for x, label in parts if label == y] for y in (0, 1)}
    if not of[0] or not of[1]:
        return out
    seen = [0, 0]
    for x, label in parts:
        i = seen[label]
        seen[label] += 1
        others = of[1 - label]
        other = others[i * 7919 % len(others)]
        a, b = 1 + i % max(1, len(x)), 1 + (i // 2) % max(1, len(other))
        first, last = (x[:a], other[-b:]) if i % 2 else (other[:b], x[-a:])
        kinds = (label, 1 - label) if i % 2 else (1 - label, label)
        out.append((np.concatenate([first, last])[:2 * SEGMENT_LINES], np.repeat(kinds, (len(first), len(last)))))
    return out


FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType()),
]


def _judge(model, min_words: int, min_share: float):
    def work(texts):
        rows = []
        for t in texts:
            m = measure(t)
            failed, share = base_failed(m, min_words), content_share(m, model)
            rows.append((m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, share,
                         not failed and share >= min_share))
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        return [pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]

    return work


def report(docs: DataFrame, model: dict | None, *, doc_id: str = "doc_id", text: str = "text",
           min_words: int = MIN_WORDS, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """One row a document: the base counts, the base verdict, the content share and the verdict."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return add_columns(rows, "text", FIELDS, lambda: _judge(model, min_words, min_share), keep=["doc_id"])


def keep_good(docs: DataFrame, model: dict | None, *, text: str = "text", min_words: int = MIN_WORDS,
              min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """The rows of `docs` that pass, with all their columns."""
    kept = fresh("kept", docs.columns)

    def maker():
        judge = _judge(model, min_words, min_share)
        return lambda texts: judge(texts)[-1:]

    found = add_columns(docs, text, [T.StructField(kept, T.BooleanType())], maker)
    return found.where(F.col(kept)).drop(kept)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return report(docs, train(docs, table(spark, sf_dir, "labels")))
