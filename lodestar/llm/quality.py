"""Quality rules: counted base rules and a linear-chain CRF over the lines of a text.

Each line is described by a few shares (symbols, capitals, repeated words, ...).
Viterbi decoding of a two-label chain marks every line as content or
boilerplate; a document stays when content lines hold enough of its words.

* Words are runs of characters other than space and \\x09-\\x0D; lines are split at \\n.
* A null or empty text has no words and fails the base rules.
* Without labelled documents of both classes there is no model: base rules decide.
* Rows are judged one by one; repeated rows get equal verdicts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.storage import ship_package

#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

#: Share of the words that content lines must hold.
MIN_CONTENT = 0.5
#: Labelled documents per class used to fit the chain.
SAMPLE_PER_CLASS = 600
#: Neighbouring lines of a sampled document that the fit looks at; they begin anywhere in it.
FIT_LINES = 40

#: Features of a line.
FEATURES = 10

CONTENT, BOILERPLATE = 0, 1
_LOWER, _UPPER, _DIGIT, _SYMBOL, _BAR, _MARK, _SPACE, _OTHER = range(8)


def _byte_classes() -> np.ndarray:
    table = np.full(256, _OTHER, dtype=np.uint8)
    for name, code in (
        ("abcdefghijklmnopqrstuvwxyz", _LOWER),
        ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER),
        ("0123456789", _DIGIT),
        ("#*$%&<>", _SYMBOL),
        ("|", _BAR),
        ("!?", _MARK),
        (SPACES, _SPACE),
    ):
        table[list(name.encode())] = code
    table[0x80:] = _LOWER  # bytes of letters beyond ASCII
    return table


_CLASSES = _byte_classes()


@dataclass
class LineModel:
    """Emission weights (features x labels), transitions, start and scaling."""

    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a three-word window that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    pairs = code[:-1] * len(ids) + code[1:]
    if len(ids) > 1 << 20:  # keep the triple within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    triples = pairs[:-1] * len(ids) + code[2:]
    order = np.argsort(triples, kind="stable")
    same = triples[order][1:] == triples[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line in seen:
            duplicates += 1
        elif line.strip(SPACES):
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        duplicates,
        repeated_words(words),
    )


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the lines that have a word, and the words of each."""
    data = text.encode()
    parts = data.split(b"\n")
    tokens = [p.split() for p in parts]
    n_words = np.array([len(t) for t in tokens])
    distinct = np.array([len(set(t)) for t in tokens])
    # Consecutive equal words tell a stuttering line from a long one.
    stutter = np.array([sum(map(bytes.__eq__, t, t[1:])) for t in tokens])
    array = np.frombuffer(data, dtype=np.uint8)
    line = np.cumsum(array == 10)
    kinds = np.bincount(line * 8 + _CLASSES[array], minlength=8 * len(parts)).reshape(-1, 8)
    visible = np.maximum(kinds.sum(1) - kinds[:, _SPACE], 1)
    letters = np.maximum(kinds[:, _LOWER] + kinds[:, _UPPER], 1)
    some = np.maximum(n_words, 1)
    features = np.stack(
        [
            kinds[:, _SYMBOL] / visible,
            np.minimum(kinds[:, _BAR] / some, 1.0),
            np.minimum(kinds[:, _MARK] / some, 2.0),
            kinds[:, _UPPER] / letters,
            kinds[:, _DIGIT] / visible,
            kinds[:, _OTHER] / visible,
            1 - distinct / some,
            stutter / some,
            np.log1p(n_words),
            np.minimum(visible / some, 30.0) / 10,
        ],
        axis=1,
    )
    full = n_words > 0
    return features[full], n_words[full]


def viterbi(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> list[int]:
    """Best label of each line; ties go to content."""
    rows = emissions.tolist()
    if not rows:
        return []
    (a, b), (c, d) = transitions.tolist()
    first = start.tolist()
    zero, one = first[0] + rows[0][0], first[1] + rows[0][1]
    back: list[tuple[bool, bool]] = []
    for e0, e1 in rows[1:]:
        to_zero, to_one = zero + a < one + c, zero + b < one + d
        back.append((to_zero, to_one))
        zero, one = max(zero + a, one + c) + e0, max(zero + b, one + d) + e1
    path = [int(one > zero)]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def content_share(text: str, model: LineModel | None) -> float:
    """Share of the words that stand on content lines; 0 without words."""
    features, n_words = line_features(text)
    if not len(n_words):
        return 0.0
    if model is None:
        return 1.0
    labels = np.array(viterbi(model.emissions(features), model.transitions, model.start))
    return float(n_words[labels == CONTENT].sum() / n_words.sum())


def judge(text: str | None, model: LineModel | None) -> tuple:
    """The five counts, base_failed, content share and verdict of one text."""
    text = text or ""
    counts = base_counts(text)
    n_words, n_repeat = counts[0], counts[4]
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    share = content_share(text, model)
    return (*counts, failed, share, not failed and share >= MIN_CONTENT)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit_block(text: str) -> np.ndarray:
    """Features of at most FIT_LINES neighbouring lines, from a place that the text's checksum draws."""
    features, _ = line_features(text)
    spare = len(features) - FIT_LINES
    first = zlib.crc32(text.encode()) % (spare + 1) if spare > 0 else 0
    return features[first : first + FIT_LINES]


def fit_chain(texts: list[str], good: list[bool]) -> LineModel | None:
    """The chain of texts whose lines carry the document's label."""
    return fit_blocks([fit_block(t) for t in texts], good)


def fit_blocks(
    blocks: list[np.ndarray], good: list[bool], steps: int = 120, rate: float = 0.05
) -> LineModel | None:
    """Maximum-likelihood chain from blocks of lines that carry their document's label.

    Gradients come from forward-backward over padded batches; Adam steps on all
    rows, so the result depends on the sample alone.
    """
    rows = [(f, g) for f, g in zip(blocks, good) if len(f)]
    if len({g for _, g in rows}) < 2:
        return None
    every = np.concatenate([f for f, _ in rows])
    mean, scale = every.mean(0), every.std(0) + 1e-3
    n, longest, width = len(rows), max(len(f) for f, _ in rows), every.shape[1] + 1
    x = np.zeros((n, longest, width))
    mask = np.zeros((n, longest), dtype=bool)
    truth = np.zeros((n, longest), dtype=int)
    weight = np.zeros(n)
    share = sum(g for _, g in rows) / n
    for i, (f, g) in enumerate(rows):
        x[i, : len(f), :-1] = (f - mean) / scale
        x[i, : len(f), -1] = 1
        mask[i, : len(f)] = True
        truth[i] = CONTENT if g else BOILERPLATE
        weight[i] = 0.5 / (share if g else 1 - share) / len(f)
    params = [np.zeros((width, 2)), np.zeros((2, 2)), np.zeros(2)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    last = mask.sum(1) - 1
    index = np.arange(n)
    for step in range(1, steps + 1):
        w, t, s = params
        e = x @ w
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = s + e[:, 0]
        for k in range(1, longest):
            nxt = _log_sum(alpha[:, k - 1, :, None] + t, 1) + e[:, k]
            alpha[:, k] = np.where(mask[:, k, None], nxt, alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            prev = _log_sum(t + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            beta[:, k] = np.where(mask[:, k + 1, None], prev, 0)
        total = _log_sum(alpha[index, last], 1)
        node = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        pair = np.exp(
            alpha[:, :-1, :, None] + t + (e + beta)[:, 1:, None, :] - total[:, None, None, None]
        ) * mask[:, 1:, None, None]
        gold = np.eye(2)[truth] * mask[..., None]
        gold_pair = gold[:, :-1, :, None] * gold[:, 1:, None, :]
        v = weight[:, None, None]
        grads = [
            np.einsum("nlf,nlk->fk", x, (node - gold) * v) / n + 1e-3 * w,
            ((pair - gold_pair) * v[..., None]).sum((0, 1)) / n + 1e-3 * t,
            ((node - gold)[:, 0] * weight[:, None]).sum(0) / n + 1e-3 * s,
        ]
        for p, g, m in zip(params, grads, moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    w, t, s = params
    return LineModel(w, t, s, mean, scale)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS
) -> list[tuple[np.ndarray, bool]]:
    """Line blocks and labels of at most ``per_class`` documents of each class, by hash of the id.

    Ids are drawn from the labels first; the few of them are then looked up.
    Texts of any length take part: tasks make the blocks, so texts are neither
    shuffled nor sent to the driver. Of a repeated id the block of least bytes counts.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = None
    for value in (0, 1):
        part = known.where(F.col("quality") == value)
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = part if drawn is None else drawn.unionAll(part)
    ids = {row["doc_id"]: row["quality"] == 1 for row in drawn.collect()}
    if not ids:
        return []
    # At most 2 x per_class ids.
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "_id bigint")
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [fit_block(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blocks, pa.binary())], ["doc_id", "block"])

    rows = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .where(F.col("text").isNotNull())
        .join(F.broadcast(wanted), F.col("doc_id") == F.col("_id"), "left_semi")
        .mapInArrow(run, "doc_id bigint, block binary")
        .groupBy("doc_id")
        .agg(F.min("block").alias("block"))
        .collect()
    )
    found = sorted((r["doc_id"], bytes(r["block"])) for r in rows)
    return [(np.frombuffer(block).reshape(-1, FEATURES), ids[i]) for i, block in found]


def train_line_model(docs: DataFrame, labels: DataFrame) -> LineModel | None:
    """The chain fitted to a bounded sample of labelled documents."""
    sample = labelled_sample(docs, labels)
    return fit_blocks([b for b, _ in sample], [g for _, g in sample])


REPORT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("content_share", pa.float64()),
        ("kept", pa.bool_()),
    ]
)


def quality_report(docs: DataFrame, model: LineModel | None) -> DataFrame:
    """Counts and verdict of every row (``doc_id``, ``text``)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t, model) for t in batch.column("text").to_pylist()]
            columns = list(zip(*found)) or [()] * (len(REPORT) - 1)
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, list(REPORT)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *arrays], schema=REPORT)

    schema = (
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, content_share double, kept boolean"
    )
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def quality_filter(docs: DataFrame, model: LineModel | None) -> DataFrame:
    """The rows that the verdict keeps, with all their columns."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [judge(t, model)[-1] for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(mask, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
