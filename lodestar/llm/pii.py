"""Personal data: exact base patterns, and spans added by a character BiLSTM-CRF.

Base spans come from four patterns (email, ip, card, phone), each leftmost and
non-overlapping per kind. A bidirectional LSTM over characters with CRF
transitions, trained in numpy from labelled spans, adds spans that the patterns
miss (other separators, no plus sign, a spelled at-sign, ...).

The tagger reads windows of WINDOW characters every STRIDE; each is decoded by
Viterbi. Reconciliation is global: a character belongs to the window in whose
middle it lies. Windows whose common seams carry labels form a chain. Where two
of them disagree about a seam, all windows of the chain give the log-scores of
their own characters and the chain is decoded again as one sequence, so the
transitions hold over the whole text; seams that both sides see alike hold them
already. Spans are read off the text's label sequence, and a model span that
meets a base span gives way.

A span must hold a trigger: a digit, ``@``, or the word ``at`` between other
characters than letters, as in ``(at)``, ``[at]`` and `` at ``. Windows that own a
trigger are run first, then the neighbours into which a label run goes on, until
none does; this changes no result (``every_window=True`` in tests).

* A null or empty text has no spans. Rows are judged one by one.
* Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.storage import ship_package

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, unambiguous so that scanning is linear.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
#: What a span must hold; _TRIGGER and the spelled at-sign.
_HELD = re.compile(r"[0-9@]|(?<![A-Za-z])[Aa][Tt](?![A-Za-z])")

WINDOW, STRIDE = 128, 64
#: Places in a window before and after its left and right seams.
_SEAMS = [STRIDE // 2 - 1, STRIDE // 2, STRIDE // 2 + STRIDE - 1, STRIDE // 2 + STRIDE]
HIDDEN, EMBEDDED = 16, 12
#: Bounded sample for training: documents, their longest text, windows and steps.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 20_000
TRAIN_WINDOWS, TRAIN_STEPS, TRAIN_BATCH = 900, 180, 40

Span = tuple[int, int, int]  # kind, start, end


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The at-signs from left to right: the local part reaches back over its characters."""
    floor, at = 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = at - (len(before) - len(before.rstrip(_LOCAL)))
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
        floor = match.end() if match else at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind."""
    found: list[Span] = []
    if "@" in text:
        found.extend((0, a, b) for a, b in _emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [g.lstrip("0") or "0" for g in m.groups()]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                found.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    found.append((3, *m.span()))
    return sorted(found, key=lambda s: (s[1], s[0], s[2]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# ---- the tagger -------------------------------------------------------------

#: Labels: 0 outside, 1 + 2k begin and 2 + 2k inside of kind k.
LABELS = 1 + 2 * len(KINDS)
_CHARS = 100
_NEVER = -1e4


def char_codes(text: str) -> np.ndarray:
    """Printable ASCII by code, then line breaks, other letters, the rest; 0 pads."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    codes = np.where((points >= 32) & (points < 127), points - 31, 98)
    codes[points == 10] = 96
    codes[points > 127] = 97
    return codes


def allowed_transitions() -> np.ndarray:
    """0 where a label may follow another, _NEVER where inside lacks its begin."""
    table = np.zeros((LABELS, LABELS))
    for k in range(len(KINDS)):
        table[:, 2 + 2 * k] = _NEVER
        table[1 + 2 * k, 2 + 2 * k] = table[2 + 2 * k, 2 + 2 * k] = 0
    return table


@dataclass
class Tagger:
    """Parameters: embedding, two LSTMs (input, recurrent, bias), output, transitions."""

    params: dict[str, np.ndarray]

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        return _forward(self.params, codes)[0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Viterbi labels of every window (rows of ``codes``)."""
        parts = [self._decode(codes[i : i + 256]) for i in range(0, len(codes), 256)]
        return np.concatenate(parts) if parts else np.zeros(codes.shape, dtype=np.int64)

    def _decode(self, codes: np.ndarray) -> np.ndarray:
        e = self.emissions(codes)
        e[codes == 0, 1:] = _NEVER
        return self.best_path(e)

    def best_path(self, e: np.ndarray) -> np.ndarray:
        """Viterbi labels of every row of log-scores (n, t, labels); a row begins outside of spans."""
        n, t, _ = e.shape
        trans = self.params["trans"] + allowed_transitions()
        score = e[:, 0] + allowed_transitions()[0]
        back = np.zeros((n, t, LABELS), dtype=np.int8)
        for k in range(1, t):
            options = score[:, :, None] + trans
            back[:, k] = options.argmax(1)
            score = options.max(1) + e[:, k]
        path = np.zeros((n, t), dtype=np.int64)
        path[:, -1] = score.argmax(1)
        rows = np.arange(n)
        for k in range(t - 1, 0, -1):
            path[:, k - 1] = back[rows, k, path[:, k]]
        return path


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(gates_in: np.ndarray, recurrent: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states over time of precomputed input gates (n, t, 4h); trace for backward."""
    n, t, width = gates_in.shape
    h = width // 4
    out = np.zeros((n, t, h))
    hidden, cell = np.zeros((n, h)), np.zeros((n, h))
    trace = []
    for k in range(t):
        z = gates_in[:, k] + hidden @ recurrent
        gate = _sigmoid(z[:, : 3 * h])
        new = np.tanh(z[:, 3 * h :])
        i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
        before_hidden, before = hidden, cell
        cell = f * cell + i * new
        squashed = np.tanh(cell)
        hidden = o * squashed
        out[:, k] = hidden
        trace.append((i, f, o, new, before, squashed, before_hidden))
    return out, trace


def _lstm_back(grad_out: np.ndarray, trace: list, recurrent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input gates and the recurrent weights."""
    n, t, h = grad_out.shape
    grad_in = np.zeros((n, t, 4 * h))
    grad_w = np.zeros_like(recurrent)
    d_hidden, d_cell = np.zeros((n, h)), np.zeros((n, h))
    for k in range(t - 1, -1, -1):
        i, f, o, new, before, squashed, before_hidden = trace[k]
        d_hidden = d_hidden + grad_out[:, k]
        d_cell = d_cell + d_hidden * o * (1 - squashed**2)
        grad_in[:, k] = np.concatenate(
            [
                d_cell * new * i * (1 - i),
                d_cell * before * f * (1 - f),
                d_hidden * squashed * o * (1 - o),
                d_cell * i * (1 - new**2),
            ],
            axis=1,
        )
        grad_w += before_hidden.T @ grad_in[:, k]
        d_hidden = grad_in[:, k] @ recurrent.T
        d_cell = d_cell * f
    return grad_in, grad_w


def _forward(p: dict[str, np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, tuple]:
    left, trace_l = _lstm((p["embed"] @ p["in_l"] + p["bias_l"])[codes], p["rec_l"])
    right, trace_r = _lstm((p["embed"] @ p["in_r"] + p["bias_r"])[codes[:, ::-1]], p["rec_r"])
    both = np.concatenate([left, right[:, ::-1]], axis=2)
    return both @ p["out"] + p["out_bias"], (both, trace_l, trace_r)


def _backward(p: dict, codes: np.ndarray, kept: tuple, grad_e: np.ndarray) -> dict[str, np.ndarray]:
    both, trace_l, trace_r = kept
    h = p["rec_l"].shape[0]
    grads = {
        "out": np.einsum("nth,ntl->hl", both, grad_e),
        "out_bias": grad_e.sum((0, 1)),
        "embed": np.zeros_like(p["embed"]),
    }
    grad_both = grad_e @ p["out"].T
    for side, trace, at, grad in (
        ("l", trace_l, codes, grad_both[:, :, :h]),
        ("r", trace_r, codes[:, ::-1], grad_both[:, ::-1, h:]),
    ):
        grad_in, grads[f"rec_{side}"] = _lstm_back(grad, trace, p[f"rec_{side}"])
        # Inputs depend on the character alone: gradients are added up per character first.
        per_char = np.zeros((_CHARS, grad_in.shape[2]))
        np.add.at(per_char, at.ravel(), grad_in.reshape(-1, grad_in.shape[2]))
        grads[f"in_{side}"] = p["embed"].T @ per_char
        grads[f"bias_{side}"] = per_char.sum(0)
        grads["embed"] += per_char @ p[f"in_{side}"].T
    return grads


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _crf_gradient(e: np.ndarray, trans: np.ndarray, gold: np.ndarray, mask: np.ndarray):
    """Expected minus observed counts for emissions and transitions."""
    n, t, labels = e.shape
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0] + allowed_transitions()[0]
    for k in range(1, t):
        step = _lse(alpha[:, k - 1, :, None] + trans, 1) + e[:, k]
        alpha[:, k] = np.where(mask[:, k, None], step, alpha[:, k - 1])
    for k in range(t - 2, -1, -1):
        step = _lse(trans + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        beta[:, k] = np.where(mask[:, k + 1, None], step, 0)
    total = _lse(alpha[:, -1], 1)
    node = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
    observed = np.eye(labels)[gold] * mask[..., None]
    grad_t = np.zeros_like(trans)
    for k in range(1, t):
        pair = np.exp(
            alpha[:, k - 1, :, None] + trans + (e[:, k] + beta[:, k])[:, None, :] - total[:, None, None]
        )
        grad_t += (pair * mask[:, k, None, None]).sum(0)
    grad_t -= np.einsum("nta,ntb->ab", observed[:, :-1], observed[:, 1:])
    return node - observed, grad_t


def train_tagger(windows: list[tuple[str, list[Span]]], steps: int = TRAIN_STEPS, seed: int = 7) -> Tagger | None:
    """Maximum likelihood by Adam on windows with labelled spans; None without spans."""
    if not any(spans for _, spans in windows):
        return None
    rng = np.random.default_rng(seed)
    n = len(windows)
    codes = np.zeros((n, WINDOW), dtype=np.int64)
    gold = np.zeros((n, WINDOW), dtype=np.int64)
    for i, (text, spans) in enumerate(windows):
        row = char_codes(text[:WINDOW])
        codes[i, : len(row)] = row
        for kind, start, end in spans:
            gold[i, start:end] = 2 + 2 * kind
            gold[i, start] = 1 + 2 * kind
    shape = {
        "embed": (_CHARS, EMBEDDED),
        "in_l": (EMBEDDED, 4 * HIDDEN),
        "in_r": (EMBEDDED, 4 * HIDDEN),
        "rec_l": (HIDDEN, 4 * HIDDEN),
        "rec_r": (HIDDEN, 4 * HIDDEN),
        "out": (2 * HIDDEN, LABELS),
    }
    p = {name: rng.normal(0, 1 / np.sqrt(s[0]), s) for name, s in shape.items()}
    p["embed"] = rng.normal(0, 0.5, shape["embed"])
    for side in "lr":
        p[f"bias_{side}"] = np.zeros(4 * HIDDEN)
        p[f"bias_{side}"][HIDDEN : 2 * HIDDEN] = 1  # remember by default
    p["out_bias"] = np.zeros(LABELS)
    p["trans"] = np.zeros((LABELS, LABELS))
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        pick = rng.choice(n, min(TRAIN_BATCH, n), replace=False)
        e, kept = _forward(p, codes[pick])
        mask = codes[pick] > 0
        grad_e, grad_t = _crf_gradient(e, p["trans"] + allowed_transitions(), gold[pick], mask)
        grads = _backward(p, codes[pick], kept, grad_e / len(pick))
        grads["trans"] = grad_t / len(pick)
        norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
        rate = 0.02 * min(1, 2 * (steps - step + 1) / steps)
        for k, g in grads.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Tagger(p)


def _respelled(kind: int, text: str, rng: np.random.Generator) -> str:
    """A way to write the same datum that the base patterns miss."""
    if kind == 0:
        return text.replace("@", ("(at)", " @ ", "[at]")[rng.integers(3)], 1)
    if kind == 1:
        return text.replace(".", (" . ", "(.)")[rng.integers(2)])
    digits = _digits(text)
    if kind == 2:
        return ("." if rng.integers(2) else "  ").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    tail = digits[-10:]
    return (f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}")[rng.integers(2)]


def training_windows(texts: list[str], most: int = TRAIN_WINDOWS, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Labelled windows: base spans as they stand, the same data respelled, and windows with
    other digits, in equal parts as far as there are any."""
    rng = np.random.default_rng(seed)
    plain: list[tuple[str, list[Span]]] = []
    changed: list[tuple[str, list[Span]]] = []
    without: list[tuple[str, list[Span]]] = []
    for text in texts:
        spans = base_spans(text)
        for kind, start, end in spans:
            if end - start > WINDOW - 16 or any(
                s != (kind, start, end) and s[1] < end and s[2] > start for s in spans
            ):
                continue
            low = max(0, start - int(rng.integers(0, WINDOW - (end - start))))
            plain.append(_window(text, spans, low))
            new = _respelled(kind, text[start:end], rng)
            before = text[max(0, start - int(rng.integers(8, 50))) : start]
            if not _TRIGGER.search(before) and len(new) + len(before) < WINDOW:
                after = text[end : end + WINDOW - len(before) - len(new)]
                after = after[: m.start()] if (m := _TRIGGER.search(after)) else after
                changed.append((before + new + after, [(kind, len(before), len(before) + len(new))]))
        taken = [(a, b) for _, a, b in spans]
        for m in _HELD.finditer(text):
            low = max(0, m.start() - int(rng.integers(0, WINDOW)))
            if not any(a < low + WINDOW and b > low for a, b in taken):
                without.append((text[low : low + WINDOW], []))
    parts = []
    for group in (plain, changed, without):
        order = rng.permutation(len(group))[: most // 3]
        parts.extend(group[i] for i in order)
    return parts


def _window(text: str, spans: list[Span], low: int) -> tuple[str, list[Span]]:
    """The window at ``low``; spans that its edges cut are labelled as far as they reach."""
    inside = [(k, max(a - low, 0), min(b - low, WINDOW)) for k, a, b in spans if a < low + WINDOW and b > low]
    return text[low : low + WINDOW], inside


def sample_texts(docs: DataFrame) -> list[str]:
    """At most SAMPLE_DOCS texts with digits or at-signs, by hash of the id: ids first, then texts."""
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    able = rows.where(F.col("text").rlike("@[A-Za-z0-9]|[0-9][^\n]{0,4}[0-9]"))
    drawn = able.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()
    if not drawn:
        return []
    wanted = docs.sparkSession.createDataFrame([(r[0],) for r in drawn], "_id bigint")
    found = (
        rows.join(F.broadcast(wanted), F.col("doc_id") == F.col("_id"), "left_semi")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    return [r["text"] for r in sorted(found, key=lambda r: r["doc_id"])]


def fit(docs: DataFrame) -> Tagger | None:
    return train_tagger(training_windows(sample_texts(docs)))


def _plausible(kind: int, text: str) -> bool:
    if kind == 0:
        return "@" in text or "at" in text.lower()
    return len(_digits(text)) >= (4, 4, 12, 7)[kind]


def add_spans(
    texts: list[str], base: list[list[Span]], model: Tagger | None, every_window: bool = False
) -> list[list[Span]]:
    """Base and model spans of every text, by start, then kind.

    Window k of a text covers [64 k, 64 k + 128), so a character lies in the
    middle half of exactly one window (the first and last reach to the ends).
    """
    if model is None:
        return base
    windows: list[tuple[int, int]] = []
    held: dict[int, list[tuple[int, int]]] = {}
    last = [max(1, -(-(len(text) - STRIDE) // STRIDE)) - 1 for text in texts]
    for i, text in enumerate(texts):
        held[i] = [m.span() for m in _HELD.finditer(text)]
        if every_window:
            windows.extend((i, k) for k in range(last[i] + 1 if text else 0))
        else:
            owners = {min(max(0, (a - STRIDE // 2) // STRIDE), last[i]) for a, _ in held[i]}
            windows.extend((i, k) for k in sorted(owners))
    out = [list(spans) for spans in base]
    marked: dict[int, np.ndarray] = {}
    seen: dict[int, np.ndarray] = {}
    known = set(windows)
    while windows:
        reached: set[tuple[int, int]] = set()
        for at in range(0, len(windows), 1024):
            part = windows[at : at + 1024]
            codes = np.zeros((len(part), WINDOW), dtype=np.int64)
            for row, (i, k) in enumerate(part):
                found = char_codes(texts[i][k * STRIDE : k * STRIDE + WINDOW])
                codes[row, : len(found)] = found
            for (i, k), labels in zip(part, model.decode(codes)):
                if not labels.any():
                    continue
                text = texts[i]
                if i not in marked:
                    marked[i] = np.zeros(len(text), dtype=np.int8)
                    seen[i] = np.zeros((last[i] + 1, len(_SEAMS)), dtype=np.int8)
                seen[i][k] = labels[_SEAMS]
                low, high = _own(text, k, last[i])
                own = labels[low - k * STRIDE : high - k * STRIDE]
                marked[i][low:high] = own
                # A run at an edge may go on in the neighbour.
                if k > 0 and own[0]:
                    reached.add((i, k - 1))
                if k < last[i] and own[-1]:
                    reached.add((i, k + 1))
        windows = sorted(reached - known)
        known.update(windows)
    _rejoin(texts, marked, seen, last, model)
    for i, labels in marked.items():
        taken = base[i]
        for kind, start, end in _runs(labels):
            piece = texts[i][start:end]
            first = bisect.bisect_left(held[i], (start, 0))
            if first == len(held[i]) or held[i][first][1] > end or not _plausible(kind, piece):
                continue
            if not any(a < end and b > start for _, a, b in taken):
                out[i].append((kind, start, end))
        out[i].sort(key=lambda s: (s[1], s[0], s[2]))
    return out


def _own(text: str, k: int, last: int) -> tuple[int, int]:
    """The characters that belong to window k of a text whose windows end with ``last``."""
    return (0 if k == 0 else k * STRIDE + STRIDE // 2), (
        len(text) if k == last else k * STRIDE + STRIDE // 2 + STRIDE
    )


def _rejoin(
    texts: list[str],
    marked: dict[int, np.ndarray],
    seen: dict[int, np.ndarray],
    last: list[int],
    model: Tagger,
) -> None:
    """Decode as one sequence every chain of windows with labelled seams and a seam that two windows see differently.

    ``seen`` holds the labels that each window gives to the characters at both of its seams.
    """
    chains: list[tuple[int, int, int]] = []  # text, first and last window
    for i, labels in marked.items():
        seams = np.arange(last[i]) * STRIDE + STRIDE // 2 + STRIDE  # of windows k and k + 1
        for k in np.flatnonzero((labels[seams - 1] > 0) | (labels[seams] > 0)).tolist():
            if chains and chains[-1][0] == i and chains[-1][2] == k:
                chains[-1] = (i, chains[-1][1], k + 1)
            else:
                chains.append((i, k, k + 1))
    differ = {i: (v[:-1, 2:] != v[1:, :2]).any(1) for i, v in seen.items()}
    chains = [c for c in chains if differ[c[0]][c[1] : c[2]].any()]
    chains.sort(key=lambda c: c[2] - c[1])  # like lengths together
    at = 0
    while at < len(chains):
        part = chains[at : at + 256]
        part = part[: max(1, 1024 // (part[-1][2] - part[-1][1] + 1))]
        at += len(part)
        spans = [(_own(texts[i], a, last[i])[0], _own(texts[i], b, last[i])[1]) for i, a, b in part]
        scores = np.zeros((len(part), max(high - low for low, high in spans), LABELS))
        scores[:, :, 1:] = _NEVER  # padding stays outside
        windows = [(row, i, k) for row, (i, a, b) in enumerate(part) for k in range(a, b + 1)]
        for first in range(0, len(windows), 256):
            some = windows[first : first + 256]
            codes = np.zeros((len(some), WINDOW), dtype=np.int64)
            for j, (_, i, k) in enumerate(some):
                found = char_codes(texts[i][k * STRIDE : k * STRIDE + WINDOW])
                codes[j, : len(found)] = found
            for (row, i, k), e in zip(some, model.emissions(codes)):
                low, high = _own(texts[i], k, last[i])
                scores[row, low - spans[row][0] : high - spans[row][0]] = e[low - k * STRIDE : high - k * STRIDE]
        for (i, _, _), (low, high), path in zip(part, spans, model.best_path(scores)):
            marked[i][low:high] = path[: high - low]


def _runs(labels: np.ndarray) -> list[Span]:
    """Spans of a label sequence: same kind, no begin inside."""
    spans: list[Span] = []
    for at in np.flatnonzero(labels):
        label = int(labels[at])
        kind, begins = (label - 1) // 2, label % 2 == 1
        if spans and not begins and spans[-1][2] == at and spans[-1][0] == kind:
            spans[-1] = (kind, spans[-1][1], int(at) + 1)
        else:
            spans.append((kind, int(at), int(at) + 1))
    return spans


def spans_of(texts: list[str | None], model: Tagger | None) -> tuple[list[list[Span]], list[list[Span]]]:
    whole = [t or "" for t in texts]
    base = [base_spans(t) for t in whole]
    return base, add_spans(whole, base, model)


REPORT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def pii_report(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """Counts and digest of the base spans and the list of all spans, for every row."""
    ship_package(docs.sparkSession)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, full = spans_of(batch.column("text").to_pylist(), model)
            kinds = [[k for k, _, _ in spans] for spans in base]
            counts = [pa.array([k.count(i) for k in kinds], pa.int64()) for i in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(listed(s).encode()).hexdigest() for s in base], pa.string())
            spans = pa.array([listed(s) for s in full], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, spans], names=names)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(run, REPORT)


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind; overlapping spans as one, under the first's kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """``docs`` with spans in ``text`` replaced by their kind; other columns unchanged."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            _, full = spans_of(texts, model)
            new = [t if t is None or not s else mask(t, s) for t, s in zip(texts, full)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
