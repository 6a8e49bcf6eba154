"""Spelled at-signs, and spans that reach beyond the windows of their trigger."""

import numpy as np
import pytest

from lodestar.llm import pii


@pytest.fixture(scope="module")
def texts():
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    return [t for t in rows if t and pii._TRIGGER.search(t) and len(t) < 20_000]


@pytest.fixture(scope="module")
def model(texts):
    return pii.train_tagger(pii.training_windows(texts[::2]))


def test_spelled_emails_are_found(model, texts):
    lines = [t[:200] for t in texts[1::2] if not pii._TRIGGER.search(t[:200])][:20]
    assert len(lines) > 5
    found = 0
    for k, line in enumerate(lines):
        new = ("john.smith(at)example.com", "jane.doe[at]example.org")[k % 2]
        text = f"{line} {new}"
        spans = pii.add_spans([text], [pii.base_spans(text)], model)[0]
        found += any(kind == 0 and b > len(line) + 1 for kind, a, b in spans)
    print("spelled e-mails found", found, "of", len(lines))
    assert found > 0.7 * len(lines)


def test_skipped_windows_change_nothing_on_spelled_texts(model, texts):
    some = [t[:60] + " mail john.smith(at)example.com or look at it " + t for t in texts[1:40:2]]
    base = [pii.base_spans(t) for t in some]
    assert pii.add_spans(some, base, model) == pii.add_spans(some, base, model, every_window=True)


class Everything:
    """Labels every letter as part of an e-mail."""

    def decode(self, codes):
        return np.where(codes > 1, 2, 0)


def test_a_long_span_is_whole():
    text = "x" * 300 + "(at)" + "y" * 300
    for t in (text, "a " + "b" * 400 + "@", "@" + "b" * 400 + " c"):
        want = pii.add_spans([t], [[]], Everything(), every_window=True)
        assert pii.add_spans([t], [[]], Everything()) == want and len(want[0]) == 1
