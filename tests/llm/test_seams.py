"""Windows of the tagger that disagree about a seam; lines sampled from whole texts; small hosts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import line_dedup, pii, quality


class Blind(pii.Tagger):
    """Takes a run of ``z`` as an e-mail, but only when its window also holds ``#``: windows disagree."""

    def __init__(self):
        super().__init__({"trans": np.zeros((pii.LABELS, pii.LABELS))})

    def emissions(self, codes):
        e = np.zeros((*codes.shape, pii.LABELS))
        z, sharp = codes == ord("z") - 31, (codes == ord("#") - 31).any(1)
        e[..., 0] = 1
        e[z & sharp[:, None], 2] = 3
        e[z & sharp[:, None], 1] = 2
        e[z & ~sharp[:, None], 3] = 1.5
        return e


def test_chains_keep_the_transitions():
    rng = np.random.default_rng(1)
    model, checked = Blind(), 0
    allowed = pii.allowed_transitions()
    for _ in range(60):
        text = "".join(rng.choice(list("zzzzzzz9# "), p=[0.11] * 7 + [0.13, 0.02, 0.08], size=int(rng.integers(150, 900))))
        last = max(1, -(-(len(text) - pii.STRIDE) // pii.STRIDE)) - 1
        codes = np.zeros((last + 1, pii.WINDOW), dtype=np.int64)
        for k in range(last + 1):
            part = pii.char_codes(text[k * 64 : k * 64 + 128])
            codes[k, : len(part)] = part
        labels, seen = np.zeros(len(text), dtype=np.int8), np.zeros((last + 1, 4), dtype=np.int8)
        own = model.emissions(codes)
        scores = np.zeros((len(text), pii.LABELS))
        for k, row in enumerate(model.decode(codes)):
            low, high = pii._own(text, k, last)
            labels[low:high], seen[k] = row[low - k * 64 : high - k * 64], row[pii._SEAMS]
            scores[low:high] = own[k][low - k * 64 : high - k * 64]
        marked = {0: labels.copy()}
        pii._rejoin([text], marked, {0: seen}, [last], model)
        seams = [k * 64 + 96 for k in range(last)]
        for s in seams:
            assert allowed[marked[0][s - 1], marked[0][s]] == 0
        # A text whose seams are all in one chain is decoded as a whole.
        linked = [labels[s - 1] > 0 or labels[s] > 0 for s in seams]
        if seams and all(linked) and (seen[:-1, 2:] != seen[1:, :2]).any():
            checked += 1
            assert (marked[0] == model.best_path(scores[None])[0]).all()
    assert checked > 3


def test_samples_hold_long_texts(spark):
    long = "A line of plain words that nobody marks.\n" * 3000 + "write to bob@example.org, 4111 1111 1111 1111\n"
    rows = [(1, long), (1, "short\nb@c.de"), (2, "MENU | HOME | CART\n" * 50), (3, None), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("windows", F.lit(1)).withColumn("block", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (9, 1)], "doc_id long, quality long")
    sample = quality.labelled_sample(docs.where(F.coalesce(F.length("text"), F.lit(0)) != 12), labels)
    assert [g for _, g in sample] == [True, False]
    assert all(b.shape == (quality.FIT_LINES, quality.FEATURES) for b, _ in sample)
    assert quality.train_line_model(docs, labels) is not None


def test_blocks_begin_anywhere():
    texts = ["\n".join(f"word {'x' * (i % 7)} {i}" for i in range(k, k + 200)) for k in range(40)]
    firsts = [int(np.argmax((quality.line_features(t)[0] == quality.fit_block(t)[0]).all(1))) for t in texts]
    assert max(firsts) > quality.FIT_LINES and len(set(firsts)) > 5
    assert len(quality.fit_block("")) == 0


@pytest.mark.parametrize("n_pages,times,gone", [(2, 2, True), (3, 2, True), (2, 1, False), (1, 1, False), (25, 3, True), (30, 3, False)])
def test_small_hosts(spark, n_pages, times, gone):
    rows = [(i, "h", f"own {i}\nshared" if i < times else f"own {i}") for i in range(n_pages)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    texts = [r.text for r in line_dedup.drop_boilerplate(docs).collect()]
    assert sum("shared" in t for t in texts) == (0 if gone else times)
