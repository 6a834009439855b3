"""Long texts in blocks and slices give what they give at once."""

import hashlib
import time

import numpy as np
import pytest

from lamina.llm import bpe, line_crf
from lamina.llm.queries import QUERIES
from lamina.llm.tables import table


@pytest.mark.parametrize("n", [1, 2, 3, 10, 99, 100, 101, 5000])
def test_a_long_chain_has_the_same_marginals(n):
    rng = np.random.default_rng(n)
    emissions, pairs = rng.normal(0, 6, n), rng.normal(0, 2, (2, 2))
    emissions[n // 2 :] *= 10
    expected = line_crf.forward_backward(emissions, pairs, np.array([0, n]))[0][:, 1]
    assert np.allclose(line_crf.chain_marginals(emissions, pairs), expected, rtol=0, atol=1e-12)


def test_blocks_have_the_same_features(monkeypatch):
    rng = np.random.default_rng(0)
    lines = ["", " ", "Prose, of words.", "# again #", "ÉCOLE à côté", "x" * 50] + [f"line {i} is new" for i in range(20)]
    text = "\n".join(lines[i] for i in rng.integers(0, len(lines), 700))
    whole = line_crf.lines_of([text])
    monkeypatch.setattr(line_crf, "BLOCK_LINES", 64)
    monkeypatch.setattr(line_crf, "STEP_BYTES", 37)
    blocks = list(line_crf._blocks(text.encode()))
    assert len(blocks) == 11
    assert np.allclose(np.concatenate([b.features for b in blocks]), whole.features)
    assert (np.concatenate([b.chars for b in blocks]) == whole.chars).all()
    model = line_crf.Model(rng.normal(0, 1, line_crf.N_FEATURES), rng.normal(0, 1, (2, 2)), (3.0, -1.0))
    scores = line_crf.scores_of(model, iter([text, "", "a\nb", text + "\n"]), 4)
    monkeypatch.setattr(line_crf, "BLOCK_LINES", 10_000)
    assert np.allclose(line_crf.scores_of(model, iter([text, "", "a\nb", text + "\n"]), 4), scores)


def test_a_text_of_line_breaks_takes_little_time():
    model = line_crf.Model(np.ones(line_crf.N_FEATURES), np.eye(2), (3.0, -1.0))
    start = time.process_time()
    line_crf.scores_of(model, iter(["\n" * 1_000_000, "word " * 200_000]), 2)
    assert time.process_time() - start < 10


def test_labels_beyond_the_documents_are_not_chosen(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    others = spark.range(10**6, 10**6 + 5000).selectExpr("id as doc_id", "cast(id % 2 as int) quality", "0 as toxic")
    wider = labels.unionByName(others.select(labels.columns))
    found, expected = (line_crf.sample(documents, some, 30).collect() for some in (wider, labels))
    assert sorted(found) == sorted(expected) and len(found) > 30


def test_every_byte_passes_the_transducer(monkeypatch, spark, sf_dir):
    monkeypatch.setattr(bpe, "CHUNKS", 0)
    monkeypatch.setattr(bpe, "WORDS", 0)
    passed = []
    feed = bpe.Transducer.feed
    monkeypatch.setattr(bpe.Transducer, "feed", lambda self, data: (passed.append(len(data)), feed(self, data))[1])
    encoder = bpe.Encoder(bpe.merges_of(bpe.VOCABULARY))
    texts = [r.text for r in table(spark, sf_dir, "documents").where("doc_id < 40").collect()] + ["a" * 20_000, " \n\t" * 3000]
    for text in texts:
        passed.clear()
        list(encoder.encode(text or ""))
        assert sum(passed) == len((text or "").encode())


def test_digests_do_not_depend_on_the_slices(monkeypatch):
    text = "Some words, é and 🙂 too, again.\n" * 3000
    merges = bpe.merges_of(bpe.VOCABULARY)
    ids = np.frombuffer(b"".join(bpe.Encoder(merges).encode(text)), np.int32).tolist()
    expected = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    for size in (1, 7, 32_768):
        monkeypatch.setattr(bpe, "SLICE", size)
        assert bpe.Digests(bpe.VOCABULARY).of(text if size > 1 else text) == expected


def test_scores_of_the_query_are_whole(spark, sf_dir):
    rows = QUERIES["op3_line_crf"](spark, sf_dir).collect()
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 30 and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


@pytest.mark.parametrize("percentiles", [1, 2, 2048])
def test_ranges_hold_about_equally_many_rows_whatever_the_ids(spark, monkeypatch, percentiles):
    from lamina.llm import multiset

    monkeypatch.setattr(multiset, "PERCENTILES", percentiles)
    ids = [*range(0, 2000, 2), 10**15, None, None, 7, 7]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(3)
    rows = multiset.in_ranges(docs, bucket=50).collect()
    own = [r for r in rows if not r.copied]
    assert len(own) == len(ids)
    assert all(r.range == -1 for r in own if r.doc_id is None)
    largest = max(sum(r.range == k for r in own) for k in {r.range for r in own})
    if percentiles == 2048:
        assert largest < 150
    elif percentiles == 2:
        assert largest < 700
    # Ranges follow the ids, and each holds the first row of the next, the last that of the first.
    order = sorted({r.range for r in own})
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    for this, following in zip(order, [*order[1:], order[0]]):
        assert len(order) == 1 or {key(r) for r in rows if r.copied and r.range == this} == {min(key(r) for r in own if r.range == following)}
        assert this >= following or max(key(r) for r in own if r.range == this) < min(key(r) for r in own if r.range == following)
