"""Operators that SQL cannot express, against plain versions over the whole small tables."""

import hashlib
import time
import zlib
from collections import Counter, defaultdict
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lamina.llm import bands, bpe, components, fixity, line_crf, mixing, multiset, readable, shards, simhash, toolcalls
from lamina.llm.queries import QUERIES
from lamina.llm.tables import table


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}


# Fingerprints and components


def plain_simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    grams = [words[i : i + 3] for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(bits):
    keys = sorted(bits)
    values = np.array([bits[k] for k in keys], np.uint64)
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {k: keys[find(i)] for i, k in enumerate(keys)}


def test_near_duplicates(spark, sf_dir, documents):
    rows = QUERIES["op5_simhash_components"](spark, sf_dir).collect()
    bits = {i: plain_simhash(t or "") for i, t in documents.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{b:016x}" for i, b in bits.items()}
    expected = plain_components(bits)
    assert {r.doc_id: r.component_id for r in rows} == expected
    assert len(set(expected.values())) < len(expected)


def flipped(rng, base, n, most):
    out = np.full(n, base, np.uint64)
    for _ in range(most):
        out ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return out


@pytest.mark.parametrize("held", [simhash.HELD, 3])
def test_links_connect_what_is_near(spark, held):
    rng = np.random.default_rng(5)
    values = np.unique(
        np.concatenate(
            [rng.integers(0, 2**64, 300, np.uint64)]
            + [flipped(rng, b, 250, 4) for b in rng.integers(0, 2**64, 6, np.uint64)]
        )
    )
    bits = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "bits long")
    found = components.components(simhash.links(bits, held))
    roots = {r.node & (2**64 - 1): r.root for r in found.collect()}
    expected = plain_components({int(v): int(v) for v in values})
    ours = defaultdict(set)
    for v in values:
        ours[roots.get(int(v), int(v) - (2**64 if int(v) >= 2**63 else 0))].add(int(v))
    theirs = defaultdict(set)
    for v, r in expected.items():
        theirs[r].add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_pairs_that_meet_below_the_minimum_are_dropped_by_count(spark):
    base = 0x1122334455667788
    four, five, far = base ^ 0x01010101, base ^ 0x010101, base ^ 0x0F0101
    assert list(simhash.tally(np.array([base ^ four, base ^ five, base ^ far], np.uint64))) == [4, 5, 5]
    bits = spark.createDataFrame([(base,), (four,)], "bits long")
    met = simhash.index(bits).groupBy("posting", "entry").count().where("count = 2")
    assert met.count() == 1 and simhash.links(bits).isEmpty()
    for other, linked in ((five, True), (far, False)):
        assert simhash.links(spark.createDataFrame([(base,), (other,)], "bits long")).isEmpty() != linked


def batches_of(posting, entry, bits, size):
    for i in range(0, len(bits), size):
        rows = slice(i, i + size)
        columns = [pa.array(c[rows]) for c in (posting, entry, bits)]
        yield pa.RecordBatch.from_arrays(columns, ["posting", "entry", "bits"])


def test_postings_over_many_batches(monkeypatch):
    rng = np.random.default_rng(11)
    sizes = [1, 2, 70, 1, 1, 40, 3, 25]
    posting = np.repeat([0, 0, 1, 2, 3, 4, 4, 69], sizes).astype(np.int32)
    entry = np.repeat([0, 1, 0, 0, 0, 5, 6, 7], sizes).astype(np.int64)
    bits = np.sort(rng.integers(0, 2**10, sum(sizes)))

    def found(size, held):
        out = simhash._links_of_postings(batches_of(posting, entry, bits, size), simhash.COARSE, held)
        return [pair for batch in out for pair in zip(*(c.to_pylist() for c in batch.columns))]

    whole = found(len(bits), None)
    assert whole and all(sorted(found(size, None)) == sorted(whole) for size in (1, 2, 7, 30))
    # Postings above the limit are passed on, whatever the batches; the others are searched.
    begins = np.cumsum([0, *sizes])
    large = [int(b) for i in (2, 5) for b in bits[begins[i] : begins[i + 1]]]
    for size in (1, 7, 30):
        some = found(size, 25)
        assert sorted(a for a, b in some if b is None) == sorted(large)
    # A hot posting costs its size, not its size times its batches.
    joined = []
    monkeypatch.setattr(simhash, "stars", lambda b, p: joined.append(len(b)) or (b[:0], b[:0]))
    hot = np.arange(200_000, dtype=np.int64)
    same = np.zeros(len(hot), np.int64)
    list(simhash._links_of_postings(batches_of(same, same, hot, 100), simhash.FINE, None))
    assert joined == [len(hot)]


def test_large_postings_find_the_same():
    rng = np.random.default_rng(7)
    positions = (0, 1, 2, 3, 4)
    free = rng.integers(0, 2**24, 3000, np.uint64)
    near = np.concatenate([free, free[:500] ^ np.uint64(5), free[:100] ^ np.uint64(0x10101)])
    bits = np.unique(near | np.uint64(0xABCDEF0123 << 24))
    sides = [simhash.stars(bits, positions, look_up) for look_up in (10**9, 0)]
    assert [set(zip(*map(np.ndarray.tolist, s))) for s in sides][0] == set(zip(*map(np.ndarray.tolist, sides[1])))


def test_a_long_path_is_one_component(spark):
    edges = spark.range(500).selectExpr("(id * 7919) % 501 as a", "((id + 1) * 7919) % 501 as b")
    found = components.components(edges).collect()
    assert len(found) == 501 and {r.root for r in found} == {0}


def test_exactly_one_row_of_each_group_stays(spark):
    a, b, c, d = ("".join(f"{w} word {i} of {w}s text. " for i in range(40)) for w in ("one", "other", "third", "fourth"))
    rows = [
        (3, a, "x"), (5, a, "x"), (5, b, "x"),  # the only row of its group, under an id that is a copy elsewhere
        (7, c, "x"), (7, c, "x"), (7, c, None), (8, c, "x"), (None, c, "x"),  # an id's equal and unequal rows
        (None, d, "x"), (None, d, "x"), (None, d, "y"),  # no row with an id
        (None, None, None), (None, "", None),
    ]
    documents = spark.createDataFrame(rows, "doc_id long, text string, bits string").repartition(4)
    found = [(r.doc_id, r.text) for r in simhash.one_of_each(documents).collect()]
    assert Counter((i, t or "") for i, t in found) == Counter([(3, a), (5, b), (7, c), (None, d), (None, "")])


# Byte pair encoding


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


def test_round_trip_query(spark, sf_dir, documents, library):
    for r in QUERIES["op8_bpe_transducer"](spark, sf_dir).collect():
        text = documents[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@cache
def held_briefly():
    """An encoder that keeps so little that it has to stream, and the library."""
    return bpe.Encoder(bpe.merges_of(bpe.VOCABULARY), held=8), Tokenizer.from_file(bpe.VOCABULARY)


PIECES = st.sampled_from(
    ["a", "the", "Ing", " ", "  ", "\n", "\t", "1", "!", "é", "日本", "'s", "'re", "'", "<|endoftext|>", "<|endo", " ", "🙂"]
    + ["\r\n", "\x1c", "\x85", "\U00010d4a", "Ᲊ", "aaaa", "***"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=60), st.sampled_from([1, 2, 7]))
def test_slices_do_not_matter(pieces, size):
    text = "".join(pieces)
    merges = bpe.merges_of(bpe.VOCABULARY)
    encoder, library = held_briefly()
    want = library.encode(text, add_special_tokens=False).ids
    parts = [encoder.feed(text[i : i + size]) for i in range(0, len(text), size)]
    found = b"".join(piece for part in parts for piece in part) + b"".join(encoder.finish())
    assert np.frombuffer(found, np.int32).tolist() == want
    decoder = bpe.Decoder(merges)
    assert "".join([decoder.feed([i]) for i in want] + [decoder.finish()]) == text


@pytest.mark.parametrize("unit", ["a", "ab", "the", "ingthe", "9", "!", "\n", "é", "Zq"])
def test_long_runs_stream(unit, library):
    text = unit * 30_000
    encoder = bpe.Encoder(bpe.merges_of(bpe.VOCABULARY))
    assert np.frombuffer(b"".join(encoder.encode(text)), np.int32).tolist() == library.encode(text).ids
    transducer = bpe.Transducer(encoder.merges)
    fed = [transducer.feed(text[i : i + 100].encode()) for i in range(0, len(text), 100)]
    assert len(transducer.kept) <= 2 * transducer.window
    assert sum(map(len, fed)) > 0


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=80), st.binary(max_size=300))
def test_lookahead_suffices(start, rest):
    """A token is settled once the lookahead's bytes follow it, whatever comes after them."""
    merges = bpe.merges_of(bpe.VOCABULARY)
    seen = start + rest[: merges.lookahead]
    settled = bpe.Transducer(merges)
    settled.kept = seen
    ids = settled._settled()
    assert merges.split(start + rest)[: len(ids)] == ids


def test_lookahead_is_that_of_a_small_list():
    # b is taken from a by bc, which cd takes apart again: two bytes decide.
    merges = [(b"c", b"d"), (b"b", b"c"), (b"a", b"b")]
    assert bpe.sufficient_lookahead(merges) == 2 + 1


# Shards


def test_shards(spark, sf_dir, documents):
    rows = QUERIES["op6_differencing_shards"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(documents) and len(rows) == len(documents)
    total, of_text, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in rows:
        data = (documents[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        total[r.shard] += r.size
        of_text[data].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in of_text.values())
    assert set(total) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total.values()) - min(total.values()) <= 0.0005 * sum(total.values())


def test_shards_over_levels(spark):
    sizes = [(i, int(10_000 / (i % 97 + 1)) + 1) for i in range(900)]
    groups = spark.createDataFrame(sizes, "member long, bytes long")
    found = {r.member: r.shard for r in shards.assign(groups, 5, bucket=4).collect()}
    total = Counter()
    for member, size in sizes:
        total[found[member]] += size
    # Differencing ends within the largest size, also four parts at a time over five levels.
    assert len(found) == 900 and max(total.values()) - min(total.values()) <= max(s for _, s in sizes)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=60), st.integers(1, 9))
def test_differencing(sizes, k):
    vectors = np.zeros((len(sizes), k), np.int64)
    vectors[:, 0] = sizes
    moved = shards.difference(vectors)
    assert all(sorted(row) == list(range(k)) for row in moved.tolist())
    total = np.bincount(moved[:, 0], weights=sizes, minlength=k)
    assert total.max() - total.min() <= max(sizes)


def test_differencing_of_two_is_the_textbook_one():
    vectors = np.array([[s, 0] for s in (8, 7, 6, 5, 4)])
    total = np.bincount(shards.difference(vectors)[:, 0], weights=vectors[:, 0])
    assert sorted(total) == [14, 16]


# Multiset fingerprints


def edited_texts(documents):
    ids = sorted(documents)
    for i, doc_id in enumerate(ids):
        text, after = documents[doc_id] or "", documents[ids[(i + 1) % len(ids)]] or ""
        half = len(text) // 2
        yield doc_id, text, text[: len(text) - half] + after[:half], after


def test_fingerprints(spark, sf_dir, documents):
    rows = {r.doc_id: r for r in QUERIES["op10_multiset_fingerprints"](spark, sf_dir).collect()}
    by_text, nearer = {}, 0
    for doc_id, text, edited, after in edited_texts(documents):
        r = rows[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        nearer += r.near_edited > r.near_next
    assert len(set(by_text.values())) == len(by_text)
    assert nearer > 0.9 * len(rows)


def test_fingerprints_add_up(spark):
    texts = [("x", "One. Two. Three."), ("y", "Three. One.\nTwo."), ("z", "One. Two."), ("w", "Three."), ("e", "")]
    df = multiset.with_lanes(spark.createDataFrame(texts, "k string, text string"), F.col("text"), "lanes")
    lanes = {r.k: r.lanes for r in df.collect()}
    assert lanes["x"] == lanes["y"] != lanes["z"] and not any(lanes["e"])
    both = spark.createDataFrame([(lanes["z"], lanes["w"], lanes["x"])], "z array<long>, w array<long>, x array<long>")
    r = both.select(multiset.insert(F.col("z"), F.col("w")), multiset.delete(F.col("x"), F.col("w"))).first()
    assert r[0] == lanes["x"] and r[1] == lanes["z"]


def test_next_across_ranges(spark):
    rows = [(i, f"t{i}") for i in (-9, 0, 1, 2, 50, 51, 900, 901, 10**9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = multiset.fingerprint_edits(df, bucket=1).collect()
    expected = {d: hashlib.sha256(e.encode()).hexdigest() for d, _, e, _ in edited_texts(dict(rows))}
    assert {r.doc_id: r.edited_sha256 for r in found} == expected


# Mixing


def missed(rows, margin, keep):
    """The most by which a value's probability times tokens misses its target."""
    found, wanted, tokens = Counter(), {}, sum(r.tokens for r in rows)
    for r in rows:
        found[r[margin]] += r.probability * r.tokens
        wanted[r[margin]] = r[f"{margin}_target"]
    return max(abs(found[v] / (keep * tokens) * sum(wanted.values()) / wanted[v] - 1) for v in wanted)


def test_margins_meet_their_targets(spark):
    rows = [(f"s{i % 3}", f"l{i % 2}", f"t{i % 5}", float(10 + i * i % 37)) for i in range(60)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double").groupBy(
        *mixing.MARGINS
    ).sum("tokens").withColumnRenamed("sum(tokens)", "tokens")
    given_targets = {"lang": {"l0": 1.0, "l1": 1.4}}
    raked = mixing.rake(mixing.targets(cells, given_targets), keep=0.4).collect()
    assert max(missed(raked, margin, 0.4) for margin in mixing.MARGINS) < 1e-6


def attainable(tokens, power, keep):
    """Shares in proportion to a power of the tokens, none beyond what its value has."""
    wanted, shares = {k: n**power for k, n in tokens.items()}, {}
    everything = sum(tokens.values())
    while True:
        left = {k: w for k, w in wanted.items() if k not in shares}
        factor = (1 - sum(shares.values())) / sum(left.values())
        beyond = {k: tokens[k] / (keep * everything) for k, w in left.items() if w * factor > tokens[k] / (keep * everything)}
        if not beyond:
            return shares | {k: w * factor for k, w in left.items()}
        shares |= beyond


def test_the_query_s_probabilities_meet_all_targets(spark, sf_dir):
    rows = QUERIES["op2_target_mix"](spark, sf_dir).collect()
    everything, short = sum(r.tokens for r in rows), 0
    for margin, power in mixing.FLATTEN.items():
        tokens, expected = Counter(), Counter()
        for r in rows:
            tokens[r[margin]] += r.tokens
            expected[r[margin]] += r.probability * r.tokens
        shares = attainable(tokens, power, mixing.KEEP)
        plain = {k: n**power / sum(n**power for n in tokens.values()) for k, n in tokens.items()}
        short += sum(shares[k] < plain[k] * (1 - 1e-9) for k in shares)
        for key, share in shares.items():
            assert expected[key] == pytest.approx(mixing.KEEP * everything * share, rel=1e-6)
    assert short
    assert sum(r.tokens for r in rows if r.sampled) == pytest.approx(sum(r.probability * r.tokens for r in rows), rel=0.1)


def test_targets_of_zero_values_without_tokens_and_all_tokens_wanted(spark):
    rows = [("a", "x", "t", 10.0), ("a", "y", "t", 30.0), ("b", "x", "t", 60.0), ("c", None, "t", 0.0), (None, "x", "u", 20.0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    raked = mixing.rake(mixing.targets(cells, {"source": {"b": 0.0}}), keep=0.3).collect()
    assert {(r.source, r.lang): r.probability for r in raked}["b", "x"] == 0
    assert {(r.source, r.lang): r.probability for r in raked}["c", None] == 0
    assert sum(r.probability * r.tokens for r in raked if r.source != "b") > 0
    everything = mixing.rake(mixing.targets(cells), keep=1.0).collect()
    assert all(r.probability == pytest.approx(1) for r in everything if r.tokens)
    assert all(r.probability == pytest.approx(1) for r in mixing.rake(mixing.targets(cells), keep=2.0).collect() if r.tokens)
    assert mixing.rake(mixing.targets(cells.limit(0))).isEmpty()


def test_given_topics_and_many_cells(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents").withColumn("topic", F.concat(F.lit("t"), F.col("doc_id") % 3))
    cells = mixing.cells_of(mixing._marked(docs))
    assert {r.topic for r in cells.collect()} == {"t0", "t1", "t2"}
    few = {r[:3]: r.probability for r in mixing.calibrate(cells).collect()}
    monkeypatch.setattr(mixing, "FEW_CELLS", 0)
    assert {r[:3]: r.probability for r in mixing.calibrate(cells).collect()} == pytest.approx(few, rel=1e-9)


def test_a_sample_with_whole_cells_meets_its_targets(spark):
    # The targets are the margins of rates that are products, cut at one: these alone meet them as raking does.
    rows, rates = [], {}
    for i, j, k in product(range(4), range(3), range(2)):
        rows.append((f"s{i}", f"l{j}", f"t{k}", float(7 ** (i + 3 * j + k) % 97 + 5)))
        rates[rows[-1][:3]] = min(1.0, 0.08 * 2**i * 1.7**j * 1.3**k)
    given = {
        m: {v: sum(rates[r[:3]] * r[3] for r in rows if r[n] == v) for v in {r[n] for r in rows}}
        for n, m in enumerate(mixing.MARGINS)
    }
    keep = sum(rates[r[:3]] * r[3] for r in rows) / sum(r[3] for r in rows)
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    found = mixing.calibrate(cells, keep, given).collect()
    assert 2 < sum(rate == 1 for rate in rates.values()) < len(rows)
    assert {(r.source, r.lang, r.topic): r.probability for r in found} == pytest.approx(rates, rel=1e-4)


def test_a_target_beyond_a_value_s_tokens_is_named(spark, caplog):
    rows = [("a", "l", "t", 10.0), ("b", "l", "t", 90.0), (None, "l", "t", 0.0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    found = {r.source: r.probability for r in mixing.calibrate(cells, 0.5, {"source": {"a": 1.0, "b": 1.0}}).collect()}
    assert found["a"] == pytest.approx(1) and found["b"] == pytest.approx(40 / 90) and found[None] == 0
    assert "misses its target by 0.6" in caplog.text


# Fixity


def test_audit_finds_what_was_damaged(spark):
    rows = [(f"f{i % 3}", i // 3 * 40_000, 39_000, f"h{i}") for i in range(300)]
    shape = "file string, offset long, length long, hash string"
    damaged = {("f0", 40_000): "bad", ("f2", 3_960_000): "worse"}
    replica = [(f, o, n, damaged.get((f, o), h)) for f, o, n, h in rows if (f, o) != ("f1", 80_000)]
    replica += [("f1", 81_000, 10, "new"), ("f9", 0, 5, "alone")]
    found = fixity.audit(spark.createDataFrame(rows, shape), spark.createDataFrame(replica, shape)).collect()
    assert sorted((r.file, r.offset, r.finding) for r in found) == [
        ("f0", 40_000, "damaged"), ("f1", 80_000, "missing"), ("f1", 81_000, "excess"), ("f2", 3_960_000, "damaged"), ("f9", 0, "excess"),
    ]
    same = spark.createDataFrame(rows, shape)
    assert fixity.audit(same, same).collect() == []


# Classifier


def test_forward_backward_is_the_sum_over_all_labellings():
    rng = np.random.default_rng(3)
    offsets = np.array([0, 4, 5, 8])
    emissions, pairs = rng.normal(size=8), rng.normal(size=(2, 2))
    marginals, expected, log_sum = line_crf.forward_backward(emissions, pairs, offsets)
    good, joint, total = np.zeros(8), np.zeros((2, 2)), 0.0
    for a, b in zip(offsets, offsets[1:]):
        weights = {}
        for labels in product((0, 1), repeat=b - a):
            value = sum(e * y for e, y in zip(emissions[a:b], labels)) + sum(pairs[x, y] for x, y in zip(labels, labels[1:]))
            weights[labels] = np.exp(value)
        z = sum(weights.values())
        total += np.log(z)
        for labels, w in weights.items():
            good[a:b] += np.array(labels) * w / z
            for x, y in zip(labels, labels[1:]):
                joint[x, y] += w / z
    assert np.allclose(marginals[:, 1], good) and np.allclose(expected, joint) and log_sum == pytest.approx(total)


def test_held_out_accuracy(spark, sf_dir, documents):
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    rows = QUERIES["op3_line_crf"](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 50 and np.mean([p == q for p, q in judged]) > 0.95


def test_labels_of_held_out_rows_do_not_matter(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    turned = labels.withColumn("quality", F.expr("case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end"))
    assert np.array_equal(line_crf.fit(documents, labels, 40).weights, line_crf.fit(documents, turned, 40).weights)


def test_an_id_on_many_rows_is_learned_from_once(spark):
    documents = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    rows = line_crf.sample(documents, labels).collect()
    again = documents.withColumn("text", F.concat("text", F.lit(" again")))
    many = documents.unionByName(documents).unionByName(again)
    assert sorted(line_crf.sample(many, labels).collect()) == sorted(rows)


def test_every_line_has_a_marginal(spark, sf_dir, documents):
    model = line_crf.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 40)
    rows = line_crf.labelled_lines(table(spark, sf_dir, "documents"), model).collect()
    found = Counter(r.doc_id for r in rows)
    assert found == {i: (t or "").count("\n") + 1 for i, t in documents.items()}
    lengths = {(r.doc_id, r.line): r.n_chars for r in rows}
    assert all(lengths[i, k] == len(line) for i, t in documents.items() for k, line in enumerate((t or "").split("\n")))


# Compression bands


def test_base_measures(spark, sf_dir, documents):
    import re

    for r in QUERIES["op4_compression_bands"](spark, sf_dir).collect():
        text = documents[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        found = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if found[w] > 1 for k in range(3)}
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_symbols == sum(text.count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == len(covered)
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_bands_reject_repetition_and_noise(spark, sf_dir, documents):
    import base64
    import random

    import zstandard

    def fine(text):
        *_, bad, inside = bands.measure(text, zstandard.ZstdCompressor(level=bands.LEVEL))
        return inside and bad <= bands.MAX_BAD_CHUNKS

    noise = base64.b64encode(random.Random(1).randbytes(30_000)).decode()
    prose = max((t for t in documents.values() if t and "!!" not in t and "***" not in t), key=lambda t: len(set(t.split())))
    assert fine(prose) and not fine(noise) and not fine("some words again " * 500)
    assert not fine(prose[:3000] + noise) and not fine(prose[:6000] + "some words again " * 2000)
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    rows = QUERIES["op4_compression_bands"](spark, sf_dir).collect()
    assert all(r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed)


# Pages


def test_main_text_of_the_given_pages(spark, sf_dir):
    import html
    import re

    pages = {r.page_id: r.html for r in table(spark, sf_dir, "pages").collect()}
    for r in QUERIES["op7_tree_scoring"](spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        lines = [" ".join(html.unescape(p).split()) for p in parts]
        assert r.text == "\n".join(filter(None, lines)) and r.n_chars == len(r.text)


PROSE = "A paragraph of the article, long enough, with commas, to be read as prose by anyone who scores it."


@pytest.mark.parametrize(
    "junk",
    [
        '<nav><p>{0}</p></nav>', '<div class="main-menu"><p>{0}</p></div>', '<header><h1>{0}</h1></header>', '<footer>{0}</footer>',
        '<aside><p>{0}</p></aside>', '<div id="sidebar"><p>{0}</p><p>{0}</p></div>', '<div class="cookie-notice">{0}</div>',
        '<div class="ad"><p>{0}</p></div>', '<form><p>{0}</p><input></form>', '<script>"<p>{0}</p>"</script>', '<style>{0}</style>',
        '<section class="comments"><p>{0}</p><p>{0}</p></section>', '<div role="banner">{0}</div>', '<div style="display:none">{0}</div>',
        '<ul class="breadcrumbs"><li>{0}</ul>', '<!-- {0} -->', '<noscript>{0}</noscript>', '<div class="commentList"><p>{0}</p></div>',
    ],
)
def test_junk_goes(junk):
    noise = junk.format("Something else, entirely, not to be kept, however long it goes on and on, and on.")
    article = f"<h1>Title</h1><p>{PROSE}<p>{PROSE[::-1]}</p><p>Short.</p>"
    expected = f"Title\n{PROSE}\n{PROSE[::-1]}\nShort."
    for page in (
        f"<body>{noise}<article>{article}</article>{noise}</body>",
        f"<div class='content-with-sidebar'>{noise}<div class=post>{article}</div></div>",
        f"<body><main><div>{article}{noise}</div></main></body>",
        f"<article><div>{article}</div>{noise}</article>",
    ):
        if junk.startswith("<header") and page.startswith("<article"):
            continue  # that one is the article's own header
        assert readable.main_text(page) == expected


LINKS = "<ul>" + "".join(f'<li><a href="/{i}">Another page, number {i}</a></li>' for i in range(9)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        "<article><h1>T</h1><p>{0} Lead.</p><div><div>{1}</div></div></article>",
        "<body><article><h1>T</h1>{2}<div><p>{0} Lead.</p></div><section>{1}</section></article>{2}</body>",
        "<body>{2}<main><div><h1>T</h1><div><p>{0} Lead.</p></div></div><div><div><div>{1}</div></div>{2}</div></main></body>",
        "<body><div><h1>T</h1><div><p>{0} Lead.</p></div><div><div>{1}</div></div></div>{2}</body>",
        "<article><h1>T</h1>{0} <b>Lead.</b><div><div>{1}</div></div></article>",
    ],
)
def test_what_is_around_the_best_container_stays(page):
    body = [f"{PROSE} {i}" for i in range(30)]
    text = readable.main_text(page.format(PROSE, "".join(f"<p>{p}</p>" for p in body), LINKS))
    assert text.split("\n") == ["T", f"{PROSE} Lead.", *body]


@pytest.mark.parametrize(
    "part",
    [
        "<section id='discussion'>{0}</section>", "<section id='related-work'>{0}</section>", "<h2 id='search-algorithms'>H</h2>{0}",
        "<h2 id='social-history'>H</h2>{0}", "<div class='ad-hoc-tests'>{0}</div>", "<div id='copyright'>{0}</div>",
        "<h2 class='comments'>H</h2>{0}", "<section id='discussion'><h2>H</h2>{0}</section>",
        "<p>For all <math><mi>x</mi><annotation>x^2</annotation></math> it holds.</p>{0}",
    ],
)
def test_sections_named_for_their_subject_stay(part):
    paragraphs = f"<p>{PROSE}</p><p>{PROSE[::-1]}</p>"
    article = f"<h1>T</h1>{part.format(paragraphs)}{paragraphs}"
    head = ["H"] if "<h2" in part else ["For all x it holds."] if "math" in part else []
    expected = ["T", *head, PROSE, PROSE[::-1], PROSE, PROSE[::-1]]
    related = f"<div id='related-links'>{LINKS}</div><div class='social-history'>{LINKS}</div>"
    for around in ("<body>{1}<article>{0}{1}</article>{1}</body>", "<body><div class='post'>{0}{1}</div></body>"):
        assert readable.main_text(around.format(article, related)).split("\n") == expected


def test_sections_of_uneven_length_stay():
    sizes = (1, 30, 2, 1)
    sections = [[f"{PROSE} {k} {i}" for i in range(n)] for k, n in enumerate(sizes)]
    page = "".join("<section>" + "".join(f"<p>{p}</p>" for p in s) + "</section>" for s in sections)
    for around in ("<article>{0}</article>", "<body><div>{0}</div></body>"):
        assert readable.main_text(around.format(page)).split("\n") == sum(sections, [])


# Tool calls


def plain_levels(waits):
    done = {}
    while ready := [c for c in waits if c not in done and all(w in done for w in waits[c] if w in waits)]:
        depth = 1 + max(done.values(), default=-1)
        done.update({c: depth for c in ready})
    return done


def test_tool_calls(spark, sf_dir):
    import json

    turns = table(spark, sf_dir, "conversations").collect()
    rows = QUERIES["op9_tool_calls"](spark, sf_dir).collect()
    called = {(t.conv_id, t.turn): t for t in turns if t.role in ("user", "system")}
    answered = {(t.conv_id, t.turn - 1): t.text for t in turns if t.role not in ("user", "system")}
    assert {(r.conv_id, int(r.call_id)) for r in rows} == set(called) | set(answered)
    waits = {}
    for conv, turn in called:
        earlier = turn % 2 + (turn - turn % 2) // 4 * 2
        waits[conv, turn] = [(conv, earlier)] if earlier < turn else []
    depth = plain_levels(waits)
    for r in rows:
        key = (r.conv_id, int(r.call_id))
        assert r.status == ("no_call" if key not in called else "linked" if key in answered else "no_result")
        if key not in called:
            continue
        assert r.level == depth[key]
        made = json.loads(r.message)
        assert r.message == json.dumps(made, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert made["arguments"]["text"] == called[key].text and made["result"] == answered.get(key)
        most = 200 if called[key].role == "user" else 50
        assert r.valid == (1 <= len(called[key].text.split()) <= most)


def test_calls_that_cannot_be_ordered_or_linked(spark):
    calls = spark.createDataFrame(
        [
            ("c", "a", 1, "f", '{"n": 1.0}', []), ("c", "b", 2, "f", '{"n": "x", "n": 2}', ["a"]), ("c", "d", 3, "f", "{}", ["e"]),
            ("c", "e", 4, "f", '{"n": NaN}', ["d"]), ("c", "g", 5, "h", None, ["b", "zz", "a"]), ("c", "i", 6, "f", '{"n":1,"m":2}', ["e"]),
            ("c", "a", 7, "f", "{}", None), ("c", None, 8, "f", "{}", None), ("c", "j", 9, "f", '{"n": 5}', ["j"]),
        ],
        "conv_id string, call_id string, turn long, name string, arguments string, after array<string>",
    )
    results = spark.createDataFrame(
        [("c", "a", 2, '{"z":1.50,"a":[1.0]}'), ("c", "a", 1, "first"), ("d", "a", 1, "other"), ("c", "g", 6, "not json")],
        "conv_id string, call_id string, turn long, content string",
    )
    schema = {"f": {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "integer"}}}}
    found = {(r.conv_id, r.call_id): r for r in toolcalls.linked(calls, results, schema).collect()}
    level = {k[1]: r.level for k, r in found.items() if k[0] == "c"}
    assert level == {"a": 0, "b": 1, "d": None, "e": None, "g": 2, "i": None, None: 0, "j": None}
    a = found["c", "a"]
    assert (a.status, a.other_calls, a.other_results, a.valid) == ("linked", 1, 1, True)
    assert a.message == '{"arguments":{"n":1},"id":"a","name":"f","result":"first"}'
    assert found["c", "b"].errors == ["$: not JSON"] == found["c", "e"].errors
    assert found["c", "g"].missing_waits == 1 and found["c", "g"].errors == ["$: missing"]
    assert found["c", "i"].errors == ["$.m: unknown"] and found["c", "d"].errors == ["$.n: required"]
    assert found["d", "a"].status == "no_call" and found["d", "a"].message is None
    assert found["c", None].status == "no_id"


def test_conversations_of_any_size_are_ordered_alike(spark):
    rng = np.random.default_rng(3)
    rows = []
    for conv in ("a", "b", None):
        for i in range(12):
            waits = {f"{conv}{j}" for j in rng.integers(-1, 13 if conv == "b" else i + 1, 2) if conv == "b" or j < i}
            rows.append((conv, f"{conv}{i}", sorted(waits)))
    calls = spark.createDataFrame(rows, "conv_id string, link string, waits array<string>").repartition(3)
    known = {link: [w for w in waits if w in {r[1] for r in rows}] for _, link, waits in rows}
    expected = {link: level for link, level in plain_levels(known).items() if level is not None}
    assert max(expected.values()) > 1 and len(expected) < len(rows)
    for at_once in (1, 20, toolcalls.AT_ONCE):
        assert {r.link: r.level for r in toolcalls.levels(calls, at_once).collect()} == expected


def test_calls_in_a_row_take_one_pass(spark):
    n = 5000
    calls = spark.range(n).selectExpr(
        "'c' as conv_id", "cast(id as string) as call_id", "id as turn", "'f' as name", "'{}' as arguments",
        "array(cast(id - 1 as string)) as after",
    )
    results = spark.createDataFrame([], "conv_id string, call_id string, turn long, content string")
    began = time.monotonic()
    found = {r.turn: r.level for r in toolcalls.linked(calls, results, {}).collect()}
    assert found == {i: i for i in range(n)} and time.monotonic() - began < 30


def test_every_call_and_result_has_a_row(spark):
    calls = [(None, "0", 0, "f", '{"n": 1}', None)] * 3 + [(None, "0", 0, "f", '{"n": "x"}', None), (None, "0", 4, "f", '{"n": 2}', ["0"])]
    calls += [("c", "1", None, "f", "{}", None), ("c", None, 2, "f", "{}", None)]
    results = [(None, "0", 1, "first")] * 2 + [(None, "0", 5, '{"b": 2.0, "a": 1}'), ("c", None, None, "lost"), ("c", None, 7, None)]
    results += [("d", "9", 1, "a"), ("d", "9", 1, "b")]
    shape = "conv_id string, call_id string, turn long, name string, arguments string, after array<string>"
    schema = {"f": {"type": "object", "properties": {"n": {"type": "integer"}}}}
    found = toolcalls.linked(
        spark.createDataFrame(calls, shape).repartition(3),
        spark.createDataFrame(results, "conv_id string, call_id string, turn long, content string").repartition(3),
        schema,
    ).collect()
    assert Counter(r.status for r in found) == {
        "linked": 1, "no_result": 1, "no_call": 1, "no_id": 1, "repeated_call": 4, "repeated_result": 3, "result_no_id": 2,
    }
    first = next(r for r in found if r.status == "linked")
    assert (first.turn, first.other_calls, first.other_results) == (0, 4, 2)
    repeated = sorted((r.turn, r.valid, r.message) for r in found if r.status == "repeated_call")
    made = '{"arguments":{"n":%s},"id":"0","name":"f","result":null}'
    assert not first.valid and repeated == [(0, True, made % 1)] * 3 + [(4, True, made % 2)]
    again = sorted((r.result_turn, r.message) for r in found if r.status == "repeated_result")
    assert again == [(1, '{"id":"0","result":"first"}'), (1, '{"id":"9","result":"b"}'), (5, '{"id":"0","result":{"a":1,"b":2}}')]
    lost = [(r.conv_id, r.call_id, r.result_turn, r.message, r.valid) for r in found if r.status == "result_no_id"]
    assert sorted(lost, key=str) == [("c", None, 7, None, None), ("c", None, None, None, None)]


# Pipeline


def test_pipeline(spark, sf_dir, documents, library):
    docs = table(spark, sf_dir, "documents")
    good = {r.doc_id for r in QUERIES["op3_line_crf"](spark, sf_dir).collect() if r.predicted}
    kept = good & {r.doc_id for r in QUERIES["op4_compression_bands"](spark, sf_dir).collect() if r.kept}
    groups = plain_components({i: plain_simhash(documents[i]) for i in kept})
    one_each = {i for i, root in groups.items() if i == root}
    mixed = mixing.mix(docs.where(F.col("doc_id").isin(sorted(one_each))))
    drawn = {r.doc_id for r in mixed.where("sampled").collect()}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == drawn and len(rows) == len(drawn)
    for r in rows:
        assert r.round_trip and r.ids == library.encode(documents[r.doc_id], add_special_tokens=False).ids
