"""Every query and stage over awkward rows and over empty tables."""

import json
import time

import pytest

import corpus_pipeline
from lamina.llm import fixity, readable, toolcalls
from lamina.llm.queries import QUERIES
from lamina.llm.tables import table

PER_DOCUMENT = [n for n in QUERIES if n.split("_")[0] in ("op2", "op3", "op4", "op5", "op6", "op8", "op10")]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(spark, awkward, awkward_rows, name):
    rows = QUERIES[name](spark, awkward).collect()
    key = lambda i: (i is not None, i or 0)
    assert sorted((r.doc_id for r in rows), key=key) == sorted((r[0] for r in awkward_rows["documents"]), key=key)


@pytest.mark.parametrize("name", ["op1_merkle_fixity", "op7_tree_scoring", "op9_tool_calls", "op11_grid_cell_codes", "op12_survival_words", "op13_blocked_bloom_urls"])
def test_awkward_rows(spark, awkward, name):
    assert QUERIES[name](spark, awkward).collect()


@pytest.mark.parametrize("which", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, awkward, empty, which):
    stage = corpus_pipeline.STAGES[which][1]
    for folder in (awkward, empty):
        docs = table(spark, folder, "documents")
        out = stage(spark, docs, folder)
        if which < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert out.exceptAll(docs).count() == 0  # rows come through as they are
        else:
            assert out.count() == docs.count()
            assert out.where("not round_trip").count() == 0


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_damage_in_records_without_file_offset_or_hash(spark):
    shape = "file string, offset long, length long, hash string"
    ours = [
        ("a", 0, 10, "h1"), ("a", 10, 10, None), ("a", 20, None, "h3"), (None, 0, 5, "h4"), (None, 5, 5, "h5"),
        ("a", None, 5, "h6"), ("a", None, 5, "h7"), (None, None, 1, "h8"), ("", 0, 1, "h9"), ("?", 0, 1, "same"),
    ]
    theirs = [
        ("a", 0, 10, None), ("a", 10, 10, "h2"), ("a", 20, None, "h3"), (None, 0, 5, "h4"), (None, 5, 5, "other"),
        ("a", None, 5, "h6"), (None, None, 1, "h8b"), ("", 0, 1, "h9"), ("?", 0, 1, "same"),
    ]
    found = fixity.audit(spark.createDataFrame(ours, shape), spark.createDataFrame(theirs, shape)).collect()
    assert {(r.file, r.offset, r.hash, r.replica_hash, r.finding) for r in found} == {
        ("a", 0, "h1", None, "damaged"), ("a", 10, None, "h2", "damaged"), (None, 5, "h5", "other", "damaged"),
        ("a", None, "h7", None, "missing"), (None, None, "h8", None, "missing"), (None, None, None, "h8b", "excess"),
    }
    assert len(found) == 6 and all(r.root != r.replica_root for r in found)


TAGS = [f'<p a{"b" * 3}' + ' x="1"' * 100, "<p" + " x='>" * 50_001, "<p" + ' ="' * 50_000 + ">end"]
DEEP = [
    "<div>" * 10_000 + "</b>" * 50_000, "<div><b>" * 25_000 + "</i>" * 50_000, "<script></script" * 30_000,
    '<div class="comment box">' * 50_000 + "text", '<div class="related">word <a>' * 25_000, "<table><td>" * 20_000 + "<p>" * 20_000,
    "<p>" + "<table><td>" * 5_000 + "<div>" * 20_000, "<ul><li>" * 20_000 + "<h2>" * 10_000, "<aside>" * 50_000, "<p>x" + "<form></form>" * 50_000,
    "<td>" + "</p>" * 50_000, "<article>" * 20_000 + "text", "<header>" * 30_000, "<!--" * 50_000, "</" * 50_000, '="' * 50_000,
]


@pytest.mark.parametrize("page", TAGS + DEEP, ids=range(len(TAGS + DEEP)))
def test_no_page_takes_long(page):
    start = time.process_time()
    readable.main_text(page)
    assert time.process_time() - start < 2


def test_quoted_ends_of_tags_and_several_articles():
    prose = "A sentence, with commas, that is long enough to count as prose of some kind, we hope. " * 3
    links = '<p><a href="x">Read the first part</a> and <a href="y">the other one, too</a>.</p>'
    page = f'<body><div><article><p title="a > b">{prose}</p></article></div><div><article><p>{prose}</p></article></div></body>'
    assert readable.main_text(page) == "\n".join([prose.strip()] * 2)
    page = f"<article><div><p>{prose}</p><p>{prose}</p></div>{links}<h2><a>All linked</a></h2></article><article><a>teaser only</a></article>"
    expected = [prose.strip()] * 2 + ["Read the first part and the other one, too.", "All linked"]
    assert readable.main_text(page) == "\n".join(expected)


def test_half_a_surrogate_pair(spark):
    calls = spark.createDataFrame(
        [(1, "a", 1, "answer", '{"text": "\\ud800", "words": 1, "\\udc00": 2}', None)],
        "conv_id long, call_id string, turn long, name string, arguments string, after array<string>",
    )
    results = spark.createDataFrame([(1, "a", 2, '"\\ud800 \\ud83d\\ude42"')], "conv_id long, call_id string, turn long, content string")
    row = toolcalls.linked(calls, results, toolcalls.SCHEMAS).first()
    assert row.errors == ["$.\\udc00: unknown"]
    assert json.loads(row.message)["result"] == "\ud800 \U0001f642" and "\\ud800 \U0001f642" in row.message
