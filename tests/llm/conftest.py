"""Small tables with every awkward row, and the same tables empty."""

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SHAPES = {
    "documents": DOCUMENTS,
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}
PROSE = " ".join(f"Sentence number {i} says something of its own, with words{i} and more{i}." for i in range(60))


def stored(spark, folder, rows):
    for name, shape in SHAPES.items():
        df = spark.createDataFrame(rows.get(name, []), shape)
        # Extra columns, some named as operators name theirs.
        for extra in ("ids", "score", "bits", "shard", "slot", "range", "copied", "component_id", "weight", "document"):
            df = df.selectExpr("*", f"'extra' as {extra}")
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def awkward_rows():
    texts = [
        None, "", " ", "\n\n", "a", "a b", PROSE, PROSE, PROSE + " And one more word.", PROSE.replace("says", "tells"),
        "again " * 400, "\x00 \U0001f642 é ß", "x" * 200_000, ("word " * 9 + "\n") * 3000, "<|endoftext|> in a text",
        "# * $ % & | < >", "EINS!! ZWEI!! " * 60,
    ]
    documents = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    documents += [
        (None, PROSE, None, None, None), (None, None, None, None, None), documents[6], documents[6],
        (6, "another text under the same id", "de", "src0", 1), (10**12, PROSE + " Far away.", "fr", "src9", 2),
        (-5, "below zero", "fr", "src9", 2),
    ]
    labels = [(i, int(i not in (10, 13, 15, 16)), 0) for i in range(17)] + [(6, 1, 0), (7, 0, 0), (None, 1, None), (3, None, 0)]
    pages = [
        (0, "u", f"<html><body><article><h1>T</h1><p>{PROSE}</p></article></body></html>"), (1, None, None), (2, "", ""),
        (None, None, "<p>no id"), (None, None, "<p>no id"), (3, "u", "<" * 5000), (4, "u", "<div>" * 3000 + "deep"),
        (4, "u", "<div>" * 3000 + "deep"), (10**12, "u", "<!-- open"), (5, "u", '<p class="a>x</p>'), (-7, "v", "y" * 100_000),
    ]
    conversations = [
        (0, 0, "system", "s"), (0, 1, "user", "q?"), (0, 2, "assistant", "a"), (0, 2, "assistant", "a"), (0, 3, "user", None),
        (0, 3, "user", "second"), (0, 5, "user", "{\"a\": 1}"), (0, 6, "assistant", "{\"b\": 2.0, \"a\": 1}"), (None, 0, "user", "n"),
        (None, 1, "assistant", None), (1, None, "user", "no turn"), (1, None, None, "no role"), (2, 8, "assistant", "no call"),
        (3, 0, "user", "word " * 5000),
    ]
    nan, inf = float("nan"), float("inf")
    embeddings = [
        (3, [0.5] * 8, 1), (3, [0.5] * 8, 1), (3, [-0.25] * 8, 1), (1, [0.125 * i for i in range(8)], None), (2, None, 1),
        (4, [1.0] * 7 + [nan], 1), (5, [inf] + [1.0] * 7, 1), (6, [None] + [1.0] * 7, 1), (None, [0.5] * 8, 2), (7, [], 2),
        (8, [3.4e38, -3.4e38] * 4, 2), (9, [1.0] * 6, None), (10**12, [0.3] * 8, 3), (-5, [0.0] * 8, None),
    ]
    return {
        "documents": documents, "labels": labels, "pages": pages, "conversations": conversations, "embeddings": embeddings,
    }


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory, awkward_rows):
    return stored(spark, tmp_path_factory.mktemp("awkward"), awkward_rows)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return stored(spark, tmp_path_factory.mktemp("empty"), {})
