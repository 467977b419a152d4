"""The ways that only large tables take give the rows of the ways that small ones take."""

import random

import pytest
from pyspark.sql import functions as F

from voxloom.llm import common, components, decontam, linededup, ngramjoin

LINE = "a line that is long enough to count, by far and wide"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(17)
    words = [f"{a}{b}{c}" for a in ("ba", "ke", "lo") for b in ("n", "st", "r") for c in range(9)]
    texts = [" ".join(r.choice(words) for _ in range(40)) for _ in range(30)]
    rows = [(i, f"{t}\n{LINE}\nend {i}" if i % 3 else t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[2 + i % 2]) for i in range(25)] + [(200, None), (None, f"{LINE}\nnobody's"), (3, f"again\n{LINE}")]
    # A third of all rows hold the hot line.
    rows += [(300 + i, f"{LINE}\n{i}") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def items(spark, docs):
    own = [x["text"] for x in docs.where("doc_id IN (1, 3, 9, 12)").collect()]
    return spark.createDataFrame([(i, " ".join(t.split()[5:25])) for i, t in enumerate(own)] + [(90, "too few"), (91, None)], "item_id long, text string")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_components_by_rounds_of_stars(spark, monkeypatch):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(150)] + [(5, 5), (None, 3), (7, 6), (7, 6)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(9)
    once = rows_of(components.connected_components(frame))
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert rows_of(components.connected_components(frame)) == once


def test_common_lines_by_a_shuffle(docs, monkeypatch):
    sent = rows_of(linededup.drop_common_lines(docs)), rows_of(linededup.line_report(docs))
    monkeypatch.setattr(linededup, "BROADCAST_LINES", 0)
    assert (rows_of(linededup.drop_common_lines(docs)), rows_of(linededup.line_report(docs))) == sent


def test_ids_by_a_shuffle(docs, monkeypatch):
    some = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("gone")).distinct()
    sent = rows_of(common.without_ids(docs, some, "gone", "doc_id")), rows_of(common.with_ids(docs, some, "gone", "doc_id"))
    near = rows_of(ngramjoin.keep_one_of_each(docs, n=5, percent=80))
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    assert (rows_of(common.without_ids(docs, some, "gone", "doc_id")), rows_of(common.with_ids(docs, some, "gone", "doc_id"))) == sent
    assert rows_of(ngramjoin.keep_one_of_each(docs, n=5, percent=80)) == near


def test_sketches_by_a_shuffle(docs, items, monkeypatch):
    sent = rows_of(decontam.find_items(docs, items))
    assert sent
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert rows_of(decontam.find_items(docs, items)) == sent
