"""What the pipeline leaves to tasks, so that the driver holds neither sampled texts nor a sketch."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plectrum.llm import jaccard, toxicity
from plectrum.llm.bytewise import NOT_SPACE, Words


def spied(monkeypatch, module, name):
    """The calls of a function in this process; a worker notes them in a copy of its own."""
    calls, own = [], getattr(module, name)

    def spy(*args):
        calls.append(args)
        return own(*args)

    monkeypatch.setattr(module, name, spy)
    return calls


@pytest.fixture
def labelled(spark):
    rows = [(i, None if i == 7 else "tame words here and there" if i % 2 else "vilest wretch here and there") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))


def test_the_classifier_is_fit_by_a_task_and_is_that_of_the_sample(labelled, monkeypatch):
    rows = toxicity.labelled_sample(*labelled).collect()
    due = toxicity.fit([r["text"] or "" for r in rows], [r["toxic"] for r in rows])
    assert len(due.features)
    calls = spied(monkeypatch, toxicity, "fit")
    got = toxicity.train(*labelled)
    assert not calls
    assert (got.features == due.features).all()
    assert np.allclose(np.append(got.weights, got.bias), np.append(due.weights, due.bias), atol=1e-9)


def test_without_labels_the_model_is_that_of_no_rows(labelled):
    docs, labels = labelled
    for none in (labels.where("false"), labels.where("toxic = 5")):
        model = toxicity.train(docs, none)
        assert (len(model.features), model.bias) == (0, -30.0)


def test_the_sketch_is_written_by_tasks_and_counts_every_shingle(spark, tmp_path, monkeypatch):
    texts = [" ".join(f"w{(i * j) % 13}" for j in range(40)) for i in range(30)]
    runs = np.concatenate(Words(pa.array(texts), NOT_SPACE).shingle_runs(3))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    written = spied(monkeypatch, jaccard, "open_for_write")
    names = jaccard.build_sketch(docs, f"file://{tmp_path}/counts", 8)
    assert (len(names), written) == (jaccard.CHUNKS, [])
    assert (jaccard._sketch(names) == np.bincount((runs & np.uint64(255)).astype("i8"), minlength=256)).all()


def test_the_sketch_of_an_empty_table_counts_nothing(spark, tmp_path):
    names = jaccard.build_sketch(spark.createDataFrame([], "text string"), f"file://{tmp_path}/counts", 8)
    assert jaccard._sketch(names).tolist() == [0] * 256
