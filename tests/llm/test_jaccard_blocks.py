"""A large group of near copies: each text is stored once, however many blocks meet."""

import pyarrow as pa

from plectrum.llm import jaccard
from plectrum.llm.common import read_or_map


def near_copies(spark, n):
    base = [f"w{j}" for j in range(60)]
    return spark.createDataFrame([(i, " ".join([*base, f"own{i}"])) for i in range(n)] + [(n, "ein anderer text"), (n + 1, None)], "doc_id long, text string").repartition(3)


def test_each_text_of_a_large_unit_is_stored_once(spark, tmp_path, monkeypatch):
    n, stored = 60, []
    whole = jaccard.stored_blocks
    monkeypatch.setattr(jaccard, "stored_blocks", lambda *x: stored.append(whole(*x)) or stored[-1])
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.join(near_copies(spark, n), budget=300).collect()}
    assert got == {i: (0, n - 1) for i in range(n)} | {n: (n, 0), n + 1: (n + 1, 0)}
    names = stored[0].collect()
    assert len(names) > 4  # blocks; each meets all others, since all sets are of one size
    reps = [r for row in names for batch in pa.ipc.open_stream(pa.py_buffer(read_or_map(row["name"]))) for r in batch.column("rep").to_pylist()]
    assert sorted(reps) == list(range(n))
