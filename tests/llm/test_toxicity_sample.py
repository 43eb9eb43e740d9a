"""The labelled sample is bounded by rows, not only by ids."""

import numpy as np

from cadenza.llm import toxicity
from tests.llm.test_operators import frame


def test_repeated_ids_teach_once(spark, monkeypatch):
    """A third of all rows repeat one doc_id; the machine sees one row of each id."""
    ids = [r["id"] for r in spark.range(300).filter(~toxicity.held_out("id")).orderBy("id").limit(60).collect()]
    docs = [(d, f"{'vile' if d % 2 else 'kind'} words of {d}", "a") for d in ids]
    docs += [(ids[0], f"again {i}", "a") for i in range(30)]
    labels = spark.createDataFrame([(d, d % 2) for d in ids], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit_machine
    monkeypatch.setattr(toxicity, "fit_machine", lambda x, y, *a: seen.append((x, y)) or fit(x, y, *a))
    m = toxicity.fit(frame(spark, docs), labels)
    x, y = seen[0]
    assert x.shape[0] == len(ids) and y.sum() == sum(d % 2 for d in ids)
    assert np.array_equal(toxicity.fit(frame(spark, docs[::-1]), labels).ids, m.ids)
    assert [s[0].shape[0] for s in seen] == [len(ids)] * 2
