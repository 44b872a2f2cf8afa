"""What a worker of the dense search holds at once."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tessera.operators import dense


def test_a_large_batch_is_multiplied_in_tiles():
    r = np.random.RandomState(1)
    vectors, queries = r.randn(10_000, 8), r.randn(256, 8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(list(vectors), pa.list_(pa.float64()))], names=["doc_seq", "embedding"])
    tracemalloc.start()
    out = list(dense._nearest(SimpleNamespace(value=(np.arange(256), queries)), 5, 6)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # all similarities at once are 20 MB, and again when rounded
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    exact = np.round(unit(queries) @ unit(vectors).T, 6)
    rows = [(x["query_id"], -x["score"], x["doc_seq"]) for b in out for x in b.to_pylist()]
    for q in range(256):
        best = sorted(x[1:] for x in rows if x[0] == q)[:5] if q < 8 else None
        assert best is None or [s for _, s in best] == list(np.lexsort((np.arange(10_000), -exact[q]))[:5])
