"""Features of texts are made in slices, so that a batch takes bounded memory."""

import tracemalloc

from citegrain.llm import hashed


def test_sparse_rows_take_memory_by_slices():
    texts = [" ".join(f"word{k * j}" for j in range(900)).encode() for k in range(250)]
    hashed.sparse_rows(texts[:2])
    tracemalloc.start()
    rows = hashed.sparse_rows(texts)
    kept, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(rows) == 250 and most - kept < 30 * sum(map(len, texts))
