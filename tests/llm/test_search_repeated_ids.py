"""Vector search for an id that occurs many times in a large group of equal vectors."""

import numpy as np

from scorelens.llm import vector_search as S


def test_own_rows_take_no_places():
    ids = np.array([3] * 15 + list(range(10, 40)) + [100], np.int64)
    vectors = np.array([[1.0, 2.0]] * 45 + [[1.0, 2.5]])
    shard = S.Shard(ids, vectors, 0)
    q, got, far = shard.search(np.array([3, 10, 100], np.int64), vectors[[0, 15, 45]], 10, 20)
    assert got[q == 3].tolist() == list(range(10, 20)) and not far[q == 3].any()
    assert got[q == 10].tolist() == [3] * 10 and not far[q == 10].any()
    assert got[q == 100].tolist() == [3] * 10 and (far[q == 100] == 0.5).all()
