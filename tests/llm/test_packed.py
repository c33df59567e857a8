"""Packed integers: smaller than plain ones, and read back as they were."""

import numpy as np
import pytest

from gridloom.llm.common import pack, pack_ints, small, unpack_ints


@pytest.mark.parametrize("values", [[], [7], [0, 255, 256, 65535, 2**32 - 1], [2**32, 1], [2**62, 0, 5]])
def test_read_back(values):
    a = np.array(values, np.int64)
    got = unpack_ints(pack_ints(a))
    assert got.dtype == np.int64 and got.tolist() == values


def test_frequent_small_numbers_take_less_room():
    a = np.random.default_rng(3).zipf(1.3, 200_000) % 60_000
    assert len(pack_ints(a)) < 0.95 * len(pack(small(a)))
