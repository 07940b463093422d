"""Index rules by closed-form tables."""

import pytest

from tessera.functions.ranges import MAX_OFFSET, bit_range, list_range, rank_range, size_text, ttl_bucket
from tessera.operators.maintenance import needs_flush


@pytest.mark.parametrize(("args", "want"), [((0, -1), (0, 99)), ((0, 110), (0, 99)), ((0, 80), (0, 80)), ((10, 90), (10, 90)), ((5, 75), (5, 75)), ((50, 40), None), ((110, -1), None), ((0, -1, True), (0, 99)), ((10, 90, True), (9, 89)), ((-3, -1), (97, 99))])
def test_rank_range(args, want):
    assert rank_range(100, *args) == want


@pytest.mark.parametrize(("args", "want"), [((0, -101), None), ((90, 80), None), ((1, -10), (1, 90)), ((-20, -10), (80, 90)), ((-120, -10), (0, 90)), ((0, 200), (0, 99)), ((100, 200), None)])
def test_list_range(args, want):
    assert list_range(100, *args) == want


def test_list_range_cap():
    assert list_range(50_000, 5, -1) == (5, 10_004)


def test_other_rules():
    assert bit_range(0, -1) == (0, MAX_OFFSET) and bit_range(-1, -10) is None and bit_range(119, -2) == (119, MAX_OFFSET - 1)
    assert (ttl_bucket(1), ttl_bucket(300_000), ttl_bucket(299_001)) == (300, 600, 600)
    assert size_text(10) == "10B" and size_text(3 << 20) == "3.00MB"
    assert needs_flush(2_000_000, 0, 0, 1) and needs_flush(30_000, 20_000, 0, 1) and not needs_flush(30_000, 10, 0, 1) and needs_flush(10, 0, 7200, 2)
