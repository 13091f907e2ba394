"""What a task of the rank correlation makes is bounded by a range of pairs."""

from driftloom.operators import rankcorrelation as RC


def test_two_blocks_make_no_more_pairs_than_a_range_has():
    assert RC.BLOCK * RC.BLOCK <= RC.RANGE
