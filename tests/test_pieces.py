"""Recordings are made a few at a time."""

import pandas as pd

from driftloom.plans import recordings
from driftloom.plans import tables as T


def test_frames_come_in_pieces_of_bounded_size():
    frames = [pd.DataFrame({"x": range(n)}) for n in (0, 1, 150, 64)]
    pieces = list(T.in_pieces(iter(frames), recordings.AT_ONCE))
    assert max(map(len, pieces)) == recordings.AT_ONCE
    assert [x for p in pieces for x in p["x"]] == [x for f in frames for x in f["x"]]
