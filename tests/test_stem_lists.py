"""What a Python worker holds when lists are stemmed."""

import tracemalloc
from string import ascii_lowercase

import pyarrow as pa

from lexigraph.functions import text as tx


def test_stems_of_lists_are_made_of_few_objects(monkeypatch):
    lists = [["cats", "running"], None, [], ["cats"], None, ["runs", "ponies"]]
    monkeypatch.setattr(tx, "LISTS", 2)
    whole = pa.array([["x"], *lists])[1:]  # a slice has an offset
    assert tx._stem_lists(whole).to_pylist() == [None if x is None else [tx.porter_stem(w) for w in x] for x in lists]
    assert tx._stem_lists(pa.array([], pa.list_(pa.string()))).to_pylist() == []
    many = pa.array([[a + b for a in ascii_lowercase for b in ascii_lowercase]] * 2000)
    monkeypatch.undo()
    tracemalloc.start()
    assert len(tx._stem_lists(many)) == 2000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6  # a string or a reference for each of 1.35 million words would take more
