"""What Python workers hold while texts become sets, and how many sets of workers there are."""

import tracemalloc

import numpy as np
import pytest

from tallyloom.llm import decontaminate, jaccard


def traced_peak(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_sets_of_many_texts_take_little_beyond_themselves():
    rng = np.random.default_rng(1)
    blobs = [" ".join(f"word{k}" for k in rng.integers(0, 3000, 300)).encode() for _ in range(512)]
    alone = [jaccard.element_sets([b], 5)[0] for b in blobs]
    sets, most = traced_peak(lambda: jaccard.element_sets(blobs, 5))
    assert all(np.array_equal(a, b) for a, b in zip(alone, sets, strict=True))
    assert most < 16_000_000


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 50, 200_000])
@pytest.mark.parametrize("kinds", [1, 2, 11, 40_000])
def test_repeated_elements_are_counted_in_place(n, kinds):
    elements = np.random.default_rng(n).integers(0, kinds, n).astype(np.uint64) << np.uint64(45)
    values, counts = np.unique(elements, return_counts=True)
    (got, times), most = traced_peak(lambda: jaccard.repeated(elements, 4))
    assert got.tolist() == values[counts >= 4].tolist() and times.tolist() == counts[counts >= 4].tolist()
    assert most < 2.5 * elements.nbytes + 10_000


def test_passages_need_no_second_set_of_workers(spark, monkeypatch):
    def refused(*args, **more):
        raise AssertionError("rows pickled for workers of the RDD interface")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    rows = [np.array([1, 2, 2]), np.array([3])]
    assert decontaminate._singular_vectors(spark, rows, np.array([0.0, 1.0, 2.0, 3.0]), 2).shape == (4, 2)
