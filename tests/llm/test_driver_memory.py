"""What decontamination brings to the driver."""

import numpy as np

from tallyloom.llm import decontaminate


def test_products_of_passages_reach_the_driver_as_one_sum(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n, rank = 2 * decontaminate.SUMMED + 88, 40
    rows = [rng.integers(1, n, rng.integers(8, 64)).astype(np.int32) for _ in range(90)]
    weight = np.append(0.0, rng.random(n - 1) + 0.1)
    frame, brought = type(spark.range(0)), []
    real = frame.toArrow

    def watched(self):
        out = real(self)
        brought.append(out.nbytes)
        return out

    monkeypatch.setattr(frame, "toArrow", watched)
    got = decontaminate._singular_vectors(spark, rows, weight, rank)
    assert brought and max(brought) <= 1.1 * n * rank * 8
    passages = np.zeros((len(rows), n))
    for k, r in enumerate(rows):
        np.add.at(passages[k], r, weight[r])
    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(5)).standard_normal((n, rank)))[0]
    for _ in range(3):
        basis = np.linalg.qr(passages.T @ (passages @ basis))[0]
    assert np.allclose(got @ got.T, basis @ basis.T, atol=1e-6)


def test_few_terms_and_fewer_passages_than_tasks(spark):
    weight = np.array([0.0, 1.0, 2.0, 3.0])
    got = decontaminate._singular_vectors(spark, [np.array([1, 2, 2]), np.array([3])], weight, 2)
    passages = np.array([[0.0, 1.0, 4.0, 0.0], [0.0, 0.0, 0.0, 3.0]])
    assert np.allclose(passages @ got @ got.T, passages)
