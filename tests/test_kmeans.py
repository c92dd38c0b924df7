"""Joint KMeans runs against plain Lloyd iterations and against runs made one by one."""

import numpy as np
import pytest

from churnlake.functions import sums
from churnlake.operators import kmeans as KM


def points(n=500, d=3, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=(n // 4, d)) + c for c in ((0,) * d, (5,) * d, (0, 6, 0)[:d], (-5, 0, 5)[:d])])


def frame(spark, x, parts=3):
    return spark.createDataFrame([([float(v) for v in row],) for row in x], "x array<double>").repartition(parts)


def lloyd(x, centres, tol=1e-4):
    centres = np.array(centres)
    while True:
        label = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[label == i].mean(axis=0) if (label == i).any() else centres[i] for i in range(len(centres))])
        moved, centres = np.sqrt(((new - centres) ** 2).sum(1)).max(), new
        if moved <= tol:
            return centres, ((x[:, None] - centres[None]) ** 2).sum(-1).min(1).sum()


@pytest.mark.parametrize("fan, parts", [(32, 3), (2, 7)])
def test_runs_equal_plain_iterations(spark, monkeypatch, fan, parts):
    monkeypatch.setattr(sums, "FAN", fan)
    x = points()
    starts = [KM.start_centres(x, k, np.random.default_rng([k, i])) for k in (2, 4, 6) for i in range(3)]
    runs = KM.iterate(frame(spark, x, parts), starts)
    for start, run in zip(starts, runs):
        centres, cost = lloyd(x, start)
        assert run.cost == pytest.approx(cost, rel=1e-9)
        assert np.allclose(run.centres, centres[np.lexsort(centres.T[::-1])], atol=1e-9)


def test_joint_runs_equal_separate_ones_in_fewer_scans(spark, monkeypatch):
    scans = []
    whole = KM.summed
    monkeypatch.setattr(KM, "summed", lambda *a: scans.append(1) or whole(*a))
    x = frame(spark, points(seed=2))
    joint = KM.fit(x, "x", [3, 5], 3, 7)
    together = len(scans)
    for k in (3, 5):
        alone = KM.fit(x, "x", [k], 3, 7)[k]
        assert [r.cost for r in joint[k]] == pytest.approx([r.cost for r in alone], rel=1e-9)
    longest = max(r.passes for runs in joint.values() for r in runs)
    assert together == longest + 1 < sum(r.passes for runs in joint.values() for r in runs)


def test_few_and_equal_rows(spark):
    assert KM.fit(frame(spark, np.zeros((0, 2))), "x", [2], 2, 1) == {2: []}
    run = KM.best(KM.fit(frame(spark, np.ones((5, 2))), "x", [3], 2, 1)[3])
    assert run.cost == 0.0 and np.array_equal(run.centres, np.ones((3, 2)))
    run = KM.best(KM.fit(frame(spark, np.array([[0.0], [1.0], [5.0]])), "x", [3], 5, 1)[3])
    assert run.cost == 0.0 and run.centres.ravel().tolist() == [0.0, 1.0, 5.0]
