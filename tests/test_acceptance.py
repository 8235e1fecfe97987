"""The walk with stop rules against a plain loop over all rows."""

from collections import deque

import numpy as np
import pytest

from colsense.operators import sampling


def plain(rows, target, limit, diversity, coverage):
    out, taken, window, radii, centre = [], [], deque(maxlen=20), deque(maxlen=10), None
    for k, v in rows:
        e = np.array(v) / (np.linalg.norm(v) + 1e-12)
        if diversity and taken and max(float(e @ x) for x in taken) > limit:
            window.append(True)
            if len(window) == 20 and sum(window) / 20 > 0.6:
                return [*out, (k, False, "stopped_diversity_exhausted")]
            out.append((k, False, "rejected_diversity"))
            continue
        window.append(False)
        taken.append(e)
        if centre is None:
            centre = e.copy()
        else:
            n = len(taken)
            centre = ((n - 1) * centre + e) / n
            centre = centre / (np.linalg.norm(centre) + 1e-12)
        radii.append(max(1 - float(centre @ x) for x in taken))
        if coverage and len(radii) == 10 and radii[-1] - radii[0] < 0.002:
            return [*out, (k, True, "stopped_coverage_saturated")]
        if len(taken) >= target:
            return [*out, (k, True, "stopped_target_met")]
        out.append((k, True, "accepted"))
    return out


def groups():
    """Far apart, all alike, alike but for some, growing slowly, few rows, repeated rows with null vectors."""
    rng = np.random.default_rng(5)
    unit = lambda n, d=16: rng.normal(size=(n, d))
    near = lambda n, s: rng.normal(size=16) + s * rng.normal(size=(n, 16))
    mixed = np.where(rng.random((600, 1)) < 0.55, near(600, 0.01), unit(600))
    return {"far": unit(500), "alike": near(400, 0.001), "mixed": mixed, "slow": near(300, 0.4), "few": unit(3), None: near(60, 0.2)}


@pytest.mark.parametrize(("target", "limit", "diversity", "coverage"), [(40, 0.995, True, False), (40, 0.995, True, True), (30, 0.5, True, False), (200, 0.9, True, True), (25, 0.5, False, True), (1, 0.5, True, True)])
def test_the_walk_is_that_of_a_plain_loop(spark, target, limit, diversity, coverage):
    data = groups()
    rows = [(g, k, [float(x) for x in v]) for g, vs in data.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame([*rows, ("far", 9999, None)], "g string, k long, v array<double>").repartition(5)
    got = {}
    for r in sampling.accept(df, "g", "k", "v", target, limit, diversity=diversity, coverage=coverage).collect():
        got.setdefault(r["g"], []).append((r["place"], r["k"], r["accepted"], r["outcome"]))
    for g, vs in data.items():
        want = plain(list(enumerate(vs)), target, limit, diversity, coverage)
        assert [x[1:] for x in sorted(got[g])] == want, g
        assert len(want) <= sampling.considered(target, 20, 0.6)
    assert got.keys() == data.keys()


def test_the_bound_holds_for_the_worst_order():
    """The first window may bring one acceptance alone, later ones eight."""
    for target in (1, 8, 9, 100):
        outcomes, taken, k = deque(maxlen=20), 0, 0
        while taken < target:
            reject = k > 0 and (len(outcomes) < 19 or sum(outcomes) - (outcomes[0] if len(outcomes) == 20 else 0) + 1 <= 12)
            outcomes.append(reject)
            taken += not reject
            k += 1
        assert k <= sampling.considered(target, 20, 0.6)
