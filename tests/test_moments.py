import datetime as dt

import numpy as np
import pytest

from recordloom.functions import hot
from recordloom.operators import histories as H

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(("spread", "width"), [(False, 3600), (True, 7)])
def test_pairs_are_those_of_a_nested_loop(spark, monkeypatch, spread, width):
    monkeypatch.setattr(H, "BIN_SECONDS", width)
    if spread:
        monkeypatch.setattr(hot, "HOT_ROWS", 1)
        monkeypatch.setattr(hot, "HOT_SHARE", 10_000)
    rng = np.random.default_rng(5)
    seconds = [int(s) for s in rng.integers(0, 4_000_000, 60)]
    moments = [START + dt.timedelta(seconds=s) for s in seconds] + [START, None, START]
    spans = [(f"r{i}", int(a), int(a) + int(n)) for i, (a, n) in enumerate(zip(rng.integers(-9**7, 9**7, 150), rng.integers(-10, 3_000_000, 150), strict=True))]
    spans += [("open", None, None), ("from", 2_000_000, None), ("until", None, 2_000_000), ("point", seconds[0], seconds[0])]
    text = lambda s: None if s is None else (START + dt.timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = [(i, (text(a), text(b))) for i, a, b in spans] + [("bad", ("no time", text(100)))]
    information = spark.createDataFrame(rows, "id string, time struct<valid_from: string, valid_until: string>")
    found = H.valid_at_moments(information, spark.createDataFrame([(m,) for m in moments], "moment timestamp"))
    got = sorted((r["moment"], r["id"]) for r in found.collect())
    want = []
    for m in {m for m in moments if m}:
        s = (m - START).total_seconds()
        want += [(m, i) for i, a, b in [*spans, ("bad", None, 100)] if (a is None or a <= s) and (b is None or s <= b)]
    assert got == sorted(want)


def test_no_moments(spark):
    information = spark.createDataFrame([("a", (None, None))], "id string, time struct<valid_from: string, valid_until: string>")
    assert H.valid_at_moments(information, spark.createDataFrame([], "moment timestamp")).count() == 0
