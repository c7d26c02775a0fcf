import datetime as dt

import numpy as np
import pytest

from recordloom.operators import histories as H

START = dt.datetime(2024, 1, 1)
EVENTS = "event_id string, information_id string, thread_id string, revision long, before string, after string, happened_at timestamp"


def _at(second):
    return None if second is None else START + dt.timedelta(seconds=int(second))


@pytest.mark.parametrize("max_rows", [1_000_000, 25])
def test_states_are_those_of_the_last_event_before(spark, max_rows):
    rng = np.random.default_rng(3)
    # one entity has a third of all events, and many events share a second
    names = ["hot" if i % 3 == 0 else f"e{rng.integers(12)}" for i in range(400)]
    events = [(f"ev{i:03}", n, None, i, f"b{i}", f"a{i}", int(rng.integers(200))) for i, n in enumerate(names)]
    odd = [("x", "hot", "t", 999, "b", "a", 5), ("y", None, None, 999, "b", "a", 5), ("z", "hot", None, 999, "b", "a", None)]
    moments = [(str(n), int(s)) for n, s in zip(rng.choice(["hot", "e1", "e5", "none"], 150), rng.integers(-20, 230, 150), strict=True)]
    moments += [moments[0], ("hot", None), (None, 3)]
    rows = [(*e[:6], _at(e[6])) for e in events + odd]
    found = H.states_at(
        spark.createDataFrame(rows, EVENTS), spark.createDataFrame([(n, _at(s)) for n, s in moments], "entity_id string, moment timestamp"), max_rows
    )
    want = []
    for name, second in {m for m in moments if None not in m}:
        own = sorted((e[6], e[3], e) for e in events if e[1] == name)
        past = [e for s, _, e in own if s <= second]
        if past:
            want.append((name, _at(second), past[-1][5], past[-1][3], past[-1][0]))
        else:
            want.append((name, _at(second), own[0][2][4] if own else None, None, None))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_without_events_or_moments(spark, rowset):
    none, asked = spark.createDataFrame([], EVENTS), spark.createDataFrame([("a", START)], "entity_id string, moment timestamp")
    assert rowset(H.states_at(none, asked)) == [("a", START, None, None, None)]
    assert rowset(H.states_at(none, asked.limit(0))) == []
