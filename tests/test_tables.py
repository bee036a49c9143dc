import random
from datetime import datetime, timedelta

from conftest import rows

from tagweave.sources.tables import next_event_edges


def test_next_event_of_busy_users_is_found_in_two_levels(spark):
    rng = random.Random(4)
    start = datetime(2024, 3, 1, 23, 59, 50)
    events = [
        # User 1 is busy: several events per second, some at the same time, over midnight.
        (1 if i % 3 else 2 + i % 5, start + timedelta(milliseconds=250 * rng.randrange(200)), i)
        for i in range(300)
    ]
    # Some have no time; user null is busy, too, and most events of user 9 lie in one instant or far apart.
    events += [(1, None, 1000 + 40_000 * i) for i in range(10)] + [(2, None, 2000 + i) for i in range(3)]
    events += [(None, start + timedelta(days=97 * i), 3000 + i) for i in range(120)] + [(None, None, 3500)]
    events += [(9, start, 4000 - i) for i in range(110)] + [(9, start - timedelta(days=20_000 + i), 4100 + i) for i in range(20)]
    by_user: dict[int, list] = {}
    for user, ts, event in events:
        by_user.setdefault(user, []).append((ts is not None, ts or start, event))
    expected = sorted(
        (a[2], b[2]) for own in by_user.values() for a, b in zip(sorted(own), sorted(own)[1:])
    )
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(events, f"user_id long, ts {kind}, id long").coalesce(2)
        assert rows(next_event_edges(df, split_at=100)) == expected
        assert rows(next_event_edges(df)) == expected
