"""The snapshot at half of the system time, against brute force."""

from factflow.queries import QUERIES


def test_as_of_point_follows_the_data(spark, tmp_path):
    rows = [(k, k * 7 % 13, k * 3 % 1000 / 100) for k in range(1, 12_001)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for k, user, value in sorted(rows, key=lambda r: (r[0] % 10, r[0])):
        if k % 10 <= 6 and k <= 6000:  # ids from 5,001 on count too
            want[user] = (k, round(value * 100))
    assert any(k > 5000 for k, _ in want.values())
    got = QUERIES["bitemporal_snapshot"](spark, str(tmp_path)).collect()
    assert {r["e"]: r["v"] for r in got} == {user: v for user, (_, v) in want.items()} and len(got) == len(want)
