from __future__ import annotations

import pytest

from tidewater.sources.poller import Poller, polled

MINUTE = 60_000


class Minutes:
    """A service that has a row for every ticker and minute, and fails as often as its file says."""

    def __init__(self, known, failures=None):
        self.known, self.failures = known, failures

    def latest(self):
        return self.known

    def fetch(self, ticker, after, upto):
        if self.failures and ticker == "B" and after == 3 * MINUTE:
            with open(self.failures) as f:
                left = int(f.read())
            if left:
                with open(self.failures, "w") as f:
                    f.write(str(left - 1))
                raise OSError("busy")
        return [(ticker, k * MINUTE) for k in range(after // MINUTE + 1, upto // MINUTE + 1)]


def test_offsets_move_by_whole_polls_and_no_further_than_a_batch(tmp_path):
    poller = Poller(Minutes(7 * MINUTE + 5), ["A"], 0, MINUTE, 3, f"file://{tmp_path}/cursor", 3, 0)
    assert poller.initialOffset() == {"upto": 0}
    assert [poller.latestOffset()["upto"] // MINUTE for _ in range(4)] == [3, 6, 7, 7]
    poller.commit({"upto": 6 * MINUTE})
    again = Poller(Minutes(20 * MINUTE), ["A"], 0, MINUTE, 3, f"file://{tmp_path}/cursor", 3, 0)
    assert again.latestOffset()["upto"] == 9 * MINUTE
    assert again.partitions({"upto": 5}, {"upto": 5}) == []
    with pytest.raises(ValueError, match="is lost"):
        again.partitions({"upto": 6}, {"upto": 5})
    # The checkpoint is ahead of the cursor: a batch that is planned again says so.
    again.partitions({"upto": 9 * MINUTE}, {"upto": 12 * MINUTE})
    assert again.latestOffset()["upto"] == 15 * MINUTE


def run(spark, folder, service, name, **kwargs):
    stream = polled(spark, name, service, "ticker string, at long", ["A", "B"], f"file://{folder}/cursor", poll_ms=MINUTE, polls=4, wait=0, **kwargs)
    query = stream.writeStream.format("parquet").option("path", f"file://{folder}/out").option("checkpointLocation", f"file://{folder}/state").start()
    try:
        query.processAllAvailable()
        return len([p for p in query.recentProgress if p["numInputRows"]])
    finally:
        query.stop()


def rows(spark, folder):
    return sorted(tuple(r) for r in spark.read.schema("ticker string, at long").parquet(f"file://{folder}/out").collect())


def test_a_stream_that_stops_fails_and_starts_again_has_every_row_once(spark, tmp_path):
    want = lambda n: sorted((t, k * MINUTE) for t in "AB" for k in range(1, n + 1))
    failures = f"{tmp_path}/failures"
    with open(failures, "w") as f:
        f.write("2")  # within the three attempts
    assert run(spark, tmp_path, Minutes(9 * MINUTE, failures), "minutes_a") == 3
    assert rows(spark, tmp_path) == want(9)
    run(spark, tmp_path, Minutes(9 * MINUTE), "minutes_b")  # nothing new
    assert rows(spark, tmp_path) == want(9)
    run(spark, tmp_path, Minutes(22 * MINUTE), "minutes_c")
    assert rows(spark, tmp_path) == want(22)


def test_a_silent_service_fails_the_batch_and_loses_nothing(spark, tmp_path):
    failures = f"{tmp_path}/failures"
    with open(failures, "w") as f:
        f.write("1000000")
    with pytest.raises(Exception, match="no answer for B"):
        run(spark, tmp_path, Minutes(9 * MINUTE, failures), "minutes_d")
    run(spark, tmp_path, Minutes(9 * MINUTE), "minutes_e")
    assert rows(spark, tmp_path) == sorted((t, k * MINUTE) for t in "AB" for k in range(1, 10))
