"""Pacing, statuses, stored places, and archives."""

import pytest

from calibra.sources import sinks
from calibra.sources.pulls import Paced, RequestFailed, checked, resumed
from calibra.sources.readers import TooManyRequests, by_cursor, by_offset, with_retries


def test_statuses():
    answers = iter([(429, ""), (503, ""), (200, "rows")])
    assert with_retries(lambda: checked(*next(answers)), sleep=lambda s: None) == "rows"
    with pytest.raises(RequestFailed):
        with_retries(lambda: checked(404, ""), sleep=lambda s: None)
    with pytest.raises(TooManyRequests):
        with_retries(lambda: checked(500, ""), attempts=2, sleep=lambda s: None)


def test_pacing():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    call = Paced(lambda x: x + 1, 4, lambda: now[0], sleep)
    assert [call(k) for k in range(4)] == [1, 2, 3, 4] and waits == [0.25, 0.25, 0.25]
    now[0] += 10
    call(0)
    assert len(waits) == 3


def test_a_break_goes_on_from_the_page_in_hand(tmp_path):
    pages = {"": ([1], "a"), "a": ([2], "b"), "b": ([3], "")}
    state = tmp_path / "place.json"
    run = resumed(lambda at: by_cursor(pages.__getitem__, at), str(state), "")
    assert [next(run), next(run)] == [[1], [2]]
    run.close()  # interrupted while page 2 is in hand
    assert list(resumed(lambda at: by_cursor(pages.__getitem__, at), str(state), "")) == [[2], [3]] and not state.exists()
    rows = list(range(5))
    assert sum(resumed(lambda at: by_offset(lambda o, n: rows[o : o + n], 2, at), str(state), 0), []) == rows


def test_archive_round_trip(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.txt").write_text("x" * 100_000)
    (tmp_path / "in" / "b.txt").write_text("")
    archive, out = str(tmp_path / "all.tar.zst"), tmp_path / "out"
    assert sinks.pack(str(tmp_path / "in"), archive) == sinks.checksum(archive)
    assert sinks.unpack(archive, str(out)) and (out / "deep" / "a.txt").read_text() == "x" * 100_000 and (out / "b.txt").exists()
    assert not sinks.unpack(archive, str(out))
    (tmp_path / "bad.tar.zst").write_bytes(b"no archive")
    with pytest.raises(Exception):
        sinks.unpack(str(tmp_path / "bad.tar.zst"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
