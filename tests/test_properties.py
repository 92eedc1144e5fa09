"""Properties of the plain functions, over random input."""

from hypothesis import given, settings, strategies as st

from tidewatt import schemas as S
from tidewatt.plans import coverage
from tidewatt.schemas import Resolution
from tidewatt.sources import tsbs, wire, workload

spans = st.lists(st.tuples(st.integers(-40, 40), st.integers(1, 15)).map(lambda x: (x[0], x[0] + x[1])), max_size=12)


@settings(max_examples=300, deadline=None)
@given(spans, st.integers(-30, 30), st.integers(1, 40))
def test_cover_and_gaps_fill_the_range_exactly(descriptors, start, width):
    end = start + width
    used, gaps = coverage.cover(descriptors, start, end)
    covered = {t for s, e in descriptors for t in range(s, e)}
    assert {t for a, b in gaps for t in range(a, b)} == {t for t in range(start, end) if t not in covered}
    chosen = {t for k in used for t in range(*descriptors[k])}
    assert all(t in chosen for t in range(start, end) if t in covered)
    assert len(used) == len(set(used))


@settings(max_examples=200, deadline=None)
@given(st.integers(-(10**15), 4 * 10**15), st.sampled_from([Resolution(micros=7), Resolution(micros=S.DAY), Resolution(unit="Day", tz="Europe/Stockholm"), Resolution(unit="Month", tz="America/Sao_Paulo"), Resolution(unit="Year", tz="UTC")]))
def test_buckets_hold_their_time_and_follow_on_each_other(t, resolution):
    start, end = coverage.bucket_of(t, resolution)
    assert start <= t < end
    assert coverage.bucket_of(end - 1, resolution) == (start, end)
    assert coverage.bucket_of(end, resolution)[0] == end


point = st.fixed_dictionaries({"series_id": st.integers(1, 2**62), "valid_time": st.integers(-(2**40), 2**40), "valid_time_end": st.just(2**41), "knowledge_time": st.integers(0, 9), "change_time": st.integers(0, 9), "run_id": st.just(S.ZERO_ID),
                               "value": st.floats(allow_nan=False, allow_infinity=False), "quality": st.just(0), "flags": st.just(0)})


@settings(max_examples=50, deadline=None)
@given(st.lists(point, min_size=1, max_size=5), st.integers(0, 2**60), st.integers(1, 2**128 - 1))
def test_frames_round_trip_and_notice_any_cut(points, sequence, source):
    frame = {"source_id": S.hex_id(source), "sequence": sequence, "commit_id": S.hex_id(7), "points": points}
    raw = wire.encode("CommitBatch", frame)
    assert wire.decode(raw) == ("CommitBatch", frame)
    for cut in (1, len(raw) // 2, len(raw) - 1):
        try:
            wire.decode(raw[:cut])
            raise AssertionError("a cut frame was read")
        except ValueError:
            pass


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**64 - 1))
def test_series_ids_round_trip(x):
    assert S.unsigned(S.signed(x)) == x


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**63), st.integers(0, 50), st.integers(1, 20))
def test_draws_are_numbered(seed, first, count):
    whole = workload.draws(seed, 0, first + count)
    assert (workload.draws(seed, first, count) == whole[first:]).all() and ((whole >= 0) & (whole < 1)).all()


def test_tag_key_is_order_free():
    assert tsbs.tag_key({"a": "1", "b": "2"}) == tsbs.tag_key({"b": "2", "a": "1"}) != tsbs.tag_key({"a": "12", "b": ""})
