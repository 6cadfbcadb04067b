import math
import time
from fractions import Fraction

from hypothesis import given
from hypothesis import strategies as st

from kgforge.llm import mixing


@given(st.dictionaries(st.text("abcdefgh", min_size=1, max_size=2), st.floats(0.01, 100), min_size=1, max_size=9), st.integers(20, 300))
def test_every_source_stays_within_a_block(weights, period):
    whole = mixing.quantise(weights, period)
    assert sum(whole.values()) == period
    slots = mixing.schedule(whole)
    assert sorted(x for s in slots.values() for x in s) == list(range(period))
    for s, own in slots.items():
        for t in range(1, period + 1):
            assert abs(sum(x < t for x in own) - Fraction(whole[s] * t, period)) < 1


def test_schedule_follows_windows():
    whole = {"a": 5, "b": 3, "c": 2}
    for s, own in mixing.schedule(whole).items():
        for j, t in enumerate(own):
            assert j * 10 // whole[s] <= t < -(-(j + 1) * 10 // whole[s])


def test_all_rows_once_and_deviation(spark):
    rows = [(k, "big" if k % 3 else f"s{k % 9}", str(k)) for k in range(3000)] + [(9000, None, None), (9001, "", "x"), (None, "big", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block=4, period=50).collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    assert sorted((str(r["doc_id"]), r["source"]) for r in got) == sorted((str(r[0]), r[1]) for r in rows)
    # brute force over the first phase: blocks of each source against its whole weight
    per = {}
    for r in rows:
        per[r[1] or ""] = per.get(r[1] or "", 0) + 1
    left = {s: -(-n // 4) for s, n in per.items()}
    whole = mixing.quantise({s: n**0.5 for s, n in per.items()}, 50)
    first = [r for r in got if r["phase"] == 0]
    for t in range(1, max(r["slot"] for r in first) + 2):
        for s in left:
            done = len({r["slot"] for r in first if (r["source"] or "") == s and r["slot"] < t})
            assert abs(done - Fraction(whole[s] * t, 50)) < 1


def test_empty_and_other_columns(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, "a", "t", 5, "x")], "doc_id long, source string, text string, position int, weight string"))
    assert set(got.columns) == {"doc_id", "source", "text", "weight", "slot", "phase", "position"} and got.first()["position"] == 0


@given(st.dictionaries(st.text("abcdefgh", min_size=1, max_size=2), st.tuples(st.floats(0.01, 100), st.integers(1, 60)), min_size=1, max_size=9))
def test_exact_schedule_stays_within_a_block_of_the_targets(sources):
    blocks, weights = {s: n for s, (_, n) in sources.items()}, {s: w for s, (w, _) in sources.items()}
    plan = list(mixing.exact(blocks, weights))
    assert sorted((s, b) for s, b, _ in plan) == sorted((s, b) for s, n in blocks.items() for b in range(n))
    left = dict(blocks)
    for k in range(plan[-1][2] + 1):
        own, total, got = [s for s, _, phase in plan if phase == k], sum(Fraction(weights[s]) for s in left), dict.fromkeys(left, 0)
        for t, s in enumerate(own, 1):
            got[s] += 1
            assert all(abs(n - Fraction(weights[s]) / total * t) < 1 for s, n in got.items())
        left = {s: left[s] - n for s, n in got.items() if left[s] > n}


def test_hot_source_gets_its_target_among_many(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"s{k % 100}", str(k)) for k in range(6000)]
    weights = {"hot": 1 / 3} | {f"s{k}": 2 / 300 for k in range(100)}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights, block=2).where("phase = 0").collect()
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    end = max(r["slot"] for r in got) + 1
    assert end > 1000
    for t in range(0, end + 1, 50):
        assert abs(len({r["slot"] for r in got if r["source"] == "hot" and r["slot"] < t}) - t / 3) < 1


def test_any_number_of_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 7)
    monkeypatch.setattr(mixing, "PIECE", 50)
    rows = [(k, None if k == 0 else f"s{k % 40}" if k % 3 else "hot", str(k)) for k in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block=2).collect()
    assert sorted(r["position"] for r in got) == list(range(3000)) and sorted(r["doc_id"] for r in got) == list(range(3000))
    order = sorted(got, key=lambda r: r["position"])
    assert [r["slot"] for r in order] == sorted(r["slot"] for r in got)
    per = {}
    for _, s, _ in rows:
        per[s or ""] = per.get(s or "", 0) + 1
    total, first = sum(n**0.5 for n in per.values()), [r for r in got if r["phase"] == 0]
    # until a source runs out: within two blocks of the target
    blocks = {s: -(-n // 2) for s, n in per.items()}
    ends = {s: max(r["slot"] for r in got if (r["source"] or "") == s) for s in per}
    for t in range(1, min(min(ends.values()), max(r["slot"] for r in first)) + 1):
        for s in per:
            done = len({r["slot"] for r in got if (r["source"] or "") == s and r["slot"] < t})
            assert abs(done - per[s] ** 0.5 / total * t) < 2 and done <= blocks[s]


def test_a_hundred_thousand_slots_with_tiny_weights():
    weights = {"third": 1 / 3, "other": 1 / 3, "last": 1 / 3 - 0.0002, "tiny": 0.0002}
    blocks = {"third": 40_000, "other": 40_000, "last": 40_000, "tiny": 30}
    total, got, t = sum(map(Fraction, weights.values())), dict.fromkeys(weights, 0), 0
    for s, _, phase in mixing.exact(blocks, weights):
        if phase or t == 100_000:
            break
        got[s] += 1
        t += 1
        if t % 7 == 0 or s == "tiny":
            assert all(abs(n - Fraction(weights[x]) / total * t) < 1 for x, n in got.items())
    assert t == 100_000 and got["tiny"] == 20


def plain(blocks, weights):
    """Brute force: every phase begins anew with all sources that are left."""
    left, done, phase = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0
    while left:
        least = min((weights[s] for s in left if weights.get(s, 0) > 0), default=1)
        share = {s: Fraction(w if (w := weights.get(s, 0)) > 0 else least) for s in left}
        total, own, t, ended = sum(share.values()), dict.fromkeys(left, 0), 0, False
        while not ended:
            released = [s for s in left if math.floor(own[s] * total / share[s]) <= t]
            s = min(released, key=lambda s: (math.ceil((own[s] + 1) * total / share[s]), (own[s] + 1) * total % share[s] == 0, -share[s], s))
            yield s, done[s], phase
            own[s], done[s], t = own[s] + 1, done[s] + 1, t + 1
            ended = done[s] == blocks[s]
        del left[s]
        phase += 1


@given(st.dictionaries(st.text("abcdefgh", max_size=2), st.tuples(st.sampled_from([-1, 0, 0.1, 0.5, 1, 1, 1.5, 3, 7, 40]), st.integers(0, 9)), max_size=12), st.sets(st.text("abcdefgh", max_size=1)))
def test_the_schedule_is_that_of_phases_begun_anew(sources, unknown):
    blocks, weights = {s: n for s, (_, n) in sources.items()}, {s: w for s, (w, _) in sources.items() if s not in unknown}
    assert list(mixing.exact(blocks, weights)) == list(plain(blocks, weights))


def test_results_know_no_number_of_sources(spark, monkeypatch):
    rows = [(k, None if k == 0 else f"s{k % 40}" if k % 3 else "hot", str(k)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = {"hot": 0.5, "s1": 0.2, "s2": 0.0, "elsewhere": 0.001}
    run = lambda: [sorted(tuple(map(str, r)) for r in mixing.mix(docs, w, block=2, period=p).collect()) for w, p in ((None, None), (weights, None), (None, 60))]
    expected = run()
    monkeypatch.setattr(mixing, "MAX_SOURCES", 7)
    assert run() == expected


def test_more_sources_than_ten_thousand(spark):
    blocks = {f"s{k}": 1 + k % 3 for k in range(12_000)} | {"hot": 3_000}
    weights = {s: float(n) for s, n in blocks.items()}
    began = time.monotonic()
    plan = list(mixing.exact(blocks, weights))
    assert time.monotonic() - began < 30  # starting every one of 12,001 phases with all sources takes many minutes
    assert sorted((s, b) for s, b, _ in plan) == sorted((s, b) for s, n in blocks.items() for b in range(n))
    # the first phase: within a block of the target
    total, first = sum(map(Fraction, weights.values())), [s for s, _, phase in plan if not phase]
    own = dict.fromkeys(blocks, 0)
    for t, s in enumerate(first, 1):
        own[s] += 1
        for x in (s, "hot"):
            assert abs(own[x] - Fraction(weights[x]) / total * t) < 1
    rows = spark.range(24_000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'hot' ELSE 's' || (id DIV 2) END AS source", "'' AS text")
    got = mixing.mix(rows, block=2).select("doc_id", "source", "slot", "position").collect()
    assert sorted(r["position"] for r in got) == list(range(24_000)) and len({r["slot"] for r in got}) == 18_000
    assert len({r["doc_id"] for r in got}) == 24_000
