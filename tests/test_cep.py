"""Automata and the detector, scenario by scenario."""

from __future__ import annotations

import random

import pytest

from tidewater.config import SETTINGS
from tidewater.operators.cep.automata import Many, Single
from tidewater.operators.cep.detector import CepDetector, EventDetector
from tidewater.operators.cep.patterns import DOWN, DROP, SURGE, UP, Absence, Edge, Guard, Pattern, Repeat, default_patterns

AB = (Edge(0, "A", 1), Edge(1, "B", 2))


def run(machine, windows, rows=None):
    return [machine.step(set(w), rows[i] if rows else None) for i, w in enumerate(windows)]


@pytest.mark.parametrize("kind", [Single, Many])
@pytest.mark.parametrize(("gap", "windows", "expected"), [(2, ["A", "", "B"], 0.9), (1, ["A", "", "B"], 0), (3, ["A", "B"], 0.9), (2, ["AB"], 0.9), (2, ["B", "A"], 0)])
def test_sequences(kind, gap, windows, expected):
    assert run(kind(Pattern("p", AB, 2, 0.9, gap)), windows)[-1] == expected


@pytest.mark.parametrize("kind", [Single, Many])
def test_several_hops_in_one_window(kind):
    assert run(kind(Pattern("p", (*AB, Edge(2, "C", 3)), 3, 1.0)), ["ABC"]) == [1.0]


def test_overlap_and_eviction():
    assert run(Many(Pattern("p", AB, 2, 0.9, 3)), ["A", "", "A", "B"])[-1] == 0.9
    machine = Many(Pattern("p", AB, 2, 0.9, 3, limit=2))
    run(machine, ["A", "A", "A"])
    assert [r.born for r in machine.runs] == [1, 2]
    machine = Many(Pattern("p", AB, 2, 0.9, 99))
    run(machine, ["A"] * 12)
    assert len(machine.runs) == 8 and machine.runs[0].born == 4


@pytest.mark.parametrize(("edges", "windows", "expected"), [((Edge(0, "A", 1), Edge(1, "B", 2, 1)), ["A", "", "B"], 0), ((Edge(0, "A", 1), Edge(1, "B", 2, 5)), ["A", "", "", "", "", "B"], 0.9)])
def test_gap_of_an_edge(edges, windows, expected):
    assert run(Many(Pattern("p", edges, 2, 0.9, 3)), windows)[-1] == expected


def test_different_gaps():
    pattern = Pattern("p", (Edge(0, "A", 1), Edge(1, "B", 2, 4), Edge(2, "C", 3, 1)), 3, 0.9, 2)
    assert run(Many(pattern), ["A", "", "", "B", "", "C"])[-1] == 0


@pytest.mark.parametrize(("guard", "value", "expected"), [(Guard("x", "gt", 10), 15, 0.9), (Guard("x", "gt", 10), 5, 0), (Guard("x", "abs_gt", 0.05), -0.07, 0.9), (Guard("x", "lt", 0), -1, 0.9), (Guard("x", "gte", 3), 3, 0.9), (Guard("x", "gt", -1), None, 0.9)])
def test_guards(guard, value, expected):
    pattern = Pattern("p", (Edge(0, "A", 1), Edge(1, "B", 2, guard=guard)), 2, 0.9)
    assert run(Many(pattern), ["A", "B"], [{}, {"x": value}])[-1] == expected


def test_a_guard_without_features_blocks():
    assert run(Many(Pattern("p", (Edge(0, "A", 1), Edge(1, "B", 2, guard=Guard("x", "gt", -1))), 2, 0.9)), ["A", "B"])[-1] == 0


@pytest.mark.parametrize(("timeout", "windows", "expected"), [(2, ["A", "", ""], [0, 0, 0.7]), (2, ["A", "", "B", ""], [0, 0, 0, 0]), (3, ["A", "", "", ""], [0, 0, 0, 0.7]), (2, ["A", "", "A", "", ""], [0, 0, 0.7, 0, 0.7])])
def test_absence(timeout, windows, expected):
    pattern = Pattern("p", (Edge(0, "A", 1),), 2, 0.7, 5, absences=(Absence(1, "B", 2, timeout),))
    assert run(Many(pattern), windows) == expected


@pytest.mark.parametrize(("least", "most", "windows", "expected"), [(3, None, "AAAAB", 0.9), (3, None, "AAAB", 0), (1, 4, "AAAAAAB", 0), (2, None, ["A", "A", "", "A", "B"], 0.9)])
def test_repeats(least, most, windows, expected):
    pattern = Pattern("p", AB, 2, 0.9, 3, repeats=(Repeat(1, "A", least, most),))
    assert run(Many(pattern), windows)[-1] == expected


def row(**changes):
    return {"price_change_rate": 0.001, "total_volume": 1000.0, "avg_sentiment": 0.0, "sentiment_shift": 0.0, **changes}


FEATURES = {"V": {"total_volume": 100_000.0}, "U": {"price_change_rate": 0.05}, "D": {"price_change_rate": -0.05}, "S": {"sentiment_shift": -0.5}, "s": {"avg_sentiment": -0.6}}


def play(windows, detector=None, update=False):
    """Events of every window, after four quiet ones that set the baseline."""
    detector = detector or CepDetector()
    for _ in range(4):
        detector.score(row())
        detector.update(row())
    out = []
    for w in windows:
        r = row(**{k: v for c in w for k, v in FEATURES[c].items()})
        out.append((detector.score(r), detector.match))
        if update:
            detector.update(r)
    return out


@pytest.mark.parametrize(
    ("windows", "expected"),
    [
        (["V", "U"], -0.85),
        (["U", "D"], -0.80),
        (["S", "D"], -0.90),
        (["s", "D"], -0.90),
        (["V", "S", "D"], -1.0),
        (["V", "", ""], -0.50),
        (["U", "D", "V"], -0.95),
        (["V", "U", "S", "D"], -1.0),
        (["U"], -0.55),
        ([""], 0.0),
        (["VU"], -0.90),  # spawning ignores the repeat
    ],
)
def test_default_patterns(windows, expected):
    assert play(windows)[-1][0] == expected


def test_labels_and_idle():
    assert play(["U"])[-1][1] == "point:price_jump_up"
    assert play(["D", "", ""])[-1][1] == "sustained_selloff"
    assert play(["V", "V", "V", "V", "U"])[-1][1] == "sustained_accumulation"
    score, match = play(["U", ""])[-1]
    assert match is None and str(score) == "0.0"
    assert play(["U"], CepDetector(point_severity=0.0))[-1] == (0.0, None)
    assert play(["V", *[""] * 6, "S", "D"])[-1][1] != "panic_compound"


def test_own_patterns_drop_the_meta_patterns():
    base, meta = default_patterns()
    assert not CepDetector(base=base).meta and len(CepDetector(base=base, meta=meta).meta) == 2


def test_keys_do_not_share_state():
    a, b = Many(Pattern("p", AB, 2, 0.9)), Many(Pattern("p", AB, 2, 0.9))
    a.step({"A"})
    assert b.step({"B"}) == 0 and a.step({"B"}) == 0.9


def test_events_at_their_thresholds():
    d = EventDetector()
    assert d.detect({"price_change_rate": 0.02}) == {UP} and d.detect({"price_change_rate": -0.02}) == {DOWN}
    assert d.detect({"sentiment_shift": -0.3}) == {DROP} and d.detect({}) == set()
    for _ in range(3):
        d.update({"total_volume": 10.0})
    assert d.detect({"total_volume": 30.0}) == {SURGE} and d.detect({"total_volume": 29.9}) == set()


def test_random_streams_against_closed_forms():
    """The kernel against what each pattern's rules come to, on the window's ordinals."""
    rng = random.Random(7)
    for _ in range(60):
        windows = [{e for e in (UP, DOWN, SURGE, DROP) if rng.random() < 0.25} for _ in range(40)]
        for w in windows:
            if {UP, DOWN} <= w:
                w.discard(rng.choice((UP, DOWN)))
        has = lambda t, *e: t >= 0 and any(x in windows[t] for x in e)  # noqa: E731, B023
        fired = {}
        for pattern in default_patterns()[0]:
            machine = Many(pattern)
            fired[pattern.name] = [machine.step(w, {"price_change_rate": 0.05}) > 0 for w in windows]
        for t in range(len(windows)):
            quiet = lambda s, *e: not any(has(k, *e) for k in range(s, t))  # noqa: E731, B023
            assert fired["volume_led_breakout"][t] == (has(t, UP, DOWN) and any(has(s, SURGE) and quiet(s, UP, DOWN) for s in range(max(0, t - 2), t + 1)))
            assert fired["news_driven_selloff"][t] == (has(t, DOWN) and any(has(s, DROP) and quiet(s, DOWN) for s in range(max(0, t - 3), t + 1)))
            assert fired["flash_reversal"][t] == ((has(t - 1, UP) and has(t, DOWN)) or (has(t - 1, DOWN) and has(t, UP)))
            assert fired["failed_breakout"][t] == (has(t - 2, SURGE) and not has(t - 1, UP) and not has(t, UP))
    assert SETTINGS.threshold == -0.28
