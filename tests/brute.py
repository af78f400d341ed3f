"""Expected rule events, found by searching each series' row of verdicts.

A verdict is V (in violation), C (in the clear region) or N (neither: not a number,
between the two levels, or nothing to compare). A rule fires at the end of the first
stretch of ``for_samples`` V in a row, and clears at the first C after that.
"""

from __future__ import annotations

import math
import operator
import re
import struct

COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
FIELDS = {"value": 3, "min": 4, "max": 5, "avg": 6}


def fires_and_clears(verdicts: str, need: int):
    """(place, state, samples in violation), by search in the text of verdicts."""
    at = 0
    while fire := re.compile("V" * need).search(verdicts, at):
        yield fire.end() - 1, "fired", need
        clear = verdicts.find("C", fire.end())
        if clear < 0:
            return
        yield clear, "cleared", need + verdicts.count("V", fire.end(), clear)
        at = clear + 1


def level_verdict(rule, x: float) -> str:
    if math.isnan(x):
        return "N"
    beyond = COMPARE[rule.op]
    return "V" if beyond(x, rule.threshold) else "N" if beyond(x, rule.clear_level) else "C"


def verdict(rule, recent: list):
    """(verdict, shown value) of the last of a series' readings in consecutive samples."""
    row, field = recent[-1], FIELDS[rule.metric]
    if rule.kind == "missing":
        return "C", None
    if rule.kind == "stale":
        bits = [struct.pack("4d", *(math.nan if math.isnan(x) else x for x in r[3:7])) for r in recent[-2:]]
        return ("N" if len(bits) < 2 else "V" if bits[0] == bits[1] else "C"), row[3]
    if rule.kind == "rate":
        if len(recent) < rule.window_samples:
            return "N", None
        change = row[field] - recent[-rule.window_samples][field]
        return level_verdict(rule, change), change
    return level_verdict(rule, row[field]), row[field]


def matching(rule, tick) -> dict:
    """Series -> (place in the sample, its first matching reading)."""
    fits = lambda want, have: want is None or want in have.lower()
    rows = [(k, r) for k, r in enumerate(tick) if fits(rule.sensor, r[0]) and fits(rule.reading, r[1]) and rule.type in (None, r[2])]
    return {(r[0], r[1]): (k, r) for k, r in reversed(rows)}


def series_events(rule, key, samples):
    """Events of one series; ``samples`` are (tick, matching readings) of the samples that came."""
    steps, recent, unit = [], [], None
    for tick, hits in samples:
        if key in hits:
            place, row = hits[key]
            recent.append(row)
            unit = row[7]
            sign, shown = verdict(rule, recent)
            steps.append((sign, tick, (0, place), shown, unit))
        elif steps:
            recent = []
            steps.append(("V" if rule.kind == "missing" else "N", tick, (1, key), None, unit))
    for at, state, count in fires_and_clears("".join(s[0] for s in steps), rule.for_samples):
        _, tick, order, shown, unit = steps[at]
        yield tick, order, (state, *key, shown, unit, count)


def run_rules(rules, ticks):
    """All events in order: (seq, tick, rule, state, sensor, reading, value, unit, samples).

    ``ticks`` holds None (no data) or a list of readings (sensor, reading, type, value,
    min, max, avg, unit).
    """
    found = []
    for i, rule in enumerate(rules):
        if rule.kind == "source-unavailable":
            states = "".join("V" if t is None else "C" for t in ticks)
            found += [(at + 1, i, (0, 0), (state, None, None, None, None, n)) for at, state, n in fires_and_clears(states, rule.for_samples)]
            continue
        samples = [(k, matching(rule, t)) for k, t in enumerate(ticks, 1) if t is not None]
        for key in {key for _, hits in samples for key in hits}:
            found += [(tick, i, order, event) for tick, order, event in series_events(rule, key, samples)]
    found.sort(key=lambda e: e[:3])
    return [(seq, tick, rules[i].name, *event) for seq, (tick, i, _, event) in enumerate(found, 1)]
