"""Every registered record query against its SQL in DuckDB; those that SQL cannot express against brute force over the same rows."""

import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from conftest import SF, rows

from scrivener.plans.base import Tables, cells
from scrivener.plans.texts import near
from scrivener.registry import FLAGSHIP, ORACLES, QUERIES

FOLD = str.maketrans("V0Q1568", "UOOISGB")


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def closest(word, names, cutoff):
    best = max(sorted(names), key=lambda n: ratio(word, n))
    return best if ratio(word, best) >= cutoff else None


def clue_score(clue, reading):
    clue, reading = ("".join(x for x in (t or "").upper() if x.isascii() and x.isalnum()).translate(FOLD) for t in (clue, reading))
    if not clue or not reading:
        return 0.0
    if len(clue) < 5 or clue in reading:
        return (0.9 if len(clue) < 5 else 1.0) if clue in reading else 0.0
    windows = {reading[i : i + n] for n in range(max(1, len(clue) - 2), len(clue) + 3) for i in range(max(1, len(reading) - n + 1))}
    return max(SequenceMatcher(None, w, clue, autojunk=False).ratio() for w in windows)


def read(t, column="raw"):
    return [r for r in cells(t).collect() if r[column]]


def ranked(scores, least):
    return [(n, s) for n, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))][:least]


def vocabulary(t):
    found = {}
    for p in t.part.collect():
        one = found.setdefault(p["p_type"], {})
        one[p["p_name"].upper()] = one.get(p["p_name"].upper(), 0) + 1
    return found


def nearest(t):
    """(cell, entry or None, score or None, whether the reading is an entry)."""
    known, out = vocabulary(t), []
    for r in read(t):
        word, one = r["raw"].upper(), known[r["field"]]
        close = {e: ratio(word, e) for e in one if abs(len(e) - len(word)) <= max(2, len(word) // 4)}
        best = min((e for e, s in close.items() if s >= 0.85), key=lambda e: (-close[e], -one[e], e), default=None)
        out.append((r["cell"], None, None, True) if word in one else (r["cell"], best, close.get(best), False))
    return out


def names_of(t, f, least):
    return [(r["cell"], place, n, s) for r in read(t) for place, (n, s) in enumerate(f(r["raw"]), 1) if least(place, s)]


PATTERNS = {"ring work": ["small ring", "red ring"], "bolts": ["blue bolt"], "widgets": ["widget"]}
CLUES = ["small ring", "red widget", "blue bolt"]
LONG = {"SMALL RING": 30 - 9, "RED": 30 - 3, "LARGE WIDGET": 30 - 11}
NAMES = ["widget", "bolt", "gear", "ring", "panel", "valve", "nut", "frame"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
def rare_words(t):
    """Each word that documents hold once with the closest common one, all pairs of like length compared."""
    n = Counter(w for r in t.documents.collect() for w in re.findall("[a-z]{8,12}", (r["text"] or "").lower()))
    common, out = {w.upper(): c for w, c in n.items() if c >= 10}, []
    for w in (w for w, c in n.items() if c == 1):
        m, best = SequenceMatcher(None, "", ""), None
        for e, c in common.items():
            if abs(len(e) - len(w)) <= max(2, len(w) // 4):
                m.set_seqs(w.upper(), e)
                if m.quick_ratio() >= 0.85 and (s := m.ratio()) >= 0.85:
                    best = min(best or (0, 0, ""), (-s, -c, e))
        out.append((w, best[2].lower() if best else None, -best[0] if best else None))
    return out


BRUTE = {
    "j08_rare_words": (("word", "nearest", "nearest_score"), rare_words),
    "f09_gestalt_similarity": (("p_partkey", "ratio"), lambda t: [(r["p_partkey"], ratio(r["a"], r["b"])) for r in near(t).collect() if r["b"] is not None]),
    "f10_close_match": (("cell", "nearest"), lambda t: [(r["cell"], closest(r["raw"].rsplit(" ", 1)[-1].lower(), NAMES, 0.6)) for r in read(t)]),
    "f11_clue_scores": (("cell", "scores"), lambda t: [(r["cell"], [clue_score(c, r["raw"]) for c in ("small ring", "widget", "blu")]) for r in cells(t).collect()]),
    "f20_city_words": (
        ("c_custkey", "like", "together"),
        lambda t: [(r["c_custkey"], (w := r["c_mktsegment"].upper().replace("I", "1")).startswith("BUILDING") or w == "BD" or ratio(w, "BUILDING") >= 0.8, r["c_mktsegment"].upper() == "BUILDING") for r in t.customer.collect()],
    ),
    "f27_fix_place": (("c_custkey", "place"), lambda t: [(r["c_custkey"], closest(r["c_mktsegment"].replace("E", "F"), SEGMENTS, 0.8)) for r in t.customer.collect()]),
    "f32_surname_match": (
        ("p_partkey", "same"),
        lambda t: [(r["p_partkey"], bool((a := r["a"].strip().upper()) and (b := r["b"].strip().upper()) and (a in b or b in a or ratio(a, b) >= 0.8))) for r in near(t).collect() if r["b"] is not None],
    ),
    "j08_nearest_entry": (("cell", "nearest", "nearest_score"), lambda t: [x[:3] for x in nearest(t)]),
    "j09_pattern_ranking": (("cell", "place", "pattern", "score"), lambda t: names_of(t, lambda raw: ranked({i: clue_score(c, raw) for i, c in enumerate(CLUES)}, 2), lambda place, s: True)),
    "j17_fuzzy_semi_join": (("cell",), lambda t: [(cell,) for cell, best, _, known in nearest(t) if known or best]),
    "r12_suggestion": (
        ("cell", "place", "pattern", "score"),
        lambda t: names_of(t, lambda raw: ranked({n: max(clue_score(c, raw) for c in cs) for n, cs in PATTERNS.items()}, 4), lambda place, s: s >= (0.7 if place == 1 else 0.5)),
    ),
    "x13_best_clue": (("cell", "score"), lambda t: [(r["cell"], max(0.0, *(clue_score(c, r["raw"]) - 0.001 * less for c, less in LONG.items()))) for r in read(t)]),
}
#: Its steps are tested on fixtures in test_correction.py.
FIXTURES = {"f19_cascade"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name in BRUTE:
        columns, brute = BRUTE[name]
        assert sorted(df.columns) == sorted(columns)
        assert rows(df.columns, got) == rows(columns, brute(Tables(spark, SF)))
        return
    if name in FIXTURES:
        assert {r["fixed_by"] for r in got} >= {"words", "none"} and len(got) == Tables(spark, SF).part.count()
        return
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and FLAGSHIP in ORACLES
