"""Merging operators of the library against the plain folds, over tables of three kinds of scripts."""

import random

import plain_folds as plain
import pytest

from subweave.operators import layout, merging, segments
from subweave.params import Params

SCHEMA = "track_id string, cue_index int, start_ms double, end_ms double, text string"
LATIN = ["the", "and", "hello", "world", "of", "run.", "Yes,", "(", "foo", "'s", "[music]", "♪", "—", "...", "is", "stop!", "but", "well", ">>", "so", "because", "word-", "know;", "then:", "&amp;"]
WIDE = ["再见", "的", "我们和", "你好，", "因为", "。", "他们走了。", "漢字かな", "A1", "，", "가나다 "]
P = Params()


def table(seed, tracks=90):
    r, rows = random.Random(seed), []
    for t in range(tracks):
        at, pool = 0.0, [LATIN, LATIN + WIDE, WIDE][t % 3]
        for k in range(r.choice([1, 1, 2, 5, 12, 40])):
            at = max(0.0, at + r.choice([-100, 0, 0, 0, 300, 1000, 1001, 1300, 1500]))
            n, d = r.choice([0, 1, 1, 2, 3, 5, 9, 25, 60]), float(r.choice([0, 200, 500, 900, 1500, 3000, 7500]))
            rows.append((f"t{t}", k, at, at + d, r.choice([" ", ""] if t % 3 == 2 else [" ", "  "]).join(r.choice(pool) for _ in range(n)) if n else r.choice(["", " ", None])))
            at += d
    return rows


def folded(rows, fold):
    out = {}
    for track in {x[0] for x in rows}:
        cues = [plain.Cue(s, e, t or "") for name, _, s, e, t in sorted(x for x in rows if x[0] == track) if name == track]
        out |= {(track, k): tuple(c) for k, c in enumerate(fold(cues))}
    return out


def collected(d):
    return {(x.track_id, x.cue_index): (x.start_ms, x.end_ms, x.text) for x in d.collect()}


def sorted_rows(rows):
    return [(a, b, c, d, t or "") for a, b, c, d, t in rows]


def some(fold):
    """Blank cues of a track go before its fold, which still knows how many there were."""
    return lambda cues: fold([c for c in cues if plain.cue_text(c.text)], P, len(cues) == 1)


CASES = {
    "paragraphs": (lambda c: plain.paragraphs(c, P), segments.merge_cues),
    "compact": (some(plain.compact), segments.compact_short_cues),
    "semantic": (some(plain.semantic), segments.semantic_segments),
    "both": (lambda c: plain.semantic(plain.compact(c, P), P), lambda d: merging.compact_and_segment(d, P)),
    "optimize": (lambda c: plain.optimize(c, P), segments.optimize_source_cues),
    "readable": (lambda c: [y for x in c if plain.cue_text(x.text) for y in plain.readable(x, P)], segments.split_readable_cues),
    "repair": (plain.repair, layout.repair_boundaries),
    "display": (lambda c: plain.compact_display(c, P), layout.compact_render_cues),
    "both displayed": (lambda c: plain.compact_display(plain.repair(c), P), lambda d: layout.compact_render_cues(layout.repair_boundaries(d))),
}


@pytest.mark.parametrize("case", CASES)
def test_equals_the_plain_fold(spark, case):
    fold, operator = CASES[case]
    rows = table(11)
    want = folded(sorted_rows(rows), fold)
    assert collected(operator(spark.createDataFrame(rows, SCHEMA))) == want and len(want) > 200


def test_words_of_recognition(spark):
    rows = [(a, b, c, d, t or "") for a, b, c, d, t in table(12)]
    got = collected(merging.assemble_words(spark.createDataFrame(rows, SCHEMA)))
    want = folded(rows, plain.assemble)
    assert got.keys() == want.keys()
    assert {k: (v[0], v[2]) for k, v in got.items()} == {k: (v[0], v[2]) for k, v in want.items()}  # ends are cut at the next start later


@pytest.mark.parametrize("case", CASES)
def test_empty_table(spark, case):
    assert CASES[case][1](spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_limits(spark):
    p = Params(merge_chars=0, merge_words=5, merge_min_ms=0, render_words=6, render_cjk=8, source_min_words=4, source_max_words=7)
    rows = table(13, 45)
    d = spark.createDataFrame(rows, SCHEMA)
    assert collected(segments.merge_cues(d, p)) == folded(sorted_rows(rows), lambda c: plain.paragraphs(c, p))
    assert collected(segments.optimize_source_cues(d, p)) == folded(sorted_rows(rows), lambda c: plain.optimize(c, p))


def test_no_python_in_the_plan(spark, capsys):
    d = spark.createDataFrame(table(14, 3), SCHEMA)
    for _, operator in CASES.values():
        operator(d).explain()
    assert "Python" not in capsys.readouterr().out
