"""A second, plain version of the merging operators: greedy folds over one track's cues in a list, for comparison."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from subweave.operators.folds import *  # noqa: F403
from subweave.functions.text import PAUSE_WORDS
from subweave.operators.layout import GAP_MS, joined, weight
from subweave.params import Params

SOFT = re.compile(r"[,:;，、；：]\Z")
COMMA_OR_END = re.compile(r"[,.;!?，。！？；…]\Z")
PARAGRAPH_END = re.compile(r"[.!?…。！？]\Z")
_STOPS = re.compile(r"[。！？；，、：,.!?;:]")
_PAUSE, LEAST_MS = frozenset(PAUSE_WORDS), 700


def merged(a: Cue, b: Cue) -> Cue:
    return Cue(a.start, b.end, combined([a.text, b.text]))


def sentences(t: str) -> list[str]:
    t = cue_text(t)
    cut = r"(?<=[。！？；：，、…])" if is_cjk(t) else rf"(?<=[,.;:!?]){S}+"
    return [p for p in map(trim, re.split(cut, t)) if p] or ([t] if t else [])


def by_length(t: str, limit: int) -> list[str]:
    """Pieces of at most `limit` words (some more where no safe place to cut comes earlier) or characters."""
    t = cue_text(t)
    if is_cjk(t):
        out = []
        while len(t) > limit:
            places = range(limit, max(10, int(limit * 0.6)) - 1, -1)
            fits = [k for k in places if (a := trim(t[:k])) and (b := trim(t[k:])) and not CONNECTOR.search(a) and not LEADING.match(b)]
            k = next((k for k in fits if re.search(r"[，。！？；：、…]\Z", trim(t[:k]))), fits[0] if fits else limit)
            out.append(trim(t[:k]))
            t = trim(t[k:])
        return [p for p in [*out, t] if p]
    words, out, at = words_of(t), [], 0
    least, most = max(6, int(limit * 0.6)), max(limit + 3, math.ceil(limit * 1.2))
    while len(words) - at > limit:
        last = len(words) - 1
        ends = [*range(min(at + limit, last), at + least - 1, -1), *range(min(at + limit, last) + 1, min(at + most, last) + 1)]
        cut = next((e for e in ends if not weak_end(" ".join(words[at:e]))), min(at + limit, last))
        out.append(" ".join(words[at:cut]))
        at = cut
    return [*out, " ".join(words[at:])] if words[at:] else out


def assemble(atoms: list[Cue]) -> list[Cue]:
    """Words of scrolling recognition to cues: closed at the end of a sentence or clause, or when long enough at a fitting place."""
    out: list[Cue] = []
    held: list[Cue] = []
    text = ""

    def close() -> None:
        nonlocal text
        t = event_text(text)
        if held and t:
            cue = Cue(held[0].start, held[-1].end, t)
            if out and out[-1].end > cue.start:
                out[-1] = out[-1]._replace(end=cue.start)
            out.append(cue)
        held.clear()
        text = ""

    for a in atoms:
        held.append(a)
        text += (" " if text and not is_cjk(text) and not text.endswith(" ") and not a.text.startswith(" ") else "") + a.text
        t = event_text(text)
        most, more = (34, 8) if is_cjk(t) else (20, 5)
        weak = CONNECTOR.search(t) is not None if is_cjk(t) else weak_end(t)
        n = size(t)
        if COMMA_OR_END.search(trim(a.text)) or n >= most and (not weak or n >= most + more):
            close()
    close()
    return out


def paragraphs(cues: list[Cue], p: Params) -> list[Cue]:
    """Cues to paragraphs of a few seconds: cut before a cue that is too far or makes it too long, or after a sentence once long enough."""
    out: list[list[Cue]] = []
    held: list[Cue] = []
    chars = words = 0
    for c in cues:
        t = cue_text(c.text)
        if not t:
            continue
        if held and (c.end - held[0].start >= p.merge_max_ms or c.start - held[-1].end > p.merge_gap_ms):
            out.append(held)
            held, chars, words = [], 0, 0
        fresh = not held
        held.append(c._replace(text=t))
        chars, words = chars + len(t) + (not fresh), words + len(words_of(t))
        enough = PARAGRAPH_END.search(t) or 0 < p.merge_chars <= chars or 0 < p.merge_words <= words
        if not fresh and c.end - held[0].start >= p.merge_min_ms and enough:
            out.append(held)
            held, chars, words = [], 0, 0
    if held:
        if out and held[-1].end - held[0].start < p.merge_min_ms:
            out[-1] = out[-1] + held
        else:
            out.append(held)
    return [Cue(g[0].start, g[-1].end, combined([c.text for c in g])) for g in out]


def _backward(cues: list[Cue], fits: Callable[[Cue, Cue], bool]) -> list[Cue]:
    """From the last to the second: merged into the one before where that fits."""
    out = list(cues)
    for k in range(len(out) - 1, 0, -1):
        if fits(out[k - 1], out[k]):
            out[k - 1 : k + 1] = [merged(out[k - 1], out[k])]
    return out


def _compact_edge(a: Cue, b: Cue) -> bool:
    left, right = trim(a.text), trim(b.text)
    return b.start - a.end > 1000 or STRONG.search(left) is not None and not dangling(left) or SYMBOL.match(right) is not None and not dangling(right)


def _pause_edge(a: Cue, b: Cue) -> bool:
    t = trim(b.text)
    return b.start - a.end > 1000 or SYMBOL.match(t) is not None or (words_of(t.lower()) or [""])[0] in _PAUSE


def _fill(cues: list[Cue], p: Params, edge: Callable[[Cue, Cue], bool], allowance: bool) -> list[Cue]:
    """Short cues to the target length, forward and then back. Lengths add up, in the unit of the first cue's script."""

    def limit(a: Cue, b: Cue, cjk: bool) -> int:
        more = allowance and (dangling(a.text) or dangling(b.text))
        return p.target(cjk)[1] + (more and (10 if cjk else 4))

    out, k = [], 0
    while k < len(cues):
        cur = cues[k]
        cjk, n = is_cjk(cur.text), size(cur.text)
        while n < p.target(cjk)[0] and k + 1 < len(cues):
            following = cues[k + 1]
            both = n + size(following.text)
            if edge(cur, following) or both > limit(cur, following, cjk):
                break
            cur, n, k = merged(cur, following), both, k + 1
        out.append(cur)
        k += 1

    def fits(a: Cue, b: Cue) -> bool:
        cjk, n = is_cjk(b.text), size(b.text)
        wanted = n < p.target(cjk)[0] or allowance and dangling(b.text)
        return wanted and size(a.text) + n <= limit(a, b, cjk) and not _compact_edge(a, b)

    return _backward(out, fits)


def compact(cues: list[Cue], p: Params, alone: bool | None = None) -> list[Cue]:
    """alone: whether the track has this one cue only, which is left as it is."""
    if alone if alone is not None else len(cues) <= 1:
        return cues
    kept = tidied(cues)
    return _fill(kept, p, _compact_edge, True) if len(kept) > 1 else kept


def optimize(cues: list[Cue], p: Params) -> list[Cue]:
    cut = [(c, sentences(c.text)) for c in tidied(cues)]
    parts = [x for c, texts in cut for x in (spread(c, texts, 400) if len(texts) > 1 else [c])]
    return _fill(parts, p, _pause_edge, False) if len(parts) > 1 else parts


def readable(cue: Cue, p: Params) -> list[Cue]:
    t = cue_text(cue.text)
    limit = max(p.render_cjk + 6, 24) if is_cjk(t) else max(p.render_words + 3, 15)
    parts = by_length(t, limit) if size(t) > limit else [t]
    return spread(cue, parts, 500) if len(parts) > 1 else [cue._replace(text=t)]


def semantic(cues: list[Cue], p: Params, alone: bool | None = None) -> list[Cue]:
    kept = tidied(cues)
    if alone if alone is not None else len(cues) <= 1:
        return kept

    def edge(a: Cue, b: Cue) -> bool:
        t = trim(a.text)
        return b.start - a.end > 1400 or STRONG.search(t) is not None or SOFT.search(t) is not None and not dangling(t) or SYMBOL.match(trim(b.text)) is not None

    out, k = [], 0
    while k < len(kept):
        cur = kept[k]
        while k + 1 < len(kept):
            following, n = kept[k + 1], size(cur.text)
            low, preferred, high, more = p.semantic(is_cjk(cur.text))
            enough = min(high + more, max(low + (6 if is_cjk(cur.text) else 10), int(preferred * 0.6)))
            if n >= enough and not dangling(cur.text) or edge(cur, following) or n + size(following.text) > high + more:
                break
            cur, k = merged(cur, following), k + 1
        out.append(cur)
        k += 1

    def fits(a: Cue, b: Cue) -> bool:
        low, _, high, more = p.semantic(is_cjk(a.text))
        return (dangling(b.text) or size(b.text) < low) and not edge(a, b) and size(a.text) + size(b.text) <= high + more

    return [x for c in _backward(out, fits) for x in _semantic_parts(c, p)]


def _semantic_parts(c: Cue, p: Params) -> list[Cue]:
    t = cue_text(c.text)
    cjk, n = is_cjk(t), size(t)
    _, preferred, high, more = p.semantic(cjk)
    if n <= high:
        return [c._replace(text=t)]
    parts = sentences(t)
    if len(parts) <= 1:
        parts = [t] if not cjk and n <= high + more + 16 else by_length(t, preferred if cjk else high)
    return spread(c, parts, 500) if len(parts) > 1 else [c._replace(text=t)]


def _retimed(a: Cue, b: Cue, left: str, right: str) -> tuple[Cue, Cue]:
    """Two cues with new texts; the time between them moves with the texts' lengths."""
    share = weight(left) / (weight(left) + weight(right))
    at = min(b.end - LEAST_MS, max(a.start + LEAST_MS, half_up(a.start + share * (b.end - a.start))))
    return Cue(a.start, at, left), Cue(at, b.end, right)


def repair(cues: list[Cue]) -> list[Cue]:
    """Left to right: a loose end goes to the next cue, and what completes an open end comes from it."""
    out = [c._replace(text=collapse(c.text)) for c in cues]
    for k in range(len(out) - 1):
        a, b = out[k], out[k + 1]
        if b.start - a.end > GAP_MS:
            continue
        stops = [m.end() for m in _STOPS.finditer(a.text)]
        head, tail = (trim(a.text[: stops[-1]]), trim(a.text[stops[-1] :])) if stops else ("", "")
        if head and tail and b.text and (dangling(tail, False) or weight(tail) <= 8):
            a, b = _retimed(a, b, head, joined([tail, b.text]))
        if CONNECTOR.search(trim(a.text)):
            ends = [m.end() for m in _STOPS.finditer(b.text) if m.end() <= min(40, len(b.text) - 1)]
            fits = [e for e in ends if trim(b.text[:e]) and trim(b.text[e:]) and not LEADING.match(trim(b.text[e:])) and not CONNECTOR.search(trim(b.text[:e]))]
            if fits:
                a, b = _retimed(a, b, joined([a.text, trim(b.text[: fits[-1]])]), trim(b.text[fits[-1] :]))
        out[k], out[k + 1] = a, b
    return [c for c in out if trim(c.text)]


def _bounds(t: str, p: Params) -> tuple[int, int]:
    line = p.line_limit(is_cjk(t))
    least = max(8 if is_cjk(t) else 5, int(line * 0.65))
    return least, max(least, 2 * line)


def _may_join(a: Cue, b: Cue, p: Params) -> bool:
    left, right, ms = trim(a.text), trim(b.text), a.end - a.start
    loose = dangling(left, False)
    if b.start - a.end > GAP_MS or SYMBOL.match(right) or STRONG.search(left) and not loose and ms >= LEAST_MS:
        return False
    either, both = loose or dangling(right, False), joined([a.text, b.text])
    if size(both) > _bounds(both, p)[1] + (either and (10 if is_cjk(both) else 4)) or b.end - a.start > (9000 if either else 6500):
        return False
    return either or size(left) < _bounds(left, p)[0] or ms < 1200


def compact_display(cues: list[Cue], p: Params) -> list[Cue]:
    if len(cues) <= 1:
        return cues
    out: list[Cue] = []
    for c in tidied(cues, collapse):
        if out and _may_join(out[-1], c, p):
            out[-1] = Cue(out[-1].start, c.end, joined([out[-1].text, c.text]))
        else:
            out.append(c)
    return out
