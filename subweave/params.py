"""Parameters of the caption jobs, passed to them; nothing is read from the environment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    merge_gap_ms: int = 1200
    merge_min_ms: int = 3000
    merge_max_ms: int = 7000
    merge_chars: int = 160
    merge_words: int = 30
    source_min_cjk: int = 15
    source_max_cjk: int = 25
    source_min_words: int = 11
    source_max_words: int = 20
    bilingual_cjk: int = 22
    bilingual_words: int = 14
    bilingual_min_ms: int = 1200
    render_cjk: int = 20
    render_words: int = 12
    mode: str = "translation-only"
    overlap_gap_ms: int = 100
    batch_items: int = 12
    before: int = 2
    after: int = 1
    retries: int = 0
    max_tokens: int = 500
    guidance_tokens: int = 200
    chunk_chars: int = 12_000
    ttl_ms: int = 720 * 3_600_000
    max_retries: int = 3
    retry_base_ms: int = 5000

    def target(self, cjk: bool) -> tuple[int, int]:
        return (self.source_min_cjk, self.source_max_cjk) if cjk else (self.source_min_words, self.source_max_words)

    def semantic(self, cjk: bool) -> tuple[int, int, int, int]:
        """min, preferred, max, overflow of a semantic segment."""
        low, high = self.target(cjk)
        line, wide, step, far, least = (self.render_cjk, 8, 8, 12, 34) if cjk else (self.render_words, 8, 10, 18, 36)
        preferred = max(high + 4, line + wide, 24)
        return max(low, 10), preferred, max(preferred + step, line + far, least), 6

    def line_limit(self, cjk: bool) -> int:
        return self.render_cjk if cjk else self.render_words

    def char_budget(self) -> int:
        return max(240, min(2400, int(self.max_tokens * 1.8)))
