"""Column functions over caption text. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: white space as caption players see it, scripts written without blanks, punctuation, connecting words
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = r"[\t\n\x0B\f\r \u00A0[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]]"  # other letters fail at the range
CJK = r"[\u3040-\uFAFF&&[\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uAC00-\uD7AF]]"  # other letters fail at the range
CONNECTOR_END = r"(?:和|与|或|而|并|从|向|给|把|被|对|在|为|将|让|跟|比|及)\z"
LEADING_PUNCTUATION = r"\A[,.;:!?，。！？；：、]"
PUNCTUATION_ONLY = rf"\A(?:[\p{{P}}\p{{S}}]|{SPACE})+\z"
MARK = rf"[\p{{P}}\p{{S}}]|{SPACE}"
SYMBOL_START = r"\A[\[(♪]"
STRONG_END = r"[.!?。！？…]\z"
SOFT_END = r"[,:;，、；：]\z"
WEAK_LAST_WORDS = (
    "a an and are as at be because been being but by can could did do does for from had has have i if in into is it may "
    "might must of on or our over should so that the their then there these this those to under was we were what when "
    "where which while who will with would you your"
).split()
PAUSE_WORDS = (
    "actually also although and anyway as basically because but eventually frankly honestly hopefully however if instead "
    "just like literally maybe meanwhile nevertheless nonetheless now okay or otherwise perhaps personally probably right "
    "since so suddenly then therefore though thus unless until well while"
).split()
LANGUAGES = {"zh-CN": "Simplified Chinese", "zh-TW": "Traditional Chinese", "ja": "Japanese", "ko": "Korean", "es": "Spanish", "fr": "French", "de": "German", "ru": "Russian"}
FRAGMENT_START = r"\A(?:的|了|着|过|并|但|而|或|及|将|把|被|在|对|给|从|向|为|与|且|则|也|又)"
FRAGMENT_END = r"(?:的|了|着|过|而|并|及|将|把|被|在|对|给|从|向|为|与)\z"
PRICES = {"gpt-4o": (2.5, 10.0), "gpt-4o-mini": (0.15, 0.6), "gpt-3.5-turbo": (0.5, 1.5)}  # per million tokens in and out


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def unless_blank(text: Column) -> Column:
    """For select: the text as a column, without the rows for which it is blank or null. A filter after the projection would have it computed twice."""
    return F.explode(F.filter(F.array(text), lambda t: t != ""))


def first(text: Column) -> Column:
    """For expressions that look at a text's start: an anchored one is tried at every character."""
    return F.substring(text, 1, 1)


def last(text: Column) -> Column:
    """The same for its end."""
    return F.substring(text, -1, 1)


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def cut_ends(text: Column) -> Column:
    """trimmed, for texts that take work: computed once, and taken apart by the list of characters only where an end is blank."""
    ends = lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
    return let(text, lambda t: F.when(ends(t).rlike(SPACE), trimmed(t)).otherwise(t))


def _replaced(text: Column, found: str | Callable[[Column], Column], *replacements: tuple[str, str]) -> Column:
    """The replacements one after the other, for texts in which `found` occurs; most need one look only."""

    def one(t: Column) -> Column:
        out = t
        for pattern, by in replacements:
            out = F.regexp_replace(out, pattern, by)
        return F.when(t.rlike(found) if isinstance(found, str) else found(t), out).otherwise(t)

    return let(text, one)


def odd_blanks(t: Column) -> Column:
    """Whether a text may hold white space other than single blanks; wide characters count too, as one range is looked up faster than a list."""
    return t.contains("  ") | t.rlike(r"[\t-\r\u00A0\u1680-\uFEFF]")


def trimmed_column(name: str) -> Column:
    """trimmed, for a column: taken apart by the list of characters only where an end is blank."""
    t = F.col(name)
    return F.when(first(t).rlike(SPACE) | last(t).rlike(SPACE), trimmed(t)).otherwise(t)


def collapsed(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return cut_ends(_replaced(text, odd_blanks, (f"{SPACE}+", " ")))


_CLOSED = ((rf"{SPACE}+([,.;:!?])", "$1"), (rf"{SPACE}+([，。！？；：])", "$1"))


def _close_up(text: Column) -> Column:
    """No white space before punctuation."""
    return _replaced(text, rf"{SPACE}[,.;:!?，。！？；：]", *_CLOSED)


def normalize_event(text: Column) -> Column:
    return cut_ends(_close_up(collapsed(text)))


def normalize_cue(text: Column) -> Column:
    """Without the speaker mark at the start, other marks as blanks, white space collapsed."""
    marked = lambda t: F.regexp_replace(F.regexp_replace(t, rf"\A>>{SPACE}*", ""), ">>", " ")
    return collapsed(let(text, lambda t: F.when(t.contains(">>"), marked(t)).otherwise(t)))


CLOSES_BEFORE, CLOSES_AFTER = r"[,.;:!?，。！？；：)\]}'\"”’]", r"[(\[{“‘]"  # no blank before, none after
_MAY_CLOSE_UP = rf"{SPACE}(?:{CLOSES_BEFORE}|{SPACE})|{CLOSES_AFTER}{SPACE}"


def may_close_up(t: Column) -> Column:
    """Whether normalize_merged or the speaker's mark may change a text whose ends aren't blank."""
    return t.contains(">>") | t.rlike(_MAY_CLOSE_UP)


def normalize_merged(text: Column) -> Column:
    brackets = ((rf"({CLOSES_AFTER}){SPACE}+", "$1"), (rf"{SPACE}+([)\]}}'\"”’])", "$1"))
    return cut_ends(_replaced(text, _MAY_CLOSE_UP, *_CLOSED, *brackets, (f"{SPACE}{{2,}}", " ")))


def normalize_render(text: Column) -> Column:
    """As merged text, and no blank between two characters of a script without blanks."""
    out = F.regexp_replace(_close_up(text), f"({CJK}){SPACE}+({CJK})", "$1$2")
    return cut_ends(F.regexp_replace(out, f"{SPACE}{{2,}}", " "))


def is_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK), F.lit(False))


def word_count(text: Column) -> Column:
    return tidy_word_count(collapsed(text))


def tidy_word_count(text: Column) -> Column:
    """Words of a text whose white space is collapsed."""
    return let(text, lambda t: F.when(t == "", 0).otherwise(blanks_of(t) + 1))


def text_length(text: Column) -> Column:
    """Characters of scripts without blanks, else words."""
    return let(text, lambda t: F.when(is_cjk(t), F.length(trimmed(t))).otherwise(word_count(t)))


def text_stats(text: Column) -> Column:
    return F.struct(is_cjk(text).alias("is_cjk"), text_length(text).alias("length"))


def blanks_of(t: Column) -> Column:
    """The number of plain blanks."""
    return F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit("")))


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def cue_weight(text: Column) -> Column:
    return F.greatest(F.lit(1), visible_length(text))


def render_width(text: Column) -> Column:
    """Estimated width in units of a wide character, from counts of each kind of character."""
    rest = F.length(text)
    parts = []
    for pattern, width in ((SPACE, 30), (CJK, 100), ("[A-Z]", 72), ("[a-z0-9]", 62)):
        n = F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
        parts.append(n * width)
        rest = rest - n
    return (sum(parts[1:], parts[0]) + rest * 50) / F.lit(100.0)


def last_latin_word(text: Column) -> Column:
    return F.lower(F.regexp_extract(normalize_cue(text), r"([A-Za-z][A-Za-z'\-]*)\z", 1))


def asks_for_more(t: Column) -> Column:
    """Whether the last Latin word of a text whose white space is collapsed asks for a next one."""
    word = F.substring_index(t, " ", -1)
    latin = F.regexp_extract(word, r"([A-Za-z][A-Za-z'\-]*)\z", 1)
    return F.lower(latin).isin(WEAK_LAST_WORDS) | (word.endswith("-") & (latin != ""))


def loose_end(t: Column, n: Column, cjk: Column, source: bool = True) -> Column:
    """is_dangling of a text whose white space is collapsed, of length n."""
    wide = (n <= 6) | last(t).rlike(CONNECTOR_END)
    words = (n <= 3) & ~last(t).rlike(STRONG_END)
    if source:
        words = words | asks_for_more(t)
    marked = first(t).rlike(MARK)  # most texts begin with a letter
    out = F.when((t == "") | (marked & first(t).rlike(SYMBOL_START)), False).when(marked & (first(t).rlike(LEADING_PUNCTUATION) | t.rlike(PUNCTUATION_ONLY)), True)
    return F.coalesce(out.when(cjk, wide).otherwise(words), F.lit(False))


def is_dangling(text: Column, source: bool = True) -> Column:
    """Whether a cue can't stand alone. source: also for words that need a next one."""
    t = normalize_cue(text) if source else collapsed(text)
    return loose_end(t, text_length(t), is_cjk(t), source)


def _shown(t: Column) -> Column:
    """visible_length, counted without replacing where all blanks are plain ones."""
    return F.when(odd_blanks(t), visible_length(t)).otherwise(F.length(t) - blanks_of(t))


def is_suspicious(source: Column, translation: Column, in_context: bool = True) -> Column:
    """Whether a translated line looks wrong: empty, bare punctuation, a new ellipsis, far too short, or (in context) a fragment."""
    texts = F.struct(F.coalesce(source, F.lit("")).alias("s"), cut_ends(F.coalesce(translation, F.lit(""))).alias("t"))
    sized = lambda x: F.struct(x["s"].alias("s"), x["t"].alias("t"), _shown(x["s"]).alias("ns"), _shown(x["t"]).alias("nt"))

    def bad(x: Column) -> Column:
        s, t, ns, nt = x["s"], x["t"], x["ns"], x["nt"]
        dots = lambda c: c.contains("...") | c.contains("…") | c.contains("⋯")
        out = (nt == 0) | (first(t).rlike(MARK) & t.rlike(PUNCTUATION_ONLY)) | (dots(t) & ~dots(s))
        if in_context:
            for least, most in ((12, 2), (18, 4), (28, 6), (40, 8)):
                out = out | ((nt <= most) & (ns >= least))
            out = out | ((nt <= 10) & is_cjk(t) & ((t.rlike(FRAGMENT_START) & (nt <= 8)) | (last(t).rlike(FRAGMENT_END) & (ns >= 14))))
        return out

    return let(let(texts, sized), bad)


def select_output(source: Column, translation: Column, mode: str = "translation-only") -> Column:
    """struct(primary, secondary) of what is shown: both, the original alone, or the translation alone (the original where there is none)."""
    s, t = trimmed(F.coalesce(source, F.lit(""))), trimmed(F.coalesce(translation, F.lit("")))
    none = F.lit("")
    if mode == "original-only":
        primary, secondary = s, none
    elif mode == "translation-only":
        primary, secondary = F.when(t != "", t).otherwise(s), none
    elif mode == "bilingual":
        primary, secondary = s, t
    else:
        raise ValueError(f"no such mode: {mode}")
    return F.struct(primary.alias("primary"), secondary.alias("secondary"))


def source_hash(text: Column) -> Column:
    """The 32-bit multiply-by-31 hash of the text's UTF-16 units, without its sign, in base 36."""
    units = F.flatten(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(F.ascii(c) < 65536, F.array(F.ascii(c).cast("long"))).otherwise(F.array((F.floor((F.ascii(c) - 65536) / 1024) + 55296).cast("long"), ((F.ascii(c) - 65536) % 1024 + 56320).cast("long")))))
    h = F.aggregate(units, F.lit(0).cast("long"), lambda a, u: F.pmod(a * 31 + u, F.lit(1 << 32)))
    return F.lower(F.conv(F.when(h >= (1 << 31), (1 << 32) - h).otherwise(h).cast("string"), 10, 36))


def content_hash(text: Column) -> Column:
    """For long payloads: SHA-256 in one native call."""
    return F.sha2(text, 256)


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), code)


def estimated_cost(text: Column, model: Column, prices: dict[str, tuple[float, float]] | None = None) -> Column:
    """Cost of translating a text: a token for every four characters, in and out; unknown models cost as the first one. prices: per million tokens."""
    prices = prices or PRICES
    first = next(iter(prices.values()))
    tokens = F.ceil(F.length(text) / 4) / 1e6
    a, b = F.lit(first[0]), F.lit(first[1])
    for name, (x, y) in prices.items():
        a, b = F.when(model == name, x).otherwise(a), F.when(model == name, y).otherwise(b)
    return tokens * a + tokens * b


def request_key(video: Column, lang: Column, tlang: Column, kind: Column, fmt: Column) -> Column:
    filled = [F.coalesce(video, F.lit("")), F.coalesce(lang, F.lit("")), F.coalesce(tlang, F.lit("zh-CN")), F.coalesce(kind, F.lit("asr")), F.coalesce(fmt, F.lit("json3"))]
    return F.concat_ws("|", *filled)


def split_key(key: Column) -> Column:
    parts = F.split(key, r"\|")
    names = (("video_id", ""), ("lang", ""), ("tlang", "zh-CN"), ("track", "asr"), ("fmt", "json3"))
    return F.struct(*[F.coalesce(F.when(F.get(parts, i) != "", F.get(parts, i)), F.lit(d)).alias(n) for i, (n, d) in enumerate(names)])


def request_error(video: Column, lang: Column) -> Column:
    """What is wrong with a request, or null."""
    return F.when(video.isNull() | ~video.rlike(r"\A[a-zA-Z0-9_\-]{11}\z"), "video").when(lang.isNull() | ~F.length(lang).between(1, 10), "lang")
