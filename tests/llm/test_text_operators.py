"""Token files, byte-level BPE, pages, quality, languages, contamination and near-duplicates against plain versions."""

import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from subweave.llm import byte_bpe, decontaminate, html_text, language_gru, near_dedup, quality_crf, shared, token_files
from subweave.llm.words import shingle_hashes

P = pytest.importorskip("public_tokenizers")
SPECIAL = [None, "", " ", "\n", "  two  blanks ", "a\tb c", "x\n\ny \n z", "l'été it's I'LL 3½ 東京 😀", "<|endoftext|>ok", "ΑΣ J̌ İ ﬁ", "word " * 3000, "a" * 5000, "same", "same"]


def table(spark, texts):
    rows = [(k, t, "clash", "clash") for k, t in enumerate(texts)] + [(None, "no id", "c", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens string")


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert (token_files.from_planes(token_files.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize(("kind", "block"), [("byte", 64), ("bit", 1000)])
def test_token_files(spark, kind, block):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    docs = table(spark, SPECIAL)
    out = token_files.read_token_files(token_files.write_token_files(docs, path, shards=3, kind=kind, block=block)).withColumn("crc", F.crc32("ids")).collect()
    at = 0
    for r, text in zip(sorted(out, key=lambda r: r.start), ["no id", *SPECIAL], strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        at += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), path)).count() == 0


def test_pieces_as_the_library_encodes_them():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, encode = Tokenizer.from_file(path), token_files.PieceEncoder(path, most=3000)
    r = random.Random(3)
    letters = [*"abcABC '’.,!?019\t\n\r  <|>/", "it's", "I'LL", "<|endoftext|>", "<|startoftext|>", "é", "É", "ß", "ﬁ", "İ", "Σ", "ς", "\u0301", "東", "😀", "\xa0", "\x85", "\u2009", "\u3000", "½", "\x1c", "\x00", "\x7f"]
    texts = [f"a{chr(c)}b" for c in range(256)] + [chr(c) for c in range(256)] + ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(6000)]
    for lo in range(0, len(texts), 700):
        part = texts[lo : lo + 700]
        ids, first = encode(pa.array(part, pa.string()))
        for k, x in enumerate(part):
            assert ids[first[k] : first[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
    other = json.load(open(path, encoding="utf-8"))
    assert other["normalizer"]["normalizers"] == token_files._NORMALIZERS


def test_patterns_that_match_across_blanks(spark):
    assert byte_bpe.breaks_at_blanks(P.PATTERN) and not byte_bpe.breaks_at_blanks(r"\w+ \w+|\S+|\s+")
    path, across = P.path("byte_bpe_multi_50k.tiktoken"), r"\w+ \w+|\S+|\s+"
    out = byte_bpe.encode_and_decode(table(spark, SPECIAL), path, across, buckets=3).collect()
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=across, mergeable_ranks=byte_bpe.token_bytes(path), special_tokens={})
    assert all(list(r.ids) == e.encode_ordinary(bytes(r.decoded).decode()) for r in out) and len(out) == len(SPECIAL) + 1


def test_byte_bpe(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.token_bytes(path), special_tokens={})
    out = byte_bpe.encode_and_decode(table(spark, SPECIAL), path, P.PATTERN, buckets=3).collect()
    want = sorted((text or "" for text in [*SPECIAL, "no id"]))
    assert sorted(bytes(r.decoded).decode() for r in out) == want
    assert all(list(r.ids) == e.encode_ordinary(bytes(r.decoded).decode()) for r in out)
    assert byte_bpe.encode_and_decode(table(spark, []).limit(0), path, P.PATTERN).count() == 0


def test_short_numbers():
    x = np.array([0, 191, 192, 12_479, 12_480, 995_519, 995_520, 2**31])
    assert (byte_bpe._unshort(byte_bpe._short(x), len(x)) == x).all()


def test_pages(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><div id="cookie-notice"><p>We use cookies, really, all the time.</p></div>
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav><div class="main-content"><div class="post"><h2>Head&amp;line</h2><p>First  paragraph, with <b>bold</b> text,
    and an <a href=z>inline link</a> that goes on for a while, so it is long.<p>Second paragraph, not closed, also long enough to count as running text.<br>After a break</div>
    <div class="share"><a href=1>Share</a></div></div><div class="sidebar"><p>Related, things, that, have, many, commas, in, them</p></div><div class="comments"><p>A reader says, well, something long here, with commas.</p></div>
    <form><p>Sign up, now, please</p></form><footer><p>&copy; all rights</p></footer></body></html>"""
    want = "Head&line\nFirst paragraph, with bold text, and an inline link that goes on for a while, so it is long.\nSecond paragraph, not closed, also long enough to count as running text.\nAfter a break"
    rows = [(1, "u", page, "c"), (2, None, None, "c"), (3, "u", "", "c"), (4, "u", "<p", "c"), (None, "u", page, "c"), (5, "u", "<div>" * 3000 + "deep, text" + "</div>" * 3000, "c"), (6, "u", "plain text &lt;only&gt;", "c")]
    out = {r.page_id: r for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert out[1].text == want and out[1].n_chars == len(want) and out[None].text == want
    assert [out[k].text for k in (2, 3, 4)] == ["", "", ""] and out[5].text == "deep, text" and out[6].text == "plain text <only>"


ONE = "This is the first paragraph, long enough to count, with commas, and words that go on for a while."
TWO = "And this is the second one, also long, with commas, which ends the article here for good, yes."
BODY = f"<p>{ONE}</p><p>{TWO}</p>"
JUNK = "<p>Home, about, contact, imprint, reader says, and so on, and so forth, for quite a while indeed.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><header>Site name, slogan, and more</header>{BODY}</body>",
        f"<div class='site-header'>{JUNK}</div><div>{BODY}</div>",
        f"<div class=content>{BODY}<div class='main-menu'>{JUNK}</div></div>",
        f"<article>{BODY}<div class='article-comments'>{JUNK}</div></article>",
        f"<article>{BODY}<section id=reader-comments>{JUNK}</section></article>",
        f"<div>{BODY}</div><div class='content-sidebar'>{JUNK}</div>",
        f"<div>{BODY}</div><div class='socialShare'>{JUNK}</div>",
        f"<div>{BODY}<div class='comments-area'>{JUNK}</div></div>",
        f"<div class='has-sidebar no-comments'>{BODY}</div>",
        f"<div class='content-with-sidebar'>{BODY}</div>",
        f"<div><a href=foo'bar></a>{BODY}</div>",
        f"<div><a title='a > b' href=\"x>y\"></a>{BODY}</div>",
        f"<div data-class='menu'>{BODY}</div>",
        f"<nav><ul><li>a<li>b</ul></nav><main>{BODY}</main><aside>{JUNK}</aside>",
        f"<div>{BODY}</div><form>{JUNK}</form><footer>{JUNK}</footer>",
        f"<div role=navigation>{JUNK}</div><div>{BODY}</div>",
        f"<div style='display: none'>{JUNK}</div><div>{BODY}</div>",
        f"<div hidden>{JUNK}</div><div>{BODY}</div>",
        f"<script>'<p>{ONE}</p>'</script><style>p {{}}</style><div>{BODY}</div><!-- {JUNK} -->",
        f"<div><p>{ONE}<p>{TWO}</div>",
        f"<div><p>{ONE.replace('first', '<b>first</b>')}</p></i></section><p>{TWO}</p></div>",
        f"<div><p>{ONE.replace(' with', '&#32;with')}</p><p>{TWO.replace(' one', chr(10) + ' one')}</p></div>",
        f"<table><tr><td>{BODY}</td></tr></table>",
        f"<div class='cookie-notice'>{JUNK}</div><div class='newsletter signup'>{JUNK}</div><div>{BODY}</div>",
    ],
)
def test_hand_made_pages(page):
    assert html_text.main_text(page) == f"{ONE}\n{TWO}"


def test_pages_in_one_form_headers_of_articles_and_deep_pages():
    assert html_text.main_text(f"<form id=all><div>{BODY}{BODY}</div></form>").count(ONE) == 2
    assert html_text.main_text(f"<article><header><h1>Title</h1></header>{BODY}</article>") == f"Title\n{ONE}\n{TWO}"
    assert html_text.main_text("<form><p>Sign up</p></form>") == ""
    began = time.process_time()
    assert html_text.main_text("<div>" * 20_000 + "deep, text" + "</div>" * 20_000) == "deep, text"
    assert html_text.main_text("<p><span>" * 20_000 + "deep, text") == "deep, text"
    assert time.process_time() - began < 10


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _sets(texts, k):
    out = []
    for t in texts:
        w = _words(t)
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def _components(sets):
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [root(i) for i in range(len(sets))]


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(1)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [r.choice(vocabulary) for _ in range(120)]
    texts = [None, "", "a b", "A B", "a b c", "a b c", "\t"]
    for _ in range(260):  # a large group of copies with some to many words changed, of which many link through others only
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    for _ in range(60):
        w = [r.choice(vocabulary) for _ in range(r.randint(1, 60))]
        texts += [" ".join(w), " ".join(w[:-1])]
    out = {x.doc_id: x for x in near_dedup.near_duplicates(table(spark, texts), shingle=4, few=4).collect()}
    sets = _sets(texts, 4)
    want = _components(sets)
    assert [out[k].component_id for k in range(len(texts))] == want
    assert [out[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]
    assert all(out[k].kept == (want[k] == k) for k in range(len(texts))) and out[None].kept and out[None].component_id is None
    kept = near_dedup.without_near_duplicates(table(spark, texts), shingle=4)
    assert kept.columns == ["doc_id", "text", "id", "n_tokens"]
    assert {x.doc_id for x in kept.collect()} == {k for k in range(len(texts)) if want[k] == k} | {None}


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_near_duplicates_at_other_similarities(spark, percent):
    r = random.Random(percent)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.randrange(12)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    sets = _sets(texts, 5)
    up = {k: k for k in range(len(texts))}
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((up[a], up[b]))
                up = {k: lo if v == hi else v for k, v in up.items()}
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(table(spark, texts), percent=percent, few=4).collect()}
    assert [got[k] for k in range(len(texts))] == [up[k] for k in range(len(texts))]
    with pytest.raises(ValueError, match="percent"):
        near_dedup.forest_shape(20)


def test_odd_column_names_and_very_long_words(spark):
    long = ["x" * 4107, "x" * 4107, "y" + "x" * 4095 + "z" + "x" * 10, "z" + "x" * 4095 + "y" + "x" * 10]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(long)], "`a b.c` long, `te``xt` string")
    got = {r[0]: r.component_id for r in near_dedup.near_duplicates(d, "a b.c", "te`xt").collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}
    assert near_dedup.without_near_duplicates(d, "a b.c", "te`xt").columns == ["a b.c", "te`xt"]


def test_spanning_forest():
    r = np.random.default_rng(1)
    linked = r.random((60, 60)) < 0.02
    linked |= linked.T
    found = near_dedup.spanning_forest(linked)
    reach = lambda edges: np.linalg.matrix_power(np.eye(60) + sum((np.eye(60)[[a]].T @ np.eye(60)[[b]] + np.eye(60)[[b]].T @ np.eye(60)[[a]]) for a, b in edges), 60) > 0
    every = [(a, b) for a, b in zip(*np.nonzero(linked), strict=True) if a < b]
    assert (reach(found) == reach(every)).all() and len(found) == 60 - len(np.unique(reach(every), axis=0))


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(table(spark, []).limit(0)).count() == 0
    assert near_dedup.near_duplicates(table(spark, [None, "", "x"])).count() == 4


def test_components(spark):
    chain = [(k + 1, k) for k in range(30)] + [(100, 200), (200, 100), (7, 7)]
    got = {r.id: r.component for r in shared.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 200: 100}


def test_contamination(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [" ".join(word() for _ in range(n)) for n in (3, 15, 40, 60)]
    noise = lambda n: " ".join(word() for _ in range(n))
    changed = items[3].split()
    changed[20] = "other"  # leaves 51 of 61 shingles
    texts = [noise(200), f"{noise(50)} {items[1].upper()}!! {noise(50)}", items[3], f"{noise(9)} {' '.join(changed)} {noise(9)}", f"{noise(5)} ({items[0]}) {noise(5)}", " ".join(items[2].split()[:20]), None, ""]
    docs = table(spark, texts)
    bench = spark.createDataFrame([*enumerate(items), (9, None), (None, items[3]), (8, "")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated_passages(docs, bench).collect()}
    assert got == {(1, 1), (2, 3), (3, 3), (4, 0)}
    sliced = {(x.doc_id, x.item_id) for x in decontaminate.contaminated_passages(docs, bench, slice_chars=50).collect()}
    assert sliced == got
    left = decontaminate.without_contaminated(docs, bench)
    assert {x.doc_id for x in left.collect()} == {0, 5, 6, 7, None} and left.columns == docs.columns
    assert decontaminate.contaminated_passages(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated_passages(docs.limit(0), bench).count() == 0


def test_scores_do_not_depend_on_slices(spark):
    # 40 items share 20 words; documents hold some of these, or end in words that only other slices' items share
    common = [f"c{i}" for i in range(24)]
    own = lambda k: [f"i{k}w{j}" for j in range(14)]
    bench = spark.createDataFrame([(k, " ".join(common + own(k))) for k in range(40)] + [(100 + k, " ".join(f"z{j}" for j in range(6)) + f" s{k}") for k in range(20)], "item_id long, text string")
    docs = table(spark, [" ".join(["x"] * 3 + common[cut:] + own(k) + [f"z{j}" for j in range(6)]) for cut in range(0, 20, 2) for k in range(0, 40, 5)])
    one, many = (sorted(tuple(r) for r in decontaminate.contaminated_passages(docs, bench, percent=50, slice_chars=n).collect()) for n in (4_000_000, 2000))
    assert one and one == many


def test_hamming_blocks_miss_nothing():
    r = np.random.default_rng(4)
    prints = r.integers(0, 1 << 16, (40, decontaminate.BLOCKS)).astype("<u2")
    radius = decontaminate.radius_of(80)
    index = decontaminate.MultiIndex(prints, radius)
    for k in range(200):
        bits = np.unpackbits(prints[k % 40].view(np.uint8))
        bits[r.choice(decontaminate.BITS, r.integers(0, radius + 1), replace=False)] ^= 1
        row, item = index.candidates(np.packbits(bits).view("<u2")[None, :])
        assert k % 40 in item.tolist()


def _index_and_brute_force(items, docs, percent):
    words, first = decontaminate._words([t for _, t in items])
    held = Counter()
    grams = []
    for k in range(len(items)):
        own = words[first[k] : first[k + 1]]
        grams.append(shingle_hashes(own, np.array([0, len(own)]), min(5, len(own)))[0])
        held.update(set(grams[-1].tolist()))
    shared_grams = np.array(sorted(g for g, n in held.items() if n > 1), np.uint64)
    index = decontaminate.BenchmarkIndex(items, (shared_grams, np.array([held[int(g)] for g in shared_grams], np.int32)), 5, decontaminate.radius_of(percent))
    w, f = decontaminate._words(docs)
    want = {}
    for d in range(len(docs)):
        for k, (item_id, _) in enumerate(items):
            n = first[k + 1] - first[k]
            size = min(5, n)
            if f[d + 1] - f[d] >= size:
                g, _ = shingle_hashes(w[f[d] : f[d + 1]], np.array([0, f[d + 1] - f[d]]), size)
                weight, own = index.weights(g), index.weights(grams[k])
                width, best = n - size + 1, 0.0
                for start in range(max(1, len(g) - width + 1)):
                    a, b = Counter(g[start : start + width].tolist()), Counter(grams[k].tolist())
                    value = dict(zip(g.tolist() + grams[k].tolist(), weight.tolist() + own.tolist(), strict=True))
                    best = max(best, sum(value[x] * c for x, c in (a & b).items()) / sum(value[x] * c for x, c in (a | b).items()))
                if 100 * best >= percent - 1e-9:
                    want[d, item_id] = best
    return index, w, f, want


def test_contamination_against_all_windows():
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    stem = some(12)
    items = [(k, " ".join(stem + some(r.choice([8, 9, 20, 30])))) for k in range(25)] + [(100, "only three words"), (101, "a " * 20), (102, " ".join(some(300)))]
    docs = ["", "a " * 300, items[-1][1] + " x", items[3][1], " ".join(stem)]
    for _ in range(120):
        w = some(r.randrange(80))
        for _ in range(r.randrange(3)):
            own = [x if r.random() > r.choice([0, 0.02, 0.04]) else "zz" for x in r.choice(items)[1].split()]
            at = r.randrange(len(w) + 1)
            w[at:at] = own[: int(len(own) * r.choice([1, 1, 0.95, 0.85]))]
        docs.append(" ".join(w))
    index, w, f, want = _index_and_brute_force(items, docs, 80)
    got = {(d, i): s for d, i, s, *_ in index.hits(w, f, 80)}
    assert len(want) > 40 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    # the multi-index decides: without its tables nothing is found
    for _, _, lengths in index.sizes.values():
        for x in lengths:
            x.index.keys = np.full_like(x.index.keys, 0xFFFFFFFF)
    assert not list(index.hits(w, f, 80))


def test_contamination_of_a_very_long_text():
    r = random.Random(6)
    some = lambda n: " ".join(r.choice("bcdfgh") * 3 + str(r.randrange(300)) for _ in range(n))
    stem = some(12)
    items = [(k, f"{stem} {some(8)}") for k in range(20)]
    index = decontaminate.BenchmarkIndex(items, {}, 5, decontaminate.radius_of(80))
    w, f = decontaminate._words([" ".join(f"{stem} {some(8)}" for _ in range(10_000)) + " " + items[7][1]])
    assert [(i, s) for _, i, s, *_ in index.hits(w, f, 80)] == [(7, 1.0)]


@pytest.mark.parametrize("stem", [10, 40, 60, 74, 100])
@pytest.mark.parametrize("n", [2, 200, 2000])
def test_items_with_a_common_stem(stem, n):
    r = random.Random(stem * n)
    common = [f"s{k}" for k in range(stem)]
    for own in (1, 2, 5):
        items = [(k, " ".join(common + [f"i{k}w{j}" for j in range(own)])) for k in range(n)]
        docs = [" ".join(common + [f"other{j}" for j in range(own)]), "before " + " ".join(["x", *common[1:], *[f"i1w{j}" for j in range(own)]]) + " after", items[-1][1] + " " + items[0][1], " ".join(w if r.random() > 0.03 else "y" for w in items[n // 2][1].split())]
        if n == 2000:  # too many for all windows: one window, all items
            index, w, f, _ = _index_and_brute_force(items, [], 80)
            w, f = decontaminate._words(docs[:1])
            g, _ = shingle_hashes(w, np.array([0, len(w)]), 5)
            weight, x = index.weights(g), next(iter(index.sizes.values()))[2][0]
            scores = [decontaminate.weighted_similarity(g, weight, b, t) for b, t in zip(x.bags, x.totals, strict=True)]
            want = {(0, k) for k, s in enumerate(scores) if s >= 0.8}
        else:
            index, w, f, want = _index_and_brute_force(items, docs, 80)
        got = {(d, i) for d, i, *_ in index.hits(w, f, 80)}
        assert got == set(want), (own, len(got), len(want))


def test_windows_with_repeated_shingles():
    r = np.random.default_rng(8)
    for n, width, letters in ((1, 30, 3), (40, 12, 2), (300, 25, 4), (25, 1, 2)):
        grams = r.integers(0, letters, n + width - 1).astype(np.uint64)
        weights = (decontaminate.UNIT / (1 + grams.astype(float))).astype(np.int64)
        got = decontaminate.window_simhashes(grams, weights, n, width)
        assert (got == [decontaminate.simhash(grams[k : k + width], weights[k : k + width]) for k in range(n)]).all()
    # a heavy repeat that one bag lacks doesn't part bags that are similar
    repeated, single = np.full(18, 7, np.uint64), np.arange(100, 182).astype(np.uint64)
    one = np.ones(200, np.int64) * decontaminate.UNIT
    both = np.concatenate([repeated, single])
    apart = np.unpackbits((decontaminate.simhash(both, one[:100]) ^ decontaminate.simhash(single, one[:82])).view(np.uint8)).sum()
    assert apart <= decontaminate.radius_of(80)


def test_many_slices_are_one_pass(spark):
    r = random.Random(12)
    some = lambda n: " ".join(f"v{r.randrange(5000)}" for _ in range(n))
    items = [(k, some(30)) for k in range(60)] + [(99, some(100_000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, [some(20) + " " + items[k][1] + " " + some(9) for k in range(0, 60, 7)] + [some(200), items[-1][1]])
    out = decontaminate.contaminated_passages(docs, bench, slice_chars=20_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "BroadcastExchange" not in plan
    assert {(x.doc_id, x.item_id) for x in out.collect()} == {(k // 7, k) for k in range(0, 60, 7)} | {(10, 99)}
    many = decontaminate.contaminated_passages(docs, bench, slice_chars=12_000).collect()
    assert sorted(map(tuple, many)) == sorted(map(tuple, out.collect()))
    assert decontaminate.without_contaminated(docs, bench, slice_chars=20_000)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_quality(spark):
    good = ["This is a normal line of text, with words and an end.\nAnother line follows here, as one would expect it to."] * 1
    docs, labels = [], []
    for k in range(120):
        bad = k % 2
        text = " ".join(f"WORD{k}!!" for _ in range(30)) if bad else good[0] + f" Number {k} has its own ending."
        docs.append((k, text, 0))
        labels.append((k, 1 - bad, 0))
    d = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    y = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_crf.fit_quality(d, y)
    out = quality_crf.quality_scores(d, model).join(y.where("quality is not null"), "doc_id").collect()
    assert all(r.predicted == r.quality and 0 <= r.score <= 1 for r in out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "\n \n"), (None, good[0])], "doc_id long, text string")
    assert [r.score for r in quality_crf.quality_scores(odd, model).orderBy("doc_id").collect()][1:] == [0.0, 0.0, 0.0]
    assert quality_crf.accepted_documents(odd, model).count() == 1
    empty = quality_crf.fit_quality(d.limit(0), y)
    assert quality_crf.quality_scores(d.limit(0), empty).count() == 0


def test_field_marginals_are_exact():
    r = np.random.default_rng(7)
    f = quality_crf.LineField()
    f.own, f.pair = r.normal(size=f.own.shape), r.normal(size=(2, 2))
    x = r.normal(size=(1, 5, quality_crf.FEATURES)).astype(np.float32)
    p = f.marginals(x, np.ones((1, 5), bool))[0]
    score, total, want = x[0] @ f.own.astype(np.float32), 0.0, np.zeros((5, 2))
    for k in range(32):
        y = [k >> i & 1 for i in range(5)]
        w = np.exp(sum(score[i, y[i]] for i in range(5)) + sum(f.pair[y[i], y[i + 1]] for i in range(4)))
        total += w
        for i in range(5):
            want[i, y[i]] += w
    assert np.allclose(p, want / total, atol=1e-5)


def test_languages(spark):
    r = random.Random(5)
    parts = {"aa": ["tha", "ing", "wh", "sh"], "bb": ["eau", "oux", "é", "ç"]}
    rows = [(k, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(40)), lang) for k in range(120) for lang in [r.choice(["aa", "bb"])]]
    d = spark.createDataFrame([*rows, (500, None, "aa"), (501, "123 ...", "bb"), (502, "", None), (503, "eauoux " * 40, None)], "doc_id long, text string, lang string")
    model = language_gru.fit_languages(d, rounds=80)
    out = {x.doc_id: x for x in language_gru.predict_languages(d, model).collect()}
    held = [row for row in rows if zlib.crc32(str(row[0]).encode()) % 3 == 1]
    assert sum(out[k].lang_pred == lang for k, _, lang in held) >= 0.95 * len(held)
    assert [out[k].lang_pred for k in (500, 501, 502, 503)] == ["und", "und", "und", "bb"]
    assert all(0 <= x.score <= 1 for x in out.values())
    none = language_gru.fit_languages(d.limit(0))
    assert {x.lang_pred for x in language_gru.predict_languages(d, none).collect()} == {"und"}


def _plain_network(g, raw):
    h, w = g.hidden, g.w
    soft = lambda v: v / (1 + np.abs(v))

    def one_way(d, sequence):
        state, out = np.zeros(h), []
        for byte in sequence:
            a, x = state @ w[d + "g"], w[d + "x"][byte]
            z, reset = 0.5 + 0.5 * soft(x[:h] + a[:h]), 0.5 + 0.5 * soft(x[h : 2 * h] + a[h : 2 * h])
            state = z * state + (1 - z) * soft(x[2 * h :] + reset * a[2 * h :])
            out.append(state)
        return np.array(out)

    logits = one_way("f", raw) @ w["fo"] + one_way("b", raw[::-1])[::-1] @ w["bo"] + w["bias"]
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def test_network_reads_whole_texts():
    g = language_gru.ByteGRU(["a", "b", "c"], 4)
    r = np.random.default_rng(3)
    texts = [bytes(r.integers(32, 127, n, dtype=np.uint8)) for n in (1, 5, 511, 512, 513, 540, 1100, 3000)] + ["東京に行きます".encode() * 60]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    labels = np.zeros((len(data), 3), np.float32)
    sums = g.pooled(data, np.concatenate([[0], ends[:-1]]), ends, labels)
    for k, t in enumerate(texts):  # windows read OVERLAP bytes around them, a plain loop all of them
        want = _plain_network(g, t)
        assert np.abs(labels[ends[k] - len(t) : ends[k]] - want).max() < 1e-4 and np.abs(sums[k] - want.sum(0)).max() < 1e-2
    langs, scores = language_gru.predict_texts(g, pa.array(["ab cd ef", "cd ab ef", "東京", None, "12", ""]))
    assert scores[0] != scores[1] and langs[3:] == ["und"] * 3


def test_trained_network_hardly_depends_on_windows():
    r = random.Random(8)
    make = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n)).encode()
    kinds = [["tha", "ing", "wh", "sh"], ["eau", "oux", "é", "ç"]]
    g = language_gru.ByteGRU(["a", "b"]).fit([make(kinds[k % 2], 40) for k in range(100)], np.arange(100) % 2, rounds=60)
    t = make(kinds[0] + kinds[1], 700)
    labels = np.zeros((len(t), 2), np.float32)
    g.pooled(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]), labels)
    gap = labels - _plain_network(g, t)
    assert np.abs(gap).mean() < 1e-3 and np.abs(gap.mean(0)).max() < 1e-3 and np.quantile(np.abs(gap), 0.99) < 0.01


def test_backpropagation_through_time():
    g = language_gru.ByteGRU(["a", "b", "c"], 4)
    g.w = {k: v.astype("float64") for k, v in g.w.items()}
    data = np.frombuffer(b"".join(t.encode().ljust(6, b"\0") for t in ("hello", "weltß", "x")), np.uint8).reshape(3, 6)
    sizes = np.array([5, 6, 1])
    y = np.array([0, 1, 2])
    _, grads = g.step(data, sizes, y)
    for n, w in g.w.items():
        at = np.unravel_index(np.abs(grads[n]).argmax(), w.shape)
        w[at] += 1e-4
        up, _ = g.step(data, sizes, y)
        w[at] -= 2e-4
        down, _ = g.step(data, sizes, y)
        w[at] += 1e-4
        assert abs(grads[n][at] - (up - down) / 2e-4) < 1e-5



def test_tables_of_near_duplicates_are_dropped(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join([*words[: 40 + k % 3], *[f"x{k}y{j}" for j in range(k % 11)]]) for k in range(120)]
    out = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert out.count() == 120
    left = {name.split("-")[0] for name in set(os.listdir(folder)) - before}
    assert left <= {"fingerprints", "classes", "components", "links"}, left  # what the result is read from, and the last links of components
