"""Main text of ordinary pages: names of classes, titles and closing lines beside the container, sections, forms, labels."""

import pytest

from subweave.llm.html_text import main_text, suspicion

ONE = "The first paragraph of the article, with commas, runs on for a while so that it scores as text should."
TWO = "A second paragraph follows, again with some words, and some more of them so that it is long enough."
P, TEXT = f"<p>{ONE}</p><p>{TWO}</p>", f"{ONE}\n{TWO}"
MENU = "<div class='main-menu'><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></div>"
TEASERS = "<div class='related-posts'><h3>Read on</h3><p><a href=/c>Another story of ours</a></p><p><a href=/d>And one more story</a></p></div>"
COMMENTS = "<div id='comments'><div class='comment-body'><p>I liked this very much, thank you for the words, and for the commas, which I counted twice.</p></div>" + f"<div class='comment'>{P}{P}</div></div>"


@pytest.mark.parametrize("name", ["post-12 post tag-politics hentry", "share-price-report", "search-engine-history", "social-sciences", "side-content", "nav-closed", "modal-open-page", "category-news tag-sports tag-widgets", "has-sidebar", "sidebar-collapsed", "menu-open", "no-comments", "related-to-us", "skip-level", "widget-review", "tags-explained", "hidden-figures"])
@pytest.mark.parametrize("shape", ["{0}", "<h1>Title</h1>{0}", "<div class=inner>{0}</div>"])
def test_what_names_are_about(name, shape):
    page = f"<html><body>{MENU}<div class='{name}'>{shape.format(P)}</div>{TEASERS}{COMMENTS}<div class='site-footer'>© 2024 Example</div></body></html>"
    assert main_text(page) == ("Title\n" if "h1" in shape else "") + TEXT


@pytest.mark.parametrize("name", ["ad", "ads", "top-ad", "ad-slot", "cookie-message", "newsletter-form", "comments", "comment-list", "comments-area", "comment-body", "post-comments", "sidebar", "left-sidebar", "sidebar-left", "sidebar-2", "related-posts", "share-buttons", "social-links", "site-footer", "footer-bottom", "breadcrumbs", "nav-main-links", "tags", "tag-list", "pagination", "login-box", "search-form", "site-header", "promo-box", "masthead"])
def test_what_names_are(name):
    assert suspicion(name) >= 1
    beside = f"<div class='{name}'><p>Words that stand beside the text, which go on for some time, but not as long.</p></div>" if suspicion(name) > 1 else f"<div class='{name}'><a href=1>One</a> <a href=2>Two</a></div>"
    assert main_text(f"<body><div class=story>{P}</div>{beside}</body>") == TEXT
    assert main_text(f"<body><div class=story>{P}{beside}</div></body>") == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div id=content><h1>Title</h1><div class=body>{P}</div><p>The end.</p></div>", f"Title\n{TEXT}\nThe end."),
        (f"<section>{P}</section><section><p>Short one.</p></section>", f"{TEXT}\nShort one."),
        (f"<div><p>{ONE}</p></div><div><p>{TWO}</p></div>", TEXT),
        (f"<h1>Title</h1><div>{P}</div>", f"Title\n{TEXT}"),
        (f"<h1>Title</h1><div>{P}</div><p>© 2024 Example, all rights reserved</p>", f"Title\n{TEXT}"),
        (f"<div class=wrap><div class=row><div class=col-8>{P}</div><div class=col-4><p>About</p><a href=1>One</a> <a href=2>Two links here</a></div></div></div>", TEXT),
        (f"<main><h1>Title</h1><div>{P}</div><div><p>Last words.</p></div></main>{COMMENTS}", f"Title\n{TEXT}\nLast words."),
        (f"<main><h1>Title</h1>{P}<h2>More</h2><section>{P}</section></main>", f"Title\n{TEXT}\nMore\n{TEXT}"),
        (f"<article><header><h1>Title</h1></header>{P}<ul><li>one</li><li>two</li></ul><p>Short.</p></article>", f"Title\n{TEXT}\none\ntwo\nShort."),
        (f"<article><div class=entry-content>{P}</div><p class=closing>Bye.</p></article>{TEASERS}", f"{TEXT}\nBye."),
        (f"<div class=post><h2>One</h2><p>{ONE}</p><h2>Two</h2><p>{TWO}</p></div>{MENU}", f"One\n{ONE}\nTwo\n{TWO}"),
        (f"<div class=post><div class=part><p>{ONE}</p></div><div class=part><p>Short between.</p></div><div class=part><p>{TWO}</p></div></div>", f"{ONE}\nShort between.\n{TWO}"),
        (f"<div><p>{ONE}</p></div><div><p>Short between.</p></div><div><p>{TWO}</p></div>", f"{ONE}\nShort between.\n{TWO}"),
        (f"<article><p>Press the <label>big red</label> button, then wait.</p>{P}</article>", f"Press the big red button, then wait.\n{TEXT}"),
        (f"<article>{P}<div><label>Your name</label><input></div></article>", TEXT),
        (f"<form id=aspnet>{P}<p>Short.</p><input type=hidden></form>", f"{TEXT}\nShort."),
        ("<form><p>A short article inside of a form, of some twelve words or more.</p><input></form>", "A short article inside of a form, of some twelve words or more."),
        ("<form><p>Please log in</p><input></form>", ""),
        (f"<div>{P}</div><form><p>Subscribe to get the news, every day, in your own mailbox, from us, for free and forever.</p><input></form>", TEXT),
        (f"<div class=comments>{P}</div>", ""),
        (f"<div class=sidebar>{P}</div>", TEXT),
        (f"<div class=widget>{P}</div>{MENU}", TEXT),
        (f"<div class=ad>Buy this now.</div><div>{P}</div>", TEXT),
        (f"<div class='page sidebar-left'><article>{P}</article><div class=sidebar><p>{ONE}</p></div></div>", TEXT),
        (f"<table><tr><td>{MENU}</td><td>{P}</td></tr></table>", TEXT),
        (f"<div>{P}<blockquote>Said so.</blockquote><pre>x = 1</pre></div>", f"{TEXT}\nSaid so.\nx = 1"),
        (f"<div>{P}<p><a href=1>The whole report</a></p></div>", f"{TEXT}\nThe whole report"),
        ("<div>Short text only.</div>", "Short text only."),
        ("<div><a href=1>A</a></div>", "A"),
        ("", ""),
        (None, ""),
    ],
)
def test_what_stands_beside_the_container(page, text):
    assert main_text(page and f"<html><head><title>T</title></head><body>{page}</body></html>") == text


@pytest.mark.parametrize("wrappers", [[], ["<div class=site>", "<div class='page nav-closed'>"], ["<div id=wrapper>", "<div class='modal-open-page has-sidebar'>", "<div class=col>"]])
@pytest.mark.parametrize("parts", range(1, 7))
def test_articles_put_together_from_parts(wrappers, parts):
    """A plain second version: what was put into the article, in order, is what comes out, whatever stands around it."""
    body, want = "<h1>Title of it all</h1>", ["Title of it all"]
    for k in range(parts):
        one, two = ONE.replace("first", f"first{k}"), TWO.replace("second", f"second{k}")
        body += [f"<p>{one}</p><p>{two}</p>", f"<div class=text><p>{one}</p><p>{two}</p></div>", f"<section><h2>Part {k}</h2><p>{one}</p><p>{two}</p></section>"][k % 3]
        want += ([f"Part {k}"] if k % 3 == 2 else []) + [one, two]
    inside = f"<div class='content'>{body}<p>So long.</p></div>"
    page = MENU + "".join(wrappers) + inside + TEASERS + COMMENTS + "</div>" * len(wrappers) + "<footer>Foot</footer>"
    assert main_text(f"<body>{page}</body>") == "\n".join([*want, "So long."])
