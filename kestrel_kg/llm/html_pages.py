"""Labelled pages made from a rule: the training set of the page model.

Each page is a list of (markup, text, is content) parts around invented words, in the element names, class names and orders that
public sites use. The words carry no signal; only structure, names, lengths, links and punctuation do.
"""

from __future__ import annotations

import random

SYLLABLES = "ka lo mi ne ru ta vo sel dan por tir gan mes fol ber lin".split()

MENUS = ["nav", "div class='menu'", "ul id='main-menu'", "div class='navbar navigation'", "div role='navigation'", "div class='breadcrumbs'", "ol class='breadcrumb'", "div class='pagination'", "div class='site-nav'"]
HEADERS = ["header", "div class='header'", "div id='masthead'", "div class='site-header topbar'", "div class='branding'"]
FOOTERS = ["footer", "div class='footer'", "div id='colophon'", "div class='site-footer copyright'", "div class='bottom'"]
SIDEBARS = ["aside", "div class='sidebar'", "div class='widget'", "section class='related'", "div id='secondary'", "div class='recommended'", "div class='toc'", "div class='tags'", "div class='share social'", "div class='author-box'"]
ADVERTS = ["div class='ad'", "div class='ads'", "ins class='adsbygoogle'", "div class='advert'", "div class='advertisement'", "div class='banner'", "div class='sponsored'", "aside class='promo'", "div class='ad-slot'", "section class='promotion'"]
NOTICES = ["div class='cookie'", "div class='cookie-banner'", "div id='consent'", "div class='notice'", "div class='alert'", "div class='gdpr'", "div class='popup modal'", "div role='alert'", "div class='disclaimer'", "div class='subscribe newsletter'"]
FORMS = ["form", "form class='search'", "form id='login'", "div class='signup'", "fieldset"]
COMMENTS = ["div id='comments'", "section class='comments'", "ol class='commentlist'", "div class='comment-list'", "div class='discussion replies'", "div id='disqus_thread'", "section id='responses'", "div class='reader-comments'"]
ARTICLES = ["article", "main", "div class='content'", "div class='post'", "div class='entry-content'", "div id='content'", "div class='article-body'", "section class='story'", "div itemprop='articleBody'", "div role='main'", "article class='post hentry'", "div class='text'"]
WRAPPERS = ["div", "div class='page'", "div id='wrapper'", "div class='container'", "div class='row'", "div class='col'"]


def words(r: random.Random, n: int) -> str:
    """``n`` invented words; one text in six has no sentences, one in twelve is in capitals."""
    marks = ["", "", "", "", "", "", ",", "."] if r.random() < 5 / 6 else [""]
    out = []
    for i in range(n):
        w = "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))
        out.append(w + r.choice(marks) if i + 1 < n else w)
    text = " ".join(out)
    return text.upper() if r.random() < 1 / 12 else text.capitalize()


def page(r: random.Random) -> list[tuple[str, str, bool]]:
    """Parts (markup before, text, is content) in page order; a last part has the closing markup."""
    parts: list[tuple[str, str, bool]] = []
    pending = "<html><head></head><body>"

    def say(before: str, text: str, content: bool) -> None:
        nonlocal pending
        parts.append((pending + before, text, content))
        pending = ""

    def close(*tags: str) -> None:
        nonlocal pending
        for tag in reversed(tags):
            pending += f"</{tag.split()[0]}>"

    def box(kind: str, least: int, most: int, links: float, prose: bool) -> None:
        nonlocal pending
        pending += f"<{kind}>"
        inner = r.choice(["li", "p", "div", "span", ""]) if not kind.startswith(("ul", "ol")) else "li"
        if prose:
            inner = r.choice(["p", "div", "li"])
        if r.random() < 0.4:
            tag = r.choice(["h2", "h3", "h3", "h4", "strong"])
            say(f"<{tag}>", words(r, r.randint(1, 5)), False)
            close(tag)
        wrap = r.choice(["", "", "ul"]) if inner == "li" and not kind.startswith(("ul", "ol")) else ""
        pending += f"<{wrap}>" if wrap else ""
        for _ in range(r.randint(1, 5)):
            text = words(r, r.randint(least, most)) + ("." if prose or r.random() < 0.3 else "")
            linked = r.random() < links
            say((f"<{inner}>" if inner else "") + ("<a href='#'>" if linked else ""), text, False)
            pending += ("</a>" if linked else "") + (f"</{inner}>" if inner else " <br>")
        close(*([wrap] if wrap else []))
        close(kind)

    def furniture(chance: float) -> None:
        for kinds, least, most, links, prose in ((NOTICES, 4, 30, 0.2, False), (ADVERTS, 3, 25, 0.4, False), (FORMS, 1, 5, 0.1, False), (SIDEBARS, 2, 12, 0.7, False), (MENUS, 1, 3, 0.95, False)):
            if r.random() < chance:
                wordy = kinds is not MENUS and r.random() < 0.3
                box(r.choice(kinds), least, most * (3 if wordy else 1), 0.1 if wordy else links, prose or wordy)

    around = [r.choice(WRAPPERS) for _ in range(r.randint(0, 3))]
    if r.random() < 0.6:
        box(r.choice(HEADERS), 1, 5, 0.4, False)
    if r.random() < 0.8:
        box(r.choice(MENUS), 1, 3, 0.95, False)
    pending += "".join(f"<{w}>" for w in around)
    furniture(0.35)
    article = r.choice(ARTICLES)
    pending += f"<{article}>"
    if r.random() < 0.85:
        tag = r.choice(["h1", "h1", "h2"])
        say(f"<{tag}>", words(r, r.randint(2, 12)), True)
        close(tag)
    bare = r.random() < 0.15
    for k in range(r.choice([1, 1, 1, 2, 2, 3, 5, 8, 12])):
        kind = r.choice(["p", "p", "p", "p", "h2", "h3", "li", "blockquote", "pre", "td", "div", "figcaption", "dd"])
        if bare:
            say("<br><br>", words(r, r.randint(5, 80)) + ".", True)
        elif kind in ("h2", "h3"):
            say(f"<{kind}>", words(r, r.randint(1, 7)), True)
            close(kind)
        elif kind in ("li", "td", "dd"):
            outer = {"li": ["ul"], "td": ["table", "tr"], "dd": ["dl"]}[kind]
            pending += "".join(f"<{x}>" for x in outer)
            for _ in range(r.randint(1, 4)):
                linked = r.random() < 0.15
                say(f"<{kind}>" + ("<a href='#'>" if linked else ""), words(r, r.randint(1, 20)), True)
                pending += ("</a>" if linked else "") + f"</{kind}>"
            close(*outer)
        else:
            say(f"<{kind}>", words(r, r.choice([1, 2, 6, 20, 60, 150, 400])) + r.choice([".", ".", ".", "", "!", "?", " |"]), True)
            if r.random() < 0.9:
                close(kind)
        if r.random() < 0.06 and k:
            box(r.choice(ADVERTS + SIDEBARS[:4]), 2, 15, 0.5, False)
    close(article)
    if r.random() < 0.4:
        box(r.choice(COMMENTS), 4, 60, 0.05, True)
    furniture(0.3)
    close(*around)
    if r.random() < 0.9:
        box(r.choice(FOOTERS), 2, 15, 0.3, r.random() < 0.3)
    parts.append((pending + "</body></html>", "", False))
    return parts


def labelled_pages(n: int, seed: int = 7) -> list[list[tuple[str, str, bool]]]:
    r = random.Random(seed)
    return [page(r) for _ in range(n)]
