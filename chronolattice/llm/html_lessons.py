"""Labelled pages made by rule, from which the classifier of ``html_extract`` is fitted.

A page has one article among navigation, notices, adverts, related stories, comments, forms and a footer. Sections stand in
elements that tell what they are, in ones with a telling class, or in ones that tell nothing; paragraphs run from one
word to many sentences, so that a block alone is often in doubt and its neighbours are not.
"""

from __future__ import annotations

import random

#: Elements and class words that pages are made with, by section. Generic ones tell nothing.
GENERIC = ("x1", "row", "col-4", "wrap", "block b2", "inner", "unit", "panel-7")
STYLES = {
    "article": (("article", "main"), ("content", "post", "story body", "entry-text", "article-body")),
    "nav": (("nav",), ("menu", "navbar", "main-navigation", "breadcrumbs")),
    "head": (("header",), ("masthead", "site-header", "banner")),
    "notice": (("aside",), ("cookie-notice", "alert", "consent popup", "gdpr")),
    "ad": (("aside",), ("ad", "advert", "sponsored", "promo banner")),
    "related": (("aside", "nav"), ("sidebar", "related", "recommended widget", "rail")),
    "comments": (("section", "div"), ("comments", "replies", "discussion", "comment-list")),
    "form": (("form",), ("newsletter subscribe", "login", "search")),
    "footer": (("footer",), ("footer", "legal", "site-footer copyright")),
}


def _sentence(rng: random.Random, words: int, end: str = ".") -> str:
    out = ["".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(words)]
    for i in range(3, words - 1):
        if rng.random() < 0.08:
            out[i] += ","
    return " ".join(out).capitalize() + end


def _prose(rng: random.Random, least: int, most: int) -> str:
    left, out = int(least * (most / least) ** rng.random()), []
    while left > 0:
        n = min(left, rng.randint(3, 18))
        out.append(_sentence(rng, n, rng.choice("...!?")))
        left -= n
    return " ".join(out)


def _inside(rng: random.Random, kind: str, body: str) -> str:
    tags, classes = STYLES[kind]
    how = rng.random()
    if how < 0.45 and kind != "comments":
        name, attribute = rng.choice(tags), ""
    elif how < 0.85:
        name, attribute = rng.choice(("div", "div", "section")), f' class="{rng.choice(classes)}"'
    else:
        name, attribute = "div", f' class="{rng.choice(GENERIC)}"'
    return f"<{name}{attribute}>{body}</{name}>"


def lesson(seed: int) -> tuple[str, set[str]]:
    """A page, and the texts of its blocks that are content."""
    rng, content = random.Random(f"page {seed}"), set()
    link = lambda t: f'<a href="/{len(t)}">{t}</a>'

    def own(text: str) -> str:
        content.add(text)
        return text

    def links(n: int, least: int, most: int) -> str:
        return "<ul>" + "".join(f"<li>{link(_sentence(rng, rng.randint(least, most), ''))}</li>" for _ in range(n)) + "</ul>"

    parts = [f"<h1>{own(_sentence(rng, rng.randint(2, 12), rng.choice(['', '.'])))}</h1>"]
    for _ in range(rng.randint(2, 14)):
        how = rng.random()
        if how < 0.62:
            parts.append(f"<p>{own(_prose(rng, 1, 160))}</p>")
        elif how < 0.7:
            parts.append(f"<h2>{own(_sentence(rng, rng.randint(1, 6), ''))}</h2>")
        elif how < 0.8:
            parts.append("<ul>" + "".join(f"<li>{own(_prose(rng, 2, 25))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif how < 0.86:
            parts.append(f"<blockquote>{own(_prose(rng, 4, 40))}</blockquote>")
        elif how < 0.92:
            first, linked = _prose(rng, 1, 20), _sentence(rng, rng.randint(1, 8), ".")
            own(f"{first} {linked}")
            parts.append(f"<p>{first} {link(linked)}</p>")
        else:
            parts.append(f"<div>{own(_prose(rng, 3, 90))}</div>")
    before = [_inside(rng, "nav", links(rng.randint(3, 8), 1, 3))]
    if rng.random() < 0.6:
        before.append(_inside(rng, "head", f"<h2>{_sentence(rng, 2, '')}</h2><p>{_sentence(rng, rng.randint(2, 8), '')}</p>"))
    if rng.random() < 0.5:
        before.append(_inside(rng, "notice", f"<p>{_prose(rng, 6, 45)}</p>" + link("Accept") * rng.randint(0, 1)))
    after = [_inside(rng, "footer", f"<p>&copy; {rng.randint(1999, 2030)} {_sentence(rng, rng.randint(2, 14))}</p>" + links(rng.randint(0, 4), 1, 2))]
    beside = []
    for kind, chance in (("ad", 0.7), ("related", 0.5), ("comments", 0.5), ("form", 0.4)):
        if rng.random() > chance:
            continue
        if kind == "ad":
            body = f"<p>{_prose(rng, 3, 30)}</p>" if rng.random() < 0.5 else _prose(rng, 3, 30)
        elif kind == "related":
            body = f"<h3>{_sentence(rng, 2, '')}</h3>" + links(rng.randint(2, 5), 3, 9) + f"<p>{_prose(rng, 4, 20)}</p>" * rng.randint(0, 1)
        elif kind == "comments":
            body = f"<h3>{_sentence(rng, 2, '')}</h3>" + "".join(f"<p>{_sentence(rng, 2, '')}</p><p>{_prose(rng, 3, 50)}</p>" for _ in range(rng.randint(1, 4)))
        else:
            body = f"<p>{_prose(rng, 3, 15)}</p><label>{_sentence(rng, 2, '')}</label><input name=q>"
        where = rng.random()
        if where < 0.25 and kind != "comments":
            parts.insert(rng.randint(1, len(parts)), _inside(rng, kind, body))  # inside the article
        elif where < 0.6:
            beside.append(_inside(rng, kind, body))
        else:
            (before if kind == "ad" else after).insert(0, _inside(rng, kind, body))
    rng.shuffle(before)
    middle = _inside(rng, "article", "".join(parts)) + "".join(beside)
    if rng.random() < 0.5:
        middle = rng.choice(("<main>{}</main>", '<div class="content">{}</div>', '<div class="row">{}</div>')).format(middle)
    return f"<!doctype html><html><head><title>{_sentence(rng, 4, '')}</title></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>", content
