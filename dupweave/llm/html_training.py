"""Labelled pages for the extractor: layouts drawn at random, with the texts of their main blocks."""

from __future__ import annotations

import html
import random

SYLLABLES = "an ba cor de el fi gra ho in ju ka lo mi no or pe qui ra so ti un ve wi xa yo zu th st er ing ou ea".split()


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng, self.marked, self.used = rng, set(), set()

    def words(self, least: int, most: int) -> str:
        r = self.rng
        while True:
            out = [("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))) for _ in range(r.randint(least, most))]
            if r.random() < 0.15:
                out = [w + r.choice(["***", "###", "!!", "&&", "%", ""]) for w in out]
            text = " ".join(out)
            if text not in self.used:
                self.used.add(text)
                return text

    def sentences(self, n: int) -> str:
        r, out = self.rng, []
        for _ in range(n):
            s = self.words(1, 22).capitalize().split(" ")
            for i in range(len(s) - 1):
                if r.random() < 0.07:
                    s[i] += ","
            out.append(" ".join(s) + r.choice([".", ".", ".", "?", "!"]))
        if r.random() < 0.08:
            return " | ".join(" ".join(out).split(" "))
        return " ".join(out)

    def main(self, text: str) -> str:
        self.marked.add(" ".join(text.split()))
        return html.escape(text)

    def dull(self, least: int = 1, most: int = 4) -> str:
        return html.escape(self.words(least, most))


#: Parts of names that pages give to what isn't main text, by kind, and to the article.
NAMES = {
    "menu": "menu nav navbar navigation topbar breadcrumb breadcrumbs tabs pagination pager links toc",
    "advert": "ad ads advert advertisement sponsored sponsor promo banner ad-slot partner offer",
    "side": "sidebar side widget related related-posts share social tags toolbar recommended trending more-stories rail",
    "notice": "cookie cookie-notice notice gdpr-consent consent alert popup newsletter subscribe modal signup login paywall privacy",
    "comments": "comments comment-list discussion responses reader-comments replies feedback talkback reactions thread",
    "comment": "comment reply response remark post-comment user-comment answer",
    "foot": "footer foot copyright legal imprint colophon site-info bottom",
    "article": "article article-body post entry entry-content story story-body content post-content text body main page single blog prose news",
    "para": "para paragraph text-block p copy line body-text",
}


def _named(w: _Writer, kind: str) -> str:
    """A class or id of that kind, or of no meaning, or none."""
    r = w.rng
    chance = r.random()
    if chance < 0.12:
        return ""
    name = w.words(1, 1) if chance < 0.2 else r.choice(NAMES[kind].split())
    if r.random() < 0.15:
        name += " " + r.choice([w.words(1, 1), "box", "wrap", "inner", "clearfix", "col"])
    return f' {r.choice(["class", "class", "id"])}="{html.escape(name)}"'


def _links(w: _Writer, tag: str = "ul") -> str:
    r = w.rng
    if r.random() < 0.15:
        return r.choice([" | ", " ", " &middot; "]).join(f'<a href="/{r.randint(1, 99)}">{w.dull(1, 3)}</a>' for _ in range(r.randint(2, 8)))
    items = "".join(f'<li><a href="/{r.randint(1, 99)}">{w.dull(1, 3)}</a></li>' for _ in range(r.randint(2, 8)))
    return f"<{tag}>{items}</{tag}>"


def _comment(w: _Writer) -> str:
    r = w.rng
    longish = lambda: html.escape(w.sentences(r.randint(1, 3)))
    text = r.choice([f"<p>{longish()}</p>", f"<b>{w.dull(1, 2)}</b><p>{longish()}</p><p>{longish()}</p>", f"<cite>{w.dull(1, 2)}</cite><p>{longish()}</p>", longish(), f"<div>{w.dull(1, 2)}</div><div>{longish()}</div>"])
    return r.choice([f'<article class="comment">{text}</article>', f"<div{_named(w, 'comment')}>{text}</div>", f"<li>{text}</li>", f"<div{_named(w, 'comment')}>{text}"])


def _comments(w: _Writer) -> str:
    r = w.rng
    each = "".join(_comment(w) for _ in range(r.randint(1, 4)))
    if r.random() < 0.2:
        return f"<div{_named(w, 'comment') or ' class=comment'}>{html.escape(w.sentences(r.randint(1, 2)))}</div>"
    tag, name = r.choice(["section", "div", "ol", "div"]), _named(w, "comments") or ' class="comments"'
    return f"<{tag}{name}>{r.choice(['', f'<h3>{w.dull()}</h3>', f'<h2>{w.dull()}</h2>'])}{each}</{tag}>"


def _aside(w: _Writer, after: bool) -> str:
    """Anything that isn't main text, of any kind; readers' comments come after the article only."""
    r = w.rng
    longish = lambda: html.escape(w.sentences(r.randint(1, 3)))
    kind = r.randrange(12 if after else 10)
    if kind == 0:
        return f"<nav{r.choice(['', _named(w, 'menu')])}>{_links(w)}</nav>"
    if kind == 1:
        return f"<div{_named(w, 'advert') or ' class=ad'}>{r.choice([longish(), f'<p>{longish()}</p>'])}</div>"
    if kind == 2:
        return f"<aside{r.choice(['', _named(w, 'side')])}><h3>{w.dull()}</h3>{_links(w)}<p>{longish()}</p></aside>"
    if kind == 3:
        return f"<div{_named(w, 'side') or ' class=sidebar'}><h4>{w.dull()}</h4>{_links(w)}{r.choice(['', f'<p>{longish()}</p>'])}</div>"
    if kind == 4:
        return f"<div{_named(w, 'notice') or ' class=notice'}>{r.choice([f'<p>{longish()}</p>', longish()])}<button>{w.dull(1, 2)}</button></div>"
    if kind == 5:
        return f'<form action="/s"><label>{w.dull()}</label><input name=q><button>{w.dull(1, 2)}</button><p>{longish()}</p></form>'
    if kind == 6:
        return f"<div{_named(w, 'menu')}>{_links(w)}</div>"
    if kind == 7:
        return f"<footer{r.choice(['', _named(w, 'foot')])}>&copy; {w.dull()} &middot; {longish()}</footer>" if after else f"<header>{w.dull()}<p>{w.dull(2, 7)}</p>{_links(w)}</header>"
    if kind == 8:
        return f"<header><h1>{w.dull()}</h1><p>{w.dull(2, 7)}</p></header>" if not after else f"<div{_named(w, 'foot') or ' class=footer'}><p>{longish()}</p>{_links(w)}</div>"
    if kind == 9:
        return f"<script>var a = '{w.dull()}';</script><!-- {w.dull()} --><style>p{{}}</style>"
    return _comments(w)


def _body(w: _Writer, plain: str) -> str:
    """The blocks of one article; `plain` is the element of its paragraphs."""
    r, out = w.rng, []
    if r.random() < 0.8:
        level = r.choice("112")
        out.append(f"<h{level}>{w.main(w.words(2, 12))}</h{level}>")
    open_, close = {"p": ("<p>", r.choice(["</p>", "</p>", ""])), "div": (f"<div{r.choice(['', _named(w, 'para')])}>", "</div>"), "br": ("", "")}[plain]
    for _ in range(r.randint(1, 9)):
        kind = r.random()
        if kind < 0.55:
            text = w.sentences(r.choice([1, 1, 2, 4, 8]))
            if plain == "br":
                out.append(f"<p>{w.main(text)}</p>" if out and not out[-1].endswith(">") else w.main(text))
            else:
                out.append(f"{open_}{w.main(text)}{close}")
        elif kind < 0.62:
            out.append(f"<p><b>{w.main(w.words(1, 9))}<br>")
        elif kind < 0.69:
            level = r.choice("2234")
            out.append(f"<h{level}>{w.main(w.words(1, 8))}</h{level}>")
        elif kind < 0.75:
            tag = r.choice(["ul", "ul", "ol"])
            out.append(f"<{tag}>" + "".join(f"<li>{w.main(w.sentences(r.randint(1, 2)))}{r.choice(['</li>', ''])}" for _ in range(r.randint(2, 5))) + f"</{tag}>")
        elif kind < 0.79:
            out.append(f"<blockquote><p>{w.main(w.sentences(2))}</p></blockquote>")
        elif kind < 0.82:
            out.append(f"<table><tr><td>{w.main(w.words(1, 4))}</td><td>{w.main(w.words(1, 4))}</td></tr></table>")
        elif kind < 0.85:
            out.append(f"<pre>{w.main(w.words(3, 14))}</pre>")
        elif kind < 0.88:
            out.append("<dl>" + "".join(f"<dt>{w.main(w.words(1, 4))}{r.choice(['</dt>', ''])}<dd>{w.main(w.sentences(1))}{r.choice(['</dd>', ''])}" for _ in range(r.randint(1, 3))) + "</dl>")
        elif kind < 0.91:
            out.append(f'<figure><img src="/{r.randint(1, 9)}.png"><figcaption>{w.main(w.sentences(1))}</figcaption></figure>')
        elif kind < 0.94 and len(out) > 1:
            out.append(f"<div{_named(w, r.choice(['advert', 'side'])) or ' class=ad'}>{html.escape(w.sentences(1))}</div>")
        elif kind < 0.96:
            out.append(f"<section><h2>{w.main(w.words(1, 6))}</h2><p>{w.main(w.sentences(2))}</p></section>")
        else:
            head, tail = w.sentences(1), w.words(2, 6)
            w.main(f"{head} {tail}.")
            out.append(f'<p>{html.escape(head)} <a href="/x">{html.escape(tail)}</a>.</p>')
    return "".join(out)


def labelled_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page and the texts of its main blocks."""
    w = _Writer(rng)
    before = "".join(_aside(w, False) for _ in range(rng.randint(0, 4)))
    after = "".join(_aside(w, True) for _ in range(rng.randint(0, 4)))
    if rng.random() < 0.35:
        after = _comments(w) + after
    tag = rng.choice(["article"] * 6 + ["main", "main+article", "div", "div", "div", "div", "section", "td", ""])
    name = _named(w, "article") if tag in ("div", "section") or rng.random() < 0.2 else ""
    open_, close = {"main+article": ("<main><article>", "</article></main>"), "td": ("<table><tr><td>", "</td></tr></table>"), "": ("", "")}.get(tag, (f"<{tag}{name}>", f"</{tag}>"))
    plain = rng.choice(["p", "p", "p", "p", "div", "br"]) if tag != "" else "p"
    head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{w.dull()}</title></head><body>'
    return head + before + open_ + _body(w, plain) + close + after + rng.choice(["</body></html>", ""]), w.marked


def labelled_pages(n: int, seed: int) -> list[tuple[str, set[str]]]:
    rng = random.Random(seed)
    return [labelled_page(rng) for _ in range(n)]
