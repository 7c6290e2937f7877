"""Labelled pages for training: layouts drawn from a grammar of what pages are made of.

The words are invented; only structure, lengths, links and a few telltale words carry over
to real pages. The text of main blocks begins with MARK, which is how a block's label is
read back after parsing.
"""

from __future__ import annotations

import random

MARK = ""

_SYLLABLES = "an be co de er fi ga he in jo ka lo me no or pa qu re si ta un ve wo yn ä é ñ ß ción tion lich ment".split()
_MAIN = ["article", "content", "post", "entry", "story", "post-content", "entryContent", "article-body", "main", "mainText", "text", "hentry"]
_WRAP = ["page", "wrapper", "container", "site", "row", "layout", "inner", "column"]
_NAV = ["menu", "nav", "navbar", "navigation", "breadcrumbs", "topnav", "main-menu", "pagination", "tabs", "toc-nav"]
_TOP = ["header", "site-header", "masthead", "banner", "top-bar", "branding", "logo"]
_FOOT = ["footer", "site-footer", "bottom", "copyright", "legal", "colophon"]
_SIDE = ["sidebar", "widget", "aside", "related", "recommended", "most-read", "rail", "teaser", "tag-list", "popular"]
_AD = ["ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner-ad", "adsense", "sponsored"]
_NOTE = ["notice", "cookie-banner", "consent", "alert", "gdpr", "popup", "modal", "disclaimer", "warning", "paywall", "message"]
_FORM = ["search", "newsletter", "login", "signup", "subscribe", "contact-form"]
_SHARE = ["share", "social", "tools", "meta", "byline", "print"]
_TALK = ["comments", "comment-list", "discussion", "replies", "respond", "disqus", "reader-comments", "reviews", "feedback"]


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> list[str]:
        r = self.r
        return ["".join(r.choices(_SYLLABLES, k=r.choice((1, 1, 2, 2, 3)))) for _ in range(r.randint(low, high))]

    def prose(self, low: int, high: int) -> str:
        r, out = self.r, []
        marks = r.choice((("", "", "", "", "", ",", ".", "&nbsp;"), ("",), (" |",), ("", "###", "%%%", "&amp;&amp;"), ("", "", " &amp;", ", ")))
        for w in self.words(low, high):
            out.append(w + r.choice(marks))
        return " ".join(out).capitalize() + r.choice(".....!? ")

    def name(self, names: list[str]) -> str:
        r = self.r
        form = r.choice(['class="{}"', 'id="{}"', "class='x {}'", 'class="{} clearfix"', "class={}", 'id=site-{}'])
        return form.format(r.choice(names))

    def box(self, tags: str, names: list[str], inner: str, bare: float = 0.15) -> str:
        tag = self.r.choice(tags.split())
        plain = tag in ("nav", "header", "footer", "aside", "main", "article") and self.r.random() < 0.6 or self.r.random() < bare
        return f"<{tag}{'' if plain else ' ' + self.name(names)}>{inner}</{tag}>"

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{" ".join(self.words(low, high))}</a>'

    def links(self) -> str:
        r, n = self.r, self.r.randint(2, 9)
        kind = r.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{self.link()}{r.choice(('</li>', ''))}" for _ in range(n)) + "</ul>"
        return (" | " if kind < 0.8 else "").join(self.link() if kind < 0.8 else f"<p>{self.link()}</p>" for _ in range(n))

    # main text

    def paragraph(self) -> str:
        r = self.r
        text = MARK + (self.prose(1, 6) if r.random() < 0.15 else self.prose(6, 25) if r.random() < 0.3 else self.prose(20, 140))
        if r.random() < 0.08:
            text = MARK + r.choice(("All rights reserved.", "Copyright 2020.", "Please comment, share and reply.", f"The privacy of cookies. {text[1:]}"))
        if r.random() < 0.15:
            text += f" {self.link()} {self.prose(1, 12)}"
        if r.random() < 0.15:
            return f"<p><b>{text}<br>"
        return f"<p>{text}" + ("</p>" if r.random() < 0.85 else "")

    def main_block(self) -> str:
        r, k = self.r, self.r.random()
        short = lambda low, high: MARK + self.prose(low, high)
        if k < 0.7:
            return self.paragraph()
        if k < 0.78:
            return f"<h{(h := r.choice((2, 3)))}>{MARK}{' '.join(self.words(2, 8))}</h{h}>"
        if k < 0.85:
            t = r.choice(("ul", "ol"))
            return f"<{t}>" + "".join(f"<li>{short(2, 25)}</li>" for _ in range(r.randint(2, 5))) + f"</{t}>"
        if k < 0.9:
            return f"<blockquote>{r.choice((self.paragraph(), short(5, 30)))}</blockquote>"
        if k < 0.93:
            return f"<pre>{short(5, 40)}</pre>"
        if k < 0.96:
            return f"<figure><img src=x.png><figcaption>{short(3, 15)}</figcaption></figure>"
        return "<table>" + "".join(f"<tr><td>{short(1, 4)}<td>{short(1, 12)}" for _ in range(r.randint(1, 4))) + "</table>"

    def article(self) -> str:
        r = self.r
        head = f"<h1>{MARK}{' '.join(self.words(2, 12))}</h1>"
        if r.random() < 0.25:
            head = f"<header>{head}{self.box('div p', _SHARE, self.prose(2, 6)) if r.random() < 0.4 else ''}</header>"
        parts = [head if r.random() < 0.9 else ""]
        for _ in range(r.randint(1, 14)):
            parts.append(self.main_block())
            if r.random() < 0.06:
                parts.append(r.choice((self.advert, self.notice, self.share, self.form, self.related))())
        body = "".join(parts)
        if r.random() < 0.25:
            body = self.box("div section", _MAIN, body)
        return self.box("article article article main div section div", _MAIN, body, bare=0.1)

    # the rest

    def nav(self) -> str:
        return self.box("nav nav div ul", _NAV, self.links())

    def top(self) -> str:
        inner = self.r.choice((self.link(), f"<p>{self.prose(2, 8)}</p>", f"<h1>{self.link()}</h1>", f"<h2>{' '.join(self.words(1, 4))}</h2>"))
        return self.box("header header div", _TOP, inner + (self.nav() if self.r.random() < 0.4 else ""), bare=0.05)

    def foot(self) -> str:
        r = self.r
        inner = r.choice(("&copy; {} &middot; {}", "<p>&copy; {} {}</p>", "{} {}", "<p>{}</p><p>{}</p>")).format(" ".join(self.words(1, 3)), self.prose(2, 20))
        return self.box("footer footer div", _FOOT, inner + (self.links() if r.random() < 0.4 else ""), bare=0.03)

    def related(self) -> str:
        inner = f"<h3>{' '.join(self.words(1, 4))}</h3>" + self.r.choice((self.links(), f"<p>{self.link()} {self.prose(5, 40)}</p>" * 2, f"<p>{self.prose(5, 60)}</p>"))
        return self.box("aside aside div section", _SIDE, inner, bare=0.0)

    def advert(self) -> str:
        return self.box("div div section aside p", _AD, self.r.choice((self.prose(2, 30), self.link(2, 8), f"<p>{self.prose(3, 40)}</p>")), bare=0.0)

    def notice(self) -> str:
        r = self.r
        text = r.choice(("We use cookies. ", "", "Sign in to read on. ", "")) + self.prose(3, 40)
        return self.box("div div section p dialog", _NOTE, r.choice(("{}", "<p>{}</p>", "<p>{}</p><button>Ok</button>")).format(text), bare=0.0)

    def form(self) -> str:
        r = self.r
        inner = r.choice(("<label>{}</label><input><button>{}</button>", "<p>{}</p><input type=text><button>{}</button>", "{} <select><option>{}<option>x</select>", "<fieldset><legend>{}</legend>{}</fieldset>"))
        return f"<form {self.name(_FORM)}>" + inner.format(self.prose(1, 15), " ".join(self.words(1, 3))) + "</form>"

    def share(self) -> str:
        return self.box("div ul p", _SHARE, self.r.choice((self.link() + self.link(), "By " + " ".join(self.words(2, 3)))), bare=0.0)

    def talk(self) -> str:
        r, n = self.r, self.r.randint(1, 6)
        one = lambda: r.choice(("<li><b>{}</b><p>{}</p></li>", "<div class=comment><p>{}</p><p>{}</p></div>", "<article class='comment'><h4>{}</h4><p>{}</p></article>", "<p>{}: {}</p>")).format(" ".join(self.words(1, 2)), self.prose(2, 80))
        return self.box("section div ol div", _TALK, r.choice(("", "<h3>Comments</h3>", f"<h2>{' '.join(self.words(1, 3))}</h2>")) + "".join(one() for _ in range(n)) + (self.form() if r.random() < 0.4 else ""), bare=0.0)

    def page(self) -> str:
        r = self.r
        some = lambda p, make: make() if r.random() < p else ""
        before = [some(0.25, self.notice), some(0.6, self.top), some(0.7, self.nav), some(0.35, self.advert), some(0.15, self.form), some(0.2, self.related)]
        if r.random() < 0.3:
            r.shuffle(before)
        after = [some(0.25, self.share), some(0.35, self.related), some(0.2, self.advert), some(0.35, self.talk), some(0.15, self.form), some(0.1, self.notice)]
        main = self.article()
        if r.random() < 0.3:
            main = self.box("main div section", _MAIN + _WRAP, main + self.talk() if r.random() < 0.5 else main, bare=0.4)
        body = "".join(before) + main + "".join(after) + some(0.85, self.foot)
        if r.random() < 0.4:
            body = self.box("div", _WRAP, body, bare=0.3)
        return f"<!DOCTYPE html><html><head><title>{' '.join(self.words(2, 8))}</title><style>p{{margin:0}}</style></head><body>{body}" + ("</body></html>" if r.random() < 0.9 else "")


def pages(n: int, seed: int) -> list[str]:
    return [Writer(seed * 1_000_003 + k).page() for k in range(n)]
