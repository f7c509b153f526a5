"""Generated pages with known main text, on which the extractor's trees are trained."""

from __future__ import annotations

import random

#: Marks the elements whose own text is main text.
MAIN = ' data-main="1"'

_SYLLABLES = ["an", "ber", "co", "del", "en", "fo", "ga", "hin", "is", "ja", "ko", "lu", "mer", "no", "or", "pe", "qui", "ro", "st", "tion", "un", "ver", "wa", "xi", "yo", "ze"]


class Generator:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        out = []
        for i in range(max(1, n)):
            w = "".join(self.r.choices(_SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3))))
            out.append(w + ("." if i == n - 1 or self.r.random() < 0.08 else "," if self.r.random() < 0.06 else ""))
        return " ".join(out).capitalize()

    def label(self) -> str:
        return self.words(self.r.randint(1, 3)).strip(".")

    def attrs(self, *names: str) -> str:
        """A class or an id made of one of the names, or neither."""
        name = self.r.choice(names) if names else ""
        style = self.r.random()
        if not name or style < 0.15:
            return ""
        extra = self.r.choice(("", "", " box", " col-8", " wide", " js-x", "-inner", "-area"))
        return f' class="{name}{extra}"' if style < 0.75 else f' id="{name}"'

    def links(self, n: int) -> str:
        one = lambda: f'<a href="/{self.r.randint(1, 99)}">{self.label()}</a>'
        if self.r.random() < 0.6:
            tag = self.r.choice(("ul", "ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + f"</{tag}>"
        return self.r.choice((" | ", " ", " &middot; ")).join(one() for _ in range(n))

    def nav(self) -> str:
        tag = self.r.choice(("nav", "nav", "div", "section"))
        a = self.attrs() if tag == "nav" and self.r.random() < 0.5 else f' class="{self.r.choice(("nav", "menu", "navbar", "main-nav", "top-menu", "breadcrumb", "breadcrumbs", "pagination", "toc-nav"))}"'
        return f"<{tag}{a}>{self.links(self.r.randint(2, 10))}</{tag}>"

    def header(self) -> str:
        tag = self.r.choice(("header", "header", "div"))
        a = "" if tag == "header" else f' class="{self.r.choice(("header", "site-header", "masthead", "topbar", "banner"))}"'
        inner = self.r.choice((f"<a href='/'>{self.label()}</a>", f"<p>{self.label()}</p>", f"<div class='logo'>{self.label()}</div><p>{self.words(6)}</p>", f"<h1>{self.label()}</h1>", f"<h2>{self.label()}</h2>"))
        return f"<{tag}{a}>{inner}{self.nav() if self.r.random() < 0.4 else ''}</{tag}>"

    def notice(self) -> str:
        tag = self.r.choice(("div", "div", "section", "p", "aside"))
        name = self.r.choice(("cookie", "cookie-banner", "notice", "alert", "consent", "gdpr", "newsletter", "subscribe", "signup", "popup", "modal", "paywall", "disclaimer", "site-notice"))
        body = self.words(self.r.randint(4, 40))
        return f'<{tag} {self.r.choice(("class", "class", "id"))}="{name}">{body if tag == "p" or self.r.random() < 0.5 else f"<p>{body}</p>"}</{tag}>'

    def advert(self) -> str:
        tag = self.r.choice(("div", "div", "aside", "section", "p"))
        name = self.r.choice(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "promotion"))
        body = self.words(self.r.randint(2, 30))
        return f'<{tag} class="{name}">{body if tag == "p" or self.r.random() < 0.6 else f"<p>{body}</p>"}</{tag}>'

    def share(self) -> str:
        return f'<div class="{self.r.choice(("share", "social", "share-buttons", "tags", "related", "related-posts", "recommended", "author-box", "meta"))}">{self.links(self.r.randint(2, 6))}</div>'

    def form(self) -> str:
        a = self.attrs("search", "login", "contact", "newsletter-form", "subscribe")
        return f'<form{a}><p>{self.label()}</p><label>{self.label()}</label><input name="q"><div>{self.words(self.r.randint(1, 12))}</div></form>'

    def sidebar(self) -> str:
        tag = self.r.choice(("aside", "aside", "div", "section"))
        a = self.attrs("sidebar", "widget") if tag == "aside" else f' class="{self.r.choice(("sidebar", "side", "widget", "related", "right-rail", "widgets"))}"'
        parts = [f"<h3>{self.label()}</h3>", self.links(self.r.randint(2, 7))]
        if self.r.random() < 0.5:
            parts.append(f"<p>{self.words(self.r.randint(5, 40))}</p>")
        return f"<{tag}{a}>{''.join(parts)}</{tag}>"

    def comments(self) -> str:
        tag = self.r.choice(("div", "section", "ul", "ol", "div"))
        inner = "li" if tag in ("ul", "ol") else self.r.choice(("div", "div", "article", "p"))
        name = self.r.choice(("comments", "comment-list", "discussion", "replies", "responses", "reader-comments"))
        each = self.r.choice((' class="comment"', "", ' class="reply"'))
        out = [f"<h3>{self.label()}</h3>"] if inner != "li" else []
        for _ in range(self.r.randint(1, 6)):
            body = self.words(self.r.randint(3, 60))
            out.append(f"<{inner}{each}>{body if inner == 'p' or self.r.random() < 0.4 else f'<b>{self.label()}</b><p>{body}</p>'}</{inner}>")
        return f'<{tag} {self.r.choice(("class", "id"))}="{name}">{"".join(out)}</{tag}>'

    def footer(self) -> str:
        tag = self.r.choice(("footer", "footer", "div"))
        a = self.attrs() if tag == "footer" else f' {self.r.choice(("class", "id"))}="{self.r.choice(("footer", "site-footer", "bottom", "copyright"))}"'
        body = self.r.choice((f"&copy; {self.words(8)}", f"<p>&copy; {self.words(12)}</p>", f"<p>{self.words(10)}</p>{self.links(4)}", f"{self.words(5)} &middot; {self.words(20)}"))
        return f"<{tag}{a}>{body}</{tag}>"

    def paragraph(self) -> str:
        n = self.r.choice((1, 2, 4, 10, 25, 50, 90, 160))
        text = self.words(n)
        if self.r.random() < 0.2:
            text = text.upper()
        if self.r.random() < 0.25:
            w = text.split(" ")
            k = self.r.randrange(len(w))
            w[k] = self.r.choice((f"<b>{w[k]}</b>", f'<a href="/x">{w[k]}</a>', f"<em>{w[k]}</em>", f"<b>{w[k]}", f"{w[k]}<br>"))
            text = " ".join(w)
        kind = self.r.random()
        if kind < 0.8:
            return f"<p{MAIN}>{text}" + ("</p>" if self.r.random() < 0.9 else "")
        if kind < 0.86:
            return f"<h2{MAIN}>{self.label()}</h2>"
        if kind < 0.91:
            return "<ul>" + "".join(f"<li{MAIN}>{self.words(self.r.randint(2, 20))}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>"
        if kind < 0.95:
            return f"<blockquote><p{MAIN}>{text}</p></blockquote>"
        if kind < 0.97:
            return "<table>" + "".join(f"<tr{MAIN}><td>{self.label()}</td><td>{self.label()}</td></tr>" for _ in range(self.r.randint(2, 5))) + "</table>"
        return f"<div{MAIN}>{text}</div>"

    def article(self) -> str:
        parts = []
        if self.r.random() < 0.85:
            title = f"<h1{MAIN}>{self.words(self.r.randint(2, 10))}</h1>"
            parts.append(f"<header>{title}</header>" if self.r.random() < 0.1 else title)
        for _ in range(self.r.choice((1, 1, 2, 2, 3, 5, 8, 14))):
            parts.append(self.paragraph())
            if self.r.random() < 0.06:
                parts.append(self.r.choice((self.advert, self.share, self.notice))())
        if self.r.random() < 0.2:
            parts.append(self.r.choice((self.share, self.comments, self.form, self.advert))())
        tag = self.r.choice(("article", "article", "article", "main", "div", "div", "section"))
        a = self.attrs("post", "entry", "story") if tag in ("article", "main") else f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(("content", "post", "entry-content", "article-body", "main-content", "story", "post-body", "text", "page-content"))}"'
        return f"<{tag}{a}>{''.join(parts)}</{tag}>"

    def page(self) -> str:
        before = [x for x, p in ((self.header, 0.6), (self.nav, 0.8), (self.notice, 0.3), (self.advert, 0.4), (self.form, 0.2), (self.sidebar, 0.15), (self.nav, 0.1)) if self.r.random() < p]
        after = [x for x, p in ((self.share, 0.25), (self.advert, 0.3), (self.comments, 0.4), (self.sidebar, 0.35), (self.form, 0.2), (self.notice, 0.2), (self.footer, 0.85)) if self.r.random() < p]
        self.r.shuffle(before)
        inner = "".join(x() for x in before) + self.article() + "".join(x() for x in after)
        for _ in range(self.r.choice((0, 0, 0, 1, 2))):
            inner = f"<div{self.attrs('wrapper', 'container', 'page', 'site', 'row')}>{inner}</div>"
        end = "" if self.r.random() < 0.15 else "</body></html>"
        return f"<!DOCTYPE html><html><head><title>{self.label()}</title><style>p{{}}</style></head><body>{inner}{end}"
