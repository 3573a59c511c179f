"""Labelled pages to train the extraction model on, made by a rule: content carries the marker attribute, which the
reader of features never sees."""

from __future__ import annotations

import random

MARK = "data-content"
SYLLABLES = "ka lo mi ren ta sol ver un di pra cho eln ius mor tep gra nid fos bel qua ach ou eur lich ción ment tion ing the de la".split()
GROUPS = {
    "nav": ("nav", "menu", "main-menu", "navbar", "breadcrumbs", "pagination", "tabs", "toc"),
    "header": ("header", "site-header", "masthead", "topbar", "branding"),
    "footer": ("footer", "site-footer", "copyright", "legal", "bottom"),
    "side": ("sidebar", "aside", "widget", "related", "recommended", "popular", "rail", "secondary"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot"),
    "notice": ("notice", "cookie-banner", "consent", "alert", "newsletter", "subscribe", "modal", "paywall"),
    "comments": ("comments", "comment", "comment-list", "replies", "discussion", "respond"),
    "share": ("share", "social", "share-buttons", "follow-us"),
    "form": ("search", "login", "contact-form", "signup"),
}
CONTENT = ("content", "article", "post", "entry-content", "story-body", "main", "post-body", "text")


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r, n = self.r, self.r.randint(low, high)
        out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) + r.choice(["", "", "", "", ",", "."]) for _ in range(n)]
        return " ".join(out).capitalize() + r.choice([".", ".", "", "!", "?"])

    def line(self) -> str:
        return self.r.choice([lambda: self.words(1, 3), lambda: self.words(3, 12), lambda: self.words(8, 60), lambda: self.words(40, 160)])()

    def attr(self, group: str, often: float = 0.7) -> str:
        r = self.r
        if r.random() > often:
            return ""
        return f' {r.choice(["class", "class", "id"])}="{r.choice(["", "", "c12 ", "wrap "])}{r.choice(GROUPS[group])}"'

    def links(self) -> str:
        r = self.r
        items = [f'<a href="/{k}">{self.words(1, 4)}</a>' for k in range(r.randint(2, 9))]
        return r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items), "".join(f"<p>{x}</p>" for x in items)])

    def boiler(self, group: str) -> str:
        r = self.r
        if group == "nav":
            return r.choice([lambda: f"<nav{self.attr('nav', 0.4)}>{self.links()}</nav>", lambda: f"<div{self.attr('nav', 1)}>{self.links()}</div>", lambda: f'<div role="navigation">{self.links()}</div>'])()
        if group == "header":
            body = r.choice([f"<h2>{self.words(1, 4)}</h2>", f'<a href="/">{self.words(1, 3)}</a>', f"<div>{self.words(1, 6)}</div>"]) + r.choice(["", self.boiler("nav"), self.boiler("form"), f"<p>{self.words(3, 12)}</p>"])
            return r.choice([f"<header{self.attr('header', 0.4)}>{body}</header>", f"<div{self.attr('header', 1)}>{body}</div>", f'<div role="banner">{body}</div>'])
        if group == "footer":
            body = r.choice([f"&copy; 2020 {self.words(1, 8)}", f"<p>&copy; {self.words(2, 12)}</p>", self.links(), self.words(4, 30), f"<p>{self.words(10, 50)}</p>{self.links()}", f"{self.words(2, 4)} &middot; {self.words(3, 20)}"])
            return r.choice([f"<footer{self.attr('footer', 0.4)}>{body}</footer>", f"<div{self.attr('footer', 1)}>{body}</div>", f'<div role="contentinfo">{body}</div>'])
        if group == "side":
            body = f"<h3>{self.words(1, 4)}</h3>" * r.randint(0, 1) + r.choice([self.links(), f"<p>{self.words(5, 50)}</p>", "".join(f"<div><p>{self.words(4, 25)}</p></div>" for _ in range(r.randint(1, 3)))])
            return r.choice([f"<aside{self.attr('side', 0.4)}>{body}</aside>", f"<div{self.attr('side', 1)}>{body}</div>", f"<section{self.attr('side', 1)}>{body}</section>", f'<div role="complementary">{body}</div>'])
        if group == "form":
            return f"<form{self.attr('form', 0.5)}><label>{self.words(1, 3)}</label><input name=q><p>{self.words(2, 14)}</p><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><button>{self.words(1, 2)}</button></form>"
        if group == "comments":
            one = lambda: r.choice(["<div{}><b>{}</b><p>{}</p></div>", "<li{}><span>{}</span><p>{}</p></li>", "<article{}><h4>{}</h4><p>{}</p></article>"]).format(self.attr("comments", 0.6), self.words(1, 2), self.line())
            return f"<{(t := r.choice(['section', 'div', 'ol']))}{self.attr('comments', 1)}>{f'<h3>{self.words(1, 3)}</h3>' * r.randint(0, 1)}{''.join(one() for _ in range(r.randint(1, 5)))}{self.boiler('form') * r.randint(0, 1)}</{t}>"
        body = r.choice([self.words(2, 40), f"<p>{self.words(3, 60)}</p>", f"<p>{self.words(3, 20)}</p><a href='/x'>{self.words(1, 3)}</a>", f"<b>{self.words(1, 3)}</b> {self.words(4, 20)}"])
        extra = r.choice(["", "", ' role="alert"', " hidden", ' style="display:none"']) if group == "notice" else ""
        return f"<{(t := r.choice(['div', 'div', 'section', 'p', 'aside']))}{self.attr(group, 1)}{extra}>{body if t != 'p' else self.words(2, 40)}</{t}>"

    def content(self) -> str:
        r, m = self.r, f" {MARK}"
        out = []
        if r.random() < 0.85:
            out.append(f"<h1{m}>{self.words(2, 12)}</h1>")
        broken = r.random() < 0.3
        for _ in range(r.choice([1, 2, 3, r.randint(1, 14), r.randint(1, 14), r.randint(1, 14)])):
            k = r.random()
            if k < 0.7:
                t = self.line()
                t = f'{t} <a href="/z">{self.words(1, 4)}</a> {self.words(1, 20)}' if r.random() < 0.15 else t
                t = f"<b>{t}<br>" if broken and r.random() < 0.4 else f"<em>{t}</em>" if r.random() < 0.1 else t
                out.append(f"<p{m}>{t}" + ("" if broken and r.random() < 0.5 else "</p>"))
            elif k < 0.78:
                out.append(f"<h{(h := r.randint(2, 4))}{m}>{self.words(1, 8)}</h{h}>")
            elif k < 0.86:
                out.append("<ul>" + "".join(f"<li{m}>{self.words(1, 25)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif k < 0.9:
                out.append(f"<blockquote{m}>{self.words(5, 40)}</blockquote>")
            elif k < 0.92:
                out.append("<table>" + "".join(f"<tr><td{m}>{self.words(1, 3)}<td{m}>{self.words(1, 4)}</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif k < 0.95:
                out.append(f"<div><p{m}>{self.line()}</p></div>")
            elif k < 0.97:
                out.append(f"<pre{m}>{self.words(3, 30)}</pre>")
            else:
                out.append(self.boiler(r.choice(["ad", "ad", "share", "notice", "side"])))
        if r.random() < 0.15:
            out.append(self.boiler(r.choice(["share", "comments", "nav"])))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        some = lambda kinds, p: "".join(self.boiler(g) for g in kinds if r.random() < p)
        kind, body = r.random(), self.content()
        if kind < 0.5:
            main = f"<article{r.choice(['', '', ' class=post', ' id=content'])}>{body}</article>"
        elif kind < 0.65:
            main = f"<main{r.choice(['', ' id=main'])}>{body}</main>"
        else:
            main = f'<{(t := r.choice(["div", "section", "div"]))} {r.choice(["class", "id"])}="{r.choice(CONTENT)}">{body}</{t}>'
        if r.random() < 0.35:
            main = f'<{(t := r.choice(["main", "div", "section"]))}{r.choice(["", f" class={r.choice(CONTENT)}", " class=wrapper", " id=page"])}>{some(["nav", "ad", "share"], 0.15)}{main}{some(["side", "comments", "ad", "share"], 0.25)}</{t}>'
        top = some(["notice"], 0.25) + some(["header"], 0.4) + some(["nav"], 0.75) + some(["ad"], 0.45) + some(["form"], 0.12)
        bottom = some(["side"], 0.3) + some(["comments"], 0.25) + some(["share"], 0.15) + some(["ad"], 0.15) + some(["footer"], 0.85) + some(["notice"], 0.1)
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{top}{main}{bottom}</body></html>"


def labelled_pages(n: int, seed: int) -> list[str]:
    return [Maker(seed * 100_003 + k).page() for k in range(n)]
