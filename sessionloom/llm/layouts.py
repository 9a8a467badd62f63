"""Labelled pages that `extraction` learns from.

No table of labelled pages is given, so a set of layouts of the common kinds is written down here, with what is content and
what is not marked by hand (`label`), and filled with invented text of several alphabets. [a|b] stands for one of
its parts; {name} for text: w some words, s a sentence, p a paragraph, P paragraphs in <p>, B those with inline markup and open
tags, M items of a menu, R items with links to other pages. Labels are inherited; without one nothing is content.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

_BODY = "[content|post-content|entry-content|article-body|story-body|main-content|post|entry|text|article-text|td-post-content|mw-parser-output|markdown-body|prose|body]"
_MENU = "[nav|menu|main-menu|navbar|navigation|top-nav|breadcrumb|topbar|nav-links]"
_SIDE = "[sidebar|side|aside|widget-area|widget|related|right-column|secondary|sidebar-left|rail]"
_FOOT = "[footer|site-footer|page-footer|bottom|colophon|copyright]"
_HEAD = "[header|site-header|page-header|masthead|banner|top|branding]"
_AD = "[ad|ads|advert|advertisement|sponsored|promo|ad-slot|banner-ad|adsense|sponsor]"
_NOTE = "[notice|cookie-notice|cookie-banner|alert|consent|message|gdpr|popup|modal|newsletter|subscribe|paywall|banner-notice|announcement]"
_TALK = "[comments|comment-list|reader-comments|discussion|responses|disqus|replies|user-comments]"
_SHARE = "[share|social|sharing|share-buttons|social-links|tags|post-meta|byline|pagination|pager|author-box]"
_SAYS = (
    "[We use cookies to improve your experience.|This site uses cookies.|Please log in to continue.|Subscribe to our newsletter!|Our terms have changed.|"
    "JavaScript is required.|Sign up for free|{s}|{s}] [Accept|OK|Read more|Close|{w}|]"
)
_LEGAL = "[&copy; {w}|&copy; 2024 {w} &middot; {s}|Copyright {w}. All rights reserved.|{w} &middot; {w}|{s}|Privacy Policy | Terms|Impressum {w}]"
_FORM = '<form action="/[search|login|subscribe|contact]"><label>[Search|Email|Name|{w}]</label><input name="q"><p>{s}</p><button>[Go|Send|{w}]</button></form>'
_THREAD = (
    f'[<section|<div] class="{_TALK}" id="[comments|talk|c]" label="other"><h[2|3]>[Comments|{{w}}|Responses]</h3>'
    '[<div class="comment"><p>{p}</p><p>{s}</p></div><div class="comment"><b>{w}</b><p>{p}</p></div>|<ul><li class="comment">{p}</li><li>{p}</li></ul>|<p>{p}</p><p>{p}</p>]</div></section>'
)
_NAV = f'[<nav>|<nav class="{_MENU}">|<div class="{_MENU}">|<div id="{_MENU}" role="navigation">|<nav role="navigation">]<ul>{{M}}</ul></nav></div>'
_TOP = f'[<header>|<header class="{_HEAD}">|<div class="{_HEAD}">|<div id="{_HEAD}">]<[div|h1|p|a]>{{w}}</a></p></h1></div><p>[{{s}}|{{w}}]</p>[{{LINKS}}|]</header></div>'
_END = f'[<footer>|<footer class="{_FOOT}">|<div class="{_FOOT}">|<div id="{_FOOT}">][{_LEGAL}|<p>{_LEGAL}</p>|<p>{_LEGAL}</p><ul>{{M}}</ul>]</footer></div>'
_RAIL = f'[<aside>|<aside class="{_SIDE}">|<div class="{_SIDE}">|<div id="{_SIDE}">][<h3>{{w}}</h3><ul>{{R}}</ul>|<h4>[Related|{{w}}]</h4><p>{{p}}</p><ul>{{M}}</ul>|<p>{{p}}</p>|<section><h2>{{w}}</h2><p>{{s}}</p></section>]</aside></div>'
_SOLD = f'<[div|aside|section] class="{_AD}" label="other">[{{s}}|{{p}}|<a href="#">{{s}}</a>|<p>{{s}}</p>]</section></aside></div>'
_TOLD = f'[<[div|section|aside] [class|id]="{_NOTE}" label="other">[{_SAYS}|<p>{_SAYS}</p>|<p>{{p}}</p>]</aside></section></div>|<p class="{_NOTE}" label="other">{_SAYS}</p>]'
_TEXT = "[<h1>{w}</h1>{P}|<h1>{s}</h1>{B}|{P}|{B}|<h1>{w}</h1><p>{s}</p>|<h1>{w}</h1>{P}<h2>{w}</h2>{P}<ul><li>{s}</li><li>{w}</li><li>{p}</li></ul>{P}|<header><h1>{s}</h1></header>{P}<blockquote><p>{p}</p></blockquote>{B}<pre>{p}</pre>|<h2>{w}</h2>{P}<table><tr><th>{w}</th><th>{w}</th></tr><tr><td>{w}</td><td>{s}</td></tr></table>{P}<figure><figcaption>{s}</figcaption></figure>|<h1>{w}</h1><ol><li>{s}</li><li>{s}</li></ol>{P}<h3>{w}</h3><dl><dt>{w}</dt><dd>{p}</dd></dl>]"
_INSIDE = f"[|||{_SOLD}|{_TOLD}|<div class=\"{_SHARE}\" label=\"other\"><ul>{{M}}</ul></div>|<aside label=\"other\"><p>{{p}}</p></aside>|<nav label=\"other\"><ul>{{M}}</ul></nav>|<form label=\"other\"><p>{{s}}</p></form>|<footer label=\"other\"><p>{{s}}</p></footer>]"

LAYOUTS = (
    f'{_NAV}<!-- x -->{_SOLD}<article label="content">{_TEXT}</article>{_END}',
    f'{_TOP}{_NAV}<main><article label="content">{_TEXT}{_INSIDE}{_TEXT}{_INSIDE}</article>{_THREAD}{_RAIL}</main>{_END}',
    f'{_TOLD}{_TOP}<div class="[wrap|container|page|wrapper]"><div class="{_BODY}" label="content">{_TEXT}{_INSIDE}</div>{_RAIL}</div>{_THREAD}{_END}',
    f'<div id="[page|wrapper|container]">{_TOP}{_NAV}<div id="[content|main|primary]"><div class="{_BODY}" label="content">{_TEXT}{_INSIDE}{_TEXT}</div>{_SOLD}{_THREAD}</div>{_RAIL}{_FORM}{_END}</div>',
    f'{_NAV}<main label="content">{_TEXT}{_INSIDE}{_TEXT}</main>{_RAIL}{_END}',
    f'{_TOP}<main class="[main|content]" label="content"><section>{_TEXT}</section>{_INSIDE}<section>{_TEXT}</section></main>{_FORM}{_END}',
    f'<table><tr><td class="{_MENU}"><a href="/">{{w}}</a><br><a href="/">{{w}}</a></td><td class="{_BODY}" label="content">{_TEXT}</td><td>{{LINKS}}</td></tr></table>{_END}',
    f'{_TOP}{_NAV}<h1 label="content">{{w}}</h1><div class="{_BODY}" label="content">{_TEXT}</div>{_TOLD}{_THREAD}{_END}',
    f'{_NAV}{_RAIL}<article class="[post|entry|article|story]"><div class="{_SHARE}" label="other">{{w}} <a href="/">{{w}}</a></div><div class="{_BODY}" label="content">{_TEXT}</div>{_THREAD}</article>{_SOLD}{_END}',
    f'<form id="[aspnetForm|form1]">{_TOP}{_NAV}<div class="{_BODY}" label="content">{_TEXT}</div>{_END}</form>',
    f'{_TOLD}{_NAV}<article label="content">{_TEXT}{_THREAD}</article>{_RAIL}{_FORM}{_END}',
    f'{_TOP}{_FORM}{_NAV}<section class="{_BODY}" label="content">{_TEXT}{_INSIDE}{_TEXT}</section><section class="[related|more|recommended]"><h2>{{w}}</h2><ul>{{R}}</ul></section>{_END}',
    '<div label="content">{P}</div>',
    '<div label="content"><h1>{w}</h1>{P}</div>',
)

_ALPHABETS = ("abcdefghijklmnoprstuvw", "aeiouàéèçtnrslmdp", "äöüßabdefghiklnrstu", "абвгдежиклмнопрст", "αβγδεηικλμνοπρστ", "あいうえおかきくけこさしすせそ")


class _Filler:
    def __init__(self, draw: random.Random) -> None:
        self.draw, self.letters = draw, draw.choice(_ALPHABETS)
        self.marks = draw.choice(("", "", "", "###", "&amp;&amp;"))
        # Some pages are odd throughout: words alone, lists without end, one word again and again, commas only.
        self.lengths = draw.choice(((1, 2, 5, 9, 14, 22), (1, 2, 5, 9, 14, 22), (1,), (1, 2, 3), (30, 60)))
        self.commas = draw.choice((0, 0.1, 0.1, 0.3, 1))
        self.counts = draw.choice(((1, 1, 2, 4, 8), (1, 1, 2, 4, 8), (1, 3), (15, 40)))
        self.again = draw.random() < 0.15

    def word(self) -> str:
        return "".join(self.draw.choice(self.letters) for _ in range(self.draw.randint(1, 11))) + self.marks

    def w(self) -> str:
        return " ".join(self.word() for _ in range(self.draw.randint(1, 5))).capitalize()

    def s(self) -> str:
        n = self.draw.choice(self.lengths)
        words = [self.word()] * n if self.again else [self.word() for _ in range(n)]
        words = [w + ("," if self.draw.random() < self.commas else "") for w in words]
        return " ".join(words).capitalize() + self.draw.choice(("...!?") if self.draw.random() < 0.95 else ("", ""))

    def p(self) -> str:
        return " ".join(self.s() for _ in range(self.draw.choice((1, 1, 2, 3, 5, 9, 30))))

    def P(self) -> str:
        return "".join(f"<p>{self.p()}</p>" for _ in range(self.draw.choice(self.counts)))

    def B(self) -> str:
        kinds = ("<p><b>{}<br>", "<p>{} <a href='#'>x</a> {}", "<p>{}<em>{}</em></p>", "<p><b>{}.<br><p>{}</p>", "<div>{}</div>", "<p>{}<br><br>{}</p>", "{}<br>")
        return "".join(self.draw.choice(kinds).format(self.p(), self.p()) for _ in range(self.draw.choice((1, 2, 3, 6))))

    def M(self) -> str:
        return "".join(f'<li><a href="/">{self.w() if self.draw.random() < 0.3 else self.word()}</a></li>' for _ in range(self.draw.randint(2, 8)))

    def R(self) -> str:
        return "".join(f'<li><a href="/">{self.s()}</a></li>' for _ in range(self.draw.randint(2, 6)))

    def LINKS(self) -> str:
        return " ".join(f'<a href="/">{self.word()}</a>' for _ in range(self.draw.randint(2, 6)))


def _fill(layout: str, draw: random.Random) -> str:
    filler = _Filler(draw)
    while True:  # innermost choices first
        chosen, n = re.subn(r"\[([^\[\]]*)\]", lambda m: draw.choice(m[1].split("|")), layout)
        if not n:
            break
        layout = chosen
    return re.sub(r"\{(\w+)\}", lambda m: getattr(filler, m[1])(), layout)


def _plainer(page: str, draw: random.Random) -> str:
    """Some pages lose the names of their elements or their telling tags, so that text and place have to count too."""
    kind = draw.random()
    if kind < 0.12:
        return re.sub(r'(class|id)="[^"]*"', lambda m: f'class="{draw.choice("xyzqk")}{draw.randint(1, 9)}"', page)
    if kind < 0.3:
        return re.sub(r"<(/?)(article|main|section|nav|header|footer|aside)\b", r"<\1div", page)
    return page


def labelled_pages(count: int, seed: int = 13) -> Iterator[str]:
    """`count` pages, the layouts in turn; the same for a seed."""
    draw = random.Random(seed)
    for k in range(count):
        body = _plainer(_fill(LAYOUTS[k % len(LAYOUTS)], draw), draw)
        yield f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>"
