"""Labelled pages for training: generated from templates by a seeded rule.

Each page mixes layouts, element names and class names as they occur on real sites, so that a model learns what
surrounds an article instead of one site's markup. The text of a block is random words; its label is known because the
generator wrote it. The number of pages is a parameter.
"""

from __future__ import annotations

import random

from .html_blocks import Block, blocks

# Class and id names common on public web pages, by the kind of block they mark.
ARTICLE = "article content post entry story main body text page single prose markdown reader detail news blog post-content entry-content article-body main-content story-body post-body article-content page-content entry-body".split()
NAVIGATION = "nav menu navbar navigation breadcrumb breadcrumbs topbar site-nav main-menu tabs pagination pager toc links skip".split()
HEADER = "header masthead banner site-header top logo brand branding site-title tagline".split()
FOOTER = "footer site-footer bottom copyright legal colophon credits page-footer".split()
SIDEBAR = "sidebar aside side rail widget widgets secondary right-column related related-posts recommended popular trending tags tag-cloud archive more-stories also see-also".split()
NOTICE = "cookie cookies cookie-banner consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall promo message toast announcement privacy banner-notice disclaimer".split()
ADVERT = "ad ads advert advertisement sponsor sponsored sponsored-content promoted ad-slot adsbygoogle banner-ad commercial dfp promo-box".split()
FORM = "form search search-form login signup contact contact-form register newsletter-form comment-form respond".split()
COMMENTS = "comments comment comment-list comments-area disqus discussion replies reply responses user-comments reader-comments comment-body comment-content thread feedback".split()
SHARE = "share social sharing social-links share-buttons follow byline-share".split()
PLAIN = "wrap wrapper container row col inner outer box section block group layout grid site page-wrap".split()


#: Share of pages whose article is one to three paragraphs without a heading.
SHORT = 0.35


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.labels: dict[str, int] = {}
        self.serial = 0

    def words(self, low: int, high: int, stop: bool = True) -> str:
        """Random words; the first is unique, so that the label of the block that holds it can be found again."""
        n = self.r.randint(low, high)
        syllable = lambda: self.r.choice("bcdfghlmnprstvw") + self.r.choice("aeiou") + self.r.choice(("", "n", "r", "s", "t"))
        found = ["".join(syllable() for _ in range(self.r.randint(1, 4))) for _ in range(n)]
        self.serial += 1
        found[0] = f"Q{self.serial}q" + found[0]
        return " ".join(found) + (self.r.choice(".....!?") if stop else "")

    def put(self, text: str, label: int) -> str:
        self.labels[text.split(" ")[0].split("<")[0].rstrip(".!?")] = label
        return text

    def some(self, names: list[str]) -> str:
        kind = self.r.choice(("class", "class", "class", "id"))
        more = f" {self.r.choice(PLAIN)}" if self.r.random() < 0.3 else ""
        return f' {kind}="{self.r.choice(names)}{more}"'

    def links(self, low: int, high: int) -> str:
        items = [self.put(self.words(1, 3, False), 0) for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/x">{t}</a></li>' for t in items) + "</ul>"
        return "".join(f'<div><a href="/x">{t}</a></div>' for t in items)

    def other(self, names: list[str], tags: list[str], low: int, high: int, repeat: int = 1) -> str:
        tag = self.r.choice(tags)
        attribute = self.some(names) if tag in ("div", "section", "ul", "span") or self.r.random() < 0.5 else ""
        inner = []
        for _ in range(self.r.randint(1, repeat)):
            t = self.put(self.words(low, high, self.r.random() < 0.8), 0)
            inner.append(self.r.choice((f"<p>{t}</p>", f"<p>{t}</p>", f"<div>{t}</div>", f"<h3>{t}</h3>", t + "<hr>")))
        return f"<{tag}{attribute}>{''.join(inner)}</{tag}>"

    def paragraph(self) -> str:
        short = self.r.random() < 0.2
        t = self.put(self.words(*((1, 5) if short else (8, 90))), 1)
        if self.r.random() < 0.06:  # articles hold addresses and figures too
            t += self.r.choice((" Write to ab@cd.example.", " 192.0.2.7 555-0100 @ab"))
        k = self.r.random()
        if k < 0.1:
            head, _, rest = t.partition(" ")
            return f'<p>{head} <a href="/y">{rest[:20]}</a>{rest[20:]}</p>'
        if k < 0.2:
            return f"<p><b>{t}<br>"
        if k < 0.3:
            return f"<p>{t}"
        if k < 0.36:
            return f"<blockquote><p>{t}</p></blockquote>"
        if k < 0.42:
            return "<ul>" + "".join(f"<li>{self.put(self.words(2, 18), 1)}</li>" for _ in range(self.r.randint(2, 5))) + f"</ul><p>{t}</p>"
        if k < 0.5:
            return f"<{'h2' if k < 0.46 else 'h3'}>{self.put(self.words(2, 8, False), 1)}</{'h2' if k < 0.46 else 'h3'}><p>{t}</p>"
        if k < 0.53:
            return f"<table><tr><td>{self.put(self.words(1, 4, False), 1)}</td><td>{t}</td></tr></table>"
        if k < 0.56:
            return f"<pre><code>{t}</code></pre>"
        if k < 0.6:
            return f"<div>{t}</div>"
        return f"<p>{t}</p>"

    def comments(self) -> str:
        tag = self.r.choice(("section", "div", "ol", "aside"))
        inner = "".join(f"<{k}{self.some(COMMENTS) if self.r.random() < 0.5 else ''}><p>{self.put(self.words(3, 60), 0)}</p></{k}>" for k in [self.r.choice(("div", "article", "li"))] for _ in range(self.r.randint(1, 6)))
        return f"<{tag}{self.some(COMMENTS)}>" + (f"<h3>{self.put(self.words(1, 3, False), 0)}</h3>" if self.r.random() < 0.6 else "") + inner + f"</{tag}>"

    def form(self) -> str:
        return f"<form{self.some(FORM) if self.r.random() < 0.6 else ''}><label>{self.put(self.words(1, 6, False), 0)}</label><input name=q><p>{self.put(self.words(1, 25), 0)}</p></form>"

    def page(self) -> str:
        r = self.r
        before, after, inside = [], [], []
        if r.random() < 0.7:
            before.append(f"<header{self.some(HEADER) if r.random() < 0.5 else ''}><div>{self.put(self.words(1, 5, False), 0)}</div></header>" if r.random() < 0.6 else self.other(HEADER, ["div"], 1, 12, 2))
        if r.random() < 0.85:
            tag = r.choice(("nav", "nav", "div"))
            before.append(f"<{tag}{self.some(NAVIGATION) if tag == 'div' or r.random() < 0.4 else ''}>{self.links(3, 9)}</{tag}>")
        extra = [
            lambda: self.other(NOTICE, ["div", "section", "aside"], 4, 45, 2), lambda: self.other(ADVERT, ["div", "aside", "section"], 2, 30, 2), lambda: self.other(SIDEBAR, ["aside", "aside", "div"], 2, 40, 3), self.form,
            lambda: f"<aside{self.some(SIDEBAR) if r.random() < 0.5 else ''}><h3>{self.put(self.words(1, 3, False), 0)}</h3>{self.links(2, 6)}</aside>", lambda: self.other(SHARE, ["div", "ul"], 1, 4, 2),
        ]
        for group, chance in ((before, 0.35), (after, 0.35), (inside, 0.1)):
            group += [e() for e in extra if r.random() < chance]
        if r.random() < 0.45:
            (inside if r.random() < 0.35 else after).append(self.comments())
        if r.random() < 0.85:
            after.append(f"<footer{self.some(FOOTER) if r.random() < 0.4 else ''}><p>{r.choice(('', '&copy; ', '&copy; '))}{self.put(self.words(2, 25), 0)}</p></footer>" if r.random() < 0.7 else self.other(FOOTER, ["div"], 2, 25, 2))
        short = r.random() < SHORT
        body = [f"<h1>{self.put(self.words(3, 12, False), 1)}</h1>"] if not short and r.random() < 0.8 else []
        paragraphs = [f"<p>{self.put(self.words(12, 90), 1)}</p>" for _ in range(r.randint(1, 3))] if short else [self.paragraph() for _ in range(r.randint(1, 14))]
        if inside and r.random() < 0.4:
            paragraphs.insert(r.randint(0, len(paragraphs)), inside.pop(0))
        body += paragraphs + inside
        k = r.random()
        open_, close = ("<article>", "</article>") if k < 0.45 else (f"<article{self.some(ARTICLE)}>", "</article>") if k < 0.6 else ("<main>", "</main>") if k < 0.72 else (f"<div{self.some(ARTICLE)}>", "</div>") if k < 0.95 else ("<div>", "</div>")
        wrap = [f"<div{self.some(PLAIN)}>", "</div>"] if r.random() < 0.4 else ["", ""]
        return f"<!DOCTYPE html><html><head><title>t</title></head><body>{wrap[0]}{''.join(before)}{open_}{''.join(body)}{close}{''.join(after)}{wrap[1]}" + ("</body></html>" if r.random() < 0.85 else "")


def labelled_pages(n: int, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """(blocks, labels) of n generated pages; label 1 is the article."""
    w = Writer(seed)
    out = []
    for _ in range(n):
        w.labels = {}
        page = blocks(w.page())
        labels = [w.labels.get(b.text.split(" ")[0].replace("©", "").strip().rstrip(".!?")) for b in page]
        labels = [x if x is not None else w.labels.get(b.text.split(" ")[1].rstrip(".!?"), 0) if " " in b.text else 0 for x, b in zip(labels, page, strict=True)]
        out.append((page, labels))
    return out
