"""Labelled pages that the extraction model is trained on.

They are written by a seeded generator: the parts that sites are made of (article,
menus, headers, footers, side columns, notices, adverts, forms, reader comments) in
several ways of marking each, in changing order, with invented words. An element's
``data-main`` says whether the blocks in it are main text (the nearest mark counts);
the model never sees that attribute.
"""

from __future__ import annotations

import random

# Each entry: (opening tags, closing tags) of a wrapper.
_MAIN = (
    ("<article>", "</article>"), ("<main>", "</main>"), ('<main id="content"><article class="post">', "</article></main>"),
    ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post-body entry-content">', "</div>"),
    ('<div class="article-body">', "</div>"), ('<section class="story">', "</section>"), ('<div id="article">', "</div>"),
    ('<div id="main">', "</div>"), ('<div class="article">', "</div>"), ('<div class="post">', "</div>"),
    ('<div class="entry">', "</div>"), ('<section id="article-text">', "</section>"),
    ('<div class="page"><div class="text">', "</div></div>"), ('<div class="wrapper"><div class="col-main">', "</div></div>"),
    ("<div>", "</div>"), ("<article>", "</article>"), ("<article class=\"entry\">", "</article>"), ('<div role="main">', "</div>"), ('<table><tr><td class="main">', "</td></tr></table>"), ("", ""),
)
_WRAPPERS = {
    "menu": (("<nav>", "</nav>"), ('<div class="menu">', "</div>"), ('<ul class="navbar">', "</ul>"),
             ('<div id="nav">', "</div>"), ('<div class="breadcrumbs">', "</div>"), ('<div role="navigation">', "</div>"),
             ('<header><nav class="top-menu">', "</nav></header>"), ('<div class="topbar">', "</div>"),
             ('<div class="pagination">', "</div>"), ('<div class="toc menu">', "</div>")),
    "header": (("<header>", "</header>"), ('<div id="header">', "</div>"), ('<div class="masthead">', "</div>"),
               ('<div class="site-header banner">', "</div>"), ('<header class="site-title">', "</header>")),
    "footer": (("<footer>", "</footer>"), ('<div id="footer">', "</div>"), ('<div class="site-footer">', "</div>"),
               ('<div class="copyright">', "</div>"), ('<div class="legal bottom">', "</div>"),
               ('<footer class="footer"><div class="links">', "</div></footer>")),
    "aside": (("<aside>", "</aside>"), ('<div class="sidebar">', "</div>"), ('<div id="sidebar-right">', "</div>"),
              ('<div class="widget">', "</div>"), ('<aside class="related">', "</aside>"),
              ('<section class="related-posts">', "</section>"), ('<div class="recommended">', "</div>"),
              ('<div class="share social">', "</div>"), ('<div role="complementary">', "</div>"), ('<div class="tags">', "</div>")),
    "notice": (('<div class="notice">', "</div>"), ('<div id="cookie-banner">', "</div>"), ('<div class="cookie consent">', "</div>"),
               ('<div class="alert popup">', "</div>"), ('<div class="gdpr modal">', "</div>"), ('<div role="alert">', "</div>"),
               ('<section class="cookie-notice">', "</section>"), ('<div class="disclaimer">', "</div>"),
               ('<p class="notice">', "</p>"), ('<div class="overlay">', "</div>")),
    "advert": (('<div class="ad">', "</div>"), ('<div class="ads">', "</div>"), ('<div id="advert">', "</div>"),
               ('<div class="advertisement">', "</div>"), ('<div class="promo">', "</div>"), ('<div class="sponsored">', "</div>"),
               ('<aside class="ad-slot">', "</aside>"), ('<ins class="adsbygoogle">', "</ins>"), ('<div class="banner-ad">', "</div>"),
               ('<p class="ad">', "</p>"), ('<div class="sponsor">', "</div>")),
    "form": (("<form>", "</form>"), ('<div class="newsletter"><form>', "</form></div>"), ('<form class="search">', "</form>"),
             ('<div class="subscribe">', "</div>"), ('<form id="login">', "</form>"), ('<div class="signup">', "</div>")),
    "comments": (('<section class="comments">', "</section>"), ('<div id="comments">', "</div>"), ('<ol class="comment-list">', "</ol>"),
                 ('<div class="comment">', "</div>"), ('<section id="disqus_thread">', "</section>"), ('<div class="replies">', "</div>"),
                 ('<section class="reader-comments"><article class="comment">', "</article></section>"),
                 ('<div class="discussion responses">', "</div>"), ('<ul class="user-comments">', "</ul>")),
}
#: In the training pages so many parts have a name that tells nothing: the text itself is learned from as well.
UNNAMED = 0.1
_SYLLABLES = "an ba ce do en fi go ha in jo ka le mi no or pu qua re sta ti un ve wo xi you zu ción ung eau ment".split()
_SHORT = "Home,About,Contact,News,Products,Login,Search,Archive,More,Next,Privacy,Terms,Help,Share,Reply,Sitemap".split(",")


class _Writer:
    def __init__(self, rng: random.Random, held_out: bool | None, unnamed: float):
        self.rng, self.unnamed = rng, unnamed

        def some(ways):
            """Every fifth way of marking a part is held out (None: all are used)."""
            kept = [w for k, w in enumerate(ways) if held_out is None or (k % 5 == 4) == held_out]
            return kept or list(ways)
        self.mains, self.wrappers = some(_MAIN), {k: some(v) for k, v in _WRAPPERS.items()}

    def word(self):
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low, high):
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self):
        return self.words(2, 25).capitalize() + self.rng.choice(".....!?")

    def prose(self):
        r, style = self.rng, self.rng.random()
        if style < 0.05:
            return self.word().capitalize() + "."
        if style < 0.13:
            return self.words(1, 12).capitalize() + r.choice((".", "", ",", ":"))
        if style < 0.18:
            return "; ".join(f"{self.word().capitalize()}: {r.randint(1, 9999)}" for _ in range(r.randint(2, 12)))
        if style < 0.22:
            return f"{r.randint(1, 28)} {self.word().capitalize()} {r.randint(1900, 2030)}, {self.words(1, 5)} ({self.words(1, 3)})"
        if style < 0.27:
            return f"&ldquo;{self.sentence()}&rdquo; &mdash; {self.words(2, 3).title()}"
        if style < 0.32:
            return self.words(5, 60).replace(" ", f" {r.choice(('&amp;', '+', '/', '-'))} ")
        return " ".join(self.sentence() for _ in range(r.randint(1, 8)))

    def links(self):
        items = [f'<a href="/{self.word()}">{self.rng.choice(_SHORT) if self.rng.random() < .5 else self.words(1, 4)}</a>'
                 for _ in range(self.rng.randint(2, 8))]
        if self.rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.rng.choice((" | ", " ", "<br>")).join(items)

    def filling(self, part):
        r = self.rng
        text = [f"<p>{self.prose()}</p>" for _ in range(r.randint(1, 3))]
        if part == "menu":
            return self.links()
        if part in ("header", "footer", "aside"):
            own = [self.links(), self.prose(), f"<h2>{self.words(1, 5)}</h2>", f"&copy; {self.words(1, 3)}", *text]
            return "".join(r.sample(own, r.randint(1, 3)))
        if part == "form":
            return (f"<label>{self.words(1, 4)}</label><input name=q>" + r.choice(("", self.prose()))
                    + f"<button>{r.choice(_SHORT)}</button>")
        if part == "comments":
            return f"<h3>{self.words(1, 3)}</h3>" + "".join(
                f"<{t}>{self.prose()}</{t}>" for t in r.choices(("p", "li", "div"), k=r.randint(1, 4)))
        return r.choice((self.prose(), "".join(text)))

    def part(self, part):
        low, high = self.rng.choice(self.wrappers[part])
        if self.rng.random() < self.unnamed:
            low, high = f'<div class="{self.word()}-{self.word()}">', "</div>"
        return f'<div data-main="0">{low}{self.filling(part)}{high}</div>'

    def bare(self):
        """A page that is all main text, as a file saved by hand: no heading, no telling class, nothing beside it."""
        r = self.rng
        text = r.choice(('<p data-main="1">{}</p>', '<p data-main="1">{}', '<div data-main="1">{}</div>'))
        low, high = r.choice((("", ""), ("<div>", "</div>"), ("<html><body>", "</body></html>"), ("<body><div>", "</div></body>")))
        return low + "".join(text.format(" ".join(self.sentence() for _ in range(r.randint(1, 9))))
                             for _ in range(r.choice((1, 1, 2, 2, 3, 5)))) + high

    def page(self):
        r = self.rng
        if r.random() < 0.06:
            return self.bare()
        low, high = r.choice(self.mains)
        if r.random() < self.unnamed:
            low, high = f'<div class="{self.word()}">', "</div>"
        title = self.words(2, 9).capitalize()
        body = [f"<{r.choice(('h1', 'h1', 'h2'))}>{title}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 1, 2, 3, 4, 5, 6, 8, 10))):
            kind = r.random()
            if kind < 0.64:
                body.append(r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p><strong>{}</strong>", "<p>{}",
                                      "<div>{}</div>", "<p><em>{}<br>", "<p><span>{}</span></p>")).format(self.prose()))
            elif kind < 0.7:
                body.append(f"<h{r.randint(2, 4)}>{self.words(1, 6)}</h{r.randint(2, 4)}>")
            elif kind < 0.76:
                body.append("<ul>" + "".join(f"<li>{self.prose()}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind < 0.8:
                body.append(f"<blockquote>{self.prose()}</blockquote>")
            elif kind < 0.84:
                body.append(f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>")
            elif kind < 0.86:
                body.append(f"<pre>{self.prose()}</pre>")
            else:
                body.append(self.part(r.choice(("aside", "advert", "advert", "notice", "form", "menu"))))
        if r.random() < 0.2:
            body.append(self.part("comments"))
        main = f'{low}<div data-main="1">{"".join(body)}</div>{high}'
        before = [self.part(x) for x in r.sample(("menu", "header", "notice", "advert", "form", "aside"), r.randint(0, 4))]
        after = [self.part(x) for x in r.sample(("comments", "aside", "advert", "footer", "menu", "form", "notice"), r.randint(0, 4))]
        body = "".join((*before, main, *after))
        if r.random() < 0.1:
            return body
        return (f"<html><head><title>{title}</title></head><body>{body}" + r.choice(("</body></html>", "</body></html>", "")))


def labelled_pages(count: int = 500, seed: int = 11, held_out: bool | None = None, unnamed: float = UNNAMED) -> list[str]:
    """``held_out``: only the ways of marking parts that are held out (True) or all others (False);
    ``unnamed``: the share of parts whose names tell nothing."""
    writer = _Writer(random.Random(seed), held_out, unnamed)
    return [writer.page() for _ in range(count)]
