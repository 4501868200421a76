"""Main text against a second version: another parser, and the windows by their definition."""

import os
import random
from html.parser import HTMLParser

import pytest

from kgloom.llm import html_text

BLOCK = set("p div h1 h2 h3 li ul ol td tr table body html section article main nav aside footer header form blockquote pre".split())
BAD_TAGS = set("nav footer aside form button script style head title header".split())
BAD_WORDS = {"ad", "sidebar", "comments", "menu", "cookie", "share"}
VOID = set("br img hr meta link input".split())


class Second(HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.lines, self.parts, self.open, self.kind, self.links = [], [], [], "", 0
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.links, self.kind, any(x[0] in ("article", "main") or x[1] == "main" for x in self.open)))
        self.parts, self.links = [], 0

    def bad(self):
        return any(x[2] for x in self.open)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        words = set(" ".join(v or "" for k, v in attrs.items() if k in ("class", "id")).replace("-", " ").split())
        bad = tag in BAD_TAGS and not (tag == "header" and any(x[0] == "article" for x in self.open)) or bool(words & BAD_WORDS)
        if tag in BLOCK and not self.bad():
            self.end()
            self.kind = "h" if tag[0] == "h" and tag[1:].isdigit() else "p" if tag == "p" else "" if tag in ("li", "td", "div") else self.kind
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self.open.pop()
        self.open.append((tag, attrs.get("role"), bad))

    def handle_endtag(self, tag):
        at = max((i for i, x in enumerate(self.open) if x[0] == tag), default=None)
        if at is None:
            return
        was = self.bad()
        if not was and tag in BLOCK:
            self.end()
            self.kind = ""
        bad = self.open[at][2]
        del self.open[at:]
        if was and bad and not self.bad() and tag in BLOCK | {"script", "style", "button", "head"} and tag not in ("script", "style"):
            self.end()
            self.lines += [("", 0, "", False)] * 3

    def handle_data(self, data):
        if not self.bad():
            self.parts.append(data)
            if any(x[0] == "a" for x in self.open):
                self.links += len(data)


def second(page):
    lines = Second(page).lines
    marked = any(inside for *_, inside in lines)
    w = [(3 if k == "p" else 1) * max(0, len(t) - n) if inside or not marked else 0 for t, n, k, inside in lines]
    t = min(0.15 * max([sum(w[i : i + 3]) for i in range(len(w))] or [0]), 150) or 1
    w = [max(x, t) if text and (inside or k == "h" and x and not marked) else x for x, (text, _, k, inside) in zip(w, lines, strict=True)]
    kept, at = [], 0
    while at < len(w):
        s = [sum(w[i : i + 3]) for i in range(len(w))]
        follows = all(i >= len(w) or s[i] or not any(s[i:]) for i in (at + 1, at + 2)) or w[at] >= t
        if not (s[at] and s[at] >= t and follows):
            at += 1
            continue
        end = next((i for i in range(at, len(w)) if not s[i]), len(w))
        strong = [i for i in range(at, end) if w[i] >= t / 3]
        if strong:
            kept += [i for i in range(strong[0], strong[-1] + 1) if lines[i][0] and (lines[i][3] or not marked)]
        at = end
    return "\n".join(lines[i][0] for i in kept)


def page(rng, mark):
    say = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(n))
    menu = "<nav><ul>" + "".join(f"<li><a href=x>{say(1)}</a></li>" for _ in range(5)) + "</ul></nav>"
    bare = "".join(f"<div><a href=x>{say(1)}</a></div>" for _ in range(rng.randint(0, 4)))
    body = [f"<h1>{say(4)}</h1>"] + [f"<p>{say(rng.randint(8, 120))}, <b>{say(2)}</b> &amp; it's<br>{say(3)}.</p>" for _ in range(rng.randint(2, 7))]
    inner = [f"<div class='ad'><p>{say(9)}</p></div>", f"<ul><li>{say(3)}</li><li>{say(12)}</li></ul>", f"<form><p>{say(4)}</p></form>", f"<p>{say(4)}<span class=share>{say(2)}</span> {say(30)}</p>", "<script>var x='</p>';</script>"]
    for part in rng.sample(inner, rng.randint(0, 4)):
        body.insert(rng.randint(1, len(body)), part)
    tail = [f"<div id=comments><p>{say(40)}</p></div>", f"<footer>{say(20)}</footer>", f"<div>{say(1)}</div>", f"<aside><p>{say(50)}</p></aside>"]
    a, z = {"article": ("<article>", "</article>"), "role": ("<div role=main><div>", "</div></div>"), "": ("<div>", "</div>")}[mark]
    return f"<html><head><title>{say(3)}</title></head><body>{menu}{bare}{a}{''.join(body)}{z}{''.join(rng.sample(tail, rng.randint(0, 4)))}</body></html>"


@pytest.mark.parametrize("mark", ["", "article", "role"])
def test_pages_against_the_second_version(mark):
    rng = random.Random(3)
    for _ in range(60):
        p = page(rng, mark)
        assert html_text.main_text(p) == second(p)
        assert len(html_text.main_text(p)) > 20


def test_unmarked_pages_lose_menus_and_keep_paragraphs():
    rng = random.Random(5)
    for _ in range(50):
        p = page(rng, "")
        text = html_text.main_text(p).split("\n")
        for part in Second(p.replace("<div><h1", "<div role=main><h1")).lines:
            if len(part[0]) > 160:
                assert (part[0] in text) == part[3]
    long = "word " * 100
    assert html_text.main_text(f"<div>Home</div><div>About</div><div>Contact</div><p>{long}</p><p>{long}</p><div>Copyright</div>") == f"{long.strip()}\n{long.strip()}"
    assert html_text.main_text(f"<div><p>{'long ' * 400}</p><figure>f</figure><p>{'tail ' * 60}</p></div>").count("tail") == 60


def test_marks_close_and_apostrophes_stay():
    assert html_text.main_text("<div role=main><div><p>in it</p></div><p>too</p></div><p>after</p>") == "in it\ntoo"
    assert html_text.main_text("<p title=it's>one two three<p>it's two<p>three 'x") == "one two three\nit's two\nthree 'x"
    assert html_text.main_text("<article><h2 id=related-work>Related</h2><p>x</p><div class=article-header><h3>T</h3></div></article>") == "Related\nx\nT"


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="no test tables")
def test_whole_table_against_the_second_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {r.page_id: r for r in html_text.op4_html_text(spark, "/root/testdata/sf0.01").collect()}
    rows = pages.collect()
    assert len(out) == len(rows) and all(out[r.page_id].text == second(r.html or "") and out[r.page_id].n_chars == len(out[r.page_id].text) for r in rows)
