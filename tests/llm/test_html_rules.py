"""Main texts against a second implementation of the rules, by another parser and plain loops."""

import collections
import random
import re
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from fieldloom.llm import html_blocks as hb

LONG = "The house of the mouse is in the town and it was there for a very long time, as it is to this day and will be."


class Reader(HTMLParser):
    """Blocks of a page in which every element but p, li, br and input is closed, each with the chain of elements around it."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.chain, self.blocks, self.now, self.links, self.number = [], [], "", 0, 0
        self.feed(page)
        self.close()
        self.end_block()

    def end_block(self):
        text = " ".join(self.now.split())
        if text:
            self.blocks.append({"text": text, "linked": min(self.links, len(text)), "chain": list(self.chain)})
        self.now, self.links = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in hb.BLOCKS:
            self.end_block()
            if self.chain and self.chain[-1][0] == "p":
                self.chain.pop()
        if tag == "br":
            self.now += " "
        if tag == "li" and self.chain and self.chain[-1][0] == "li":
            self.chain.pop()
        if tag not in hb.VOID:
            self.number += 1
            self.chain.append((tag, dict(attrs), self.number))

    def handle_endtag(self, tag):
        if tag in hb.BLOCKS:
            self.end_block()
        if tag in [t for t, _, _ in self.chain]:
            while self.chain.pop()[0] != tag:
                pass

    def handle_data(self, data):
        names = [t for t, _, _ in self.chain]
        if any(t in ("script", "style", "title", "textarea") or t in hb.SKIPPED for t in names):
            return
        self.now += data
        if "a" in names:
            self.links += len(" ".join(data.split()))


def kind(tag, attrs, before):
    """What an element says, given those around it."""
    in_content = any(t in ("article", "main") or a.get("role") in ("article", "main") for t, a, _ in before)
    names = ((attrs.get("class") or "") + " " + (attrs.get("id") or "")).lower().split()
    if "hidden" in attrs or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or ""):
        return "fixed"
    if tag in ("main", "html", "body"):
        return None
    if tag in hb.BOILERPLATE_TAGS or attrs.get("role") in hb.BOILERPLATE_ROLES or tag == "header" and not in_content:
        return "movable" if tag == "form" or attrs.get("role") == "form" else "fixed"
    out = None
    for name in names:
        words = re.findall("[a-z]+", name)
        if set(words) & hb.BOILERPLATE_NAMES and words[0] not in hb.BESIDE:
            if set(words) & hb.SURE_NAMES:
                return "fixed"
            if set(words) <= hb.BOILERPLATE_NAMES | hb.PLACE_NAMES:
                out = "movable"
            else:
                out = out or "doubt"
    return out


def brute_text(page):
    blocks = Reader(page).blocks
    weights, holds, free_text = collections.Counter(), set(), 0
    for b in blocks:
        b["parts"], b["content"], b["doubt"], b["heading"] = [], False, False, False
        for i, (tag, attrs, number) in enumerate(b["chain"]):
            k = kind(tag, attrs, b["chain"][:i])
            if k in ("fixed", "movable"):
                b["parts"].append((number, k))
            b["doubt"] |= k == "doubt"
            here = tag in ("article", "main") or attrs.get("role") in ("article", "main")
            b["content"] |= here
            b["heading"] |= tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            if here or tag == "h1":
                holds |= {n for n, _ in b["parts"]}
        words = re.findall(r"[^\W\d_]+", b["text"].lower())
        b["stop"], n = sum(w in hb.STOP_WORDS for w in words) / max(1, len(words)), len(b["text"])
        b["link"] = b["linked"] / n
        if b["link"] <= 0.5 and (n >= 200 or b["stop"] >= 0.08):
            free_text += 0 if b["parts"] else n
            for number, _ in b["parts"]:
                weights[number] += n
    for b in blocks:
        marked = [not (k == "movable" and weights[p] >= 200 and (p in holds or not free_text) and 4 * free_text < weights[p]) for p, k in b["parts"]]
        b["marked"] = any(marked)
        n = len(b["text"])
        b["points"] = (2 if b["stop"] >= 0.16 else 1 if b["stop"] >= 0.08 else 0) + (2 if n >= 200 else 0) + b["content"] - b["doubt"] - 7 * b["marked"]
        full = b["link"] > 0.5 and not (b["content"] and n < 70)
        b["points"] -= 7 * full + 3 * (not full and b["link"] > 0 and b["stop"] == 0 and n >= 70)
        b["label"] = "boilerplate" if b["points"] <= -2 else "text" if b["points"] >= 2 and n >= 70 else None
    out = []
    for i, b in enumerate(blocks):
        label = b["label"]
        if not label:
            left = next((j for j in range(i - 1, -1, -1) if blocks[j]["label"] and not blocks[j]["marked"]), None)
            right = next((j for j in range(i + 1, len(blocks)) if blocks[j]["label"] and not blocks[j]["marked"]), None)
            said = [blocks[j]["label"] for j in (left, right) if j is not None]
            if not said or "text" in said and b["points"] > 0 and len(b["text"]) >= 70 or b["heading"] and right is not None and blocks[right]["label"] == "text":
                label = "text"
            elif len(set(said)) == 1:
                label = said[0]
            elif any(x["content"] for x in blocks):
                label = "text" if b["content"] else "boilerplate"
            else:
                label = blocks[left if i - left <= right - i else right]["label"]
        if label == "text":
            out.append(b["text"])
    return "\n".join(out)


STOPS, RARE = "the of and to in is it was for on".split(), "qarx brun zond plif mure stack velt".split()
NAMES = ["", "", "", "content", "sidebar", "with-sidebar", "article-header", "site-footer", "comment-list", "post-comments", "ad", "notice", "read-more", "header"]


def random_page(rng):
    def words(n, share):
        return " ".join(rng.choice(STOPS if rng.random() < share else RARE) for _ in range(n))

    def piece(deep):
        roll = rng.random()
        if deep > 3 or roll < 0.5:
            n, share = rng.choice([2, 6, 14, 20, 45, 80]), rng.choice([0, 0.1, 0.14, 0.4])
            inner = words(n, share)
            if rng.random() < 0.3:
                inner = f"{words(rng.randint(0, 9), 0.3)} <a href='x'>{inner}</a> {words(rng.randint(0, 30), 0.3)}"
            return rng.choice(["<p>{}", "<p>{}</p>", "<div>{}</div>", "<h2>{}</h2>", "<li>{}", "{} &amp; <br>&nbsp;{}"]).replace("{}", inner)
        tag = rng.choice("div div div section article main nav footer header aside form ul span".split())
        name = rng.choice(NAMES)
        attrs = rng.choice(["", f' class="{name}"', f" id={name or 'x'}", ' data-hidden="false"', ' title="a hidden ad"', " hidden", ' style="display: none"', ' role="main"'] if rng.random() < 0.6 else [""])
        inside = "".join(piece(deep + 1) for _ in range(rng.randint(1, 4)))
        return f"<{tag}{attrs}>{inside}</{tag}>"

    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{''.join(piece(0) for _ in range(rng.randint(1, 6)))}<script>var x='<p>';</script></body></html>"


def test_random_pages_equal_brute_force():
    rng = random.Random(5)
    used = collections.Counter()
    for _ in range(3000):
        page = random_page(rng)
        assert hb.main_text(page) == brute_text(page), page
        used += hb.rules_used(page)
    assert {k for k, _ in used} == {"density", "length", "links", "part", "neighbours"}


def test_shared_pages_equal_brute_force_and_use_all_rules():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    used = collections.Counter()
    for page in pages:
        text = hb.main_text(page)
        assert text == brute_text(page)
        article = re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*)</article>", page, re.S)[1])
        import html

        assert text.split() == html.unescape(article).split()
        used += hb.rules_used(page)
    assert {k for k, _ in used} == {"density", "length", "links", "part", "neighbours"}
    assert sum(n for (rule, label), n in used.items() if label == "text" and rule in ("density", "length")) > len(pages)


@pytest.mark.parametrize(
    "page",
    [
        f'<div data-hidden="false"><p>{LONG}</p></div>',
        f'<div title="a hidden gem"><p>{LONG}</p></div>',
        f"<div data-url=/x?id=ad/1><p>{LONG}</p></div>",
        f"<form><p>{LONG}</p><p>{LONG}</p></form>",
        f'<div class="content with-sidebar"><p>{LONG}</p></div>',
        f"<button><p>{LONG}</p>",
        f"<p>{LONG}</p><div hidden>{LONG}</div>",
        f"<p>{LONG}</p><div id='post-comments'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>",
    ],
)
def test_marks_that_do_not_take_the_text(page):
    assert set(hb.main_text(page).split("\n")) == {LONG}
    assert ("<div hidden" in page or "comments" in page) <= (hb.main_text(page).count(LONG) == 1)


def test_headings_stay():
    assert hb.main_text(f'<div class="article-header"><h1>Head</h1></div><p>{LONG}</p>') == f"Head\n{LONG}"
    assert hb.main_text(f"<article><header><h1>Head</h1></header><p>{LONG}</p></article>") == f"Head\n{LONG}"


def test_text_beside_an_article_stays():
    page = f"<body><article><p>Read more of this.</p></article><div><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert hb.main_text(page).split("\n")[-2:] == [LONG, LONG]


def test_an_article_does_not_make_boilerplate_text():
    junk = "Home | Shop | Cart | Login | Register | Help | Jobs | Press | Imprint | <a href=x>Sitemap</a>"
    assert hb.main_text(f"<body><article><p>{LONG}</p><div>{junk}</div></article></body>") == LONG


@pytest.mark.parametrize("unit", ["<button>", "<svg>", "<select>", "<iframe>", "<script>", "<b>x", "<nav>x", "</i>", "<!--", "<i><article>", '"<a ', "<form>x", "&amp;<"])
def test_long_broken_pages_take_linear_time(unit):
    began = time.perf_counter()
    hb.main_text(unit * 60_000)
    assert time.perf_counter() - began < 6


def test_odd_pages(spark):
    want = {None: "", "": "", "<": "<", "<p": "", "a < b": "a < b", "<![CDATA[x": "", "<!--": "", "</p></p>": "", "<script>": "", "&nope; &lt;": "&nope; <", "<div " * 500: "", "<b>" * 2000 + "x": "x"}
    assert {k: hb.main_text(k) for k in want} == want
    rows = [(1, "u", "<article><p>Text</p></article>", "other"), (2, "u", None, None), (2, "u", "<nav>x</nav>", None), (None, None, f"<p>{LONG}</p>" * 20_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {(r.page_id, r.url): (r.text, r.n_chars) for r in hb.extraction_report(pages).collect()}
    assert out == {(1, "u"): ("Text", 4), (2, "u"): ("", 0), (None, None): ("\n".join([LONG] * 20_000), 20_000 * (len(LONG) + 1) - 1)}
    assert hb.extraction_report(pages).count() == 4
    assert hb.extraction_report(pages.limit(0)).count() == 0
