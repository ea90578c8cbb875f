"""Main text of HTML pages by two passes over their blocks.

First pass: every block gets points for its stop-word density, its length and its
link density; the parts of the page that it stands in add or take points.  Enough
points make it text, few make it boilerplate, and short blocks or middling points
leave it open.  Second pass: open blocks inherit the label of the nearest decided
neighbours.  Both passes, and the reading of the page, take time in proportion to
the page's length.
"""

from __future__ import annotations

import bisect
import html as html_module
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fieldloom.llm.textbatch import pieces

#: Frequent words of four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be by this have from or at an not which you "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es werden aus er hat dass sie nach wird bei "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur se ne ce il avec son "
    "que el en y los del las por con para una su al lo como más pero sus".split()
)

#: Elements read as plain characters up to their end, elements whose content isn't text, elements that begin and end blocks, elements without content.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
SKIPPED = frozenset("noscript template svg math object canvas audio video select option button datalist".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An inline element doesn't end across one of these.
BORDERS = frozenset("article main body table td".split())
#: Parts of a page that hold no main text, by element, by role, and by words in class and id.
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog search".split())
BOILERPLATE_ROLES = frozenset("navigation contentinfo complementary banner search form menu menubar dialog alertdialog alert".split())
BOILERPLATE_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu submenu breadcrumb breadcrumbs footer header masthead sidebar side aside widget related recommended share sharing social comment comments commentlist reply replies disqus respond notice notices cookie cookies consent gdpr popup modal newsletter subscribe subscription login signup pagination pager toolbar skip copyright legal".split())
#: Of these names, the ones that tell the same as part of any longer name.
SURE_NAMES = frozenset("advert adverts advertisement advertising sponsored navbar breadcrumb breadcrumbs comment comments commentlist disqus cookie cookies consent gdpr newsletter pagination".split())
#: Words beside a boilerplate name that only say where or how large it is.
PLACE_NAMES = frozenset("site page main global top bottom left right upper lower primary secondary area bar box block list item items section wrapper wrap container inner outer links buttons button posts post articles slot unit text content message sticky fixed".split())
#: A name that begins so tells of something beside the part, or of its absence.
BESIDE = frozenset("with has no without".split())
CONTENT_TAGS = frozenset(["article", "main"])
CONTENT_ROLES = frozenset(["main", "article"])

#: Limits of the first pass.
MAX_LINK_DENSITY = 0.5
SHORT, LONG = 70, 200
LOW_STOP, HIGH_STOP = 0.08, 0.16
#: Points: of link-filled blocks and of those in boilerplate parts (more than all others together), of a block that isn't
#: short and has links but no stop words, and of a block in a part whose name is doubtful.
LINK_POINTS, PART_POINTS, LIST_POINTS, DOUBT_POINTS = -7, -7, -3, -1
TEXT_POINTS, BOILERPLATE_POINTS = 2, -2

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']+|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}
_SPACE = re.compile(r"\s+")


@dataclass(eq=False)
class Part:
    """An element that may hold no main text; ``within`` is the next such element around it."""

    within: Part | None
    #: Whether the page may still turn out to be all in it, as in a form around the page.
    movable: bool
    marked: bool = True
    weight: int = 0
    holds_content: bool = False


@dataclass(eq=False)
class Block:
    """A block's text and what it stands in."""

    text: str
    in_link: int
    part: Part | None
    content: bool
    heading: bool
    doubtful: bool
    label: str = field(default="")
    #: What the label comes from.
    rule: str = field(default="")

    @property
    def link_density(self) -> float:
        return self.in_link / max(1, len(self.text))

    @property
    def boilerplate(self) -> bool:
        return self.part is not None and self.part.marked

    @property
    def stop_density(self) -> float:
        words = _WORD.findall(self.text.lower())
        return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def attributes(attrs: str) -> dict[str, str]:
    """Names and values of a tag's attributes, read one after the other; of equal names the first counts."""
    out: dict[str, str] = {}
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def name_kind(name: str) -> str:
    """What a class or id says: "part" (a boilerplate part), "doubt" (it may be one) or ""."""
    words = _NAME.findall(name)
    told = [w for w in words if w in BOILERPLATE_NAMES]
    if not told or words[0] in BESIDE:
        return ""
    if all(w in BOILERPLATE_NAMES or w in PLACE_NAMES for w in words) or not SURE_NAMES.isdisjoint(words):
        return "part"
    return "doubt"


def element_kind(tag: str, attrs: str, within_content: bool) -> tuple[str, bool, bool]:
    """("part", "hidden", "doubt" or "", whether the page may be in it all the same, whether it marks content)."""
    found = attributes(attrs)
    role = found.get("role", "").strip().lower()
    content = tag in CONTENT_TAGS or role in CONTENT_ROLES
    if "hidden" in found and found["hidden"].lower() != "until-found" or "style" in found and _HIDDEN_STYLE.search(html_module.unescape(found["style"]).lower()):
        return "hidden", False, content
    if tag == "main" or tag in ("html", "body"):
        return "", False, content
    if tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES or tag == "header" and not within_content:
        return "part", tag == "form" or role == "form", content
    names = html_module.unescape(f"{found.get('class', '')} {found.get('id', '')}").lower().split()
    kinds = {name_kind(x): x for x in names}
    if "part" in kinds:
        return "part", SURE_NAMES.isdisjoint(_NAME.findall(kinds["part"])), content
    return "doubt" if "doubt" in kinds else "", False, content


class _Open:
    """An open element and what holds for all in it."""

    __slots__ = ("content", "doubtful", "heading", "part", "skipped", "tag")

    def __init__(self, tag: str, around: _Open | None):
        self.tag = tag
        self.part, self.content, self.heading, self.doubtful, self.skipped = (around.part, around.content, around.heading, around.doubtful, around.skipped) if around else (None, False, False, False, False)


def blocks_of(page: str) -> tuple[list[Block], list[Part]]:
    """The page's blocks and its boilerplate parts, in order.  Unclosed and wrongly nested elements end where an enclosing one ends."""
    out: list[Block] = []
    parts: list[Part] = []
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}  # where in the stack elements of a name are
    borders: list[int] = []
    last_end: dict[str, int] = {}
    lowered = ""
    text: list[str] = []
    linked = 0
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            joined = _SPACE.sub(" ", "".join(text)).strip()
            text.clear()
            if joined:
                now = stack[-1] if stack else _Open("", None)
                out.append(Block(joined, min(linked, len(joined)), now.part, now.content, now.heading, now.doubtful))
        linked = 0

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            gone = stack.pop()
            places[gone.tag].pop()
            if borders and borders[-1] == len(stack):
                borders.pop()

    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None:
            if stack and stack[-1].skipped:
                continue
            plain = html_module.unescape(m["text"]) if "&" in m["text"] else m["text"]
            text.append(plain)
            if places.get("a"):
                linked += len(_SPACE.sub(" ", plain).strip())
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if not m["close"]:
            if tag in RAW:
                if last_end.get(tag, at) >= at:  # else the element has no end after this place
                    if end := _RAW_END[tag].search(page, at):
                        at = end.end()
                    else:
                        last_end[tag] = -1
                        if tag != "iframe":
                            at = size
                text.append(" ")
                continue
            if tag in SKIPPED:
                if tag not in last_end:
                    lowered = lowered or page.lower()
                    last_end[tag] = lowered.rfind(f"</{tag}") if len(lowered) == size else size
                text.append(" ")
                if last_end[tag] < at or m["attrs"].endswith("/"):
                    continue  # it is never closed: what follows isn't in it
            if tag in BLOCKS:
                flush()
                if stack and stack[-1].tag == "p":
                    close(len(stack) - 1)
            elif tag == "br":
                text.append(" ")
            if tag in VOID or m["attrs"].endswith("/") and tag not in BLOCKS:
                continue
            if tag in ("li", "td", "th", "tr", "dt", "dd", "option", "a") and stack and stack[-1].tag == tag:
                close(len(stack) - 1)
            now = _Open(tag, stack[-1] if stack else None)
            kind, movable, content = element_kind(tag, m["attrs"], now.content) if m["attrs"] or tag in BOILERPLATE_TAGS or tag in CONTENT_TAGS or tag == "header" else ("", False, False)
            if kind in ("part", "hidden"):
                now.part = Part(now.part, movable)
                parts.append(now.part)
            if (content or tag == "h1") and now.part is not None:
                now.part.holds_content = True
            now.content |= content
            now.heading |= tag in HEADINGS
            now.doubtful |= kind == "doubt"
            now.skipped |= tag in SKIPPED
            places.setdefault(tag, []).append(len(stack))
            if tag in BORDERS:
                borders.append(len(stack))
            stack.append(now)
        else:
            if tag in BLOCKS:
                flush()
            if places.get(tag):
                where = places[tag][-1]
                if tag in BLOCKS or not borders or where > borders[-1]:
                    close(where)
    flush()
    return out, parts


def weigh_parts(blocks: list[Block], parts: list[Part]) -> None:
    """Takes the mark off parts that hold nearly all of the page's text, such as a form around the page.

    A part is set free if it is movable, holds a heading, article or main element
    (or nothing has text beside it), and the text-like blocks in no part have less
    than a quarter of the characters of those in it, which are ``LONG`` at least.
    """
    if not any(p.movable for p in parts):
        return
    beside = 0
    for b in blocks:
        if b.link_density <= MAX_LINK_DENSITY and (len(b.text) >= LONG or b.stop_density >= LOW_STOP):
            if b.part is None:
                beside += len(b.text)
            else:
                b.part.weight += len(b.text)
    for p in reversed(parts):  # parts come after those around them
        if p.within is not None:
            p.within.weight += p.weight
            p.within.holds_content |= p.holds_content
    for p in parts:
        free = p.movable and p.weight >= LONG and (p.holds_content or not beside) and 4 * beside < p.weight
        p.marked = not free or p.within is not None and p.within.marked


def points(b: Block) -> tuple[int, str]:
    """The block's points, and the rule that weighs most in them."""
    n, density = len(b.text), b.stop_density
    stop = 2 if density >= HIGH_STOP else 1 if density >= LOW_STOP else 0
    long = 2 if n >= LONG else 0
    total, rule = stop + long + b.content, "density" if stop >= long else "length"
    if b.link_density > MAX_LINK_DENSITY and not (b.content and n < SHORT):
        total, rule = total + LINK_POINTS, "links"
    elif b.in_link and not density and n >= SHORT:
        total, rule = total + LIST_POINTS, "links"
    if b.boilerplate:
        total, rule = total + PART_POINTS, "part" if rule != "links" else rule
    return total + (DOUBT_POINTS if b.doubtful else 0), rule


def classify(blocks: list[Block], parts: list[Part]) -> None:
    """Sets each block's label to "text" or "boilerplate", and the rule that it comes from."""
    weigh_parts(blocks, parts)
    scores = []
    for b in blocks:
        score, b.rule = points(b)
        scores.append(score)
        if score <= BOILERPLATE_POINTS:
            b.label = "boilerplate"
        elif score >= TEXT_POINTS and len(b.text) >= SHORT:
            b.label = "text"
    # blocks in boilerplate parts say nothing of the blocks beside them
    decided = [(i, b.label) for i, b in enumerate(blocks) if b.label and not b.boilerplate]
    places = [i for i, _ in decided]
    marked = any(b.content for b in blocks)
    for i, b in enumerate(blocks):
        if b.label:
            continue
        k = bisect.bisect(places, i)
        left, right = decided[k - 1] if k else None, decided[k] if k < len(decided) else None
        around = {x[1] for x in (left, right) if x}
        b.rule = "neighbours"
        if not around or scores[i] > 0 and len(b.text) >= SHORT and "text" in around or b.heading and right and right[1] == "text":
            b.label = "text"
        elif len(around) == 1:
            b.label = around.pop()
        elif marked:  # the element around it decides between neighbours that differ
            b.label = "text" if b.content else "boilerplate"
        else:  # the nearer one; of two as near the one before
            b.label = left[1] if i - left[0] <= right[0] - i else right[1]


def labelled(page: str | None) -> list[Block]:
    """The blocks of a page with their labels."""
    blocks, parts = blocks_of(page or "")
    classify(blocks, parts)
    return blocks


def main_text(page: str | None) -> str:
    """The page's main text, a line for each block; empty if there is none."""
    return "\n".join(b.text for b in labelled(page) if b.label == "text")


def rules_used(page: str | None) -> Counter[tuple[str, str]]:
    """How many of a page's blocks each rule gave each label."""
    return Counter((b.rule, b.label) for b in labelled(page))


def extract_pages(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` without the column ``html`` and with a string column ``text``: the main text of each page.

    A null or empty page has an empty text; whole pages are read, however long.
    Rows are independent: repeated rows give repeated results, an empty table an
    empty one.  A column already called ``text`` is replaced, others are kept.
    """
    keep = [c for c in pages.columns if c not in (html, text)]
    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, html):
                texts = [main_text(h) for h in batch.column(batch.schema.get_field_index(html)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(texts, pa.string())], [*keep, text])

    return pages.select(*keep, html).mapInArrow(run, schema)


def extraction_report(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, url, its main text and the text's code points.

    Null ids and addresses stay null; a null page has an empty text and 0 code
    points; repeated rows give repeated rows, an empty table an empty one; other
    columns, whatever their names, aren't read.
    """
    return extract_pages(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
