"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block-level tags. The first pass decides what it can from where a
block stands, its link density, its length and its density of stop words. Where most of a page does
not read like one of the languages whose stop words are listed, length and links decide alone. Short
blocks that stay ambiguous then take the label of the nearest decided neighbours. Where a page marks
its article, blocks outside are not main text, and ambiguous blocks inside look for neighbours inside
only, or count as main text.

Where a block stands: menus are never main text, nor is what buttons, pictures and the like hold, which stand in a
line without ending it; formulas are text. Forms, headers, and elements that a word of their class, id or
role speaks against, are not unless they hold most of the page's text; in a marked article such a word
beside another ("share-price") only takes from the element that the article speaks for it. After a heading such
as "3 comments" come readers' comments, as far as that heading's element goes. Outside of a marked article, a short block
of consent words about cookies is a notice if it has a link or a button, or stands at the page's top or bottom.

Cases: a null, empty or textless page gives an empty text; repeated rows each keep a row; other
columns are left out. Broken markup is read as far as it goes: what opens with < and a letter is a
tag, an unclosed comment or script runs to the end, and unmatched end tags are ignored, in time that
grows with the page's length alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cueloom.llm.common import small_batches

# The names of HTML elements and frequent function words of four languages.
RAW = frozenset("script style textarea title xmp noframes noembed iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("head nav footer aside menu dialog".split())
#: Controls and pictures: they stand in a line of text without ending it, and what they hold is not main text.
CONTROLS = frozenset("button select svg object audio video canvas".split())
SELDOM = frozenset("form fieldset".split())
#: Words of a class, id or role that say that an element is not main text.
NEVER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus reply replies "
    "respond related recommended recommendations share sharing social widget widgets toolbar pagination pager search copyright "
    "contentinfo complementary dialog form skip hidden".split()
)
HEADER_WORDS = frozenset(["header", "topbar"])
#: Words of a class that name its form. In a marked article one that speaks against an element has to stand alone or with these;
#: beside any other word ("share-price") it is a doubt, which the text decides.
FORM_WORDS = frozenset(
    "area article articles bar block body bottom box btn button buttons card cards col column container content count counter cta desktop el entry "
    "first float footer form group header holder icon icons in inline inner item items js last layout left line link links list main mobile module new "
    "outer panel part post posts primary right row secondary section slot small sticky text title tool tools top unit view wrap wrapper".split()
)
#: With one of these, a class tells of a state of the page ("has-sidebar", "comments-open").
STATE_WORDS = frozenset("has is no not with without open opened closed enabled disabled on off target".split())
#: Headings over readers' comments, and words of notices about cookies of which a notice has two.
COMMENT_HEADING = re.compile(
    r"(\d+\s+)?((reader|user)s?\W*\s+)?(comments?|responses?|replies|kommentare?|leserkommentare|commentaires?|comentarios?|leave a (reply|comment)|post a comment|join the (discussion|conversation)|комментарии|评论)(\s*\W?\s*\d+\W?)?\W*",
    re.I,
)
CONSENT_WORDS = re.compile(r"\b(cookies?|consent|accept|agree|privacy policy|akzeptieren|zustimmen|datenschutz|accepter|confidentialité|aceptar|privacidad)\b", re.I)
NOTICE_LONGEST = 400
#: An element that holds more of the page's text than this share is no aside, whatever it is called.
MOST = 0.6
STOP_WORDS = frozenset(
    "a about all also an and are as at be been but by can for from had has have he her his if in into is it its not of on one or "
    "our she so that the their there they this to was we were what when which who will with would you "
    "aber als am auch auf aus bei das dass dem den der des die durch ein eine einen einer es für hat ich ihr im ist mit nach nicht "
    "noch nur oder sich sie sind so über um und von vor war wie wird zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa "
    "se ses son sont sur un une vous "
    "al con como del el ella ellos era esta este ha la las lo los más me mi muy no para pero por se sin su sus también te una uno "
    "y ya".split()
)
#: Shorter blocks are ambiguous; longer ones than the second need a lower density of stop words.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.2, 0.3
LINKS_MOST, LINKS_ALONE = 0.5, 0.2

_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|itemprop|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|$)""", re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_WORD = re.compile(r"[^\W\d_]+")
_WIDE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    element: int  # the element that it stands in
    group: int = 0  # the nearest element around it that holds blocks
    heading: bool = False
    article: int = 0  # number of the article or main element it stands in, or 0
    never: bool = False  # inside what is not main text
    doubt: bool = False  # a class raises a doubt, so the article around does not speak for it
    control: bool = False  # a button or the like stands in it
    label: bool | None = None


@dataclass
class _Element:
    name: str
    parent: int
    never: bool  # it or one around it is never main text
    seldom: bool  # by itself: not main text unless it holds most of it
    article: int
    group: int
    doubt: bool = False
    mute: bool = False  # a control, or inside one


@dataclass
class _Reader:
    """Blocks of a page in order."""

    blocks: list[Block] = field(default_factory=list)
    elements: list[_Element] = field(default_factory=lambda: [_Element("", 0, False, False, 0, 0)])
    stack: list[int] = field(default_factory=lambda: [0])
    open_names: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    muted: list[str] = field(default_factory=list)
    control: bool = False
    in_link: bool = False
    articles: int = 0

    def text(self, raw: str) -> None:
        if "&" in raw:
            raw = unescape(raw)
        if self.elements[self.stack[-1]].mute:
            self.muted.append(raw)
            return
        self.parts.append(raw)
        if self.in_link:
            self.links.append(raw)

    def end_block(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                at = next(k for k in reversed(self.stack) if not self.elements[k].mute)
                top = self.elements[at]
                self.blocks.append(Block(" ".join(words), len(" ".join("".join(self.links).split())), at, top.group, top.name in _HEADINGS, top.article, top.never, top.doubt, self.control))
            self.parts.clear()
            self.links.clear()
        self.control = False

    def open_control(self, name: str) -> None:
        """A control, or an element inside one: no block ends."""
        parent = self.stack[-1]
        top = self.elements[parent]
        self.stack.append(len(self.elements))
        self.elements.append(_Element(name, parent, True, False, top.article, top.group, top.doubt, True))
        self.open_names[name] += 1

    def end_controls(self, control: int) -> None:
        """After the end of a control (its element): one that nothing stood before is a block of its own, which is never main text."""
        if self.elements[self.stack[-1]].mute:
            return
        words = "".join(self.muted).split()
        self.muted.clear()
        if words and not "".join(self.parts).strip():
            e = self.elements[control]
            self.blocks.append(Block(" ".join(words), 0, control, e.group, False, e.article, True))
        self.control = True

    def close_tag(self, name: str) -> None:
        """An end tag of a block, or of a control. Inside a control only what was opened there ends without ending a block."""
        muted = self.elements[self.stack[-1]].mute
        if not muted:
            if name not in CONTROLS:
                self.end_block()
                self.close(name)
            return
        if not self.open_names[name]:
            return
        k = next(k for k in range(len(self.stack) - 1, -1, -1) if self.elements[self.stack[k]].name == name)
        if not self.elements[self.stack[k]].mute:
            self.end_block()
        control = next(at for at in self.stack if self.elements[at].mute)
        self.close(name)
        self.end_controls(control)

    def close(self, name: str, until: frozenset[str] = frozenset()) -> None:
        """Closes the innermost open element of the name, unless one of ``until`` stands before it."""
        if not self.open_names[name]:
            return
        k = len(self.stack) - 1
        while (found := self.elements[self.stack[k]].name) != name:
            if found in until:
                return
            k -= 1
        for at in self.stack[k:]:
            self.open_names[self.elements[at].name] -= 1
        del self.stack[k:]

    def open(self, name: str, attributes: str) -> None:
        if self.elements[self.stack[-1]].mute:
            if name not in VOID:
                self.muted.append(" ")
                self.open_control(name)
            return
        self.end_block()
        self.close("p", _P_ENDS)
        if name == "li":
            self.close("li", _LI_ENDS)
        elif name in ("dt", "dd"):
            self.close("dt", _DL_ENDS)
            self.close("dd", _DL_ENDS)
        if name in VOID:
            return
        parent = self.stack[-1]
        top = self.elements[parent]
        never, article = top.never or name in NEVER, top.article
        seldom, doubt = name in SELDOM or (name == "header" and not article), top.doubt
        if attributes and not never:
            of: dict[str, str] = {}
            for key, a, b, c in _ATTRIBUTE.findall(attributes):
                of.setdefault(key.lower(), a or b or c)
            role = of.get("role", "").lower()
            if name not in ("html", "body"):
                never = "hidden" in of or of.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", of.get("style", ""), re.I))
                if name not in ("article", "main"):
                    tokens = [word for k in ("class", "id", "role") for word in of.get(k, "").split()]
                    against = [t for t in tokens if _speaks(t, NEVER_WORDS if article else NEVER_WORDS | HEADER_WORDS)]
                    sure = [t for t in against if not article or _words(t) <= NEVER_WORDS | FORM_WORDS]
                    seldom = seldom or (not article and role == "banner") or bool(sure)
                    doubt = doubt or bool(against)
            if not article and (role in ("main", "article") or of.get("itemprop", "").lower() == "articlebody"):
                self.articles += 1
                article = self.articles
        if name in ("article", "main") and not article:
            self.articles += 1
            article = self.articles
        number = len(self.elements)
        self.elements.append(_Element(name, parent, never, seldom, article, top.group if name in _LEAVES else number, doubt))
        self.stack.append(number)
        self.open_names[name] += 1

    def settle(self) -> None:
        """Decides which seldom elements are main text after all, now that all text is known."""
        sizes, marked = [0] * len(self.elements), [0] * len(self.elements)
        for b in self.blocks:
            if not b.never:
                sizes[b.element] += len(b.text)
                marked[b.element] += bool(b.article)
        for k in range(len(self.elements) - 1, 0, -1):
            sizes[self.elements[k].parent] += sizes[k]
            marked[self.elements[k].parent] += marked[k]
        never = [False] * len(self.elements)
        for k, e in enumerate(self.elements):
            # One that leaves a marked article outside is no article itself.
            most = sizes[k] > MOST * sizes[0] and (e.article > 0 or marked[k] == marked[0])
            never[k] = never[e.parent] or e.never or (e.seldom and not most)
        for b in self.blocks:
            b.never = never[b.element]


def _words(token: str) -> set[str]:
    """The words of a class, id or role, without numbers."""
    return {w for w in re.split(r"[\W_\d]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()) if w}


def _speaks(token: str, against: frozenset[str]) -> bool:
    """Whether a class, id or role says that an element is not main text."""
    words = _words(token)
    return not words.isdisjoint(against) and words.isdisjoint(STATE_WORDS)


_P_ENDS = frozenset("div section article main aside nav header footer form td th li blockquote table body".split())
_LI_ENDS = frozenset("ul ol menu".split())
_DL_ENDS = frozenset(["dl"])
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEAVES = _HEADINGS | frozenset("p li dt dd td th blockquote pre".split())


def read_blocks(html: str) -> list[Block]:
    """The blocks of a page in page order."""
    page = _Reader()
    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            page.text(html[at:])
            break
        if start > at:
            page.text(html[at:start])
        following = html[start + 1 : start + 2]
        if following in ("!", "?"):
            if html.startswith("<!--", start):
                # A comment may be empty: <!--> and <!---> end at once.
                end = start + 5 if html.startswith("<!-->", start) else start + 6 if html.startswith("<!--->", start) else html.find("-->", start + 4) + 3
                at = end if end > 2 else size
            else:
                end = html.find(">", start)
                at = end + 1 if end >= 0 else size
            continue
        tag = _TAG.match(html, start)
        if not tag:
            if following == "/" or following.isascii() and following.isalpha():  # cut off inside a tag, or no tag at all
                end = html.find(">", start)
                at = end + 1 if end >= 0 else size
            else:
                page.text("<")
                at = start + 1
            continue
        at = tag.end()
        closing, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        name = name.lower()
        if name in RAW and not closing:
            end = _RAW_END[name].search(html, at)
            at = end.end() if end else size
        elif name in BLOCKS:
            if closing:
                page.close_tag(name)
                page.in_link = False
            else:
                page.open(name, attributes)
        elif name in CONTROLS:
            if closing:
                page.close_tag(name)
            elif not attributes.endswith("/"):
                page.open_control(name)
        elif name == "br":
            page.text(" ")
        elif name == "a":
            page.in_link = not closing
    page.end_block()
    page.settle()
    _end_with_comments(page)
    return page.blocks


def _end_with_comments(page: _Reader) -> None:
    """What follows a heading of comments, as far as its element goes, is never main text."""
    around = -1  # the element whose rest is comments
    for b in page.blocks:
        if around >= 0:
            at = b.element
            while at > around:
                at = page.elements[at].parent
            if at == around:
                b.never = True
                continue
            around = -1
        if (b.heading or len(b.text) < 40) and COMMENT_HEADING.fullmatch(b.text) and not b.never:
            b.never, around = True, b.group


def _width(text: str) -> float:
    """Characters, of which one of a script without spaces counts as three."""
    return len(text) + 2 * len(_WIDE.findall(text))


def _notice(blocks: list[Block], at: int) -> bool:
    """A short block about cookies and consent, outside of any marked article, where a notice would stand:
    with a link or a control in it or next to it, or at the page's top or bottom."""
    b = blocks[at]
    if b.article or len(b.text) > NOTICE_LONGEST:
        return False
    words = {w.lower().replace("cookies", "cookie") for w in CONSENT_WORDS.findall(b.text)}
    if "cookie" not in words or len(words) + b.control < 2:
        return False
    near = blocks[max(0, at - 1) : at] + blocks[at + 1 : at + 2]
    return bool(b.linked or b.control) or min(at, len(blocks) - 1 - at) < 2 or any(n.never and n.group == b.group for n in near)


def classify(blocks: list[Block]) -> None:
    """Labels every block: main text or not."""
    marked = any(b.article and not b.never for b in blocks)
    density = []
    for k, b in enumerate(blocks):
        words = _WORD.findall(b.text.lower())
        density.append(sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0)
        if b.never or (marked and not b.article) or b.linked > LINKS_MOST * len(b.text) or _notice(blocks, k):
            b.label = False
    able = [(b, d) for b, d in zip(blocks, density, strict=True) if b.label is None]
    long = [(len(b.text), d) for b, d in able if len(b.text) >= SHORT]
    listed = 2 * sum(n for n, d in long if d >= STOP_LOW) > sum(n for n, _ in long)
    for b, d in able:
        if not listed:
            if _width(b.text) >= SHORT:
                b.label = b.linked <= LINKS_ALONE * len(b.text)
        elif len(b.text) >= SHORT:
            if d >= (STOP_LOW if len(b.text) > LONG else STOP_HIGH):
                b.label = True
            else:
                # Long text of few stop words is main text only where the page says so.
                b.label = True if b.article and not b.doubt else False if d < STOP_LOW and (b.linked or len(b.text) <= LONG) else None
    decided = [b.label for b in blocks]
    # Nearest decided neighbours, in the same article where the page marks one.
    before: list[tuple[int, bool] | None] = []
    for k, (b, label) in enumerate(zip(blocks, decided, strict=True)):
        last = before[-1] if before and (not marked or blocks[k - 1].article == b.article) else None
        before.append(last if label is None else (k, label) if not marked or not b.never else last)
    after: list[tuple[int, bool] | None] = []
    for k in range(len(blocks) - 1, -1, -1):
        b, label = blocks[k], decided[k]
        last = after[-1] if after and (not marked or blocks[k + 1].article == b.article) else None
        after.append(last if label is None else (k, label) if not marked or not b.never else last)
    after.reverse()
    for k, b in enumerate(blocks):
        if b.label is None:
            if b.heading and after[k]:  # a heading belongs to what follows
                b.label = after[k][1]
                continue
            near = [(abs(k - x[0]) + 0.5 * (blocks[x[0]].group != b.group), x[1]) for x in (before[k], after[k]) if x]
            least = min((x[0] for x in near), default=0)
            labels = {label for distance, label in near if distance == least}
            # Neighbours that are as near and differ, or none at all: it depends on the article.
            b.label = labels.pop() if len(labels) == 1 else bool(b.article and not b.doubt)


def main_text(html: str | None) -> str:
    """Blocks of main text in page order, joined by an empty line."""
    if not html:
        return ""
    blocks = read_blocks(html)
    classify(blocks)
    return "\n\n".join(b.text for b in blocks if b.label)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row of ``pages``."""
    small_batches(pages.sparkSession)
    fields = [pages.schema[key], pages.schema[url]]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def each(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            own = [c.cast(k) for c, k in zip(batch.columns[:2], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return pages.select(key, url, F.col(html).cast("string").alias("html")).mapInArrow(each, schema)
