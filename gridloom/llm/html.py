"""Main text of HTML pages by tag-path ratios.

Each text node belongs to a root-to-leaf tag path: the tags of its elements down to the block that
holds it, with their classes and ids. Per path the characters outside links and the punctuation marks
of its nodes are summed; characters per node (text ratio) and marks per node (punctuation ratio) are
smoothed over the paths in page order and fused by their product, with a weak prior for paths through
article or main. Paths over a threshold are content paths, and their nodes are content.

Elements that HTML itself names as no content (navigation, forms, scripts, hidden ones ...) are left
out before; so are containers all words of whose class, id or role mark boilerplate ("cookie-notice"),
unless they hold an article or nothing else is left.

The deepest element with nearly all of the content nodes' text is the container. What stands in it
beside content nodes belongs to it (headlines, short paragraphs, lists, tables), but for lists of
links; such a list right under a heading of the text stays ("Sources"), unless the heading's words mark
boilerplate ("Related stories"), which goes with its list. An article or main around it is the container instead, if it holds it; otherwise, at each
parent, siblings next to it that are headings, paragraphs or mostly content are taken as well, so that
headline and intro before a long nested block are not lost, up to the first sibling of another kind.

Defined results: null html is empty and gives an empty text; a page without content gives an empty
text; unclosed or truncated markup is closed where the next block or the page ends; a tag with a quote
that has no partner ends at the next >; a raw element
(script, svg ...) that closes itself is empty; repeated rows give repeated rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXTS = "page_id long, url string, text string, n_chars long"

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var img wbr br".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table tr tbody thead div article section main body td th aside nav form blockquote".split())
RAW = frozenset("script style textarea title noscript iframe svg template".split())
UNSEEN = frozenset("script style template svg title".split())
SKIPPED = frozenset("nav aside form script style noscript template head title iframe svg button select option textarea dialog menu object canvas".split())
CONTAINERS = frozenset("div section ul ol dl aside header footer nav table form center details".split())
SURE = frozenset("article main".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEADS = HEADINGS | {"p"}
# Words that mark boilerplate in a class, id or role, and words that say nothing beside them.
MARKS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead topbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login paywall share sharing social related recommended teaser teasers widget "
    "comment comments reply replies discussion disqus respond complementary contentinfo search copyright disclaimer hidden".split()
)
NEUTRAL = frozenset("a area article articles bar block body box container content desktop feed form global group inner item items left link links list main mobile module news outer page post posts primary reader readers right row secondary section site slot stories story text thread top user users wrap wrapper".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|[^>\"'])*(?=>|\Z)|[^>]*)(?:>|\Z)|(?P<text>[^<]+|<)", re.S)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)(?!\s*=\s*["']?until-found)|aria-hidden\s*=\s*["']?true|style\s*=\s*(?:"[^"]*|'[^']*)(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?、。，…]")

#: The prior of paths through article or main; of the content's text, what the container holds at least; links' share in a list of links.
PRIOR, SHARE, LINKS = 1.5, 0.9, 0.6


@lru_cache(1 << 12)
def _parts(word: str) -> tuple[str, ...]:
    """A word, or the two known words that it is written together of ("commentlist")."""
    if word in MARKS or word in NEUTRAL:
        return (word,)
    for k in range(3, len(word) - 2):
        if word[:k] in MARKS and (word[k:] in NEUTRAL or word[k:] in MARKS) or (word[:k] in NEUTRAL and word[k:] in MARKS):
            return word[:k], word[k:]
    return (word,)


class Page:
    """A page's elements, by number in page order (a parent comes before its children), and its text nodes."""

    def __init__(self, html: str):
        #: Per element: tag, parent, path, whether HTML names it as no content, whether its own names mark it.
        self.tag, self.up, self.path, self.out, self.marked = ["#"], [0], [0], [False], [False]
        #: Whether it stands in an article ("a") or a quotation ("q"), and in a link.
        self.within, self.linked = [""], [False]
        #: (element, block, text), character references decoded; blocks are parted by tags that are not inline.
        self.nodes: list[tuple[int, int, str]] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._read(html)

    def _add(self, tag: str, up: int, attrs: str) -> int:
        names = [((m[2] or m[3] or m[4] or "").lower(), m[1].lower()) for m in _NAMED.finditer(attrs)] if attrs else []
        label = tag + "".join(sorted(f"|{name}" for name, _ in names)) if names else tag
        out = tag in SKIPPED or bool(attrs and _HIDDEN.search(attrs))
        # An article's own header holds its headline, a quotation's footer its source.
        out = out or (tag == "header" and not self.within[up]) or (tag == "footer" and self.within[up] != "q")
        self.tag.append(tag)
        self.up.append(up)
        self.path.append(self.path[up] if tag in INLINE else self._paths.setdefault((self.path[up], label), len(self._paths) + 1))
        self.out.append(out or self.out[up])
        self.marked.append((tag in CONTAINERS or tag == "p") and any(self._marks(token) for name, _ in names for token in name.split()))
        self.within.append("a" if tag in SURE else "q" if tag in ("blockquote", "figure") else "" if tag in ("nav", "aside") else self.within[up])
        self.linked.append(tag == "a" or (tag in INLINE and self.linked[up]))
        return len(self.tag) - 1

    @staticmethod
    def _marks(token: str) -> bool:
        words = [part for w in _WORDS.findall(token) for part in _parts(w)]
        return not MARKS.isdisjoint(words) and all(w in MARKS or w in NEUTRAL for w in words)

    def _read(self, html: str) -> None:
        tags, up = self.tag, self.up
        open_: dict[str, int] = {}  # open elements by tag: a search is made only for what is there
        at, block, place, end = 0, 0, 0, len(html)

        def pop(to: int) -> int:
            nonlocal at
            while at != to:
                open_[tags[at]] -= 1
                at = up[at]
            return at

        while place < end:
            m = _TOKEN.match(html, place)
            place = m.end()
            if (text := m["text"]) is not None:
                self.nodes.append((at, block, unescape(text)))
                continue
            if not m["tag"]:
                continue
            tag = m["tag"].lower()
            if tag not in INLINE and tag not in UNSEEN:
                block += 1
            if m["close"]:
                if open_.get(tag):
                    to = at
                    while tags[to] != tag and not (tags[to] in SCOPES and (tag in INLINE or tag == "p")):
                        to = up[to]
                    if tags[to] == tag:
                        pop(up[to])
                continue
            if tag == "br":
                self.nodes.append((at, block, " "))
            if tag in VOID:
                continue
            attrs = m["attrs"]
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)
                ends = None if attrs.endswith("/") and tag == "svg" else close.search(html, place)
                if ends:
                    place = ends.end()
                elif not attrs.endswith("/"):
                    place = end
                continue
            ends = ("p",) if tag in CLOSES_P else SAME.get(tag, ())
            if any(open_.get(t) for t in ends):
                to = at
                while to and tags[to] not in ends and tags[to] not in SCOPES:
                    to = up[to]
                if tags[to] in ends:
                    pop(up[to])
            at = self._add(tag, at, attrs)
            open_[tag] = open_.get(tag, 0) + 1


def _smooth(values: list[float], width: int = 1) -> list[float]:
    weights = [math.exp(-(k * k) / 2) for k in range(-width, width + 1)]
    out = []
    for i in range(len(values)):
        near = [(values[i + k], w) for k, w in zip(range(-width, width + 1), weights) if 0 <= i + k < len(values)]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def path_sums(page: Page, out: list[bool]) -> dict[int, list[float]]:
    """Per path in page order: characters outside links, punctuation marks, text nodes, and whether it goes through article or main."""
    sums: dict[int, list[float]] = {}
    sure = [False]
    for tag, up in zip(page.tag[1:], page.up[1:]):
        sure.append(tag in SURE or sure[up])
    for at, _, text in page.nodes:
        if out[at] or not text.strip():
            continue
        row = sums.setdefault(page.path[at], [0, 0, 0, sure[at]])
        if not page.linked[at]:
            row[0] += len(text)
            row[1] += len(_PUNCT.findall(text))
        row[2] += 1
    return sums


def content_paths(sums: dict[int, list[float]]) -> dict[int, bool]:
    """Paths whose smoothed and fused ratios pass the threshold, half a deviation under the mean; whether they pass without their neighbours'."""
    if not sums:
        return {}
    text_ratio = _smooth([chars / n for chars, _, n, _ in sums.values()])
    punct_ratio = _smooth([marks / n for _, marks, n, _ in sums.values()])
    fused = [a * (1 + b) * (PRIOR if row[3] else 1) for a, b, row in zip(text_ratio, punct_ratio, sums.values())]
    mean = sum(fused) / len(fused)
    least = mean - math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused)) / 2
    least = min(least, max(fused))
    return {path: chars / n * (1 + marks / n) * (PRIOR if sure else 1) >= least for (path, (chars, marks, n, sure)), score in zip(sums.items(), fused) if score >= least}


def _left_out(page: Page) -> list[bool]:
    """Elements that are no content. Marks count unless a marked element holds an article or nothing else is left."""
    n = len(page.tag)
    holds = [False] * n
    for k in range(n - 1, 0, -1):
        holds[page.up[k]] = holds[page.up[k]] or holds[k] or page.tag[k] in SURE
    marked = [False] * n
    for k in range(1, n):
        marked[k] = marked[page.up[k]] or (page.marked[k] and not holds[k])
    out = [a or b for a, b in zip(page.out, marked)]
    return out if any(not out[at] and text.strip() for at, _, text in page.nodes) else page.out


def extract(html: str) -> str:
    """The main text of a page; see the module's description."""
    page = Page(html)
    out = _left_out(page)
    paths = content_paths(path_sums(page, out))
    if not paths:
        return ""
    n = len(page.tag)
    whole, links, n_links, content, own = ([0] * n for _ in range(5))
    for at, _, text in page.nodes:
        if not out[at] and (size := len(text.strip())):
            whole[at] += size
            if page.path[at] in paths:
                content[at] += size
                own[at] += size if paths[page.path[at]] else 0
            if page.linked[at]:
                links[at] += size
                n_links[at] += 1
    for k in range(n - 1, 0, -1):
        for sums in (whole, links, n_links, content, own):
            sums[page.up[k]] += sums[k]

    children: dict[int, list[int]] = {}
    for k in range(1, n):
        if whole[k] and not out[k]:
            children.setdefault(page.up[k], []).append(k)
    # Down to the deepest element with nearly all content.
    holder = 0
    while True:
        below = [k for k in children.get(holder, ()) if content[k] >= SHARE * content[0] and page.tag[k] not in LEAVES and page.tag[k] not in INLINE]
        if not below:
            break
        holder = below[0]
    kept = [False] * n
    kept[holder] = True
    top = holder
    while top and page.tag[top] not in SURE:
        top = page.up[top]
    if top:
        kept[top] = True
    else:
        at = holder
        while at:
            row = children[page.up[at]]
            here = row.index(at)
            for side in (range(here - 1, -1, -1), range(here + 1, len(row))):
                for k in side:
                    b = row[k]
                    leads = page.tag[b] in LEADS and 2 * links[b] <= whole[b]
                    if not (leads or (2 * own[b] > whole[b] and page.tag[b] != "article")):
                        break
                    kept[b] = True
            at = page.up[at]

    before: dict[int, int] = {}  # the sibling with text before each
    gone: set[int] = set()
    for row in children.values():
        before.update(zip(row[1:], row))
    for k in range(1, n):
        if kept[page.up[k]] and not out[k]:
            # Nothing but links, in a list of them, is no part of the text around it, unless a heading of the text says what they are.
            menu = page.tag[k] in CONTAINERS and not content[k] and n_links[k] > 1 and links[k] > LINKS * whole[k]
            kept[k] = not menu
            head = before.get(k, 0)
            if menu and page.tag[head] in HEADINGS:
                kept[k] = kept[head] and not Page._marks(_text_of(page, head).lower())
                if not kept[k]:
                    gone.add(head)
    for k in range(1, n):
        if k in gone or page.up[k] in gone:
            gone.add(k)
            kept[k] = False
    # Beside the container, an article in a main is a teaser.
    around, at = {0}, holder
    while at:
        around.add(at)
        at = page.up[at]
    state = [0] * n  # 1: within the container, 2: within a teaser
    for k in range(1, n):
        state[k] = 1 if k == holder else state[page.up[k]] or 2 * (page.tag[k] == "article" and k not in around)
        kept[k] = kept[k] and state[k] != 2

    blocks: dict[int, list[str]] = {}
    for at, block, text in page.nodes:
        if kept[at] and not out[at]:
            blocks.setdefault(block, []).append(text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _text_of(page: Page, element: int) -> str:
    """The text of an element whose children are inline."""
    parts = []
    for at, _, text in page.nodes:
        while at != element and page.tag[at] in INLINE:
            at = page.up[at]
        if at == element:
            parts.append(text)
    return "".join(parts)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    for batch in batches:
        column = batch.column("html")
        texts = [extract(column[i].as_py() or "") for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], schema=schema)


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; no shuffle, each page on its own, at most 64 MB of pages at once."""
    return pages.select("page_id", "url", F.col("html")).mapInArrow(_extract_batches, TEXTS)
