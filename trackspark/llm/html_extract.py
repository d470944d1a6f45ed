"""Main text of web pages by tag-path ratios.

A page is read as a run of blocks, each a leaf of a root-to-leaf path of tags with their attributes. Equal
paths are one path. Then, on every page alike:

* aggregate: per path the text outside links and its punctuation marks over the path's blocks, and the
  same for all that lies below each inner path;
* smooth: a path's own ratios count half, those of the path above it a quarter, and so on upward (below
  ``body``), so that a heading among paragraphs is read with them;
* fuse: text ratio x punctuation ratio x share of text outside links x weight among the parts beside it
  (its text against the largest of them, the root of that inside an article; parts inside a part whose own
  paragraphs are its largest, and headings, weigh as it does) x names;
* threshold: paths count that reach ``strength`` of the page's highest value.

Names (tags, roles, class and id tokens that say what a part is) are one factor of the product, and a heavy one:
a named path stays only where its value is some thirteen times that of every other path. On pages whose articles
are short against a footer or an advert names decide; elsewhere the ratios alone give the same text. Parts that a
browser doesn't show are no text.

A page is a row of its own, so pages are extracted inside their partition, without a shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import name

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select object canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split()
)
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table".split())
ROOTS = frozenset("#page html body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words that name what is not content, as tags, roles, or as the last word of a class or id token.
NOT_CONTENT = frozenset(
    "nav navigation navbar menu menubar breadcrumb breadcrumbs toolbar pagination pager footer foot contentinfo copyright "
    "legal aside sidebar complementary widget related recommended recommendations more notice notices cookie cookies consent "
    "gdpr alert alertdialog dialog modal popup overlay banner newsletter subscribe subscription signup login paywall ad ads "
    "adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted form search comment "
    "comments commentlist disqus respond discussion replies share sharing social skip".split()
)
#: Words that do so outside an article only: an article may have a header of its own.
NOT_OUTSIDE = frozenset("header masthead topbar head".split())
ARTICLE = frozenset("article main".split())
#: Words after the naming one (``cookie-bar``), and words before a name that make it an attribute (``with-sidebar``).
CARRIERS = frozenset("area bar block box container inner list outer section slot unit wrap wrapper".split())
ATTRIBUTIVE = frozenset("category format has is no tag type with without".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: What a naming word leaves of a path's value, and what being outside the page's article does.
NAMED, OUTSIDE = 1 / 128, 1 / 8

# A tag ends at the first > outside quotes; where quotes don't pair up, at the first one, or with the page.
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+>|[^>]*(?:>|\Z))", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def naming_word(token: str) -> str:
    """The word of a class or id token that says what the part is: its last one, carriers left aside."""
    words = [w.lower() for w in NAME_WORD.findall(token)]
    while len(words) > 1 and words[-1] in CARRIERS:
        words.pop()
    return "" if not words or len(words) > 1 and words[0] in ATTRIBUTIVE else words[-1]


class Path:
    """A path of the page: the text of its blocks, then of all below it."""

    __slots__ = ("up", "tag", "below", "shown", "article", "factor", "n", "chars", "plain", "marks", "all", "largest")

    def __init__(self, tag: str, attributes: str, up: Path | None):
        named, shown, is_article = {tag}, True, tag in ARTICLE
        for m in ATTRIBUTE.finditer(attributes) if attributes else ():
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "role"):
                named |= {naming_word(t) for t in value.split()}
                is_article = is_article or key == "role" and value.lower() in ARTICLE
            elif key == "style" and NOT_SHOWN.search(value) or key == "aria-hidden" and value == "true":
                shown = False
        if attributes and re.search(r"(?:^|\s)hidden(?:\s|$)", ATTRIBUTE.sub(" ", attributes)):
            shown = False
        self.up, self.tag, self.below = up, tag, {}
        self.shown = shown and (up is None or up.shown) and not (tag == "head" and up is not None and up.tag == "html")
        self.article = is_article or up is not None and up.article
        self.factor = 1.0 if up is None else up.factor
        if tag not in ROOTS and not is_article and (named & NOT_CONTENT or not self.article and named & NOT_OUTSIDE):
            self.factor *= NAMED
        self.n = self.chars = self.plain = self.marks = 0  # of own blocks: number, characters, those outside links, marks
        self.all = [0, 0, 0, 0]  # the same of all blocks below too
        self.largest = 0  # of the parts: the paths below, and what stands beside them, own leaves taken together

    def child(self, tag: str, attributes: str) -> Path:
        key = (tag, attributes)
        found = self.below.get(key)
        if found is None:
            found = self.below[key] = Path(tag, attributes, self)
        return found


def blocks(page: str) -> Iterator[tuple[Path, str, int]]:
    """(path, text, characters inside links) of each run of text between block tags."""
    open_: list[Path] = [Path("#page", "", None)]
    text: list[str] = []
    at = links = in_link = 0

    def close_to(k: int) -> None:
        del open_[max(k, 1) :]

    def flush() -> tuple[Path, str, int] | None:
        nonlocal text, links
        whole = " ".join(html.unescape("".join(text)).split())
        found = (open_[-1], whole, min(links, len(whole))) if whole else None
        text, links = [], 0
        return found

    while at < len(page):
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        text.append(piece)
        if in_link:
            links += len(piece.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            text.append(" ")
        elif tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
        elif tag in VOID:
            text.append(" ")
        else:
            if found := flush():
                yield found
            in_link = 0
            if closing:
                k = next((i for i in range(len(open_) - 1, 0, -1) if open_[i].tag == tag), 0)
                if k:
                    close_to(k)
                continue
            shut = SAME_CLOSES.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag in shut:
                    close_to(i)
                    break
                if open_[i].tag in SCOPE or open_[i].tag in ("div", "article", "section", "body") and tag != "p":
                    break
            attributes = m[3].removesuffix(">").strip()
            if not attributes.endswith("/"):
                open_.append(open_[-1].child(tag, attributes))
    if found := flush():
        yield found


def path_values(found: list[tuple[Path, str, int]], names: bool = True) -> dict[Path, float]:
    """The fused value of each path that has blocks. names: whether names count."""
    paths: dict[Path, None] = {}  # in the order in which they first hold text; above each, the paths up to the page
    for path, text, links in found:
        path.n += 1
        path.chars += len(text)
        path.plain += len(text) - links
        path.marks += len(PUNCTUATION.findall(text)) * (1 - links / len(text))
        chain, p = [], path
        while p is not None and p not in paths:
            chain.append(p)
            p = p.up
        paths.update(dict.fromkeys(reversed(chain)))
    down = list(paths)  # each after the path above it
    for p in reversed(down):
        for k, x in enumerate((p.n, p.chars, p.plain, p.marks)):
            p.all[k] += x
        if p.up is not None:
            for k in range(4):
                p.up.all[k] += p.all[k]
    # parts of a path: paths below it that hold paths themselves, and its own text with that of its leaves
    inner = {p.up or p for p in down}
    leaves = dict.fromkeys(down, 0)
    for p in down:
        if p in inner:
            leaves[p] += p.plain
        if p.up is not None and p not in inner:
            leaves[p.up] += p.plain
    for p in down:
        p.largest = max(p.largest, leaves[p])
        if p.up is not None and p in inner:
            p.up.largest = max(p.up.largest, p.all[2])
    article = any(p.article for p in down)
    above: dict[Path, tuple[float, float, float]] = {}  # weight, smoothed text and punctuation ratios of inner paths
    values = {}
    for p in down:
        root = p.tag in ROOTS
        weight, chars, marks = above[p.up] if p.up is not None else (1.0, 0.0, 0.0)
        if p in inner:
            if p.up is not None:
                is_text = p.up.tag not in ROOTS and leaves[p.up] >= p.up.largest
                share = p.all[2] / p.up.largest if p.up.largest else 1.0
                weight *= 1.0 if is_text else math.sqrt(share) if p.up.article else share
            n, _, plain, m = p.all
            near = not root and p.up is not None and p.up.tag not in ROOTS
            above[p] = (weight, 0.0, 0.0) if root else (weight, (plain / n + chars) / 2 if near else plain / n, (m / n + marks) / 2 if near else m / n)
        if p.n:
            holder = p if p in inner else p.up  # the path whose parts the blocks belong to
            share = leaves[holder] / holder.largest if holder.largest else 0.0
            if p.tag in HEADINGS and holder.tag not in ROOTS and holder.largest:
                share = 1.0
            part = (math.sqrt(share) if holder.article else share) * above[holder][0]
            r, q = p.plain / p.n, p.marks / p.n
            if holder.tag not in ROOTS:
                r, q = (r + above[holder][1]) / 2, (q + above[holder][2]) / 2
            value = math.log2(1 + r) * math.log2(2 + q) * p.plain / p.chars * part
            if names:
                value *= p.factor * (OUTSIDE if article and not p.article else 1.0)
            values[p] = value
    return values


def main_text(page: str, strength: float = 0.1, names: bool = True) -> str:
    """Content blocks of a page in page order, joined by one space."""
    found = [b for b in blocks(page) if b[0].shown]
    values = path_values(found, names)
    least = strength * max(values.values(), default=0.0)
    return " ".join(text for p, text, _ in found if values[p] > 0 and values[p] >= least)


def extract_text(df: DataFrame, html_col: str = "html", *, strength: float = 0.1, text_name: str = "text", carry: bool = True) -> DataFrame:
    """One output row per input row: the input columns (without ``html_col`` if not ``carry``), then the
    main text and n_chars, its code points.

    strength: a path counts from this share of the page's highest value on, so the strongest path always
    counts. Null or empty html, or a page without text outside links: an empty text. Equal rows get equal
    texts. Empty table: no rows. Broken markup: tags that are not closed end with what holds them. A
    computed column replaces an input column of its name.
    """
    keep = [c for c in df.columns if c.lower() not in (text_name.lower(), "n_chars") and (carry or c != html_col)]
    packed = df.select(F.struct(*[F.col(name(c)) for c in keep]).alias("__row"), F.col(name(html_col)).cast("string").alias("__html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", strength) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["__row", "__text"])

    out = packed.mapInArrow(extract, packed.select("__row").schema.add("__text", "string"))
    return out.select(*[F.col(f"__row.{name(c)}").alias(c) for c in keep], F.col("__text").alias(text_name), F.length("__text").cast("long").alias("n_chars"))
