"""Main text of web pages by scoring the element tree."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, slices

#: A comment, a declaration, or a tag with its attributes; one cut off by the end of the page counts, too. Quotes matter only behind an equals sign.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: HTML's elements by kind. Without an end tag, those of TEXTUAL run to the page's end; of others only the tag is dropped.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXTUAL = frozenset("script style textarea title iframe noembed noframes xmp".split())
RAW = TEXTUAL | frozenset("noscript template select svg object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption menu search".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag that ends open elements of the kinds named, up to a fence: the nearest one, or all of them.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
ENDS_ALL = frozenset(("tr", "tbody"))
FENCES = frozenset("ul ol dl table body html article section div".split())
#: Elements that never hold the article's text.
ASIDE = frozenset("nav footer aside form button menu dialog search fieldset".split())
#: Words of which names of class, id or role are made that say as much.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners sponsor sponsors sponsored promo promos promotion promotions cookie cookies consent gdpr notice notices alert alerts comment comments commentlist disqus respond replies sidebar sidebars side nav navbar navigation menu menus breadcrumb breadcrumbs footer share sharing social related recommend recommended recommendation recommendations subscribe newsletter signup login popup modal overlay widget widgets pagination pager skip toolbar complementary contentinfo search".split()
)
#: Of these, words that name other things as well ("side-effects", "social-policy"): a name that has one and no stronger word
#: counts if its other words are unwanted, too, or parts of a page.
WEAK = frozenset("side social search share sharing related notice notices alert alerts menu menus skip promotion promotions navigation modal banner banners sponsor sponsors subscribe recommend".split())
PARTS = frozenset(
    "bar bars box boxes list lists link links area areas wrap wrapper container block blocks panel panels section item items button buttons icon icons media post posts article articles story stories content contents inner outer top bottom left right form forms text title head heading slot unit column col row group main page site global fixed sticky primary secondary tertiary mobile desktop js".split()
)
#: Elements that may wrap a whole page, and then aren't dropped.
WRAPPERS = frozenset("form fieldset dialog menu".split())
#: A container of such a name is an article, whose head holds its title.
ARTICLES = frozenset("article post entry hentry story".split())
#: Words of a page's head; an article has a head of its own, with its title.
HEAD = frozenset("header masthead topbar".split())
#: A name that begins with one of these tells of something else: a page "with-sidebar".
ABOUT = frozenset("with has no without hide is".split())
#: A name of these words alone is the text's own, whatever other names its element has.
CONTENT = frozenset("article articles content contents post entry story main body text prose".split())
#: Characters of a piece of text that has points of its own, and of what a title may have beside it in its head.
LONG_PIECE, HEAD_CHARS = 40, 120
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")
SEMANTIC = frozenset(("article", "main"))
PARAGRAPH = frozenset("p pre td blockquote li dd figcaption h2 h3 h4 h5 h6 div section article main body".split())


def tells_aside(names: str, heads: bool) -> bool:
    """Whether a value of class, id or role names something beside the article. heads: a head is no such thing here."""
    found = False
    for name in names.split():
        words = [w.lower() for w in WORDS.findall(name)]
        if not words or words[0] in ABOUT:
            continue
        if CONTENT.issuperset(words):
            return False
        own = heads or not CONTENT.isdisjoint(words)
        hits = UNWANTED.intersection(words)
        if hits and WEAK.issuperset(hits):
            hits = UNWANTED.union(PARTS).issuperset(words) and hits
        found = found or bool(hits) or not (own or HEAD.isdisjoint(words))
    return found


def points(text: str) -> float:
    """What a paragraph adds to its ancestors."""
    return 1 + text.count(",") + min(len(text) / 100, 3)


def names_article(attributes: str) -> bool:
    """Whether a class or id names an article."""
    for key, *values in ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id"):
            value = next(filter(None, values), "")
            if any(words and ARTICLES.issuperset(words) for words in ([w.lower() for w in WORDS.findall(name)] for name in value.split())):
                return True
    return False


class Page:
    """The element tree of a page, of which only blocks of text and their elements are kept.

    by_name: names of classes, ids and roles count. spared: numbers of elements that aren't dropped for what they are.
    """

    def __init__(self, html: str, by_name: bool = True, spared: frozenset[int] = frozenset()):
        self.tag, self.parent, self.unwanted = ["html"], [-1], [False]
        #: The nearest block that an element is or is in, and whether it is inside an article.
        self.block_of, self.semantic = [0], [False]
        self.blocks: list[tuple[int, str]] = []
        self.linked = [0.0]
        self.by_name, self.spared = by_name, spared
        #: Points of the long pieces of text that stand in an element itself, dropped or not.
        self.own = [0.0]
        self._read(html)

    def _read(self, html: str) -> None:
        tags, unwanted = self.tag, self.unwanted
        open_, text, at, n, links = [0], [], 0, len(html), 0
        linked = 0
        depths: dict[str, list[int]] = {"html": [0]}  # where on the stack elements of a kind stand
        fences = [0]
        endless: set[str] = set()  # raw elements of which no further end tag comes

        def flush() -> None:
            nonlocal linked
            if text:
                whole = " ".join(entities.unescape("".join(text)).split())
                text.clear()
                if whole:
                    owner = self.block_of[open_[-1]]
                    self.blocks.append((owner, whole))
                    self.linked[owner] += min(linked, len(whole))
            linked = 0

        def close(down_to: int) -> None:
            nonlocal links
            for x in reversed(open_[down_to:]):
                links -= tags[x] == "a"
                depths[tags[x]].pop()
                if tags[x] in FENCES:
                    fences.pop()
            del open_[down_to:]

        while at < n:
            found = MARKUP.search(html, at)
            stop = found.start() if found else n
            if stop > at:
                piece = html[at:stop]
                if len(piece) >= LONG_PIECE and not links:
                    self.own[open_[-1]] += points(piece)
                if not unwanted[open_[-1]]:
                    text.append(piece)
                    if links:
                        linked += len(piece)
            if not found:
                break
            at = found.end()
            name = found[2]
            if name is None:
                continue
            name = name.lower()
            if not found[4]:
                break  # a tag that the page's end cuts off
            if found[1]:
                if name in BLOCK:
                    flush()
                if depths.get(name) and depths[name][-1]:
                    close(depths[name][-1])
                continue
            if name in RAW:
                if not found[3].endswith("/") and name not in endless:
                    end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
                    at = end.end() if end else n if name in TEXTUAL else at
                    if not end:
                        endless.add(name)
                text.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                else:
                    text.append(" " if name in ("br", "img") else "")
                continue
            if name in BLOCK:
                flush()
                if depths.get("p"):
                    close(depths["p"][-1])
            if name in ENDS:
                inside = [depths[kind] for kind in ENDS[name] if depths.get(kind) and depths[kind][-1] > fences[-1]]
                if inside:
                    close(min(d[bisect_right(d, fences[-1])] for d in inside) if name in ENDS_ALL else max(d[-1] for d in inside))
            if name == "a" and links:
                continue
            over = open_[-1]
            at_depth = len(open_)
            new = len(tags)
            tags.append(name)
            self.parent.append(over)
            self.linked.append(0.0)
            self.own.append(0.0)
            self.block_of.append(new if name in BLOCK else self.block_of[over])
            self.semantic.append(self.semantic[over] or name in SEMANTIC or (bool(found[3].strip()) and name in ("div", "section") and names_article(found[3])))
            unwanted.append(unwanted[over] or (new not in self.spared and self._unwanted(name, found[3], over)))
            open_.append(new)
            depths.setdefault(name, []).append(at_depth)
            if name in FENCES:
                fences.append(at_depth)
            links += name == "a"
        flush()

    def _unwanted(self, name: str, attributes: str, over: int) -> bool:
        if name in ASIDE:
            return True
        if name == "header":  # a page's header; an article's own holds its title
            return not self.semantic[over]
        if name in ("html", "body", "article", "main") or not attributes.strip():
            return False
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next(filter(None, values), "")
            if key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                return True
            # Ids of headings are made of their words.
            if self.by_name and (key in ("class", "role") or (key == "id" and name not in HEADINGS)) and tells_aside(value, self.semantic[over]):
                return True
        return False

    def wrappers(self) -> frozenset[int]:
        """Forms and the like that hold more than half of the points of all long pieces of text, with no article beside them: they wrap the page."""
        if WRAPPERS.isdisjoint(self.tag):
            return frozenset()
        held = list(self.own)
        for x in range(len(held) - 1, 0, -1):
            held[self.parent[x]] += held[x]
        found = frozenset(x for x, tag in enumerate(self.tag) if tag in WRAPPERS and 2 * held[x] > held[0])
        if not found:
            return found
        outer = x = min(found)  # the others are in it
        within = [False] * len(held)
        while x >= 0:
            within[x], x = True, self.parent[x]
        for x in range(outer + 1, len(held)):
            within[x] = within[self.parent[x]] and self.parent[x] >= outer
        return found if all(within[x] for x, tag in enumerate(self.tag) if tag in SEMANTIC and held[x]) else frozenset()

    def main_blocks(self) -> list[str]:
        """Blocks of the best container and of siblings that look like parts of the article."""
        n = len(self.tag)
        gains, length, links = [0.0] * n, [0] * n, list(self.linked)
        for owner, text in self.blocks:
            length[owner] += len(text)
        for x in range(n - 1, 0, -1):
            length[self.parent[x]] += length[x]
            links[self.parent[x]] += links[x]
        for owner, text in self.blocks:
            if self.tag[owner] in PARAGRAPH:
                gained = points(text)
                own = self.tag[owner] in ("div", "section", "article", "main", "body", "td", "li", "dd")
                x, level = owner if own else self.parent[owner], 0
                while x > 0 and level < 5:
                    gains[x] += gained / (1 if not level else 2 * level)
                    x, level = self.parent[x], level + 1
        score = [p * (1 - (links[x] / length[x] if length[x] else 0)) for x, p in enumerate(gains)]
        places = [x for x in range(1, n) if self.tag[x] not in ("html", "p", "span", "b", "i", "em", "strong", "a", "li", "tr") and score[x] > 0]
        best = max(places, key=lambda x: (score[x], -x), default=0)
        # The whole article where the page marks it: the best container may be one section of it.
        x = best
        while x > 0:
            if self.tag[x] in SEMANTIC:
                best = x
                break
            x = self.parent[x]
        if not best:
            best = next((x for x in range(n) if self.tag[x] in SEMANTIC and length[x]), 0)
        if not best:
            return [text for _, text in self.blocks]
        keep = {best}
        if self.tag[best] != "body":
            least = max(3.0, 0.2 * score[best])
            for x in range(1, n):
                if self.parent[x] == self.parent[best] and x != best and length[x]:
                    density = links[x] / length[x]
                    if self.tag[x] in HEADINGS:
                        keep.add(x)
                    elif self.tag[x] in ("p", "pre", "blockquote", "table", "ul", "ol", "figure"):
                        if density < 0.25:
                            keep.add(x)
                    elif score[x] >= least and density < 0.25:
                        keep.add(x)
        inside = [False] * n
        for x in range(n):
            inside[x] = x in keep or (x > 0 and inside[self.parent[x]])
        if not any(inside[owner] and self.tag[owner] == "h1" for owner, _ in self.blocks):
            # The title may stand in a sibling before the container.
            for owner, _ in self.blocks:
                x = owner
                while x > 0 and x < best and self.parent[x] != self.parent[best]:
                    x = self.parent[x]
                if self.tag[owner] == "h1" and 0 < x < best and length[x] - length[owner] < length[owner] + HEAD_CHARS:
                    inside[owner] = True
        return [text for owner, text in self.blocks if inside[owner]]


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds; empty for a null or empty page.

    A page that a form or the like wraps is read again with it, and one of which names of classes leave nothing is read again without them.
    """
    if not html:
        return ""
    page = Page(html)
    wrappers = page.wrappers()
    if wrappers:
        page = Page(html, spared=wrappers)
    return "\n".join(page.main_blocks() or Page(html, by_name=False, spared=wrappers).main_blocks())


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Add the main text of every page as ``text_col``; the column of the html is left out.

    A page that is null, empty or without text has an empty text. Pages are read
    whole, whatever their length; repeated rows give equal texts, an empty table
    stays empty, and other columns pass unchanged (one named like ``text_col``
    is replaced).
    """
    base = pages.select(*[c for c in pages.columns if c not in (html_col, text_col)], F.col(html_col).cast("string").alias("_html"))
    schema = T.StructType([*[f for f in base.schema.fields if f.name != "_html"], T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big):
                texts = pa.array([main_text(x) for x in batch.columns[-1].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=schema.names)

    return in_arrow(base, run, schema)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
