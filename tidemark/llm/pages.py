"""Main text of web pages by a site style tree: the pages of a host are merged, and branches that say little are cut.

A node of the tree is a path of elements with their class, id and role. Its importance weighs two entropies over the
host's different pages, each as a share of the largest possible: of its presentation (which elements follow each other
in it) and of its content (what its branch says), the latter less the share of its text that is in links. A notice that
all pages repeat has 0, and so has a menu of the same form on every page, whatever its links say; running text has
nearly 1. Copies of a page count once. A branch that says little goes if it is made of links, else only the texts in it that
repeat. Elements that name a purpose (menus, adverts, forms, comments and so on) go on every page. Plain flow text of an
article, without classes of its own, is the content that the tree looks for, and always stays.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import urls
from tidemark.session import cut_lineage

#: A text is cut if so many different pages of its host repeat it, in a branch below this importance; a branch of links,
#: if so many have it.
MIN_PAGES, MIN_IMPORTANCE = 8, 0.3
#: Share of a branch's characters in links from which it is made of links.
MIN_LINKED = 0.8
#: How much less the content counts for each kind of child: a branch of k kinds is judged by it to this power of k.
DAMPING = 0.9
#: Texts to cut that are broadcast; a larger set is joined by a shuffle on the host.
MAX_BROADCAST_TEXTS = 200_000

_RAW = frozenset("script style noscript template textarea iframe svg math object xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
_PURPOSE_TAGS = frozenset("head title nav footer aside form button select fieldset dialog menu input datalist option".split())
_PURPOSE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: A name speaks of a purpose if all its parts do, but for those that only say what kind of box it is.
_PURPOSE_WORDS = frozenset(
    "ad ads adsense adslot adbox advert adverts advertisement advertising banner banners sponsor sponsored sponsors promo promos promotion sidebar menu "
    "menus nav navbar navigation breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices popup modal newsletter subscribe "
    "subscription signup login search searchbox share sharing sharebar social related recommended recommendations footer copyright widget widgets toolbar "
    "skiplink".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist respond responses reply replies disqus guestbook".split())
#: An article in a branch of such a name is a comment; without one the name may be that of a chapter.
_TALK_WORDS = frozenset("discussion discussions talk forum thread conversation".split())
_HEADER_WORDS = frozenset("header masthead".split())
_BOX_WORDS = frozenset(
    "side bar box area list block wrap wrapper container inner outer top bottom left right main site page global primary secondary item items link links "
    "post posts article articles story stories section form bar button buttons icon icons slot unit panel holder group row col column skip sign log in up pop "
    "to go the reader readers user users thread toggle content text media first last body".split()
)
_KINDS = (("comments", _COMMENT_WORDS), ("other", _PURPOSE_WORDS), ("talk", _TALK_WORDS), ("header", _HEADER_WORDS))
_PAIRS = frozenset([("side", "bar"), ("sign", "up"), ("log", "in"), ("pop", "up"), ("skip", "link"), ("skip", "to")])
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
_HEADINGS = frozenset("article h1 h2 h3 h4 h5 h6 header hgroup figcaption".split())
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption section div hgroup header".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: An opening element of the first kind ends an open one of the second.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@functools.lru_cache(maxsize=20_000)
def purpose(names: str) -> str:
    """What the classes and the id of an element name: "comments", "talk", "header", "other" or nothing."""
    found = ""
    for name in names.split():
        # All parts count: "social-links" is for sharing, "social-history" is about history.
        parts = [name.lower()] if name.isupper() else [x.lower() for x in _PARTS.findall(name) if not x.isdigit()]
        kinds = {k for x in parts for k, known in _KINDS if x in known}
        if any(p in _PAIRS for p in zip(parts, parts[1:], strict=False)):
            kinds.add("other")
        if kinds and all(x in _BOX_WORDS or any(x in known for _, known in _KINDS) for x in parts):
            if "comments" in kinds:
                return "comments"
            found = next((k for k in ("other", "talk", "header") if k in kinds or k == found), "")
    return found


class Element:
    """An element of a page.

    `path` is a hash of its way from the root, `cut` the reason why it is not text, `outer` the outermost article around
    it and `nested` the number of articles. `texts`, `size` and `linked` are of its whole branch.
    """

    __slots__ = ("article", "children", "cut", "linked", "nested", "outer", "parent", "path", "plain", "size", "tag", "talk", "texts")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        found = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        mark = "." + ".".join(sorted(names.split())) if names else ""
        self.tag, self.parent = tag, parent
        self.path = xxhash.xxh64_intdigest(f"{parent.path if parent else 0}/{tag}{mark}") >> 1
        self.children: list[str] = []
        self.texts = self.size = self.linked = 0
        if parent is not None and (not parent.children or parent.children[-1] != tag + mark):
            parent.children.append(tag + mark)
        inside = parent is not None and parent.article
        landmark = tag in ("article", "main") or found.get("role") in ("main", "article")
        self.article = inside or landmark
        self.nested = (parent.nested if parent else 0) + (tag == "article")
        self.outer: Element | None = parent.outer if parent and parent.outer else self if tag == "article" else None
        self.plain = landmark or (inside and parent.plain and tag in _FLOW and not names)
        named = purpose(names) if names and tag not in ("html", "body") else ""
        above = parent.cut if parent is not None else ""
        self.talk = named == "talk" or (parent is not None and parent.talk)
        if named == "comments" or above == "comments" or (tag == "article" and self.talk):
            self.cut = "comments"
        elif "hidden" in found or found.get("aria-hidden") == "true" or above == "hidden":
            self.cut = "hidden"
        elif landmark:  # an article in a menu that was never closed, or in a form around the whole page
            self.cut = ""
        elif above:
            self.cut = above
        else:
            heading = (tag == "header" or named == "header") and not inside
            self.cut = "other" if heading or tag in _PURPOSE_TAGS or found.get("role") in _PURPOSE_ROLES or named == "other" else ""


class Page:
    """The blocks of text of a page, in order, and the branches that they are in; unclosed elements end as HTML has it."""

    def __init__(self, page: str):
        self.blocks: list[tuple[Element, str, int, int]] = []
        self.elements: list[Element] = [Element("html", "", None)]
        self.stack: list[Element] = []
        self.said: list[str] = []
        self.links, self.in_link = 0, False
        self._read(page)

    def _say(self, text: str) -> None:
        self.said.append(text)
        if self.in_link:
            self.links += len(text)

    def _flush(self) -> None:
        if self.said:
            raw = "".join(self.said)
            text = " ".join(entities.unescape(raw).split())
            if text:
                self.blocks.append((self.stack[-1] if self.stack else self.elements[0], text, len(raw), self.links))
            self.said, self.links = [], 0

    def _open(self, tag: str, attributes: str) -> None:
        self.stack.append(Element(tag, attributes, self.stack[-1] if self.stack else self.elements[0]))
        self.elements.append(self.stack[-1])

    def _read(self, page: str) -> None:
        stack, at, size = self.stack, 0, len(page)
        while at < size:
            token = _TOKEN.search(page, at)
            if token is None:
                self._say(page[at:])
                break
            if token.start() > at:
                self._say(page[at : token.start()])
            at = token.end()
            tag = (token[2] or "").lower()
            if not tag:
                if token[0].startswith("<![CDATA["):
                    self._say(token[0][9:-3])
                continue
            closing = token[1] == "/"
            if tag in _RAW and not closing:
                if not token[3].rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = end.end() if end else size
                continue
            if tag in _INLINE or tag in _VOID:
                if tag == "a":
                    self.in_link = not closing
                elif tag in ("br", "hr"):
                    self.said.append(" ")
                    if tag == "hr":
                        self._flush()
                continue
            self._flush()
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                continue
            if tag not in ("article", "section") and stack and stack[-1].tag == "p":
                stack.pop()
            for other in _CLOSES.get(tag, ()):
                if stack and stack[-1].tag == other:
                    stack.pop()
            self._open(tag, token[3])
        self._flush()

    def branches(self) -> dict[int, tuple[int, int, int, int, int, int]]:
        """path -> hashes of its presentation and of what it says, its characters, those of them in links, kinds of child,
        and whether (1) its name already cuts it.

        Elements of one path count as one. Plain article flow and branches without text are left out. What an element
        says itself, beside elements with text, is a branch of its own.
        """
        own: dict[int, list[int]] = {}
        for element, text, chars, linked in self.blocks:
            row = own.setdefault(id(element), [0, 0, 0])
            row[0] = xxhash.xxh64_intdigest(text, row[0])
            row[1] += chars
            row[2] += linked
        found: dict[int, list] = {}

        def add(path: int, children: list[str], texts: int, size: int, linked: int, named: bool) -> None:
            row = found.setdefault(path, [set(), 0, 0, 0, 0, 1])
            row[0].add(" ".join(children))
            row[1] = xxhash.xxh64_intdigest(texts.to_bytes(8, "little"), row[1])
            row[2] += size
            row[3] += linked
            row[4] = max(row[4], len(children))
            row[5] = min(row[5], int(named))

        for e in reversed(self.elements):  # children come before their parents
            texts, size, linked = own.get(id(e), (0, 0, 0))
            if size and e.size and not e.plain:
                add(_own(e.path), [], texts, size, linked, bool(e.cut))
            if size:
                e.texts, e.size, e.linked = xxhash.xxh64_intdigest(texts.to_bytes(8, "little"), e.texts), e.size + size, e.linked + linked
            if e.size and not e.plain:
                add(e.path, e.children, e.texts, e.size, e.linked, bool(e.cut))
            if e.size and e.parent is not None:
                e.parent.texts = xxhash.xxh64_intdigest(e.texts.to_bytes(8, "little"), e.parent.texts)
                e.parent.size += e.size
                e.parent.linked += e.linked
        return {p: (xxhash.xxh64_intdigest("|".join(sorted(r[0]))) >> 1, r[1] >> 1, *r[2:]) for p, r in found.items()}


def _own(path: int) -> int:
    """The path of what an element says itself."""
    return xxhash.xxh64_intdigest(f"{path}/text") >> 1


def _text_id(path: int, texts: int) -> int:
    return xxhash.xxh64_intdigest(f"{path}={texts}") >> 1


def _text_ids(path: Column, texts: Column) -> Column:
    @F.pandas_udf("long")
    def ids(paths: pd.Series, said: pd.Series) -> pd.Series:
        return pd.Series([_text_id(p, t) for p, t in zip(paths, said, strict=True)], dtype="int64")

    return ids(path, texts)


def main_text(page: str | None, cut: frozenset[int] = frozenset()) -> str:
    """Blocks of the article, or of the whole page if it has none, without the branches whose path or text is in `cut`.

    An article in an article that has running text itself is a comment on it.
    """
    read = Page(page or "")
    blocks = [b for b in read.blocks if not b[0].cut]
    if any(b[0].article for b in blocks):
        blocks = [b for b in blocks if b[0].article]
        telling = {id(b[0].outer) for b in blocks if b[0].nested == 1 and b[0].tag not in _HEADINGS}
        blocks = [b for b in blocks if b[0].nested < 2 or id(b[0].outer) not in telling]
    if cut and blocks:
        found = read.branches()
        low = {p for p, row in found.items() if p in cut or _text_id(p, row[1]) in cut}
        gone: set[int] = set()
        for e in read.elements if low else ():  # parents come before their children
            if not e.plain and (e.path in low or (e.parent is not None and id(e.parent) in gone)):
                gone.add(id(e))
        blocks = [b for b in blocks if b[0].plain or (id(b[0]) not in gone and _own(b[0].path) not in low)]
    return "\n\n".join(b[1] for b in blocks)


_ROW = "host string, path long, shown long, texts long, size long, linked long, kinds long, named long, page long"


def _seen(pages: DataFrame) -> DataFrame:
    """A row for every branch of every different page."""
    names = [c.split()[0] for c in _ROW.split(", ")]

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            seen: set[tuple] = set()
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = Page(html.as_py() or "")
                whole = 0
                for e, text, _, _ in page.blocks:
                    whole = xxhash.xxh64_intdigest(f"{e.path}={text}", whole)
                seen.update((host, path, *row, whole >> 1) for path, row in page.branches().items())
            if seen:
                kinds = [pa.string(), *[pa.int64()] * (len(names) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*seen, strict=True), kinds, strict=True)], names=names)

    return pages.select(urls.host(F.col("url")).alias("host"), "html").mapInArrow(read, _ROW).distinct()


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, pages, presentation, content, linked, named and importance of every branch that is not plain article
    flow, and for each text that it says: texts (a hash) and n, the number of different pages that say it.

    Counts are combined before they shuffle; no host or branch is gathered into one task.
    """
    seen = cut_lineage(_seen(pages))  # read twice below

    key = ["host", "path"]
    sums = [F.sum("size").alias("size"), F.sum("linked").alias("linked"), F.max("kinds").alias("kinds"), F.min("named").alias("named")]
    said = cut_lineage(seen.groupBy(*key, "texts").agg(F.count("*").alias("n"), *sums))
    shown = seen.groupBy(*key, "shown").agg(F.count("*").alias("n"))
    of_pages = [F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn")]
    share = (F.log("pages") - F.col("nlogn") / F.col("pages")) / F.log("pages")
    share = F.when(F.col("pages") > 1, F.greatest(share, F.lit(0.0))).otherwise(F.lit(1.0))
    linked = F.col("linked") / F.col("size")
    of_texts = said.groupBy(*key).agg(*of_pages, *sums)
    of_texts = of_texts.select(*key, "pages", share.alias("content"), linked.alias("linked"), "kinds", (F.col("named") == 1).alias("named"))
    of_shown = shown.groupBy(*key).agg(*of_pages).select(*key, share.alias("presentation"))
    weight = F.pow(F.lit(DAMPING), F.col("kinds"))
    importance = (1 - weight) * F.col("presentation") + weight * F.col("content") * (1 - F.col("linked"))
    branch = of_texts.join(of_shown, key).withColumn("importance", importance).drop("kinds")
    return said.select(*key, "texts", "n").join(branch, key)


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """page_id, url, text and n_chars of every row: the main text, empty if there is none.

    Null html is empty, and pages without a host form one site. White space inside a block is one blank, blocks are
    joined by an empty line. Repeated rows are extracted each; other columns are ignored. The html of a page is not
    shuffled while the texts to cut are few enough to be broadcast.
    """
    low = style_tree(pages).where(~F.col("named") & (F.col("pages") >= min_pages) & (F.col("importance") < min_importance))
    low = cut_lineage(low.where((F.col("n") >= min_pages) | (F.col("linked") >= MIN_LINKED)))  # read twice below
    of_links = low.where(F.col("linked") >= MIN_LINKED).select("host", F.col("path").alias("id")).distinct()
    repeated = low.where(F.col("linked") < MIN_LINKED).select("host", _text_ids(F.col("path"), F.col("texts")).alias("id"))
    cut = cut_lineage(of_links.unionByName(repeated).select(F.col("host").alias("_site"), F.col("id").alias("content")))
    few = cut.count() <= MAX_BROADCAST_TEXTS
    of_site = cut.groupBy("_site").agg(F.sort_array(F.collect_set("content")).alias("cut"))
    read = pages.select("page_id", "url", "html", urls.host(F.col("url")).alias("_host"))
    joined = read.join(F.broadcast(of_site) if few else of_site, F.col("_host") == F.col("_site"), "left")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [main_text(p.as_py(), frozenset(c.as_py() or ())) for p, c in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    text = joined.select("page_id", "url", "html", "cut").mapInArrow(run, "page_id long, url string, text string")
    return text.withColumn("n_chars", F.length("text").cast("long"))
