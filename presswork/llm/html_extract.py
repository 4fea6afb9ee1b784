"""Main text of web pages by site style trees.

Every page becomes a list of text blocks, each with its path of elements (tag, class and id words).
Elements whose tag or names say what they are (menus, site headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) are branches of importance 0. A name counts as a
whole class, id or role, or as its head word ('cookie-notice', not 'no-sidebar'); neither a name nor
a form counts on an element that holds most of the article's text (of the page's, without an
article). Articles with less text together than one branch outside them are teasers and count as
any other element. Where all that leaves nothing, the branch with most text stays. All pages of a host, with and without an article, and
all their text blocks, named noise included (not scripts, styles and heads), are merged into its style tree, in which a node is a path:

* presentation importance of an inner node: entropy, to the base of the host's pages, of the
  sequences of child tags that its pages have;
* content importance of a text node: 1 - the mean entropy of its contents over the pages that share
  them (a text on every page has entropy 1, a text of one page 0);
* composite importance: ``(1 - GAMMA) * presentation of the parent + GAMMA * content``.

Branches below ``THRESHOLD`` whose content is shared are noise on every page of the host. They go, and they
don't count where the text of a page's articles is held against that outside: an article shorter than
the site's notice beside it is the article still. Where a page has an article (or main) element, its text
outside is dropped and nothing inside goes by sharing. Pages of a host with equal main text are one page in the tree,
so copies don't make their text noise. A host of fewer than ``LEAST_PAGES`` such pages says nothing about sharing, and the path
with most of a host's main text (on a page with articles: of their text) is never removed.

Scale: pages are parsed twice, once to count (host, path, content) of all pages, in
sums by (host, page text) and then by host, so a hot host costs sums only, and once to extract. The noisy contents of all hosts are
broadcast while there are at most ``BROADCAST_ROWS``; beyond that the (host, path, content) of each page's blocks are joined with
them, which spreads a hot host over its contents, and each page gets its own noisy blocks alone. A page is parsed in time in
proportion to its length, broken or not: ends of tags are looked for once, and open elements are found by their tag.

Edge cases: null, empty or text-less html gives an empty text; a null or odd url is a host of its
own (empty); broken markup is closed as browsers do, unclosed comments and scripts swallow the rest, an
unclosed template, noscript, svg or math is ignored; formulas are text;
repeated rows give equal texts; a null page_id stays; an empty table gives an empty result; further
columns are never read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import map_batches, pick, saved, slices

GAMMA, THRESHOLD, LEAST_PAGES = 0.9, 0.3, 5
#: Noisy (host, path, content) rows that may be broadcast: 24 bytes each.
BROADCAST_ROWS = 1_000_000

#: A whole tag without < or > in its quotes, and the beginning of any tag.
_SIMPLE = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*+)(?=[\s/>])([^<>"']*+(?:"[^<>"]*+"[^<>"']*+|'[^<>']*+'[^<>"']*+)*+)>""")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*>?", re.S)
_SPECIAL = re.compile(r"""["'>]""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NAME = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
#: Elements that '/>' ends, as it does all elements in them, and that the tags of ``_BREAKS`` end.
FOREIGN = frozenset(["svg", "math"])
#: Ignored where no end tag follows, so that they don't take the rest of the page.
CLOSED = frozenset("template noscript svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike "
                   "strong sub sup time tt u var wbr img math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot munder "
                   "mover munderover mtable mtr mtd mstyle mspace mpadded mphantom merror mfenced mmultiscripts "
                   "semantics".split())
#: Tags of importance 0 anywhere, and only outside an article.
NOISE_TAGS = frozenset("nav footer aside head button select option dialog menu object canvas audio video svg template noscript "
                       "annotation annotation-xml".split()) | RAW
OUTER_NOISE_TAGS = frozenset(["header"])
#: Their text is none of the page's, so it is no node of the style tree.
UNSEEN_TAGS = RAW | {"head"}
#: Words of class, id and role that say the same.
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup share sharing social related recommended comment comments replies disqus pagination "
    "pager search login toolbar copyright contentinfo complementary masthead".split())
OUTER_NOISE_NAMES = frozenset(["header"])
#: Words after a head word, and words with which a name tells of something else.
_TAILS = frozenset("wrapper wrap container box bar area section block inner outer widget list item items button buttons link links".split())
_ABOUT = frozenset("no not non has have having with without is hide show before after above below under near".split())
#: An opening tag ends these open elements, unless a container stands between.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
           "th": ("td", "th"), "option": ("option",)}
_CONTAINERS = frozenset("article main section div body html table ul ol dl td th blockquote nav aside footer header form".split())

_BREAKS = frozenset("article aside b big blockquote body br center code dd div dl dt em footer form h1 h2 h3 h4 h5 h6 header hr "
                    "i img li main nav ol p pre s section small span strong strike sub sup table tt u ul var".split())
#: Elements in ``FOREIGN`` ones that hold html.
_HOLDERS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())


@dataclass
class Block:
    """One block of text: its path and the children of the parent seen so far."""

    text: str
    path: int
    parent: int
    article: int  # the outermost article or main element around it, -1 if none
    noisy: bool
    mark: int  # the innermost element around it that is noise by its name, -1 if none
    seen: bool = True  # not in a script, style or head
    named: bool = False  # noise by its tag
    in_article: bool = False


def _names(value: str) -> set[str]:
    """The words of a class, id or role value that say what the element is."""
    out = set()
    for token in value.split():
        words = _NAME.findall(token)
        while len(words) > 1 and (words[-1] in _TAILS or len(words[-1]) == 1):
            words.pop()
        if words and not _ABOUT.intersection(words):
            out.add(words[-1])
    return out


def _words(attributes: str) -> tuple[frozenset[str], str, bool]:
    """Names by class, id and role; the signature part; whether the element is hidden."""
    names, signature, hidden = set(), "", False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id", "role"):
            names |= _names(value)
            signature += "." + "-".join(_NAME.findall(value))
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(
                r"display\s*:\s*none", value)):
            hidden = True
    return frozenset(names), signature, hidden


class TagEnds:
    """Where tags of a text end: at the first ``>`` outside quotes.

    A search that fails leaves behind which quotes it opened. Another one that comes to open one of
    them fails alike, so all failing searches together read the text a bounded number of times.
    """

    def __init__(self, text: str):
        self.text = text
        self.dead: set[int] = set()  # positions of quotes whose opening leads to no end
        self.unclosed = {'"': len(text) + 1, "'": len(text) + 1}  # no such quote from here on
        self.near = (0, -1)  # a range without special characters, and where the next one stands

    def find(self, at: int) -> int:
        """The position of the ``>`` that ends a tag whose attributes begin at ``at``, or -1."""
        text, opened = self.text, []
        if not self.near[0] <= at <= self.near[1]:
            self.near = (at, self._special(at))
        at = self.near[1]
        while at < len(text):
            if (quote := text[at]) == ">":
                return at
            if at in self.dead:
                break
            opened.append(at)
            if at + 1 >= self.unclosed[quote]:
                break
            if (end := text.find(quote, at + 1)) < 0:
                self.unclosed[quote] = at + 1
                break
            at = self._special(end + 1)
        self.dead.update(opened)
        return -1

    def _special(self, at: int) -> int:
        found = _SPECIAL.search(self.text, at)
        return found.start() if found else len(self.text)


class PageParser:
    """Turns the html of one page into blocks and the child sequences of its elements."""

    def __init__(self, low: frozenset | set = frozenset()):
        self.low = low  # (path, content) that the host's style tree gives up
        self.blocks: list[Block] = []
        self.children: list[tuple[int, int]] = []  # (path, hash of the child sequence)
        self.marks: list[int] = []  # of elements that are noise by name: the mark around
        self.articles: list[tuple[str, int]] = []  # tag and mark of the outermost article elements
        self.buffer: list[str] = []
        self.foreign = 0  # open elements of FOREIGN
        self.ends: dict[str, int] = {}  # where the next end tag of a CLOSED element is
        # tag, path, noisy, article, child tags, mark; the depths of the innermost element that is not
        # inline, of the innermost container, and of the innermost one that svg and math depend on; whether it is seen
        self.stack: list[list] = [["", 0, False, -1, [], -1, 0, 0, 0, True]]
        self.depths: dict[str, list[int]] = {}  # of the open elements by tag

    def parse(self, text: str) -> None:
        at, look, ends = 0, 0, TagEnds(text)
        while (look := text.find("<", look)) >= 0:
            if (token := _SIMPLE.match(text, look)) is not None:
                end, attributes = token.end() - 1, token[3]
            elif (token := _TAG.match(text, look)) is not None:
                if (end := ends.find(token.end())) < 0:
                    token = None
                else:
                    attributes = text[token.end():end]
            if token is None:
                if (other := _OTHER.match(text, look)) is None:
                    look += 1
                    continue
                end = other.end() - 1
            if look > at:
                self._text(text[at:look])
            at = look = end + 1
            if token is None:
                continue
            tag = token[2].lower()
            if token[1]:
                self._close(tag)
            elif tag not in CLOSED or self._ends(tag, text, at):
                self._open(tag, attributes)
                if tag in RAW and not (self.foreign and attributes.endswith("/")):
                    raw = re.compile(rf"</{tag}[\s/>]", re.I).search(text, at)
                    at = look = raw.start() if raw else len(text)
        self._text(text[at:])
        while len(self.stack) > 1:
            self._pop()
        self._flush()
        self._settle()

    def _settle(self) -> None:
        """Tells which marks and articles count, now that all text is known."""
        blocks = [b for b in self.blocks if not b.noisy]

        def held(among: list[Block]) -> list[int]:
            sums = [0] * len(self.marks)
            for b in among:
                if b.mark >= 0:
                    sums[b.mark] += len(b.text)
            for i in range(len(sums) - 1, -1, -1):
                if self.marks[i] >= 0:
                    sums[self.marks[i]] += sums[i]
            return sums

        def counting(among: list[Block]) -> list[bool]:
            """Of every mark whether it or one around it counts: those with most of the text don't."""
            most, out = sum(len(b.text) for b in among), []
            for i, n in enumerate(held(among)):
                out.append(2 * n <= most or self.marks[i] >= 0 and out[self.marks[i]])
            return out

        by_page = [True] * len(self.marks) if any(mark < 0 for _, mark in self.articles) else counting(blocks)
        sizes, branches = dict.fromkeys((i for i, (_, m) in enumerate(self.articles) if m < 0 or not by_page[m]), 0), {}
        for b in blocks:
            if b.article in sizes:
                sizes[b.article] += len(b.text)
            elif b.article < 0 and (b.mark < 0 or not by_page[b.mark]) and not self.given_up(b):
                branches[b.path] = branches.get(b.path, 0) + len(b.text)
        real = any(sizes.values()) and (any(n and self.articles[i][0] != "article" for i, n in sizes.items())
                                        or sum(sizes.values()) >= max(branches.values(), default=0))
        if real:
            largest = max(sizes, key=sizes.get)
            valid = counting([b for b in blocks if b.article == largest])
        else:
            valid = counting(blocks)
        for b in blocks:
            b.noisy = b.mark >= 0 and valid[b.mark]
            b.in_article = real and b.article >= 0
        if blocks and all(b.noisy for b in blocks):
            sums: dict[int, int] = {}
            for b in blocks:
                sums[b.path] = sums.get(b.path, 0) + len(b.text)
            best = max(sums, key=sums.get)
            for b in blocks:
                b.noisy = b.path != best

    def given_up(self, block: Block) -> bool:
        """Whether the style tree gives up the block's branch and content."""
        return bool(self.low) and (block.path, _hash(block.text)) in self.low

    def _ends(self, tag: str, text: str, at: int) -> bool:
        """Whether an end tag follows; each is searched for once."""
        if self.ends.get(tag, -1) < at:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(text, at)
            self.ends[tag] = end.start() if end else len(text) + 1
        return self.ends[tag] < len(text)

    def _text(self, text: str) -> None:
        if text:
            self.buffer.append(html.unescape(text) if "&" in text else text)

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            self.buffer.clear()
            if text:
                top = self.stack[-1]
                inner, above = self.stack[top[6]], self.stack[max(0, top[6] - 1)]
                self.blocks.append(Block(text, inner[1], above[1], top[3], top[2], top[5], top[9], top[2]))

    def _open(self, tag: str, attributes: str) -> None:
        if self.foreign and tag in _BREAKS:
            self._break_out()
        if tag not in INLINE:
            self._flush()
            if not self.foreign and tag not in FOREIGN:
                self._imply(tag)
        top = self.stack[-1]
        top[4].append(tag)
        if tag in VOID or attributes.endswith("/") and (tag in INLINE or self.foreign or tag in FOREIGN):
            return
        names, signature, hidden = _words(attributes) if attributes.strip(" /") else (frozenset(), "", False)
        noisy, article, mark = top[2], top[3], top[5]
        if tag not in ("html", "body", "main"):
            noisy = noisy or hidden or tag in NOISE_TAGS or article < 0 and tag in OUTER_NOISE_TAGS
            if tag == "form" or names & NOISE_NAMES or article < 0 and names & OUTER_NOISE_NAMES:
                self.marks.append(mark)
                mark = len(self.marks) - 1
        if article < 0 and (tag in ("article", "main") or "main" in names and tag == "div"):
            self.articles.append((tag, mark))
            article = len(self.articles) - 1
        path = xxhash.xxh3_64_intdigest(f"{tag}{signature}", seed=top[1] & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
        depth = len(self.stack)
        self.stack.append([tag, path, noisy, article, [], mark, top[6] if tag in INLINE else depth,
                           depth if tag in _CONTAINERS else top[7], depth if tag in FOREIGN or tag in _HOLDERS else top[8],
                           top[9] and tag not in UNSEEN_TAGS])
        self.depths.setdefault(tag, []).append(depth)
        self.foreign += tag in FOREIGN

    def _break_out(self) -> None:
        """An html tag ends the svg or math it stands in, unless an element that holds html is between."""
        depth = self.stack[-1][8]
        if self.stack[depth][0] in FOREIGN:
            self._pop_to(depth)

    def _imply(self, tag: str) -> None:
        ends = _CLOSES.get(tag, ()) + (("p",) if tag not in VOID or tag == "hr" else ())
        while True:
            depth = 0
            for t in ends:
                if (found := self.depths.get(t)) and found[-1] > depth:
                    depth = found[-1]
            if not depth or depth < self.stack[-1][7]:
                return
            self._pop_to(depth)

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        if depths := self.depths.get(tag):
            if tag not in INLINE or tag in FOREIGN or depths[-1] > self.stack[-1][6]:
                self._pop_to(depths[-1])

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self._pop()

    def _pop(self) -> None:
        if self.stack[-1][0] not in INLINE:
            self._flush()
        tag, path, _, _, tags, *_, seen = self.stack.pop()
        self.depths[tag].pop()
        self.foreign -= tag in FOREIGN
        if tags and seen:
            self.children.append((path, _hash(" ".join(t for i, t in enumerate(tags) if not i or t != tags[i - 1]))))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def parse(text: str | None, low: frozenset | set = frozenset()) -> PageParser:
    page = PageParser(low)
    page.parse(text or "")
    return page


def _host(url: str | None) -> str:
    found = re.search(r"://([^/?#]*)", url or "")
    return found[1].lower() if found else ""


def _content(page: PageParser) -> list[Block]:
    """The blocks that may be main text: without named noise, inside the article if there is one."""
    for keep in (lambda b: b.in_article and not b.noisy, lambda b: not b.noisy):
        found = [b for b in page.blocks if keep(b)]
        if found:
            return found
    return []


def _observations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, path, parent, feature, content?, chars, open?) of each page, each feature once a page; ``page``
    is a hash of its main text, equal for copies; ``chars`` counts main text alone, ``open`` is text that no tag names."""
    for batch in batches:
        for part in slices(batch, "html"):
            rows: dict[tuple, tuple[int, bool]] = {}
            for url, text in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                page, host = parse(text), _host(url)
                blocks = _content(page)
                own = _hash("\n".join(b.text for b in blocks))
                main = {id(b) for b in [b for b in blocks if b.article >= 0] or blocks}
                seen = {(host, own, 0, 0, 0, False): (0, False)}  # the page itself
                for b in page.blocks:
                    if b.seen:
                        key = (host, own, b.path, b.parent, _hash(b.text), True)
                        chars, is_open = seen.get(key, (0, False))
                        seen[key] = (chars + (len(b.text) if id(b) in main else 0), is_open or not b.named)
                rows |= seen | {(host, own, path, 0, feature, False): (0, False) for path, feature in page.children}
            columns = list(zip(*((*k, *v) for k, v in rows.items()), strict=True)) or [()] * 8
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["host", "page", "path", "parent", "feature", "content", "chars", "open"])


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, feature, importance, open) of the shared contents in branches of low importance."""
    seen = saved(map_batches(pick(pages, "url", "html"), _observations,
                             "host string, page bigint, path bigint, parent bigint, feature bigint, content boolean, chars bigint, "
                             "open boolean")
                 .groupBy("host", "page", "path", "parent", "feature", "content")
                 .agg(F.max("chars").alias("chars"), F.max("open").alias("open"))
                 .groupBy("host", "path", "parent", "feature", "content")
                 .agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.max("open").alias("open")), "style-tree")
    hosts = (seen.filter("path = 0 and not content").groupBy("host").agg(F.sum("pages").alias("m"))
             .filter(F.col("m") >= LEAST_PAGES))
    inner = seen.filter("path <> 0 and not content").groupBy("host", "path").agg(
        F.sum("pages").alias("all"), F.sum(F.col("pages") * F.log("pages")).alias("plogp"))
    # entropy of shares n/all to the base m: (log all - sum(n log n) / all) / log m
    inner = inner.join(hosts, "host").select(
        "host", F.col("path").alias("parent"),
        ((F.log("all") - F.col("plogp") / F.col("all")) / F.log("m")).alias("presentation"))
    texts = seen.filter("content")
    # summed by branch before a host's number of pages is joined, so that a hot host's contents are not dealt by host
    leaves = texts.groupBy("host", "path").agg(
        F.max("parent").alias("parent"), F.sum("chars").alias("chars"), F.avg(F.log("pages")).alias("shared"))
    leaves = leaves.join(hosts, "host").withColumn("content_importance", 1 - F.col("shared") / F.log("m"))
    main = leaves.filter("chars > 0").groupBy("host").agg(F.max_by("path", F.struct("chars", "path")).alias("main"))
    judged = (leaves.join(inner, ["host", "parent"], "left").join(main, "host").filter("path <> main")
              .withColumn("importance", (1 - GAMMA) * F.coalesce("presentation", F.lit(0.0))
                          + GAMMA * F.col("content_importance")).filter(F.col("importance") < THRESHOLD))
    return texts.filter("pages > 1").join(judged.select("host", "path", "importance"), ["host", "path"]).select(
        "host", "path", "feature", "importance", "open")


def main_text(text: str | None, noisy: frozenset | set = frozenset()) -> str:
    """The main text of one page; ``noisy``: (path, content) hashes of its host's low branches."""
    page = parse(text, noisy)
    return " ".join(b.text for b in _content(page) if b.in_article or not page.given_up(b))


def extract(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    rows = pick(pages, "page_id", "url", "html")
    # what a tag names goes from every page anyway
    low = saved(style_tree(rows).filter("open").select("host", "path", "feature"), "low-branches")
    schema = "page_id bigint, url string, text string, n_chars bigint"

    def packed(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                                           pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if low.count() <= broadcast_rows:
        noisy: dict[str, set] = {}
        for r in low.toLocalIterator():
            noisy.setdefault(r.host, set()).add((r.path, r.feature))
        held = pages.sparkSession.sparkContext.broadcast(noisy)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "html"):
                    yield packed(part, [main_text(t, held.value.get(_host(u), ())) for u, t in zip(
                        part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True)])

        return map_batches(rows, run, schema)

    # a page is known by a hash of its host and html: equal pages have equal noisy blocks
    seen = map_batches(rows.select("url", "html"), _page_blocks, "page binary, host string, path bigint, feature bigint")
    own = (saved(seen, "page-blocks").join(low.distinct(), ["host", "path", "feature"]).groupBy("page")
           .agg(F.collect_set(F.struct("path", "feature")).alias("low")))  # at most the page's own blocks
    key = map_batches(rows, _with_key, "page_id bigint, url string, html string, page binary")
    joined = key.join(own, "page", "left").select("page_id", "url", "html", "low")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                yield packed(part, [main_text(t, {(x["path"], x["feature"]) for x in low_of or ()}) for t, low_of in zip(
                    part.column("html").to_pylist(), part.column("low").to_pylist(), strict=True)])

    return map_batches(joined, run_joined, schema)


def _page_key(url: str | None, text: str | None) -> bytes:
    return xxhash.xxh3_128_digest(f"{_host(url)}\n{text or ''}".encode("utf-8", "surrogatepass"))


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_page_key(u, t) for u, t in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=["page_id", "url", "html", "page"])


def _page_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, host, path, feature) of the blocks that the style tree may give up, once a page and slice."""
    for batch in batches:
        for part in slices(batch, "html"):
            out = set()
            for url, text in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                page, host = _page_key(url, text), _host(url)
                out |= {(page, host, b.path, _hash(b.text)) for b in parse(text).blocks if not b.named}
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                columns, (pa.binary(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["page", "host", "path", "feature"])
