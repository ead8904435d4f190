"""Main text of web pages by equivalence-class template deduction.

The tokens of a page are its opening tags, each named by its path from the
root, and its blocks of text, each named by path and text.  Over all pages of
a host, tokens with the same occurrence vector (the same count on every page)
form an equivalence class.  A class with an opening tag is valid if it is on
enough pages.  Valid classes nest by their paths into the host's template: its
tags are the skeleton, its texts are constants unless they are most of their
pages (which they are if these are copies of one another), and what is left
between them are slots.  The content slot of a class is the deepest tag, once
on each page, that holds nearly all the text that no constant and no menu,
header, footer or form accounts for.  A page's slot is the first of its host's
slots that it has; it is extracted block by block, without constants.  Pages
of a host without a template, or without its slots, give their article, main
element or body.

Vectors are never collected: pages, occurrences, and two order-free digests of
(page, count) identify them, so that a host of any size is summed up in parts.
A host's template has a bounded size, as each token is on a share of its pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import park, table

SUPPORT = 0.1  # share of a host's pages that a valid class is on
MIN_PAGES = 3  # and so many pages at least
CONSTANT = 0.5  # share of its pages' text that the constants of a valid class make up at most
MASS = 0.9  # share of the text that the content slot holds at least
OWN_MASS = 0.5  # share of a page's text from which its own article goes before a slot that is the whole body
BROADCAST_BYTES = 32 << 20  # templates that are sent to all tasks; more are joined
SALTS = 16  # parts of a host's pages in that join

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
OMITTED = frozenset("head title script style noscript template iframe svg nav header footer aside button select option textarea dialog menu object canvas audio video".split())
BLOCK = frozenset("p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th hr address details summary head body html center nav header footer aside form dialog menu".split())
#: Elements that hold a part of a text, so that headings or other parts would be lost with them as slots.
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table tbody tr td th a b i em strong span font small".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Whole names (classes, ids, roles) of elements that are no text of the author, if they don't hold most of a page.
NAMES = frozenset(
    "ad ads advert advertisement adsbygoogle banner sponsored promo nav navigation navbar menu sidebar footer masthead breadcrumb breadcrumbs pagination cookie-banner cookie-notice cookie-consent "
    "comments comment-list commentlist reader-comments disqus_thread newsletter newsletter-signup share-buttons social-share related-posts complementary contentinfo".split()
)

TAG = re.compile(
    r"""<(?:!--(?:-?>|.*?--!?>|.*)|[!?][^>]*+>?|/([a-zA-Z][^\s/>]*+)[^>]*+>?|([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>?)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|["'][^"'>]*["']?""")
HEADING = frozenset("p h1 h2 h3 h4 h5 h6".split())
DIGITS = re.compile(r"\d+")
CLOSE = {x: re.compile(rf"</{x}\b[^>]*>?", re.I) for x in RAW}


def _hash(*parts) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts))) >> 1


class Page:
    """The elements of a page in page order, and its pieces of text.

    Elements left open end with their parent; a paragraph ends where a block
    begins.  Element 0 is the page itself.  The path of an element (a hash of
    it) tells equal siblings apart by their order, but not paragraphs, list
    items and the like, nor what is in these.
    """

    def __init__(self, page: str):
        self.tag, self.path, self.parent, self.end = [""], [0], [-1], [0]
        self.omitted, self.named, self.low = [False], [False], [False]
        self.met: Counter = Counter()
        self.pieces: list[tuple[int, int, str]] = []  # element, block, text
        self.breaks = 0
        self._parse(page)
        self._leave_out()

    def _text(self, element: int, text: str) -> None:
        if text:
            self.pieces.append((element, self.breaks, text))

    def _parse(self, page: str) -> None:
        stack = [0]
        opened: Counter = Counter()

        def close(k: int) -> None:
            for x in stack[k:]:
                self.end[x] = len(self.tag) - 1
                opened[self.tag[x]] -= 1
            del stack[k:]

        at = 0
        while tag := TAG.search(page, at):
            self._text(stack[-1], page[at : tag.start()])
            at = tag.end()
            ended, name, attributes = tag.groups()
            if ended:
                ended = ended.lower()
                self.breaks += ended in BLOCK
                if opened[ended]:
                    k = len(stack) - 1
                    while self.tag[stack[k]] != ended:
                        k -= 1
                    close(k)
            elif name:
                name = name.lower()
                self.breaks += name in BLOCK
                ends = CLOSED_BY.get(name, ())
                if name in BLOCK and opened["p"]:
                    ends = ("p",)
                if any(opened[x] for x in ends):
                    for k in range(len(stack) - 1, 0, -1):
                        here = self.tag[stack[k]]
                        if here in ends:
                            close(k)
                            break
                        if here in BLOCK and here != "p" and "p" not in ends:
                            break
                if name == "br":
                    self._text(stack[-1], " ")
                self._open(name, attributes, stack[-1])
                if name in VOID or attributes.endswith("/"):
                    self.end[-1] = len(self.tag) - 1
                elif name in RAW:
                    end = CLOSE[name].search(page, at)
                    at = end.end() if end else len(page)
                    self.end[-1] = len(self.tag) - 1
                else:
                    stack.append(len(self.tag) - 1)
                    opened[name] += 1
        self._text(stack[-1], page[at:])
        close(0)

    def _open(self, name: str, attributes: str, parent: int) -> None:
        step, names, hidden = name, (), False
        if attributes:
            own = [(a.lower(), v.strip("\"'").lower()) for a, v in ATTRIBUTE.findall(attributes)]
            hidden = any(a == "hidden" for a, _ in own)
            found = sorted(x for x in own if x[0] in ("class", "id", "role") and x[1])
            names = [x for _, v in found for x in v.split()]
            if found:
                step = DIGITS.sub("0", f"{name} {found}")
        path = _hash(self.path[parent], step)
        low = self.low[parent] or name in TEXT_LEVEL
        if not low:
            self.met[path] += 1
            if self.met[path] > 1:
                path = _hash(path, self.met[path])
        self.tag.append(name)
        self.low.append(low)
        self.path.append(path)
        self.parent.append(parent)
        self.end.append(0)
        self.omitted.append(self.omitted[parent] or name in OMITTED or hidden)
        self.named.append(name == "form" or not NAMES.isdisjoint(names) and name not in ("html", "body", "article", "main"))

    def inside(self, letters: list[int]) -> list[int]:
        """Sums over each element and all that it holds."""
        out = letters[:]
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out

    def _leave_out(self) -> None:
        """Omit forms and elements by their names, but not those with an article or with most of the page's text (in
        forms, which may be wrapped round a page, with a paragraph or heading in it)."""
        if any(self.named):
            own, mains, prose = [0] * len(self.tag), [0] * len(self.tag), [0] * len(self.tag)
            for element, _, text in self.pieces:
                if not self.omitted[element]:
                    own[element] += len(text.strip())
            for k, name in enumerate(self.tag):
                mains[k] = name in ("article", "main") and not self.omitted[k]
                prose[k] = name in HEADING
            letters, mains, prose = self.inside(own), self.inside(mains), self.inside(prose)
            for k in range(1, len(self.tag)):
                stays = mains[k] or 2 * letters[k] >= letters[0] and (self.tag[k] != "form" or prose[k])
                self.omitted[k] |= self.omitted[self.parent[k]] or self.named[k] and not stays
        self.pieces = [x for x in self.pieces if not self.omitted[x[0]]]

    def blocks(self, first: int = 0) -> list[tuple[int, str]]:
        """(element of the first piece, text) of each block with a text in the element ``first``."""
        found: dict[int, list] = {}
        for element, block, text in self.pieces:
            if first <= element <= self.end[first]:
                found.setdefault(block, [element]).append(text)
        rows = ((x[0], " ".join(html.unescape("".join(x[1:])).split())) for x in found.values())
        return [x for x in rows if x[1]]

    def around(self, element: int) -> int:
        """The element itself or the first around it that is named by its place."""
        while self.low[element]:
            element = self.parent[element]
        return element

    def token(self, element: int, text: str) -> int:
        return _hash(self.path[self.around(element)], "text", text)


def tokens(page: Page) -> dict[int, tuple[int, str, int, int]]:
    """By token: its parent's, its tag ("" for a text), how often it occurs on the page, and the letters in it; 0 is the page."""
    blocks = page.blocks()
    own = [0] * len(page.tag)
    out: dict[int, tuple[int, str, int, int]] = {}
    for element, text in blocks:
        own[element] += len(text)
        token = page.token(element, text)
        out[token] = (page.path[page.around(element)], "", out.get(token, (0, "", 0, 0))[2] + 1, out.get(token, (0, "", 0, 0))[3] + len(text))
    for k, letters in enumerate(page.inside(own)):
        if not page.omitted[k]:
            _, _, n, held = out.get(page.path[k], (0, "", 0, 0))
            out[page.path[k]] = (page.path[page.parent[k]] if k else -1, page.tag[k] or "/", n + 1, held + letters)
    return out


def deduce(rows: list[tuple]) -> tuple[list[int], list[int]]:
    """(slots, constants) of a host from its tokens on enough pages: (token, parent, tag, class, pages, total, letters, around).

    ``letters``: in the token, ``around``: in the pages that it is on, over all of them.
    """
    tags = {x[0]: x for x in rows if x[2]}
    classes = {x[3] for x in tags.values()}
    constant: Counter = Counter()
    for _, _, tag, kind, _, _, letters, _ in rows:
        if not tag and kind in classes:
            constant[kind] += letters
    around = {x[3]: x[7] for x in rows}
    fixed_by = {kind for kind in classes if constant[kind] <= CONSTANT * around[kind]}
    constants = [x for x in rows if not x[2] and x[3] in fixed_by]

    def above(token: int) -> Iterator[int]:
        while token in tags:
            yield token
            token = tags[token][1]

    left = {token: x[6] for token, x in tags.items()}  # letters that no constant accounts for
    for _, parent, _, _, _, _, letters, _ in constants:
        for x in above(parent):
            left[x] -= letters
    pages_of = {x[3]: x[4] for x in tags.values()}
    # the letters of constants on the pages of a class; one that is on more pages has its share of them
    fixed = {kind: sum(x[6] * min(1.0, pages_of[kind] / x[4]) for x in constants) for kind in classes}
    best: dict[int, tuple] = {}
    for token, (_, _, tag, kind, pages, total, _, letters) in tags.items():
        if total == pages and tag not in TEXT_LEVEL and left[token] > 0 and left[token] >= MASS * (letters - fixed[kind]):
            slot = tag not in ("/", "html", "body"), pages, sum(1 for _ in above(token)), token
            best[kind] = max(best.get(kind, (False,)), slot)
    slots = [x[-1] for x in sorted(best.values(), reverse=True) if x[0]]
    return slots, sorted(x[0] for x in constants)


def extract(page: str, template: tuple[list[int], list[int]] | None) -> str:
    """The text of a page in the first of its host's slots that it has, without the host's constants; without a
    slot that of its articles or main element, if it is a large part of the page, or else of its body.

    A constant in a slot is the author's text all the same if it is a
    paragraph, heading, list item or the like, or in an article: recipes of
    a host share their headings and their salt."""
    slots, constants = template or ((), ())
    tree = Page(page)
    known = frozenset(constants)

    def in_article(element: int) -> bool:
        while element > 0 and tree.tag[element] not in ("article", "main"):
            element = tree.parent[element]
        return element > 0

    def text(first: int, slot: bool = False) -> list[str]:
        rows = tree.blocks(first)
        return [x for element, x in rows if not known or slot and tree.low[element] or tree.token(element, x) not in known or in_article(element)]

    if slots:
        place = {x: k for k, x in zip(range(len(tree.path) - 1, -1, -1), reversed(tree.path), strict=True) if not tree.omitted[k]}
        for slot in slots:
            if slot in place and (found := text(place[slot], slot=True)):
                return "\n\n".join(found)
    whole = text(0)
    total = sum(map(len, whole))
    own = []
    for name in ("article", "main"):
        found, end = [], -1
        for k, x in enumerate(tree.tag):
            if x == name and k > end and not tree.omitted[k]:  # one inside another is a part of it
                found.append(text(k))
                end = tree.end[k]
        sizes = [sum(map(len, x)) for x in found]
        # several articles of like size are the page's text together; small ones beside a large one are teasers
        if any(sizes):
            own.append([x for blocks, n in zip(found, sizes, strict=True) if 2 * n >= max(sizes) for x in blocks])
    large = [x for x in own if sum(map(len, x)) >= OWN_MASS * total]
    return "\n\n".join(next(iter(large or own), whole))


def _tokens(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = ["host", "token", "parent", "tag", "pages", "total", "digest", "mixed", "letters", "around"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6]

    def rows():
        columns = [*zip(*((*key, *own) for key, own in sums.items()), strict=True)] or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    sums: dict[tuple[str, int], list] = {}
    for batch in batches:
        for host, page_id, page in zip(*(batch.column(c).to_pylist() for c in ("host", "page_id", "html")), strict=True):
            found = tokens(Page(page or ""))
            around = found[0][3]
            if not around:  # a page without text tells nothing about a template
                continue
            for token, (parent, tag, n, letters) in found.items():
                digest = _hash(page_id, n)
                own = sums.get((host, token))
                if own is None:
                    sums[host, token] = [parent, tag, 1, n, digest >> 32, digest, letters, around]
                else:
                    own[2] += 1
                    own[3] += n
                    own[4] += digest >> 32
                    own[5] ^= digest
                    own[6] += letters
                    own[7] += around
        if len(sums) > 100_000:
            yield rows()
            sums.clear()
    yield rows()


def _deduce(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        found = [deduce([tuple(x.values()) for x in rows]) for rows in batch.column("tokens").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.int64()))], ["host", "slots", "constants"])


def templates(pages: DataFrame) -> DataFrame:
    """host, slots and constants (tokens) of each host, from all its pages.

    ``pages``: host, page_id, html.
    """
    found = pages.mapInArrow(_tokens, "host string, token bigint, parent bigint, tag string, pages bigint, total bigint, digest bigint, mixed bigint, letters bigint, around bigint")
    sums = [F.first(c).alias(c) for c in ("parent", "tag")] + [F.sum(c).alias(c) for c in ("pages", "total", "digest", "letters", "around")] + [F.bit_xor("mixed").alias("mixed")]
    found = park(found.groupBy("host", "token").agg(*sums).where(F.col("pages") >= MIN_PAGES), "page-tokens")
    hosts = found.where("token = 0").select("host", F.col("pages").alias("n_pages"))
    often = found.join(hosts, "host").where(F.col("pages") >= SUPPORT * F.col("n_pages"))
    # the class of a token: vectors with the same sums and digests
    row = F.struct("token", "parent", "tag", F.xxhash64("pages", "total", "digest", "mixed").alias("class"), "pages", "total", "letters", "around")
    by_host = often.groupBy("host").agg(F.sort_array(F.collect_list(row)).alias("tokens"))
    return by_host.mapInArrow(_deduce, "host string, slots array<bigint>, constants array<bigint>")


def _extract(known):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if known is None:
                own = [x and tuple(x.values()) for x in batch.column("template").to_pylist()]
            else:
                own = [known.value.get(x) for x in batch.column("host").to_pylist()]
            texts = [extract(x or "", of_host) for x, of_host in zip(batch.column("html").to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    A null or empty page has an empty text; pages with a null url form a host
    of their own; a null page_id and repeated rows are pages like others (the
    same page_id and count on two rows cancel out in one digest, not in the
    other); other columns are not read; an empty table gives an empty result.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    spark = pages.sparkSession
    found = park(templates(rows.select("host", "page_id", "html")).where("size(slots) + size(constants) > 0"), "page-templates")
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint"
    # as Python objects some 40 bytes a number
    size = found.agg(F.sum(200 + F.length("host") + 40 * (F.size("slots") + F.size("constants")))).first()[0] or 0
    if size <= broadcast_bytes:
        known = {r.host: (r.slots, r.constants) for r in found.collect()}
        return rows.mapInArrow(_extract(spark.sparkContext.broadcast(known)), schema)
    salts = found.select("host", F.struct("slots", "constants").alias("template"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(salts, ["host", "salt"], "left").select("page_id", "url", "html", "template").mapInArrow(_extract(None), schema)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
