"""The main text of web pages, by the places where the pages of a host keep it.

Every page names the container that holds most of its running text. Pages of a
host vote with that container's path of tags and classes; numbers in names are
made alike, so that pages of one template agree. A page's text is then taken
from the path of its host that has most votes and that the page has.
"""

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticode.llm.tables import text_or_empty, written

#: A path wins if two pages of the host and one in this many vote for it.
VOTERS = 2
ONE_IN = 20
#: Hosts with one page in this many: at most so many, sent to all executors.
HOT_ONE_IN = 1000
HELD_PATHS = 100_000
CHUNK_CHARS = 4 << 20

#: A comment, a tag with its attributes, or a declaration. Quotes count behind
#: an equals sign only; what is not closed reaches to the end.
_TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))
    |(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)
    |[!?/][^>]*+(?:>|\Z))""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NUMBER = re.compile(r"\d+")

#: Fixed values of HTML: elements without content, elements whose content is
#: not markup, elements that stay within a line, what an open p or li ends at.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I)
       for t in "script style title textarea noscript iframe noembed noframes xmp".split()}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt "
                   "s samp small span strike strong sub sup time tt u var".split())
NO_NODE = frozenset(("html", "head", "body"))
ENDS = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)),
        "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")),
        "option": frozenset(("select",))}
ALIKE = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
#: Blocks that are part of a text rather than what holds it.
PARTS = HEADINGS | frozenset("p ul ol li dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr th caption "
                             "details summary hr address".split())

#: Fixed lists: elements, roles and words of class names and ids that mark what
#: is not the article; words that mark it; words that only describe a layout.
DROP_TAGS = frozenset("nav footer aside form button select object svg math canvas audio video dialog menu template map applet "
                      "datalist fieldset meter progress".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
                       "toolbar status tooltip".split())
DROP_WORDS = frozenset("nav navbar navigation menu menus masthead topbar footer sidebar aside ad ads advert adverts advertisement "
                       "advertising adbox adslot adsense banner sponsor sponsored promo promos promotion cookie cookies consent gdpr "
                       "notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription "
                       "signup login comment comments commentlist disqus respond reply replies discussion share sharing social related "
                       "recommended recommendations breadcrumb breadcrumbs pagination pager widget widgets toolbar copyright search "
                       "searchbox form".split())
DROP_WORDS_OF_MAIN = frozenset("comment comments reply ad ads advert advertisement sponsored promo related".split())
LAYOUT_WORDS = frozenset("has with no without".split())
MAIN_WORDS = frozenset("article content main post entry story body text".split())
MAIN_TAGS = frozenset(("article", "main"))

#: What a container gets of the text below it, per level, and for its name.
FADE, PART_FADE, LEAST_FADE = 0.7, 0.97, 0.01
FOR_TAG, FOR_NAME = 3.0, 1.5


class Page(NamedTuple):
    """A parsed page. Node 0 is the body; a node's blocks are first:last."""

    parent: list[int]
    label: list[str]
    first: list[int]
    last: list[int]
    holds: list[bool]
    weight: list[float]
    blocks: list[str]
    of: list[int]       # node of each block
    links: list[int]    # characters of each block that are in links
    heading: list[bool]  # whether a block is a heading

    def path(self, node: int) -> str:
        out = []
        while node > 0:
            out.append(self.label[node])
            node = self.parent[node]
        return ">".join(["body", *reversed(out)])

    def text(self, nodes: list[int]) -> str:
        return "\n".join(b for n in nodes for b in self.blocks[self.first[n]:self.last[n]])


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), double or single or bare)
    return out


def _label(tag: str, a: dict[str, str]) -> str:
    """Tag and classes, or the id where there are none; numbers are alike."""
    names = sorted({_NUMBER.sub("#", c) for c in re.sub(r"[^\w\s-]", "", a.get("class", "").lower()).split()})
    if names:
        return ".".join([tag, *names])
    name = re.sub(r"[^\w-]", "", a.get("id", "").lower())
    return f"{tag}@{_NUMBER.sub('#', name)}" if name else tag


def _words(a: dict[str, str]) -> set[str]:
    out: set[str] = set()
    for name in [*a.get("class", "").split(), *a.get("id", "").split()]:
        words = {w.lower() for w in _WORDS.findall(name)}
        if not words & LAYOUT_WORDS:
            out |= words
    return out


def _unwanted(tag: str, a: dict[str, str], words: set[str]) -> bool:
    if tag in DROP_TAGS or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in DROP_ROLES:
        return True
    style = a.get("style", "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style:
        return True
    return bool(words & (DROP_WORDS_OF_MAIN if tag in MAIN_TAGS else DROP_WORDS))


#: What an open element does to the text in it.
KEEP, TITLES, DROP = 0, 1, 2


class _Open(NamedTuple):
    tag: str
    node: int
    does: int
    link: bool
    inline: bool


class _Reader:
    """Builds a page from tags and texts in one pass."""

    def __init__(self):
        self.page = Page([-1], ["body"], [0], [0], [True], [1.0], [], [], [], [])
        self.stack = [_Open("body", 0, KEEP, False, False)]
        self.open: Counter[str] = Counter()
        self.run: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            top = next(e for e in reversed(self.stack) if not e.inline)
            if text:
                self.page.blocks.append(text)
                self.page.of.append(top.node)
                self.page.links.append(min(self.linked, len(text)))
                self.page.heading.append(top.tag in HEADINGS)
            self.run, self.linked = [], 0

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if top.does == DROP or (top.does == TITLES and not self.open.keys() & HEADINGS):
            return
        text = unescape(raw) if "&" in raw else raw
        self.run.append(text)
        if top.link:
            self.linked += len(text)

    def pop(self) -> None:
        top = self.stack[-1]
        if not top.inline:
            self.flush()
            self.page.last[top.node] = len(self.page.blocks)
        self.stack.pop()
        if self.open[top.tag] == 1:
            del self.open[top.tag]
        else:
            self.open[top.tag] -= 1

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.pop()

    def close_open(self, tags: tuple[str, ...], ends: frozenset[str] | None) -> None:
        """Ends the innermost of some elements, unless one of `ends` (of any
        other block, for None) is open inside it."""
        if not any(t in self.open for t in tags):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            entry = self.stack[depth]
            if entry.tag in tags:
                self.pop_to(depth)
                return
            if entry.tag in ends if ends is not None else not entry.inline:
                return

    def start(self, tag: str, raw: str) -> None:
        if tag in NO_NODE or tag in VOID:
            if tag in ("br", "img", "wbr", "input"):
                self.run.append(" " if tag == "br" else "")
            elif tag == "hr":
                self.close_open(("p",), None)
                self.flush()
            return
        inline = tag in INLINE
        if not inline:
            self.close_open(("p",), None)
            self.close_open(ALIKE.get(tag, (tag,)), ENDS[tag]) if tag in ENDS else None
            self.flush()
        elif tag == "a" and "a" in self.open:
            self.close_open(("a",), None)
        above = self.stack[-1]
        a = _attributes(raw) if "=" in raw or "hidden" in raw else {}
        words = _words(a) if a else frozenset()
        does = above.does
        if does != DROP and (a or tag in DROP_TAGS) and _unwanted(tag, a, words):
            does = DROP
        elif does == KEEP and not inline and (tag == "header" or words and "header" in words):
            does = TITLES if self.open.keys() & MAIN_TAGS else DROP
        node = above.node
        if not inline:
            page, node = self.page, len(self.page.parent)
            page.parent.append(above.node)
            page.label.append(_label(tag, a) if a else tag)
            page.first.append(len(page.blocks))
            page.last.append(len(page.blocks))
            page.holds.append(tag not in PARTS)
            named = words and words & MAIN_WORDS or a.get("role") == "main" or a.get("itemprop") == "articleBody"
            page.weight.append(FOR_TAG if tag == "article" else FOR_NAME if tag == "main" or named else 1.0)
        self.stack.append(_Open(tag, node, does, above.link or tag == "a", inline))
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag in self.open:
            for depth in range(len(self.stack) - 1, 0, -1):
                if self.stack[depth].tag == tag:
                    self.pop_to(depth)
                    return
                if tag in INLINE and not self.stack[depth].inline:
                    return
        elif tag in ("p", "br"):
            self.flush()


def parse(html: str) -> Page:
    """Containers and blocks of a page; what is not the article is left out.
    Broken markup is read as browsers do: elements end with what holds them."""
    reader, at = _Reader(), 0
    while m := _TAG.search(html, at):
        if m.start() > at:
            reader.text(html[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            reader.end(tag)
        elif tag in RAW:
            end = RAW[tag].search(html, at)
            at = end.start() if end else len(html)
        else:
            reader.start(tag, m[3])
            if m[3].endswith("/") and tag in ("svg", "math"):
                reader.end(tag)
    if at < len(html):
        reader.text(html[at:])
    reader.pop_to(1)
    reader.flush()
    reader.page.last[0] = len(reader.page.blocks)
    return reader.page


def best_container(page: Page) -> int | None:
    """The container with most running text: a block counts for the containers
    above it, less for each level, links count against them. If all that the
    next container adds are headings, it is that one. Of equals the first."""
    if not page.blocks:
        return None
    points: Counter[int] = Counter()
    for text, node, links in zip(page.blocks, page.of, page.links):
        share = 1.0
        while node >= 0 and share > LEAST_FADE:
            if page.holds[node]:
                points[node] += share * (len(text) - links)
            share *= FADE if page.holds[node] else PART_FADE
            node = page.parent[node]
    size, linked = [0], [0]
    for text, links in zip(page.blocks, page.links):
        size.append(size[-1] + len(text))
        linked.append(linked[-1] + links)

    def score(n: int) -> float:
        a, b = page.first[n], page.last[n]
        return points[n] * page.weight[n] * (1 - (linked[b] - linked[a]) / max(1, size[b] - size[a]))

    best = max(sorted(points) or [0], key=score)
    above = page.parent[best]
    while above >= 0:
        more = [*range(page.first[above], page.first[best]), *range(page.last[best], page.last[above])]
        if not all(page.heading[k] for k in more):
            break
        if more and page.holds[above]:
            best = above
        above = page.parent[above]
    return best


def at_path(page: Page, paths: list[str]) -> tuple[str, list[int]] | None:
    """The first of the paths that has text on the page, and its containers:
    all, in page order, but those that are links for the most part if others
    are not."""
    child: dict[tuple[int, str], int] = {}
    place, nodes = [0], [[0]]
    for n in range(1, len(page.parent)):
        key = (place[page.parent[n]], page.label[n])
        if key not in child:
            child[key] = len(nodes)
            nodes.append([])
        place.append(child[key])
        nodes[child[key]].append(n)
    for path in paths:
        here: int | None = 0
        for label in path.split(">")[1:]:
            here = child.get((here, label))
            if here is None:
                break
        found = [n for n in nodes[here] if page.last[n] > page.first[n]] if here is not None else []
        if found:
            plain = [n for n in found if 2 * sum(page.links[page.first[n]:page.last[n]])
                     <= sum(map(len, page.blocks[page.first[n]:page.last[n]]))]
            return path, plain or found
    return None


def host_of(url: str | Column) -> Column:
    """The host of an absolute URL in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(text_or_empty(url), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1))


def host_paths(pages: DataFrame, held: int = HELD_PATHS) -> DataFrame:
    """(host, path, pages): votes for each path, and, under the null path, the
    pages of the host. Tasks add up votes before they are shuffled."""
    def vote(batches):
        votes: Counter[tuple[str, str | None]] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            if votes:
                keys = list(votes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.string()),
                     pa.array([votes[k] for k in keys], pa.int64())], ["host", "path", "pages"])
                votes.clear()

        for batch in batches:
            for host, html in zip(batch["host"], batch["html"]):
                host, page = host.as_py(), parse(html.as_py())
                votes[host, None] += 1
                if (best := best_container(page)) is not None:
                    votes[host, page.path(best)] += 1
                if len(votes) > held:
                    yield from flush()
        yield from flush()

    voted = pages.select("host", "html").mapInArrow(vote, "host string, path string, pages long")
    return voted.groupBy("host", "path").agg(F.sum("pages").alias("pages"))


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 voters: int = VOTERS, one_in: int = ONE_IN) -> DataFrame:
    """(id, url, path, agreed, text), one row per row.

    `path` is where the text was found, `agreed` whether the host's pages chose
    it. Character references are decoded, white space within a block is one
    space, blocks are lines. A page without a path of its host, or without a
    host, uses its own best container. A null page is empty: no path, empty
    text, as for pages of nothing but menus. Repeated rows vote and are
    returned each time; an empty table gives no rows; other columns are not
    read.

    Votes are counted before they are shuffled. A host of at least one page in
    1,000 is one of at most 1,000: their paths (at most `one_in` each) are sent
    to all executors, and their pages are not shuffled. Pages of other hosts
    are joined with their host's paths, which Spark does by size.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"),
                        text_or_empty(html_col).alias("html"))
    votes = written(host_paths(rows.where("host <> ''")), "votes")
    hosts = votes.where("path IS NULL").select("host", F.col("pages").alias("all"))
    total = hosts.agg(F.sum("all")).first()[0] or 0
    won = (votes.where(F.col("path").isNotNull() & (F.col("pages") >= voters)).join(hosts, "host")
           .where(F.col("pages") * one_in >= F.col("all")).groupBy("host")
           .agg(F.sort_array(F.collect_list(F.struct((-F.col("pages")).alias("k"), "path"))).alias("found"))
           .select("host", F.col("found.path").alias("paths")))
    won = written(hosts.join(won, "host", "left"), "paths")
    hot = F.col("all") * HOT_ONE_IN >= F.lit(total)
    empty = rows.sparkSession.createDataFrame([("", None)], "host string, paths array<string>")
    large = F.broadcast(won.where(hot).select("host", "paths").unionByName(empty))  # at most 1,001 rows
    near = rows.join(large, "host")
    far = rows.join(large.select("host"), "host", "left_anti").join(won.where(~hot).select("host", "paths"), "host", "left")
    names = ["id", "url", "path", "agreed", "text"]

    def extract(batches):
        for batch in batches:
            out, size, start = [], 0, 0
            for k, (html, paths) in enumerate(zip(batch["html"], batch["paths"].to_pylist())):
                page = parse(html.as_py())
                found = at_path(page, paths) if paths and page.blocks else None
                if found:
                    out.append((found[0], True, page.text(found[1])))
                elif (best := best_container(page)) is not None:
                    out.append((page.path(best), False, page.text([best])))
                else:
                    out.append((None, False, ""))
                size += len(out[-1][2])
                if size > CHUNK_CHARS or k == batch.num_rows - 1:
                    path, agreed, text = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [batch["id"].slice(start, len(out)), batch["url"].slice(start, len(out)), pa.array(path, pa.string()),
                         pa.array(agreed, pa.bool_()), pa.array(text, pa.string())], names)
                    out, size, start = [], 0, k + 1

    kind = pages.schema[id_col].dataType.simpleString()
    both = near.select("id", "url", "html", "paths").unionByName(far.select("id", "url", "html", "paths"))
    return both.mapInArrow(extract, f"id {kind}, url string, path string, agreed boolean, text string")
