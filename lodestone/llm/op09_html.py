"""Main text of web pages by consensus host paths.

Each page scores its containers: the text of a block counts fully for the nearest container around it and by half for
each one further out, summed over equal generalised paths (tags with their classes, digits folded). The best path,
or the article or main element around it, or else the container that also holds the page's headline, is the page's
vote. Pages vote per host in Spark, and report digests of their blocks with their paths. A path beside the winning one is
furniture of the host if its blocks repeat, each on two pages on average. On every page of the host the winning path is
then used: outside it, furniture and blocks of links alone go, and all other readable text stays. Where the winning path holds less than half of a page's readable text, all of it stays. A
page is read in one pass whose time grows with its length only.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, written

#: A host table of at most this many paths is broadcast; a larger one is joined by shuffle.
BROADCAST_HOSTS = 200_000
#: The share of a page's readable text that the host's path must hold to be used there.
LEAST_SHARE = 0.5
# Fixed lists: elements of HTML by their role, and whole class names, ids and roles of what isn't the article.
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th caption blockquote pre figure figcaption address details summary center hr header footer nav aside form fieldset dialog menu search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body main article section div td blockquote center".split())
DROPPED = frozenset("nav footer aside dialog menu search head noscript template iframe svg canvas select button textarea object audio video label".split())
#: Dropped elements that lie inside a line of text, which goes on after them.
INLINE = frozenset("button canvas select object audio video label".split())
#: Dropped unless they hold at least half of a page's readable text: then they are wrapped around it.
FORMS = frozenset("form fieldset".split())
RAW = frozenset("script style title textarea xmp noscript iframe noframes template svg".split())
#: Raw elements after whose start tag a page goes on if they are never closed.
MAY_BE_OPEN = frozenset("title svg template".split())
NAMED = frozenset("ad ads advert adverts advertisement ad-slot sponsored banner menu nav navbar navigation breadcrumb breadcrumbs pagination header masthead site-header footer sidebar cookie cookies cookie-notice notice comment comments reader-comments login newsletter contentinfo complementary".split())
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_CLOSES_P = BLOCKS - {"html", "body"}


class _Scanner:
    """Tags of a page, one after the other. A `<` that no `>` follows is text. A quoted `>` doesn't end a tag; but once
    a quote turns out to be open to the end of the page, quotes count for nothing from there on."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True
        self.unclosed: set[str] = set()
        self.at = {">": -1, '"': -1, "'": -1}

    def next(self, pos: int) -> tuple[int, int, str, bool, str]:
        """(start, end, tag, closing, attributes) of the first tag, comment or declaration from pos on; the latter two
        have no tag. start is the page's length where there is none."""
        page = self.page
        while True:
            start = page.find("<", pos)
            if start < 0 or start > self.last:
                return len(page), len(page), "", False, ""
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", False, ""
            if page[start + 1] in "!?":
                return start, page.find(">", start) + 1, "", False, ""
            closing = page[start + 1] == "/"
            name = _NAME.match(page, start + 1 + closing)
            if name:
                end = self._end(name.end())
                return start, end, name[0].lower(), closing, page[name.end() : end - 1]
            pos = start + 1

    def _seen(self, mark: str, at: int) -> int:
        """Where the first such mark from `at` on lies; the last answer is kept, so that no stretch is searched twice."""
        if self.at[mark] < at:
            found = self.page.find(mark, at)
            self.at[mark] = len(self.page) if found < 0 else found
        return self.at[mark]

    def _end(self, pos: int) -> int:
        page, at = self.page, pos
        while self.quotes:
            end = self._seen(">", at)
            quote = min(self._seen('"', at), self._seen("'", at))
            if end < min(quote, len(page)):
                return end + 1
            shut = -1 if end == len(page) else page.find(page[quote], quote + 1)
            self.quotes = shut >= 0
            at = shut + 1
        return page.find(">", pos) + 1

    def after_raw(self, tag: str, pos: int) -> int:
        """Where the page goes on after a raw element that starts before pos."""
        if tag not in self.unclosed:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, pos)
            if end:
                return end.end()
            self.unclosed.add(tag)
        return pos if tag in MAY_BE_OPEN else len(self.page)


class _Element:
    __slots__ = ("dropped", "inside", "named", "parent", "path", "tag", "total")

    def __init__(self, tag: str, path: int, parent: _Element | None, dropped: bool, named: bool, inside: bool):
        self.tag, self.path, self.parent, self.dropped, self.named, self.inside, self.total = tag, path, parent, dropped, named, inside, 0


class Page:
    """The readable blocks of a page in order (text, its readable characters, its element), its elements, and the
    generalised paths of its containers as a tree: path i has the parent paths[i][0] and the step paths[i][1]."""

    def __init__(self, source: str):
        self.paths: list[tuple[int, str]] = [(-1, "")]
        self.elements = [_Element("", 0, None, False, False, False)]
        self.blocks: list[tuple[str, int, _Element]] = []
        self._read(source)
        # What its name calls furniture is none where it holds all of the page's text, and a form with most of it is none.
        for text, n, e in self.blocks:
            e.total += n
        for e in reversed(self.elements[1:]):
            e.parent.total += e.total
        whole = self.elements[0].total
        for e in self.elements[1:]:
            e.dropped = e.parent.dropped or (e.named and e.total < max(whole, 1)) or (e.tag in FORMS and 2 * e.total < max(whole, 1))
        self.blocks = [b for b in self.blocks if not b[2].dropped]

    def _read(self, source: str) -> None:
        scan, numbers, open_tags = _Scanner(source), {}, {}
        buffer: list[str] = []
        at, linked, links, pos = self.elements[0], False, 0, 0

        def flush() -> None:
            nonlocal links
            text = " ".join(html.unescape("".join(buffer)).split()) if buffer else ""
            buffer.clear()
            own = at
            while own.tag in INLINE:
                own = own.parent
            if text and not own.dropped:
                n = len(text) - text.count(" ")
                self.blocks.append((text, n if own.tag in HEADINGS else max(n - links, 0), own))
            links = 0

        def close(e: _Element) -> _Element:
            open_tags[e.tag] -= 1
            return e.parent

        while pos < len(source):
            start, end, tag, closing, rest = scan.next(pos)
            if start > pos and at.tag not in INLINE:
                buffer.append(source[pos:start])
                links += len("".join(html.unescape(source[pos:start]).split())) if linked else 0
            pos = end
            if not tag:
                continue
            block = tag in BLOCKS or tag in DROPPED
            if closing:
                if tag == "a":
                    linked = False
                elif tag in INLINE and at.tag == tag:
                    at = close(at)
                elif block:
                    flush()
                    if open_tags.get(tag):
                        while at.tag != tag:
                            at = close(at)
                        at = close(at)
            elif tag in RAW:
                pos = pos if tag == "svg" and rest.endswith("/") else scan.after_raw(tag, pos)
            elif tag == "a":
                linked = "href" in rest.lower()
            elif tag in ("br", "wbr", "img", "input"):
                buffer.append(" " if tag == "br" else "")
            elif block:
                if tag not in INLINE:
                    flush()
                if at.tag == "p" and tag in _CLOSES_P or at.tag == tag and tag in ("li", "tr", "td", "dt", "dd"):
                    at = close(at)
                if tag == "hr" or rest.endswith("/"):
                    continue
                attributes = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest else {}
                names = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower().split()
                dropped = at.dropped or tag in DROPPED or (tag == "header" and not at.inside) or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
                named = not NAMED.isdisjoint(names) and tag not in ("html", "body", "main", "h1") and not (at.inside and "header" in names)
                path = at.path
                if tag in CONTAINERS:
                    classes = ".".join(sorted(re.sub(r"\d+", "#", c) for c in attributes.get("class", "").lower().split()))
                    step = (at.path, f"{tag}{'.' * bool(classes)}{classes}")
                    path = numbers.setdefault(step, len(self.paths))
                    if path == len(self.paths):
                        self.paths.append(step)
                at = _Element(tag, path, at, dropped, named, at.inside or tag in ("article", "main"))
                self.elements.append(at)
                open_tags[tag] = open_tags.get(tag, 0) + 1
        flush()

    def text(self) -> str:
        return "\n".join(t for t, *_ in self.blocks)

    def name(self, path: int) -> str:
        steps = []
        while path > 0:
            path, step = self.paths[path]
            steps.append(step)
        return "/".join(reversed(steps))

    def find(self, name: str) -> int:
        """The path with this name; -1 if the page has none."""
        at = 0
        known = {step: i for i, step in enumerate(self.paths)}
        for step in name.split("/"):
            at = known.get((at, step), -1)
            if at < 0:
                break
        return at

    def under(self, path: int) -> list[bool]:
        """Which paths are this one or below it."""
        out = []
        for i, (parent, _) in enumerate(self.paths):
            out.append(i == path or (i > 0 and out[parent]))
        return out

    def vote(self) -> str:
        """The page's own choice of a path; "" for a page without readable text."""
        own = [0.0] * len(self.paths)
        for _, n, e in self.blocks:
            own[e.path] += n
        score = own[:]
        for i in range(len(self.paths) - 1, 0, -1):
            score[self.paths[i][0]] += score[i] / 2
        best = max(range(1, len(self.paths)), key=lambda i: (score[i], i), default=0)
        if not best or not score[best]:
            return ""
        around, at = [], best
        while at > 0:
            around.append(at)
            at = self.paths[at][0]
        outer = next((i for i in around if self.paths[i][1].split(".")[0] in ("article", "main")), None)
        if outer is None:
            head, above = next((e.path for _, _, e in self.blocks if e.tag == "h1"), -1), set()
            while head > 0:
                above.add(head)
                head = self.paths[head][0]
            outer = next((i for i in around if i in above), best)
        return self.name(outer)

    def digests(self) -> list[tuple[str, int]]:
        """(path, digest) of each distinct block."""
        rows = {(e.path, text) for text, _, e in self.blocks}
        names = {path: self.name(path) for path, _ in rows}
        return [(names[path], xxhash.xxh64_intdigest(text) - (1 << 63)) for path, text in rows]

    def text_at(self, name: str, furniture: frozenset[str] | list[str] = frozenset()) -> str | None:
        """Text of all elements with this path, and of those beside them that are neither furniture nor links alone. None
        if the path holds less than LEAST_SHARE of the page's readable text."""
        path = self.find(name) if name else -1
        if path <= 0:
            return None
        under = self.under(path)
        inside = [n for _, n, e in self.blocks if under[e.path]]
        if not inside or sum(inside) < LEAST_SHARE * sum(n for _, n, _ in self.blocks):
            return None
        gone = {f for f in map(self.find, furniture) if f > 0}
        return "\n".join(t for t, n, e in self.blocks if under[e.path] or (n and e.path not in gone))


def blocks(page: str) -> list[tuple[str, int, _Element]]:
    """The readable blocks of a page in order: text, characters of it that are neither white space nor in links (a
    heading's all count), and the element that holds it."""
    return Page(page).blocks


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, null) for each page's vote; (host, path, digest) for each distinct block of a page."""
    for batch in batches:
        for part in byte_chunks(batch, "html"):
            rows = []
            for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                page = Page(source)
                own = page.vote()
                if own:
                    rows.append((host, own, None))
                    rows += [(host, path, digest) for path, digest in page.digests()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["host", "path", "digest"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in byte_chunks(batch, "_html"):
            texts = []
            for source, path, furniture in zip(*(part.column(c).to_pylist() for c in ("_html", "_path", "_furniture")), strict=True):
                page = Page(source or "")
                text = page.text_at(path or "", furniture or ())
                texts.append(page.text() if text is None else text)
            yield pa.RecordBatch.from_arrays([*part.columns[3:], pa.array(texts, pa.string())], names=[*part.schema.names[3:], "_text"])


def host_of(url) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, path, furniture): each host's path with most votes, ties to the first by code point, and its paths of
    furniture. Pages without text don't vote."""
    rows = pages.where(F.col(page).isNotNull()).select(host_of(F.col(url)).alias("host"), F.col(page).alias("html"))
    seen = written(rows.mapInArrow(_vote, "host string, path string, digest long").groupBy("host", "path", "digest").agg(F.count("*").alias("n")))
    paths = seen.where("digest IS NULL").groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), "path"))["path"].alias("path"))
    repeated = seen.where("digest IS NOT NULL").groupBy("host", F.col("path").alias("at")).agg(F.sum("n").alias("n"), F.count("*").alias("texts")).where("n >= 2 * texts")
    beside = (F.col("at") != F.col("path")) & ~F.startswith("at", F.concat("path", F.lit("/")))
    furniture = repeated.join(paths, "host").where(beside).groupBy("host").agg(F.collect_list("at").alias("furniture"))
    return paths.join(furniture, "host", "left")


def extract(pages: DataFrame, url: str = "url", page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep`, text and n_chars for every row of pages. Null or empty pages, and pages without readable text, give "".

    Pages with a null url, or one without a host, share the host "". Columns of `keep` that are called text or n_chars
    are replaced; any other names are kept as they are."""
    hosts = written(host_paths(pages, url, page)).select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("furniture").alias("_furniture"))
    if hosts.agg(F.coalesce(F.sum(1 + F.size(F.coalesce("_furniture", F.array()))), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    keep = [c for c in keep if c not in ("text", "n_chars")]
    own = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    rows = pages.select(F.col(page).alias("_html"), host_of(F.col(url)).alias("_host"), *own)
    kinds = ", ".join(f"_k{i} {rows.schema[f'_k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    rows = rows.join(hosts, "_host", "left").select("_html", "_path", "_furniture", *[f"_k{i}" for i in range(len(keep))])
    out = rows.mapInArrow(_extract, f"{kinds}{', ' * bool(keep)}_text string")
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
