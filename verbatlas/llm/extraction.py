"""Main text of web pages: containers are scored page by page, each host's pages vote on their paths, and the winners are extracted."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from verbatlas.sources.shared import stash

# Fixed values of HTML: elements without content, and elements that part blocks of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold no main text wherever they stand: some part blocks, some lie within a line.
DROPPED = frozenset("aside dialog footer head legend menu nav optgroup option search".split())
SKIPPED = frozenset("applet audio button canvas datalist frameset label map meter noscript object output progress select svg template video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar tooltip".split())
#: Words of class names and ids by which sites mark what is no main text.
MARKED = frozenset(
    """ad ads adsbygoogle advert advertisement advertising adverts advertorial adunit alert alerts announcement announcements aside banner banners billboard breadcrumb breadcrumbs comment commentlist comments consent cookie cookies
    copyright crumbs disclaimer disqus donate feedback follow footer form gdpr infobar leaderboard livefyre login menu menus modal mpu nav navbar navigation navi newsletter notice notices notification notifications
    outbrain overlay pager paginate pagination paging paywall popover popup popups promo promoted promos promotion recommend recommendations recommended recirc register related replies reply respond responses search
    share sharebar sharing shoutbox sidebar sidebars signin signup skip skyscraper social sponsor sponsored sponsors subscribe subscription taboola tagcloud toast toolbar tooltip topbar trending utilities widget widgets""".split()
)
#: Words in a class name with which those above speak of a layout; words at its start that turn it round; words of what holds the article.
LAYOUT = frozenset("container content layout main page wrapper article post entry story".split())
TURNED = frozenset("has no with without is hide show".split())
ARTICLE = frozenset("article post entry story content main".split())
#: A container is passed over for one inside it that holds this share of its good text; one that calls itself an article needs less, and gives way for more.
INNER, INNER_ARTICLE, INNER_CALLED = 0.8, 0.5, 0.9
_SMALL = HEADINGS | {"p", "html", "li", "dt", "dd"}
#: A container is present on a page where it holds this share of the page's good text.
PRESENT = 0.2
#: A host agrees on a path with two votes or more, and one in so many of its votes; so it agrees on at most as many paths.
LEAST_VOTES, HOST_PATHS = 2, 1000
#: Agreed paths, of all hosts, that may travel to the tasks; with more, pages are dealt out by host.
BROADCAST_PATHS = 200_000

#: A tag or other markup. Quoted values may hold the sign that ends a tag; raw elements, comments and tags that never end take the rest of the page, so no character is tried twice.
_VALUES = r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>"""
_MARKUP = re.compile(rf"<(?:(script|style|textarea|title|iframe|noembed|noframes|xmp)(?=[\s/>]){_VALUES}(?:.*?(?=</\1[\s/>])|.*)|(/?)([a-z][^\s/>]*+){_VALUES}|!--(?:-?>|.*?-->|.*)|/?[a-z].*|[!?/][^>]*+>?)", re.I | re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TELLING = re.compile("class|id|role|style|hidden", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_VARIES = re.compile(r"[a-z]\d+[a-z]|\d[a-f]\d")
_LISTS, _TABLES = frozenset("ul ol menu dir".split()), frozenset("table tbody thead tfoot".split())
#: What the start of an element closes, and where the search for it ends.
_CLOSES = {
    "li": (("li",), _LISTS), "dt": (("dt", "dd"), frozenset(["dl"])), "dd": (("dt", "dd"), frozenset(["dl"])), "tr": (("tr",), _TABLES), "td": (("td", "th"), _TABLES | {"tr"}), "th": (("td", "th"), _TABLES | {"tr"}),
    "option": (("option",), frozenset(["select", "datalist", "optgroup"])),
}
_CELL, _TABLE_PARTS = frozenset("table td th caption".split()), frozenset("table tbody thead tfoot tr td th caption".split())


def attributes_of(raw: str) -> dict[str, str]:
    """Names in lower case, the first of a name, references decoded."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return found


def generalised(name: str, attributes: dict[str, str]) -> str:
    """A tag with its classes, or else its id: digits count as one sign, and classes that look made for one page or build (digits among letters) are left out."""
    if name in ("html", "body"):
        return name
    classes = sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").lower().split() if not _VARIES.search(c)})
    own = re.sub(r"\d+", "#", attributes.get("id", "").lower())
    return name + "".join(f".{c}" for c in classes) + (f"#{own}" if own and not classes and not _VARIES.search(own) else "")


def _name_words(attributes: dict[str, str]) -> Iterator[list[str]]:
    for name in (*attributes.get("class", "").split(), attributes.get("id", "")):
        if words := [w.lower() for w in _WORDS.findall(name)]:
            yield words


def marked(attributes: dict[str, str]) -> bool:
    """Whether class names, id, role or style say that an element holds no main text."""
    if attributes.get("role", "").lower().strip() in ROLES or "hidden" in attributes or _HIDDEN.search(attributes.get("style", "")):
        return True
    return any(words[0] not in TURNED and (words[-1] in MARKED or any(w in MARKED for w in words) and not any(w in LAYOUT for w in words)) for words in _name_words(attributes))


def kinds_of(name: str, attributes: dict[str, str]) -> tuple[bool, bool, bool, bool]:
    """Whether an element goes by its tag, is marked, heads something, and calls itself an article."""
    whole = name in ("html", "body")
    calls = name in ("article", "main") or not whole and any(w[0] not in TURNED and not MARKED.intersection(w) and ARTICLE.intersection(w) for w in _name_words(attributes))
    return name in DROPPED, name == "form" or not whole and name != "main" and bool(attributes) and marked(attributes), heads(name, attributes), calls


def heads(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element is the header of something."""
    return name == "header" or any(words[-1] in ("header", "masthead") and not any(w in LAYOUT for w in words) for words in _name_words(attributes))


class Paths:
    """Hashes and names of the paths met so far, and what tags and their values mean; forgotten beyond a bound."""

    def __init__(self) -> None:
        self.hashes: dict[tuple[int, str], int] = {}
        self.names: dict[int, str] = {}
        self.kinds: dict[tuple[str, str], tuple[str, tuple[bool, ...]]] = {}

    def step(self, parent: int, name: str, values: str) -> tuple[int, tuple[bool, ...]]:
        if (name, values) not in self.kinds:
            attributes = attributes_of(values) if values else {}
            self.kinds[name, values] = generalised(name, attributes), kinds_of(name, attributes)
        own, kinds = self.kinds[name, values]
        if (parent, own) not in self.hashes:
            found = int.from_bytes(hashlib.blake2b(f"{parent} {own}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
            self.hashes[parent, own] = found
            self.names[found] = f"{self.names.get(parent, '')}/{own}"[-200:]
        return self.hashes[parent, own], kinds

    def trim(self) -> None:
        if len(self.hashes) + len(self.kinds) > 200_000:
            self.__init__()


class Page:
    """The elements of one page and its blocks of text.

    Element i has ``parent[i]``, a ``path`` (hash of the tags and classes from the root on), and ``apart[i]``: it is no main text, or lies in such an element.
    ``blocks`` holds (element, text, characters in links) in page order; a block's element is the innermost one that parts blocks.
    """

    def __init__(self, text: str, paths: Paths) -> None:
        self.tag, self.parent, self.path, self.fixed, self.marked, self.heads, self.article = ["#root"], [-1], [0], [False], [False], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        tags, stack, count = self.tag, [0], dict.fromkeys(BLOCKS | DROPPED, 0)
        pieces: list[str] = []
        linked = link_depth = at = 0
        skipping, nested, inner = "", 0, 0

        def flush() -> None:
            nonlocal linked
            if pieces:
                block = " ".join("".join(pieces).split())
                if block:
                    self.blocks.append((stack[-1], block, linked))
                pieces.clear()
                linked = 0

        def close(wanted: tuple[str, ...], within: frozenset[str]) -> None:
            nonlocal link_depth
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] in wanted:
                    while len(stack) > i:
                        flush()
                        count[tags[stack.pop()]] -= 1
                    if link_depth > i:
                        link_depth = 0
                    return
                if tags[stack[i]] in within:
                    return

        def add(what: str) -> None:
            nonlocal linked
            what = html.unescape(what)
            pieces.append(what)
            if link_depth:
                linked += len("".join(what.split()))

        for m in _MARKUP.finditer(text):
            if m.start() > at and not skipping:
                add(text[at : m.start()])
            at = m.end()
            name = m[4]
            if not name:
                continue
            end, name, values = m[3], name.lower(), m[5]
            if skipping:
                if name == skipping:
                    nested += -1 if end else 1
                elif name in count:
                    inner += -1 if end else 1
                if nested > 0 and inner >= 0:
                    continue
                skipping = ""
                if nested == 0:
                    continue
            if name not in count:
                if name == "a":
                    link_depth = 0 if end else len(stack)
                elif name == "br":
                    pieces.append(" ")
                if not end and name not in VOID and not values.endswith("/") and (name in SKIPPED or values and _TELLING.search(values) and paths.step(0, name, values)[1][1]):
                    skipping, nested, inner = name, 1, 0
                continue
            if end:
                if count[name] and name not in ("html", "body"):
                    close((name,), frozenset() if name in _TABLE_PARTS else _CELL)
                continue
            if count["p"]:
                close(("p",), frozenset())
            if name in _CLOSES:
                close(*_CLOSES[name])
            if name == "body" and count["head"]:
                close(("head",), frozenset())
            if name in HEADINGS and tags[stack[-1]] in HEADINGS:
                close((tags[stack[-1]],), frozenset())
            flush()
            if name in VOID or name in ("html", "body") and count[name]:
                continue
            path, kinds = paths.step(self.path[stack[-1]], name, values)
            tags.append(name)
            self.parent.append(stack[-1])
            self.path.append(path)
            for own, kind in zip((self.fixed, self.marked, self.heads, self.article), kinds, strict=True):
                own.append(kind)
            stack.append(len(tags) - 1)
            count[name] += 1
        if at < len(text) and not skipping:
            add(text[at:])
        flush()
        self._set_apart()
        self._weigh()

    def _up(self, values: list) -> list:
        """Each element's own value and those of all inside it."""
        for i in range(len(self.tag) - 1, 0, -1):
            values[self.parent[i]] += values[i]
        return values

    def _set_apart(self) -> None:
        """Elements that are no main text by their tag always go. Marked ones go unless they hold the page's article, or its first heading and half of its paragraphs; headers go unless they stand in an article."""
        n = len(self.tag)
        open_ = [True] * n  # not in or under an element that goes by its tag
        for i in range(1, n):
            open_[i] = open_[self.parent[i]] and not self.fixed[i]
        articles = self._up([int(self.tag[i] in ("article", "main") and open_[i] and not self.marked[i]) for i in range(n)])
        first = self._up([int(self.tag[i] == "h1" and open_[i]) for i in range(n)])
        long = [0] * n
        for i, text, links in self.blocks:
            long[i] += len(text) * (open_[i] and len(text) >= 80 and 2 * links <= len(text))
        long = self._up(long)
        self.apart = [False] * n
        inside = [False] * n
        for i in range(1, n):
            inside[i] = inside[self.parent[i]] or self.article[i] and not self.marked[i]
            holds = articles[i] or first[i] and 2 * long[i] > long[0]
            self.apart[i] = self.apart[self.parent[i]] or self.fixed[i] or self.marked[i] and not holds or self.heads[i] and not inside[i] and not holds

    def _weigh(self) -> None:
        """``good``: the characters of an element's blocks outside elements set apart that read as prose: few links, and a heading, a sentence's end or some length (others count in part)."""
        good = [0.0] * len(self.tag)
        for i, text, links in self.blocks:
            if not self.apart[i] and 2 * links <= len(text):
                good[i] += len(text) * (1.0 if self.tag[i] in HEADINGS or len(text) >= 80 or text[-1] in ".!?…:;\"'”’»。！？" else 0.3)
        self.good = self._up(good)
        self.titles = self._up([int(self.tag[i] == "h1" and not self.apart[i]) for i in range(len(self.tag))])

    def containers(self) -> tuple[int | None, list[int]]:
        """(path of the best container, paths of those that hold a share of the good text).

        From the root inwards: a container gives way to one inside it that holds most of its good text and its first heading. An article gives way only to
        one that holds all of it, since what is set apart does not count anyway.
        """
        if not self.good[0]:
            return None, []
        can = [i for i in range(1, len(self.tag)) if self.good[i] and self.tag[i] in BLOCKS and self.tag[i] not in _SMALL]
        inner = set()
        best = base = 0
        for i in can:  # parents stand before children
            if best and self.parent[i] != best and self.parent[i] not in inner:
                continue
            inner.add(i)
            need = 1.0 if self.tag[base] == "article" else INNER_CALLED if base else INNER_ARTICLE if self.article[i] else INNER
            if self.good[i] >= need * self.good[base] and self.titles[i] >= min(1, self.titles[best]):
                best, inner = i, {i}
                base = i if self.article[i] and not (base and self.tag[base] == "article") else base
        return self.path[best] if best else None, list(dict.fromkeys(self.path[i] for i in can if i == best or self.good[i] >= PRESENT * self.good[0]))

    def extract(self, path: int | None) -> str:
        """The text of all elements of ``path`` without what is set apart; of the whole page for None."""
        inside = [path is None] * len(self.tag)
        for i in range(1, len(self.tag)):
            inside[i] = inside[self.parent[i]] or self.path[i] == path
        return "\n\n".join(text for i, text, _ in self.blocks if inside[i] and not self.apart[i])


def host_of(url: Column) -> Column:
    """The host in lower case without port; '' for none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _over_pages(rows: DataFrame, schema: StructType, work, kept: int) -> DataFrame:
    """``rows`` with their last column (html as bytes) turned into what ``work(html, row)`` yields; the first ``kept`` columns stay."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths()
        for batch in batches:
            paths.trim()
            places, made = [], []
            rest = [batch.column(i) for i in range(kept, batch.num_columns - 1)]
            for k in range(batch.num_rows):
                page = Page((batch.column(batch.num_columns - 1)[k].as_py() or b"").decode("utf-8", "replace"), paths)
                for row in work(page, paths.names, *[c[k].as_py() for c in rest]):
                    places.append(k)
                    made.append(row)
            own = [batch.column(i).take(pa.array(places, pa.int64())).cast(f.type) for i, f in zip(range(kept), arrow, strict=False)]
            fresh = [pa.array([r[j] for r in made], f.type) for j, f in enumerate(list(arrow)[kept:])]
            yield pa.RecordBatch.from_arrays([*own, *fresh], schema=arrow)

    return rows.mapInArrow(run, schema)


def path_votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, votes (pages whose best container has it), present (pages where it holds a share of the good text), name.

    Counts are summed in each task before they are shuffled, so a host with any share of the pages is a few rows a task.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").cast("binary").alias("_html"))
    schema = StructType.fromDDL("host string, path bigint, vote bigint, name string")

    def work(page: Page, names: dict[int, str]) -> Iterator[tuple]:
        best, held = page.containers()
        for path in held:
            yield path, int(path == best), names.get(path)

    return _over_pages(rows, schema, work, 1).groupBy("host", "path").agg(F.sum("vote").alias("votes"), F.count("*").alias("present"), F.min("name").alias("name"))


def agreed_paths(votes: DataFrame) -> DataFrame:
    """host, path, place: what each host agrees on, best first by ``place``; at most ``HOST_PATHS`` a host."""
    host = votes.groupBy("host").agg(F.sum("votes").alias("_all"))
    place = F.struct((-F.col("votes") / (F.col("present") + 2)).alias("share"), (-F.col("votes")).alias("votes"), F.col("path").alias("path"))
    return votes.join(host, "host").where((F.col("votes") >= LEAST_VOTES) & (F.col("votes") * HOST_PATHS >= F.col("_all"))).select("host", "path", place.alias("place"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text (blocks with an empty line between), n_chars, path (of the container), agreed (whether the host's pages chose it).

    Every page votes for its best container. A page takes, of the paths that it has and its host agrees on, the one with the largest share of votes,
    ``votes / (present + 2)`` (then the most votes, then the smaller hash), whose elements hold text. Where there is none its own best container stands, and
    without any good text all that is not set apart.

    Every row is a page of its own, also with a repeated id; null ids and urls stay null, and pages without a host vote together. A null or empty page gives '' and 0; an empty
    table no rows. There are two passes over the pages; only counts by host and path are shuffled, and the agreed paths (checked against ``BROADCAST_PATHS``) travel
    to the tasks. Beyond that bound pages are dealt out by host, where a skewed join splits a large host.
    """
    agreed = stash(agreed_paths(path_votes(pages, url_col, html_col)), "page-paths")
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias(url_col), host_of(F.col(url_col)).alias("_host"), F.col(html_col).cast("string").cast("binary").alias("_html"))
    schema = StructType([rows.schema[id_col], rows.schema[url_col], *StructType.fromDDL("text string, n_chars bigint, path string, agreed boolean").fields])

    def finish(page: Page, names: dict[int, str], order: dict[int, int]) -> Iterator[tuple]:
        for path in sorted({p for p in page.path if p in order}, key=order.__getitem__):
            if text := page.extract(path):
                yield text, len(text), names.get(path), True
                return
        path = page.containers()[0]
        text = page.extract(path)
        yield text, len(text), names.get(path), False

    if agreed.count() <= BROADCAST_PATHS:
        orders: dict[str, dict[int, int]] = {}
        for r in sorted(agreed.collect(), key=lambda r: (r["host"], tuple(r["place"]))):
            own = orders.setdefault(r["host"], {})
            own[r["path"]] = len(own)

        def by_broadcast(page: Page, names: dict[int, str], host: str) -> Iterator[tuple]:
            return finish(page, names, orders.get(host, {}))

        return _over_pages(rows, schema, by_broadcast, 2)

    lists = agreed.groupBy("host").agg(F.transform(F.array_sort(F.collect_list("place")), lambda x: x["path"]).alias("_paths"))

    def by_join(page: Page, names: dict[int, str], paths: list[int] | None) -> Iterator[tuple]:
        return finish(page, names, {p: i for i, p in enumerate(paths or [])})

    met = rows.join(lists, F.col("_host") == F.col("host"), "left").select(id_col, url_col, "_paths", "_html")
    return _over_pages(met, schema, by_join, 2)
