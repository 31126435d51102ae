"""HTML extraction by consensus host paths.

Each page's containers are scored by the paragraphs they hold. A page chooses the best one's generalised
path (tags and classes from the root, without digits) and those of the blocks beside it that aren't links
for the most part. Choices are votes, summed per host in Spark: a path that half of the pages having it
choose is won for the host, also on pages where it is mostly links. What a vote takes away must be clutter
by another sign: text beside the best container goes only where at least REPEATS pages of the host, half of
those with that path and not all of one main text, have the very same text there. A page is then extracted
again from the elements on the paths left. Around an element on a path, the nearest article or main counts
as a whole; without one, what holds it and the page's h1.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
left out, by tag, role and class or id words (``social-science`` is no ``social``); a form, an element of
such a name or talk in a main that holds most of the page is kept, and so are headings inside an article's
header. A
block's white space becomes one space, and blocks follow each other in page order, one space between them.

Defined edge cases
  * null or empty html: empty text; pages cut off anywhere: what was there until then
  * a null or host-less URL: pages without a host vote together
  * no container with text: empty text; text in links only: that counts; repeated rows get equal texts; ties
    go to the smaller path
  * an empty table gives an empty result; columns other than page_id, url and html are not read
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefeat.llm.storage import bounded_broadcast, cut, small_batches
from pulsefeat.llm.url_filter import host_of

#: Hosts with their paths are broadcast up to this count, and 64 MB.
MAX_BROADCAST_HOSTS = 100_000
#: Pages of a host that must have the same text beside their best container for it to be clutter.
REPEATS = 3

# HTML vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
SKIPPED = frozenset("head script style noscript template iframe object svg math canvas audio video nav footer aside button select textarea option input dialog menu fieldset".split())
CONTAINERS = frozenset("html body main article section div td center table".split())
ROOTS = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond".split())
TALK_WORDS = frozenset("discussion discussions replies responses".split())  # of readers, unless in an article
FRAME_WORDS = frozenset("aside banner footer header masthead".split())
TOP_WORDS = frozenset("header masthead".split())  # of an article's own top too
CLUTTER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar cookie cookies consent copyright notice alert popup modal overlay "
    "newsletter subscribe subscription signup login social share sharing related recommended widget pagination pager skip toolbar".split()
)
# Words that say no more than where an element is or what it is made of.
PLACE_WORDS = frozenset(
    "a area banner bar block bottom box btn button buttons center col column container content cover desktop footer header icon icons id inner item "
    "items js left link links list lists main mobile outer page panel placeholder primary right row secondary section site slot small sticky "
    "the top unit view wrap wrapper".split()
)
CONTENT_WORDS = frozenset("article entry fb media post reader story thread to user".split())

ALL_COMMENT_WORDS, BESIDE_WORDS = COMMENT_WORDS | TALK_WORDS, PLACE_WORDS | CONTENT_WORDS


def _marked(tokens: list[str], marks: frozenset[str], places: frozenset[str]) -> bool:
    """Whether a class or id has one of the words, and besides them only words of place."""
    for token in tokens:
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if w]
        if any(w in marks for w in words) and all(w in marks or w in places for w in words):
            return True
    return False


@dataclass
class Node:
    """An element that isn't inline."""

    tag: str
    parent: Node | None
    path: str
    skipped: bool = False  # left out whatever it holds
    clutter: bool = False  # left out unless it holds most of the page
    heading: bool = False
    in_header: bool = False
    in_head: bool = False
    in_article: bool = False  # it is one or lies in one
    in_main: bool = False


@dataclass
class Page:
    chunks: list[tuple[Node, str, bool, bool]] = field(default_factory=list)  # node, text, in a link, begins a block
    live: list[tuple[Node, str, bool, bool]] | None = None  # those that aren't clutter, once known


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.top = Node("body", None, "")  # what no container holds
        self.open: list[Node] = [self.top]
        self.links = 0
        self.fresh = True

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers aren't needed

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self.links += 1
        if tag in INLINE:
            return
        self.fresh = True
        if tag in VOID:
            return
        # What HTML closes by itself: a paragraph before any block, items and cells before their like.
        if self.open[-1].tag == "p" or (tag in ("li", "tr", "td", "th", "dt", "dd", "option") and self.open[-1].tag == tag):
            self.open.pop()
        if self.open[-1].in_head and tag not in IN_HEAD:
            while self.open[-1].in_head:
                self.open.pop()
        if tag in ("html", "body") and any(n.tag == tag for n in self.open[1:]):
            return
        parent = self.open[-1]
        values = {n: (v or "") for n, v in attrs}
        named = values.get("class", "").split()
        tokens = [*named, values["id"]] if values.get("id") else named
        classes = sorted({re.sub(r"\d+", "", c.lower()) for c in named}) if named else named
        node = Node(tag, parent, f"{parent.path}{'/' if tag in CONTAINERS else '>'}{tag}" + "".join(f".{c}" for c in classes if c), heading=tag in HEADINGS)
        node.in_article, node.in_main = parent.in_article or tag == "article", parent.in_main or tag == "main"
        node.in_head = parent.in_head or tag == "head"
        node.in_header = parent.in_header or (tag == "header" and (parent.in_article or parent.in_main))
        node.skipped = parent.skipped or tag in SKIPPED or (tag == "header" and not node.in_header)
        node.clutter = tag == "form"
        if values and tag not in ROOTS:
            hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
            talk = COMMENT_WORDS if parent.in_article or parent.in_main else ALL_COMMENT_WORDS
            frame = FRAME_WORDS - TOP_WORDS if parent.in_article or parent.in_main else FRAME_WORDS
            node.skipped = node.skipped or hidden or values.get("role", "") in SKIPPED_ROLES or _marked(tokens, talk, BESIDE_WORDS)
            node.clutter = node.clutter or _marked(tokens, CLUTTER_WORDS, BESIDE_WORDS) or _marked(tokens, frame, PLACE_WORDS)
            node.clutter = node.clutter or (parent.in_main and not parent.in_article and _marked(tokens, TALK_WORDS, BESIDE_WORDS))
        self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in INLINE:
            return
        self.fresh = True
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                self.links = 0
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self.open.pop()  # text ends a head that is left open
        if not self.open[-1].skipped:
            self.page.chunks.append((self.open[-1], data, self.links > 0, self.fresh))
            self.fresh = False


def parse(html: str) -> Page:
    builder = _Builder()
    builder.feed(re.sub(r"<[A-Za-z/!][^<>]*\Z", "", html))
    builder.close()
    return builder.page


def _live(page: Page) -> list[tuple[Node, str, bool, bool]]:
    if page.live is None:
        page.live = _without_clutter(page)
    return page.live


def _without_clutter(page: Page) -> list[tuple[Node, str, bool, bool]]:
    """Chunks of text that aren't clutter. A cluttered name on an element with most of the text says
    nothing (a wrapper called "has-sidebar"); elsewhere the element is left out."""
    weight: dict[int, int] = {}
    total = 0
    for node, text, linked, _ in page.chunks:
        size = len(text.strip())
        total += size
        at: Node | None = node
        while at is not None:
            if at.clutter:
                weight[id(at)] = weight.get(id(at), 0) + size
            at = at.parent
    gone: dict[int, bool] = {}

    def left_out(node: Node | None) -> bool:
        chain = []
        while node is not None and id(node) not in gone:
            chain.append(node)
            node = node.parent
        verdict = gone[id(node)] if node is not None else False
        for n in reversed(chain):
            verdict = verdict or (n.clutter and 2 * weight.get(id(n), 0) <= total)
            gone[id(n)] = verdict
        return verdict

    return [c for c in page.chunks if not left_out(c[0]) and (not c[0].in_header or c[0].heading)]


def container_of(node: Node) -> Node | None:
    while node is not None and node.tag not in CONTAINERS:
        node = node.parent
    return node


def path_scores(page: Page) -> dict[str, float]:
    """Score of each generalised path: characters outside links (if there are any) of the blocks directly
    in its containers, and, but for the page's root, half of what the containers right below have."""
    scores: dict[str, float] = {}
    only_links = all(linked for _, text, linked, _ in _live(page) if text.strip())
    for node, text, linked, _ in _live(page):
        size = len(text.strip())
        at, share = container_of(node), 1.0
        while at is not None and share > 0.2 and size and (only_links or not linked):
            if share < 1 and at.tag in ("html", "body"):
                break
            bonus = 1.5 if at.tag in ("article", "main") else 1.0
            scores[at.path] = scores.get(at.path, 0.0) + share * size * bonus
            at, share = container_of(at.parent) if at.parent else None, share / 2
    return scores


def best_path(scores: dict[str, float]) -> str | None:
    return min(scores, key=lambda p: (-scores[p], p)) if scores else None


def _above(node: Node | None) -> list[Node]:
    """The node and what holds it, from the inside out."""
    chain = []
    while node is not None:
        chain.append(node)
        node = node.parent
    return chain


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@dataclass
class Choice:
    """What a page says of its paths."""

    best: str | None = None
    beside: dict[str, bool] = field(default_factory=dict)  # paths of blocks beside the best container: chosen or not
    texts: dict[str, int] = field(default_factory=dict)  # digest of the text on each of these
    main: int = 0  # digest of the text on the best path


def choice(page: Page) -> Choice:
    """The paths that a page chooses: the best container's, and those of other blocks beside it.

    Beside it are, at each level up to its main or the page's root, the blocks and containers next to
    what holds it; text right in what holds it is a block of the path ending in ``>#text``. Inside an
    article or main all of it counts, so only what is next to an article in the same main is beside it."""
    live = [c for c in _live(page) if c[1].strip()]
    best = best_path(path_scores(page))
    if best is None:
        return Choice()
    roots = _widened(live, {best})
    spine: dict[int, bool] = {}  # what holds the elements that count; whether blocks in it are beside them
    for node, *_ in live:
        above = _above(node)
        at = next((i for i, n in enumerate(above) if id(n) in roots), None)
        if at is not None:
            within = next((i for i, n in enumerate(above) if n.tag == "main" and i > at), None)
            marked = above[at].tag in ("article", "main")
            for i in range(at + 1, len(above)):
                spine[id(above[i])] = i <= within if within is not None else not marked
    beside: dict[str, list] = {}  # per path: its text, characters of it, and of those in links
    main: list[str] = []
    for node, text, linked, _ in live:
        above = _above(node)
        if any(id(n) in roots for n in above):
            main.append(text.strip())
            continue
        at = next(i for i, n in enumerate(above) if id(n) in spine)
        if not spine[id(above[at])]:
            continue
        own = beside.setdefault(above[at - 1].path if at else f"{node.path}>#text", [[], 0, 0])
        own[0].append(text.strip())
        own[1], own[2] = own[1] + len(text.strip()), own[2] + linked * len(text.strip())
    beside.pop(best, None)
    texts = {path: digest(" ".join(" ".join(parts).split())) for path, (parts, _, _) in beside.items()}
    return Choice(best, {path: 2 * linked <= size for path, (_, size, linked) in beside.items()}, texts, digest(" ".join(" ".join(main).split())))


def _widened(live: list[tuple[Node, str, bool, bool]], paths: set[str]) -> set[int]:
    """The elements whose text is the page's: for each one on one of the paths the nearest article or
    main around it; where there is none, the smallest element that holds it and the page's first h1, or,
    if that is the whole body, the container and the h1."""
    held: dict[int, Node] = {}
    title: Node | None = None
    for node, text, linked, _ in live:
        if not text.strip():
            continue
        if title is None and node.tag == "h1" and not linked:
            title = node
        held.update((id(at), at) for at in _above(node) if at.path in paths)
    of_title = {id(n) for n in _above(title)}
    roots: set[int] = set()
    for at in held.values():
        above = _above(at)
        around = next((n for n in above if n.tag in ("article", "main")), None)
        if around is None:
            around = at
            if title is not None and id(at) not in of_title:
                common = next(n for n in above if id(n) in of_title)
                if common.tag in ("html", "body"):
                    roots.add(id(title))
                else:
                    around = common
        elif title is not None and id(around) not in of_title:
            roots.add(id(title))
        roots.add(id(around))
    return roots


def text_on(page: Page, paths: set[str]) -> str:
    """Text of the elements on the paths, widened, in page order."""
    live = _live(page)
    roots = _widened(live, paths)
    inside: dict[int, bool] = {}
    out: list[str] = []
    for node, text, _, fresh in live:
        if id(node) not in inside:
            inside[id(node)] = f"{node.path}>#text" in paths or any(id(n) in roots for n in _above(node))
        if inside[id(node)]:
            out.append((" " if fresh else "") + text)
        elif out:
            out.append(" ")
    return " ".join("".join(out).split())


def extract(html: str, won: set[str], repeated: dict[str, int]) -> str:
    """Text on the page's own and the host's paths, without what the host repeats beside its main text."""
    page = parse(html)
    found = choice(page)
    if found.best is None:
        return ""
    own = {p for p, chosen in found.beside.items() if (chosen or p in won) and repeated.get(p) != found.texts[p]}
    return text_on(page, {found.best, *own})


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, host_path, won, repeated``: the best path of most pages; the contested paths, which some
    but not all of the pages that have them choose, if half of these do; and the paths beside the best one
    with the digest of a text that pages of different main texts repeat there."""

    def run(batches):
        for batch in batches:
            out = []
            for html in batch.column("html"):
                found = choice(parse(html.as_py() or ""))
                votes = [{"path": found.best, "vote": 1, "text": None, "main": found.main}] if found.best is not None else []
                out.append(votes + [{"path": p, "vote": int(chosen), "text": found.texts[p], "main": found.main} for p, chosen in found.beside.items()])
            kind = pa.list_(pa.struct([("path", pa.string()), ("vote", pa.int32()), ("text", pa.int64()), ("main", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, kind)], names=["host", "votes"])

    asked = pages.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "html")
    votes = asked.mapInArrow(run, "host string, votes array<struct<path: string, vote: int, text: long, main: long>>").select("host", F.inline("votes"))
    # Per text of a path first, so that a hot host's votes are added up before they meet.
    texts = votes.groupBy("host", "path", "text").agg(F.sum("vote").alias("votes"), F.count("*").alias("pages"), (F.min("main") < F.max("main")).alias("differ"))
    same = F.when(F.col("text").isNotNull() & F.col("differ") & (F.col("pages") >= REPEATS), F.struct("pages", "text"))
    paths = texts.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages"), F.sum(F.when(F.col("text").isNull(), F.col("pages"))).alias("first"), F.max(same).alias("same"))
    won = F.when(F.col("votes").between(1, F.col("pages") - 1) & (2 * F.col("votes") >= F.col("pages")), F.col("path"))
    repeated = F.when(2 * F.col("same.pages") >= F.col("pages"), F.struct("path", F.col("same.text").alias("text")))
    best = F.when(F.col("first") > 0, F.struct(-F.col("first"), "path"))
    hosts = paths.groupBy("host").agg(F.min(best).alias("best"), F.collect_list(won).alias("won"), F.collect_list(repeated).alias("repeated"))
    return hosts.select("host", F.col("best.path").alias("host_path"), "won", "repeated")


def main_texts(pages: DataFrame) -> DataFrame:
    """Per page ``page_id, url, text, n_chars, host_path``."""
    small_batches(pages.sparkSession)
    winners = cut(host_paths(pages), "host-paths").withColumnRenamed("host", "voted")
    width = F.octet_length("voted") + F.coalesce(F.octet_length("host_path"), F.lit(0)) + F.octet_length(F.concat_ws(" ", "won", "repeated.path")) + 8 * F.size("repeated")
    asked = pages.select(F.col("page_id").cast("long"), "url", "html", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))
    asked = asked.join(bounded_broadcast(winners, MAX_BROADCAST_HOSTS, width), F.col("host") == F.col("voted"), "left")

    def run(batches):
        for batch in batches:
            texts = [extract(html.as_py() or "", set(won.as_py() or ()), {r["path"]: r["text"] for r in repeated.as_py() or ()}) for html, won, repeated in zip(*(batch.column(c) for c in ("html", "won", "repeated")))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), batch.column("host_path")], names=["page_id", "url", "text", "host_path"])

    texts = asked.select("page_id", "url", "html", "host_path", "won", "repeated").mapInArrow(run, "page_id long, url string, text string, host_path string")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host_path")
