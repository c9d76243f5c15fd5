"""Main-text extraction by consensus host paths.

Every page is parsed into elements; containers are scored by the text of the paragraphs in them.  A page votes for the
generalised tag-class path of its best container, Spark sums the votes per host, and every page is extracted again
through its host's winning paths, or through its own best container where none of them occurs.

Names of classes and ids only cast doubt on an element unless they have nothing but words for what is not the text; a doubted
element stays if little of the page's text is outside it.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_small_batches, materialize, slices

#: A tag up to the end of its name; tag_end finds the rest.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)|([^<]+|<)", re.S)
SPECIAL, NEXT, VALUE_END = re.compile("[=>]"), re.compile(r"\s*"), re.compile(r"[\s>]|\Z")
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'][^\s]*)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page; only those of another markup may close themselves.
RAW = frozenset("script style noscript template textarea title iframe svg object noframes".split())
END_OF = {tag: re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I) for tag in (*RAW, "xmp")}
NESTED = {tag: re.compile(f"<(/?){tag}(?=[\\s/>])[^>]*?(/?)>", re.I) for tag in ("svg", "object")}
#: Elements that are meant to hold the text: names only cast doubt on them.
WHOLE = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div td body center".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td dd dt figcaption".split())
DROPPED = frozenset("nav header footer aside menu button select dialog input fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: A container with a class or id of nothing but these and the next two lists' words is dropped, and one with a word of
#: these among others unless it holds the page's text (see decide); a paragraph only if such a word is all of it.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsored sponsors nav navbar navigation navi menu menus breadcrumb breadcrumbs "
    "footer topbar sidebar sidebars widget widgets related recommended recommendations sharing comment comments commentlist disqus replies "
    "cookie cookies consent gdpr newsletter pagination pager pagenav toolbar".split()
)
#: These words may also be about the text, so they count only in names of nothing but listed words.
DOUBTFUL_WORDS = frozenset(
    "sponsor promo promotion foot header masthead aside share social respond reply notice notices alert banner popup modal overlay subscribe subscription signup login "
    "search searchform skip copyright disclaimer form".split()
)
PLACE_WORDS = frozenset("top bottom left right upper lower first last outer inner site page global main box bar area block wrap wrapper container section list links link buttons button icons icon media strip panel group row col message messages".split())
READER_WORDS = frozenset("comment comments commentlist disqus replies".split())
FAVOURED_WORDS = frozenset("article content post entry story main text body page blog news".split())
#: Elements that an opening tag closes, up to the nearest ancestor that contains them.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Paths of deeper elements are digests, so that a page's paths take space in proportion to its elements.
MAX_DEPTH = 512
CELLS, TABLE_PARTS = ("td", "th", "table"), frozenset("table tr tbody thead tfoot td th".split())
P_CLOSERS = BLOCKS - {"br", "option", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}


class Element:
    __slots__ = ("tag", "parent", "path", "words", "dropped", "doubted", "items", "score", "own", "linked")

    def __init__(self, tag: str, parent: Element | None, path: str, words: frozenset, dropped: bool, doubted: bool = False):
        self.tag, self.parent, self.path, self.words, self.dropped, self.doubted = tag, parent, path, words, dropped, doubted
        self.items: list = []  # texts and elements, in page order
        self.score = 0.0
        self.own = self.linked = 0  # characters of text below (not in dropped elements), and of those inside links


class Stack(list):
    """Open elements, with the places of each tag, so that what an end tag closes is found at once at any depth."""

    def __init__(self, root: Element):
        super().__init__([root])
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self))
        if element.tag in BLOCKS:
            self.blocks.append(len(self))
        self.append(element)

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, 0 without one."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def cut(self, k: int) -> None:
        """Close the element at place k and all within it."""
        while len(self) > k:
            tag = self.pop().tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()


def tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """The position after the > that ends a tag, read on from ``at``; -1 if the page ends first.

    Only a quote right after = opens a value, which may have any length; other values end at white space or >.
    ``unclosed`` keeps quotes that do not occur any more, so that no part of a page is scanned twice in vain.
    """
    while m := SPECIAL.search(page, at):
        at = m.end()
        if m[0] == ">":
            return at
        at = NEXT.match(page, at).end()
        quote = page[at : at + 1]
        if quote in ("'", '"') and quote not in unclosed:
            end = page.find(quote, at + 1)
            if end >= 0:
                at = end + 1
                continue
            if page.find("<", at) < 0:  # the page ends within the value
                return -1
            unclosed.add(quote)
        at = VALUE_END.search(page, at).start()
    return -1


def named(names: str, paragraph: bool) -> str:
    """What class names and ids say of an element: ``dropped`` is no part of the text, ``doubted`` may not be, or nothing."""
    said = ""
    for name in names.split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if paragraph:
            if len(parts) == 1 and parts[0] in DROPPED_WORDS:
                return "dropped"
            continue
        listed = [x in DROPPED_WORDS or x in DOUBTFUL_WORDS for x in parts]
        if any(listed) and all(is_listed or x in PLACE_WORDS for is_listed, x in zip(listed, parts, strict=True)):
            return "dropped"
        if any(x in DROPPED_WORDS for x in parts):
            said = "doubted"
    return said


def past_end(page: str, tag: str, at: int) -> int:
    """The position after the end tag of an element without text; elements of its own kind may be nested in svg and object."""
    if tag not in ("svg", "object"):
        end = END_OF[tag].search(page, at)
        close = page.find(">", end.end()) if end else -1
        return close + 1 if close >= 0 else len(page)
    depth = 1
    for m in NESTED[tag].finditer(page, at):
        depth += -1 if m[1] else (0 if m[2] else 1)
        if not depth:
            return m.end()
    return len(page)


def parse(page: str) -> tuple[Element, list[Element]]:
    """The root element and all containers of a page; never fails, whatever the markup."""
    root = Element("html", None, "", frozenset(), False)
    stack, containers, doubts = Stack(root), [], []
    at, match, unclosed = 0, TOKEN.match, set()
    while at < len(page):
        m = match(page, at)
        at = m.end()
        text = m[3]
        if text is not None:
            stack[-1].items.append(text)
            continue
        tag = m[2]
        if tag is None:
            continue  # comment, declaration
        name = at
        at = tag_end(page, name, unclosed)
        if at < 0:  # cut off inside a tag
            break
        attributes = page[name : at - 1]
        tag = tag.lower()
        if m[1]:
            k = stack.last(tag)
            if k and (tag in TABLE_PARTS or k > stack.last(*CELLS)):  # a stray end tag does not leave its cell
                stack.cut(k)
            if tag in BLOCKS:
                stack[-1].items.append(" ")
            continue
        if tag in ("html", "head"):
            continue
        if tag in RAW:
            if tag != "svg" or not attributes.rstrip().endswith("/"):
                at = past_end(page, tag, at)
            continue
        if tag == "xmp":
            end = END_OF[tag].search(page, at)
            stop = end.start() if end else len(page)
            stack[-1].items.extend((" ", page[at:stop].replace("&", "&amp;"), " "))
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        if tag == "body" and stack.last("body"):
            continue
        if tag in P_CLOSERS and stack.blocks and stack[stack.blocks[-1]].tag == "p":
            stack.cut(stack.blocks[-1])
        if tag in CLOSES:
            own, within = CLOSES[tag]
            fence = stack.last(*within)
            if tag == "tr":  # all open rows and cells of the table
                k = min((p[i] for t in own if (p := stack.places.get(t)) and (i := bisect_right(p, fence)) < len(p)), default=0)
            else:
                k = stack.last(*own)
            if k > fence:
                stack.cut(k)
        if tag in VOID:
            if tag in BLOCKS:
                stack[-1].items.append(" ")
            continue
        parent, words, path, dropped, doubted = stack[-1], frozenset(), "", stack[-1].dropped or tag in DROPPED, tag == "form"
        if tag == "label":  # of a control, unless it stands in a paragraph
            dropped = dropped or not (stack.blocks and stack[stack.blocks[-1]].tag in PARAGRAPHS)
        block = tag in BLOCKS
        if attributes.strip(" /\n\t\r"):
            found = {a[0].lower(): entities.unescape(a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(attributes)}
            names = f"{found.get('class', '')} {found.get('id', '')}".lower()
            words = frozenset(re.split(r"[^a-z]+", names)) if names.strip() else words
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
            role = frozenset(found.get("role", "").lower().split())
            said = named(names, tag in PARAGRAPHS) if block and tag != "body" else ""
            dropped = dropped or bool(hidden or role & DROPPED_ROLES or (said == "dropped" and tag not in WHOLE))
            doubted = doubted or bool(said)
            path = "." + ".".join(sorted({re.sub(r"\d+", "0", c) for c in found["class"].lower().split()})) if found.get("class", "").strip() else ""
        path = f"{parent.path}>{tag}{path}" if block else parent.path
        if block and len(stack) >= MAX_DEPTH:
            path = "#" + blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        element = Element(tag, parent, path, words, dropped, doubted)
        parent.items.append(element)
        stack.push(element)
        if doubted and not dropped:
            doubts.append(element)
        if tag in CONTAINERS and not dropped:
            containers.append(element)
    if doubts:
        decide(root, doubts)
        containers = [e for e in containers if not e.dropped]
    return root, containers


#: A doubted element stays if it has so many characters outside links, and those outside of all that is doubted are less
#: than this share of its own; one named for readers' comments only if there are hardly any.
LEAST_TEXT, OUTSIDE, HARDLY_ANY = 250, 0.25, 140


def decide(root: Element, doubts: list[Element]) -> None:
    """Drop doubted elements, but for those that hold the page's text; of several the one with most text decides first."""
    whole: dict[int, int] = {}  # characters outside links, below an element
    clear: dict[int, int] = {}  # of these, outside doubted elements below it
    order, todo = [], [(root, False)]
    while todo:
        e, linked = todo.pop()
        order.append((e, linked))
        todo.extend((x, linked or x.tag == "a") for x in e.items if x.__class__ is Element and not x.dropped)
    for e, linked in reversed(order):
        own = 0 if linked else sum(len(x) for x in e.items if x.__class__ is str and not x.isspace())
        below = [x for x in e.items if x.__class__ is Element and not x.dropped]
        whole[id(e)] = own + sum(whole[id(x)] for x in below)
        clear[id(e)] = own + sum(clear[id(x)] for x in below if not x.doubted)
    outside, gone = clear[id(root)], set()
    for e in sorted((e for e in doubts if id(e) in whole), key=lambda e: -whole[id(e)]):
        text = whole[id(e)]
        stays = text >= LEAST_TEXT and outside < OUTSIDE * text and not (e.words & READER_WORDS and outside >= HARDLY_ANY)
        if stays:
            outside += clear[id(e)]
        else:
            gone.add(id(e))
    for e, _ in order:  # parents come before what is in them
        if id(e) in gone or (e.parent and e.parent.dropped):
            e.dropped = True


def _measure(root: Element) -> None:
    """Characters below each element and container scores; iterative, so depth is no limit."""
    order, todo = [], [(root, False)]
    while todo:
        e, linked = todo.pop()
        order.append((e, linked))
        todo.extend((x, linked or x.tag == "a") for x in e.items if x.__class__ is Element and not x.dropped)
    for e, linked in reversed(order):
        n = sum(len(x) for x in e.items if x.__class__ is str and not x.isspace())
        e.own += n
        e.linked += n if linked else 0
        if e.parent:
            e.parent.own += e.own
            e.parent.linked += e.linked
    for e, _ in order:
        if e.tag in PARAGRAPHS and e.own and e.linked < 0.5 * e.own and e.parent:
            gain, share, up = e.own - e.linked, 1.0, e.parent
            for _ in range(3):
                if up is None:
                    break
                up.score += gain * share
                share, up = share / 2, up.parent


def _weight(e: Element) -> float:
    return {"article": 3.0, "main": 2.0, "body": 0.5}.get(e.tag, 1.0) * (1.5 if e.words & FAVOURED_WORDS else 1.0) * (0.9 if e.doubted else 1.0)


def best_container(containers: list[Element]) -> Element | None:
    """The container of the largest weighted score, the earlier one among equals; None on a page without text."""
    best, top = None, 0.0
    for e in containers:
        value = (e.score or 0.1 * (e.own - e.linked)) * _weight(e)
        if value > top:
            best, top = e, value
    return best


def text_of(elements: list[Element]) -> str:
    """Text of elements without their dropped parts: blocks in page order, white space as one space."""
    out: list[str] = []
    todo: list = list(reversed(elements))
    while todo:
        x = todo.pop()
        if x.__class__ is str:
            out.append(entities.unescape(x) if "&" in x else x)
        elif not x.dropped:
            if x.tag in BLOCKS:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.items))
    return " ".join("".join(out).split())


def vote(page: str) -> tuple[str, float] | None:
    """(generalised path, score) of the page's best container."""
    root, containers = parse(page)
    _measure(root)
    e = best_container(containers)
    return (e.path, e.score) if e else None


#: A winning path counts on a page if it holds this share of the text of the page's own best container.
LEAST_SHARE = 0.4


def extract(page: str, paths: list[str] | None) -> str:
    """Main text by the first of the host's winning paths that holds enough text here, else by the page's own best container."""
    root, containers = parse(page)
    _measure(root)
    e = best_container(containers)
    for path in paths or ():
        found = [x for x in containers if x.path == path]
        if sum(x.own for x in found) >= LEAST_SHARE * (e.own if e else 0) and (text := found and text_of(found)):
            return text
    return text_of([e]) if e else text_of([root])


def host_paths(pages: DataFrame, top: int = 3) -> DataFrame:
    """(host, paths): the ``top`` paths of each host by votes, then score, then name.  Votes are summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [(h, *v) for h, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (v := vote(x or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.string(), pa.float64()))], ["host", "path", "score"])

    votes = pages.select("host", "html").mapInArrow(run, "host string, path string, score double").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round("score")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), F.desc("score"), "path"))
    ranked = votes.withColumn("k", rank).where(F.col("k") <= top)
    return ranked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("paths"))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    A null or empty page has an empty text; a null url is a host of its own; repeated rows vote as often as they occur.
    Broken, unclosed or truncated markup is read as far as it goes, and pages of any length or depth whole.  Other columns
    are ignored; an empty df gives no rows.  The winning paths are
    written first, so that Spark knows their size when it chooses between a broadcast and a shuffled join.
    """
    in_small_batches(df.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    pages = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"), host.alias("host"))
    winners = materialize(host_paths(pages), "paths")
    fields = [*pages.select("page_id", "url").schema.fields]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = [extract(x or "", p) for x, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.join(winners, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(run, schema)
