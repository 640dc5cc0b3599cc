"""Main text of web pages: the template of a host's pages by equivalence classes of tokens, and what its slots hold.

Tokens are tags and blocks of text, told apart by the path of elements that they stand under. Over the pages of a host,
tokens with the same occurrence vector (how often each page has them) form a class. A class is frequent if half of the
host's pages have it; it is valid if its tokens stand in one order on every page and its spans nest with those of the
other classes. The valid classes, nested, are the template; what stands between their tokens are its slots. A slot is
judged by what it holds on all pages of the host, and what is not boilerplate is the text.

Blocks inside an article or main element are never tokens of a template: copies of an article, or a passage that all
pages quote, are content.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantalake.llm.common import few, stored, tidy

#: A template needs so many pages of a host; a frequent class is on this share of them.
PAGES, SUPPORT = 4, 0.5
#: A block or slot with this share of its letters in links is a menu.
LINKS = 0.6
#: Bytes of templates that may be broadcast; larger ones are joined by host.
BROADCAST = 32 << 20

#: Elements by how a page shows them, as HTML names them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes noscript textarea title".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split())
BOILERPLATE = set("nav aside footer form button select option datalist dialog menu svg math template object canvas audio video map fieldset head".split())
CONTENT = {"article", "main"}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id that name boilerplate; those of HEADS do so outside of content only.
HINTS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar side "
    "footer cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments disqus reply replies respond widget widgets toolbar pagination pager skip form search".split()
)
HEADS = {"header", "masthead", "topbar"}
#: What an open p, li and so on ends at.
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>?)")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))")
_WORD = re.compile(r"[a-z0-9]+")
_UNSEEN, _HIDDEN, _NAMED = re.compile(r"display\s*:\s*none"), re.compile(r"(?:^|\s)hidden(?=[\s/>=]|$)"), re.compile(r"\b(?:class|id)\s*=", re.I)


def events(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name or text, attributes, position): kind is < for a start tag, > for an end tag, t for text. Comments,
    declarations and what scripts, styles, titles and their like hold give nothing."""
    at, n = 0, len(page)
    while at < n:
        cut = page.find("<", at)
        if cut < 0:
            cut = n
        if cut > at:
            yield "t", page[at:cut], "", at
            at = cut
            continue
        found = _TAG.match(page, at)
        if found:
            name, start = found[2].lower(), at
            at = found.end()
            if found[1]:
                yield ">", name, "", start
            else:
                yield "<", name, found[3], start
                if name in RAW:
                    end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
                    at = end.start() if end else n
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            at = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?", "</"), at):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
        else:
            yield "t", "<", "", at
            at += 1


@dataclass
class Item:
    """A tag (text is None) or a block of text: its token (0 for texts of content), its zone (c content, b boilerplate, f free), and how many of
    its letters are in links."""

    token: int
    text: str | None = None
    zone: str = "f"
    linked: int = 0


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


@lru_cache(1 << 12)
def _judged(name: str, attributes: str, inside: bool) -> str:
    """b: an element of boilerplate, by its name or what class, id and role say; c: of content; else empty."""
    own = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    words = set(_WORD.findall(f"{own.get('class', '')} {own.get('id', '')}".lower()))
    role = own.get("role", "").lower()
    hidden = own.get("aria-hidden") == "true" or _UNSEEN.search(own.get("style", "")) or (attributes and _HIDDEN.search(_ATTRIBUTE.sub(" ", attributes)))
    if name in BOILERPLATE or role in ROLES or hidden or (name not in ("html", "body") and (words & HINTS or (not inside and (name == "header" or words & HEADS)))):
        return "b"
    return "c" if name in CONTENT or role == "main" or own.get("itemprop") == "articleBody" else ""


@lru_cache(1 << 12)
def _marks(attributes: str) -> str:
    return " ".join(f"{m[1]}={m[2] or m[3] or m[4]}" for m in _ATTRIBUTE.finditer(attributes) if _NAMED.match(m[1] + "="))


def items(page: str) -> list[Item]:
    """Tags and blocks of text of a page in order."""
    out: list[Item] = []
    stack: list[tuple[str, int, str, bool]] = []  # name, path before, judgement, whether it's inline
    open_names: dict[str, int] = {}
    path, depth, pieces, linked, link = 0, {"b": 0, "c": 0, "": 0}, [], 0, False
    lower: list[str] = []

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                zone = "b" if depth["b"] else "c" if depth["c"] else "f"
                out.append(Item(0 if zone == "c" else _hash(path, "t", text), text, zone, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def pop() -> str:
        nonlocal path
        name, path, said, _ = stack.pop()
        open_names[name] -= 1
        depth[said] -= 1
        return name

    for kind, name, attributes, at in events(page):
        if kind == "t":
            text = entities.unescape(name)
            pieces.append(text)
            linked += len(" ".join(text.split())) if link else 0
            continue
        inline = name in INLINE
        if name == "a":
            link = kind == "<" and "href" in attributes.lower()
        if inline and kind == "<":
            said = _judged(name, attributes, depth["c"] > 0) if "=" in attributes else ""
            if said != "b" and not (stack and stack[-1][3] and stack[-1][0] == name):
                continue
            flush()
        elif inline and not (open_names.get(name) and stack[-1][3]):
            continue
        else:
            flush()
        if kind == ">":
            if open_names.get(name):
                while pop() != name:
                    pass
                out.append(Item(_hash(path, ">", name)))
            elif name == "p":
                out.append(Item(_hash(path, ">", name)))
            continue
        if name in VOID or name in RAW:
            if name not in ("br", "wbr", "img", "input", "embed"):
                out.append(Item(_hash(path, "<", name)))
            continue
        if name in CONTENT and depth["b"]:
            # boilerplate that nothing ends is over where content begins
            lower = lower or [page.lower()]
            unclosed = next((k for k, e in enumerate(stack) if e[2] == "b" and f"</{e[0]}" not in lower[0][at:]), None)
            while unclosed is not None and len(stack) > unclosed:
                pop()
        if name in ENDS_P and stack and stack[-1][0] == "p":
            pop()
        if name in ENDS:
            ended, bound = ENDS[name]
            last = next((k for k in range(len(stack) - 1, max(-1, len(stack) - 32), -1) if stack[k][0] in ended or stack[k][0] in bound), None)
            if last is not None and stack[last][0] in ended:
                while len(stack) > last:
                    pop()
        said = _judged(name, attributes, depth["c"] > 0)
        marks = _marks(attributes) if "=" in attributes else ""
        out.append(Item(_hash(path, "<", name, marks)))
        stack.append((name, path, said, inline))
        open_names[name] = open_names.get(name, 0) + 1
        depth[said] += 1
        path = _hash(path, name, marks)
    flush()
    return out


@dataclass
class Template:
    """What the pages of a host have in common: the class of each token, which class is the root, and the slots (by the
    root token before them) that hold content on most pages."""

    classes: dict[int, int] = field(default_factory=dict)
    root: int = -1
    content: set[int] = field(default_factory=set)


def slots(page: list[Item], template: Template) -> Iterator[tuple[int, int, Item]]:
    """(number of the slot, root token before it, block) for each block of text that isn't the template's."""
    number, before = 0, 0
    for item in page:
        if template.classes.get(item.token) == template.root and (item.text is None or item.zone != "c"):
            number, before = number + 1, item.token
        elif item.text is not None and (item.zone == "c" or item.token not in template.classes):
            yield number, before, item


def main_text(page: list[Item], template: Template) -> list[tuple[int, str]]:
    """(slot, block) of the page's content, in order.

    A page with an article or main element has its content there. Elsewhere it is what stands in the slots that hold
    content on most other pages of the host, or, where the host has none, in any slot, but for menus."""
    found = list(slots(page, template))
    if any(i.zone == "c" for _, _, i in found):
        return [(n, i.text) for n, _, i in found if i.zone == "c"]
    free = [(n, before, i) for n, before, i in found if i.zone == "f"]
    if template.content and any(before in template.content for _, before, _ in free):
        return [(n, i.text) for n, before, i in free if before in template.content]
    return [(n, i.text) for n, _, i in free if i.linked < LINKS * len(i.text)]


def check(tokens: list[int], classes: dict[int, int]) -> dict[int, tuple[bool, int]]:
    """Of each class on a page: whether its tokens come round in one order and its spans nest with those of classes
    before it, and a hash of that order. A class begins with the token that stands first, and ends a span with the
    last of its round; classes are numbered from the outermost."""
    where: dict[int, list[int]] = {}
    for at, t in enumerate(tokens):
        if t in classes:
            where.setdefault(classes[t], []).append(at)
    out, spans = {}, []
    for c in sorted(where):
        own = [tokens[at] for at in where[c]]
        size = len(dict.fromkeys(own))
        cycle = own[:size]
        fine = len(set(cycle)) == size and len(own) % size == 0 and all(own[k] == cycle[k % size] for k in range(len(own)))
        if fine:
            # a span must not cross a token of an outer class, unless it lies between the same two of them
            edges = [(where[c][k], where[c][k + size - 1]) for k in range(0, len(own), size)]
            outer = sorted(at for other in spans for at in other)
            fine = all(_within(outer, a, b) for a, b in edges)
        if fine:
            spans.append(where[c])
        out[c] = (fine, _hash(*cycle))
    return out


def _within(outer: list[int], a: int, b: int) -> bool:
    return bisect(outer, a) == bisect(outer, b)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of pages, what zones they are in, how long texts are, and how often a page has each token that may be
    a template's."""
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    for batch in few(batches, 128):
        rows = []
        for page in batch["html"].to_pylist():
            own = items(page or "")
            times = Counter(i.token for i in own if i.text is None or i.zone != "c")
            rows.append(([i.token for i in own], "".join(i.zone if i.text is not None else "-" for i in own), [len(i.text or "") for i in own], list(times), list(times.values())))
        tokens, zones, sizes, each, times = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch["host"], pa.array(tokens, longs), pa.array(zones), pa.array(sizes, ints), pa.array(each, longs), pa.array(times, ints)], ["host", "tokens", "zones", "sizes", "each", "times"])


def _checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, class, whether it's valid on all pages of the task, lowest and highest hash of its order)."""
    found: dict[tuple, list] = {}
    for batch in few(batches, 256):
        for host, tokens, zones, own, classes in zip(*(batch[c].to_pylist() for c in ("host", "tokens", "zones", "own", "classes")), strict=True):
            frequent = dict(zip(own, classes, strict=True))
            for c, (fine, order) in check([t for t, z in zip(tokens, zones, strict=True) if z != "c"], frequent).items():
                was = found.setdefault((host, c), [True, order, order])
                was[:] = was[0] and fine, min(was[1], order), max(was[2], order)
    yield pa.RecordBatch.from_pylist([{"host": h, "class": c, "fine": f, "low": a, "high": b} for (h, c), (f, a, b) in found.items()], pa.schema([("host", pa.string()), ("class", pa.int32()), ("fine", pa.bool_()), ("low", pa.int64()), ("high", pa.int64())]))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, slot, letters of content, of others) over the pages of the task; the slot by its root token."""
    found: dict[tuple, list] = {}
    for batch in few(batches, 256):
        for host, tokens, zones, sizes, own, classes, root in zip(*(batch[c].to_pylist() for c in ("host", "tokens", "zones", "sizes", "own", "classes", "root")), strict=True):
            page = [Item(t, None if z == "-" else "", z, size) for t, z, size in zip(tokens, zones, sizes, strict=True)]  # the size in place of letters in links
            for _, before, item in slots(page, Template(dict(zip(own, classes, strict=True)), root)):
                found.setdefault((host, before), [0, 0])[item.zone != "c"] += item.linked
    yield pa.RecordBatch.from_pylist([{"host": h, "slot": s, "content": a, "other": b} for (h, s), (a, b) in found.items()], pa.schema([("host", pa.string()), ("slot", pa.int64()), ("content", pa.int64()), ("other", pa.int64())]))


def _texts(names: tuple[str, str, str, str], kinds: list[pa.DataType]) -> Callable:
    slot = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, 128):
            texts, parts = [], []
            for page, own, classes, root, content in zip(*(batch[c].to_pylist() for c in ("html", "own", "classes", "root", "content")), strict=True):
                template = Template(dict(zip(own or (), classes or (), strict=True)), -1 if root is None else root, set(content or ()))
                found = main_text(items(page or ""), template)
                texts.append("\n".join(t for _, t in found))
                parts.append([{"slot": n, "text": t} for n, t in found])
            yield pa.RecordBatch.from_arrays([batch["i"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(parts, slot)], list(names) + ["slots"])

    return tidy(run)


def _meet(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Pages with the template of their host, if it has one. Small templates are broadcast; others are joined by host,
    where Spark splits a host with very many pages."""
    size = templates.agg(F.sum(F.size("own") * 12 + 64)).first()[0] or 0
    return pages.join(F.broadcast(templates) if size <= BROADCAST else templates, "host", "left")


def frequent_classes(known: DataFrame) -> DataFrame:
    """(host, class, tokens) of the hosts with at least PAGES pages: tokens on SUPPORT of them, by occurrence vector;
    classes are numbered from the outermost."""
    counts = known.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= PAGES)
    numbered = known.withColumn("page", F.monotonically_increasing_id())  # one number a page, given before its tokens are rows
    by_page = numbered.select("host", "page", F.explode(F.arrays_zip("each", "times")).alias("t")).select("host", "page", F.col("t.each").alias("token"), F.col("t.times").alias("n"))
    vectors = by_page.groupBy("host", "token").agg(
        F.count("*").alias("on"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("page", "n")).alias("a"), F.bit_xor(F.xxhash64("n", "page")).alias("b")
    )
    frequent = vectors.join(counts, "host").where(F.col("on") >= SUPPORT * F.col("pages"))
    classes = frequent.groupBy("host", "on", "total", "a", "b").agg(F.collect_list("token").alias("tokens"), F.max("pages").alias("pages"))
    # outermost first: on the most pages, the fewest times a page, the most tokens
    rank = F.array_sort(F.collect_list(F.struct((-F.col("on")).alias("on"), "total", (-F.size("tokens")).alias("size"), "tokens", "a")))
    ranked = classes.groupBy("host").agg(rank.alias("ranked"))
    return ranked.select("host", F.posexplode("ranked").alias("class", "c")).select("host", "class", F.col("c.tokens").alias("tokens"))


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each page.

    Returns id_col, url_col, text, n_chars (long: its code points) and slots (array of struct(slot, text): the blocks
    and the number of the template's slot each stands in, 0 without a template).

    Character references are decoded, white space inside a block is one space, blocks are joined by one newline; a line
    break ends a block. Nothing else is dropped or cut.

    Defined cases: a null or empty page has an empty text; pages without a host (null or odd urls) are one host; hosts
    with fewer than PAGES pages have no template, so their pages are read by their elements alone; repeated pages each
    give a row; unclosed and misplaced tags end where HTML ends them; other columns are ignored; an empty table gives
    none. Tokens are told by 64 bits of hash, occurrence vectors by 128.

    Plan: pages are read into tokens, which are counted by (host, token) with partial aggregates; so a host with a third of all pages is spread over tasks. Classes are checked, and slots judged, where
    the pages lie. Pages meet a template of a few hundred numbers; html is never shuffled unless the templates of all
    hosts exceed ``BROADCAST`` bytes.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    own = pages.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{url_col}`").alias("url"), host.alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    known = stored(own.select("host", "html").mapInArrow(tidy(_read), "host string, tokens array<long>, zones string, sizes array<int>, each array<long>, times array<int>"), "tokens")
    flat = stored(frequent_classes(known), "classes")
    gathered = lambda df: df.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("own"), F.flatten(F.collect_list(F.array_repeat(F.col("class"), F.size("tokens")))).alias("classes"), F.min("class").alias("root"))
    candidates = stored(gathered(flat), "candidates")
    checks = _meet(known, candidates).where("own is not null").mapInArrow(tidy(_checks), "host string, class int, fine boolean, low long, high long")
    valid = checks.groupBy("host", "class").agg(F.bool_and("fine").alias("fine"), F.min("low").alias("low"), F.max("high").alias("high")).where("fine and low = high").select("host", "class")
    shapes = stored(gathered(flat.join(valid, ["host", "class"])), "shapes")
    held = _meet(known, shapes).where("own is not null").mapInArrow(tidy(_held), "host string, slot long, content long, other long")
    judged = held.groupBy("host", "slot").agg(F.sum("content").alias("content"), F.sum("other").alias("other")).where("content > other").groupBy("host").agg(F.collect_list("slot").alias("content"))
    found = stored(shapes.join(judged, "host", "left"), "templates")
    names = (id_col, url_col, "text", "n_chars")
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    ddl = f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long, slots array<struct<slot:int,text:string>>"
    return _meet(own, found).mapInArrow(_texts(names, kinds), ddl)
