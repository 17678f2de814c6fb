"""HTML extraction: a template deduced from equivalence classes, and the slots it leaves."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .urls import host_of

#: Articles of a host from which a template is deduced, and those that a repeated text takes.
MIN_PAGES, MIN_TEXT_PAGES = 3, 8
#: Share of the articles that a class covers, and of its pages on which its order and its place hold.
SUPPORT, FIT = 0.6, 0.9
#: Share of the text below the outermost block that the main element has, where no heading tells it.
MOST = 0.8
#: Tokens of all templates up to which they are broadcast, and parts a host's pages are dealt to beyond that.
BROADCAST_TOKENS, PARTS = 1_000_000, 64

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.DOTALL
)
#: One attribute with its value, from the name's start on, so that no name is looked for inside a value.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>][^\s>]*)))?|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)")
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
_SPACE = re.compile(r"\s+")

RAW = ("script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe")
_RAW_END = {name: re.compile(f"</{name}", re.IGNORECASE) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose text is never the article's.
OUTSIDE_NAMES = {
    "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "button", "select", "textarea",
    "head", "title", "dialog", "menu", "object", "canvas", "audio", "video", "map", "math", "xmp", "noembed", "noframes",
}
#: Words of a class, id or role that name reader comments and adverts, other things beside an article, and parts of a page.
READER_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsored", "comment", "comments", "reply", "replies", "respond", "disqus"}
BESIDE_WORDS = READER_WORDS | {
    "banner", "sponsor", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside",
    "complementary", "widget", "related", "recommended", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup",
    "modal", "overlay", "subscribe", "newsletter", "signup", "login", "search", "share", "sharing", "social", "footer", "footnav",
    "masthead", "topbar", "toolbar", "pagination", "pager", "contentinfo", "skip",
}
PART_WORDS = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "group", "head", "header",
    "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "panel", "post", "posts", "right", "row", "section",
    "site", "slot", "stories", "thread", "title", "top", "unit", "wrap", "wrapper",
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend",
    "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: An opening tag closes an open element of the first names, unless one of the second is open within it.
_ITEMS = ("ul", "ol", "dl", "table", "tbody", "select")
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "body": ("head",),
}

#: Elements that hold parts of a page; those without class and id are told apart by their number among their like.
HOLDERS = {"div", "section", "table", "ul", "ol", "dl", "td"}

#: Kinds of tokens, the low bits of a mark, and what else is known of a token.
TEXT, OPEN, CLOSE, VOID_TAG, LINE_BREAK, BLOCK_BREAK, KIND = 0, 1, 2, 3, 4, 5, 7
BLOCK, OUTSIDE, MAIN, HEADING, BESIDE, READER, LINK, ROOT = 8, 16, 32, 64, 128, 256, 512, 1024


def _attributes(text: str) -> dict[str, str]:
    """The attributes of a tag in lower case; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        if m[1]:
            found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return found


def _named(value: str, names: set[str]) -> bool:
    """Whether one of the names in ``value`` has a word of ``names`` and beside
    it only words of parts, as comment-list has and search-results has not."""
    words = [set(_WORDS.findall(v)) for v in value.split()]
    return any(w & names and w <= names | PART_WORDS for w in words)


def _mark(name: str, has: dict[str, str]) -> int:
    mark = OPEN | (BLOCK if name in BLOCKS else 0)
    if name in OUTSIDE_NAMES or "hidden" in has or has.get("aria-hidden") == "true":
        return mark | OUTSIDE
    mark |= MAIN if name in ("article", "main") else ROOT if name in ("html", "body") else 0
    mark |= LINK if name == "a" else HEADING if name in ("h1", "h2") else 0
    if not mark & ROOT and has:
        value = " ".join(has.get(k, "") for k in ("class", "id", "role"))
        mark |= READER | BESIDE if _named(value, READER_WORDS) else BESIDE if _named(value, BESIDE_WORDS) and not mark & MAIN else 0
    return mark


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


#: What is known of a tag below a path: (code of the element, mark). Emptied when it grows.
_SEEN: dict[tuple[int, str, str, int], tuple[int, int]] = {}


def _element(path: int, name: str, attributes: str, number: int) -> tuple[int, int]:
    """The code of an element, a hash of its path with the class and id, or the number, of each step, and its mark."""
    key = (path, name, attributes, number)
    found = _SEEN.get(key)
    if found is None:
        has = _attributes(attributes) if attributes else {}
        step = f"{path}\0{name}\0{has.get('class', '')}\0{_DIGITS.sub('#', has.get('id', ''))}\0{number}"
        found = _signed(xxhash.xxh64_intdigest(step.encode("utf-8", "surrogatepass"))), _mark(name, has)
        if len(_SEEN) > 50_000:
            _SEEN.clear()
        _SEEN[key] = found
    return found


def parse(html: str) -> tuple[list[int], list[int], list[str], int]:
    """Codes, marks, texts and article of a page.

    One code and mark for each tag and text node: a tag's code is a hash of its
    path, its complement stands for the closing tag, a text's is a hash of path
    and text. 0 is no token of a template: white space, a closing tag that the
    page leaves out, a line break. ``texts`` has the texts that no element
    keeps outside, with references decoded and white space joined. ``article``
    is the hash of the longest texts, up to half of all text; pages that agree
    in it show copies of one article.

    Tags that the page leaves open are closed as browsers do: a block ends an
    open paragraph, an item the item before it, a closing tag all that is open
    in it. A tag that the page's end cuts off is dropped. Work is linear in the
    length of the page, whatever its depth.
    """
    codes: list[int] = []
    marks: list[int] = []
    texts: list[str] = []
    stack: list[tuple[str, int, int, int, dict[str, int]]] = []  # name, code, mark, whether outside, holders in it
    top: dict[str, int] = {}
    opened: dict[str, list[int]] = {}  # by name the places in the stack
    blocks: list[int] = []
    bares: list[str] = []

    def close(depth: int, told: bool) -> None:
        while len(stack) > depth:
            name, code, mark, _, _ = stack.pop()
            opened[name].pop()
            if mark & BLOCK:
                blocks.pop()
            codes.append(~code if told and len(stack) == depth else 0)
            marks.append(mark & ~KIND | CLOSE)

    def last(*names: str) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=-1)

    at, raw = 0, ""
    while at < len(html):
        if raw:
            end = _RAW_END[raw].search(html, at)
            stop, m = (end.start() if end else len(html)), None
        else:
            m = _TOKEN.search(html, at)
            stop = m.start() if m else len(html)
        if stop > at:
            path, outside = (stack[-1][1], stack[-1][3]) if stack else (0, 0)
            text = _SPACE.sub(" ", html[at:stop] if raw else unescape(html[at:stop]))
            bare = text.strip()
            codes.append(_signed(xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass"), path & (1 << 64) - 1)) if bare else 0)
            marks.append(TEXT | outside)
            if not outside:
                texts.append(text)
                bares.append(bare)
        if raw:
            at, raw = stop, ""
            continue
        if m is None or m[4] == "":
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br" or name == "p" and not opened.get("p"):
                codes.append(0)
                marks.append(LINE_BREAK if name == "br" else BLOCK_BREAK)
            elif opened.get(name):
                depth = opened[name][-1]
                if name in BLOCKS or not (blocks and blocks[-1] > depth):
                    close(depth, True)
            continue
        if name in BLOCKS and opened.get("p"):
            close(opened["p"][-1], False)
        if name in CLOSES and (depth := last(*CLOSES[name])) > last(*_ITEMS):
            close(depth, False)
        path, outside = (stack[-1][1], stack[-1][3]) if stack else (0, 0)
        number = 0
        if name in HOLDERS and "class" not in m[3] and "id" not in m[3]:
            like = stack[-1][4] if stack else top
            number = like[name] = like.get(name, 0) + 1
        code, mark = _element(path, name, m[3], number)
        if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCKS:
            codes.append(0 if name == "br" else code)
            marks.append(LINE_BREAK if name == "br" else BLOCK_BREAK if name == "hr" else VOID_TAG)
            continue
        if name == "header" and not any(s[2] & MAIN for s in stack[:64]):
            mark |= OUTSIDE  # the page's header; an article's own is part of it
        codes.append(code)
        marks.append(mark)
        opened.setdefault(name, []).append(len(stack))
        if mark & BLOCK:
            blocks.append(len(stack))
        stack.append((name, code, mark, outside | mark & OUTSIDE, {}))
        if name in _RAW_END:
            raw = name
    bares.sort(key=lambda t: (-len(t), t))
    half, told = sum(map(len, bares)) / 2, xxhash.xxh64()
    for bare in bares:
        told.update(bare.encode("utf-8", "surrogatepass") + b"\0")
        half -= len(bare)
        if half <= 0:
            break
    return codes, marks, texts, _signed(told.intdigest())


def _layout(codes: list[int], marks: list[int], sizes: list[int], class_of: dict[int, int], need: Counter) -> Iterator[tuple[str, int, int, int, int, int]]:
    """What one page says of its host's classes, as (kind, a, b, c, d, chars).

    seen: class. order: class, its tokens' order. nest: class, the class around
    it, the gap there. slot: class, gap, template element, text in it. part:
    class, token, template element around, mark.
    """
    yield "page", 0, 0, 0, 0, 0
    found: dict[int, list[int]] = {}
    for code in codes:
        c = class_of.get(code)
        if c is not None:
            found.setdefault(c, []).append(code)
    rank: dict[int, int] = {}
    for c, seq in found.items():
        n = need[c]
        first = seq[:n]
        whole = len(set(first)) == n and len(seq) % n == 0 and seq == first * (len(seq) // n)
        yield "seen", c, 0, 0, 0, 0
        yield "order", c, _signed(xxhash.xxh64_intdigest(repr(first))) if whole else 0, 0, 0, 0
        if whole:
            rank.update({code: k for k, code in enumerate(first)})
    # Occurrences of classes nest like brackets; what is left open when an outer one goes on crosses it.
    open_: list[list[int]] = [[0, 0]]  # class, gap
    place: dict[int, tuple[int, int]] = {}
    elements = [0]
    template_open: list[bool] = []
    k = links = outside = 0
    slots: dict[tuple[int, int, int], int] = {}
    for code, mark in zip(codes, marks, strict=True):
        kind, r = mark & KIND, rank.get(code)
        if kind == CLOSE and template_open:
            if template_open.pop():
                elements.pop()
            links -= bool(mark & LINK)
            outside -= bool(mark & (OUTSIDE | BESIDE))
        if r is not None:
            c = class_of[code]
            if r == 0:
                here = (open_[-1][0], open_[-1][1])
                if place.setdefault(c, here) != here:
                    place[c] = (-1, -1)
                open_.append([c, 0])
            else:
                depth = len(open_) - 1
                while depth and open_[depth][0] != c:
                    depth -= 1
                if depth:
                    for crossing in open_[depth + 1 :]:
                        place[crossing[0]] = (-1, -1)
                    del open_[depth + 1 :]
                    open_[-1][1] = r
                else:
                    place[c] = (-1, -1)
            yield "part", c, code, elements[-1], mark, 0
            if r == need[c] - 1 and open_[-1][0] == c:
                open_.pop()
        if kind == OPEN:
            template_open.append(r is not None)
            if r is not None:
                elements.append(code)
            links += bool(mark & LINK)
            outside += bool(mark & (OUTSIDE | BESIDE))
        elif kind == TEXT and not mark & OUTSIDE:
            if not links and not outside and r is None:
                slot = (open_[-1][0], open_[-1][1], elements[-1])
                slots[slot] = slots.get(slot, 0) + sizes[k]
            k += 1
    for c, (parent, gap) in place.items():
        yield "nest", c, parent, gap, 0, 0
    for (c, gap, element), chars in slots.items():
        yield "slot", c, gap, element, 0, chars


def choose(facts: list[tuple], min_text_pages: int = MIN_TEXT_PAGES, articles: int = 1 << 60) -> tuple[list[int], int]:
    """(tokens to drop, element of the main text or 0) of a host, from (kind, a, b, c, d, n, chars).

    A class is valid if its tokens are in one order, and it stands at one place
    among the others, on ``FIT`` of its pages. The main slot is the one with
    most text outside of links. The main element is the innermost template
    element around it that is an article or holds a heading, or else the
    innermost block with ``MOST`` of the text. Dropped are the texts that valid classes hold, and
    elements that their class or id names beside the article.
    """
    seen = {a: n for kind, a, _, _, _, n, _ in facts if kind == "seen"}
    ordered = {a for kind, a, b, _, _, n, _ in facts if kind == "order" and b and n >= FIT * seen.get(a, n)}
    nested = {a for kind, a, b, _, _, n, _ in facts if kind == "nest" and b != -1 and n >= FIT * seen.get(a, n)}
    valid = ordered & nested
    parts = sorted((f for f in facts if f[0] == "part" and f[1] in valid), key=lambda f: (f[5], f[2], f[3], f[4]))
    parent = {b: c for _, _, b, c, _, _, _ in parts}
    mark = {b: d for _, _, b, _, d, _, _ in parts}

    def path(element: int) -> list[int]:
        out: list[int] = []
        while element and element not in out:
            out.append(element)
            element = parent.get(element, 0)
        return out

    slots = [f for f in facts if f[0] == "slot" and f[3]]
    region, main = 0, []
    if slots:
        main = path(max(slots, key=lambda f: (f[6], -f[1], -f[2], f[3]))[3])
        around = [e for e in main if mark.get(e, 0) & BLOCK]
        holds = {p for e, m in mark.items() if m & HEADING and m & KIND == OPEN for p in path(e)}
        whole = [e for e in around if not mark[e] & ROOT]
        held: Counter = Counter()
        for f in slots:
            held.update({e: f[6] for e in path(f[3])})
        most = [e for e in whole if held[e] >= MOST * held[whole[-1]]]
        region = next((e for e in whole if mark[e] & MAIN or e in holds), (most or [0])[0])
    texts = [e for e, m in mark.items() if m & KIND == TEXT] if articles >= min_text_pages else []
    beside = [e for e, m in mark.items() if m & KIND == OPEN and m & BESIDE and e not in main]
    return sorted(texts + beside), region


def extract(codes: list[int], marks: list[int], texts: list[str], drop=(), region: int = 0) -> str:
    """The main text of a parsed page: what stands in the slots of the template.

    With a main element, it is the text there. Without one, as on a page of a
    host with too few articles, the text of an article or main element, or else
    all text that no class or id names beside the article; inside an article
    only such names of adverts and reader comments count. What the template
    holds is left out. Blocks are joined by a newline.
    """
    known = set(drop)
    by_template = bool(region) and region in codes
    found: tuple[list[str], list[str]] = ([], [])
    parts: list[str] = []
    states: list[tuple[bool, bool]] = []
    inside = dropped = False
    k = 0

    def close() -> None:
        text = _SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            found[inside].append(text)

    for code, mark in zip(codes, marks, strict=True):
        kind = mark & KIND
        if kind == TEXT:
            if not mark & OUTSIDE:
                if not dropped and code not in known and (inside or not by_template):
                    parts.append(texts[k])
                k += 1
        elif kind == OPEN:
            if mark & BLOCK:
                close()
            states.append((inside, dropped))
            main = code == region if by_template else bool(mark & MAIN)
            if main and not inside:
                close()
            dropped = dropped or code in known or not by_template and bool(mark & (READER if inside else BESIDE))
            inside = inside or main
        elif kind == CLOSE:
            before = states.pop()
            if mark & BLOCK or before[0] != inside:
                close()
            inside, dropped = before
        elif kind == LINE_BREAK:
            parts.append(" ")
        elif kind == BLOCK_BREAK:
            close()
    close()
    return "\n".join(found[True] if by_template else found[True] or found[False])


_PARSED = "row_key long, page_id long, url string, host string, article long, codes array<long>, marks array<int>, texts array<string>"


def _parsed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pages = b.column(4).to_pylist()
        for lo in range(0, len(pages), 256):
            found = [parse(h or "") for h in pages[lo : lo + 256]]
            codes, marks, texts, article = zip(*found, strict=True)
            own = [b.column(k).slice(lo, len(found)) for k in range(4)]
            cols = [pa.array(article, pa.int64()), pa.array(codes, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*own, *cols], [f.split()[0] for f in _PARSED.split(", ")])


def classes(parsed: DataFrame) -> DataFrame:
    """Rows (host, articles, tokens): the tokens of each host's equivalence classes, with their class.

    Tokens of a host with the same occurrence vector, the number of times they
    occur in each page, form an equivalence class. Pages that show one article
    count once. Vectors are compared by a sum over the pages that does not
    depend on order, so that counting is combined before the shuffle, for the
    largest host too. A class has two tokens or more, on ``SUPPORT`` of the
    articles, of which there are ``MIN_PAGES``. Each of its tokens is on more
    than half of them, so that a template has less than twice the tokens of a
    mean page.
    """
    shown = parsed.groupBy("host", "article").agg(F.min_by("codes", "row_key").alias("codes"))
    counted = shown.select("host", "article", F.explode("codes").alias("token")).filter("token != 0").groupBy("host", "article", "token").count()
    # Two halves of the sum keep it from overflowing.
    vector = F.xxhash64("article", "count")
    vectors = counted.groupBy("host", "token").agg(
        F.count("*").alias("support"), F.sum(vector.bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftright(vector, 32)).alias("high")
    )
    vectors = vectors.filter(F.col("support") >= SUPPORT * MIN_PAGES)  # most texts are on one page alone
    articles = parsed.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("articles")).filter(F.col("articles") >= MIN_PAGES)
    frequent = vectors.join(articles.hint("shuffle_hash"), "host").filter(F.col("support") >= SUPPORT * F.col("articles"))
    same = frequent.groupBy("host", "support", "low", "high").agg(F.collect_list("token").alias("tokens"), F.first("articles").alias("articles"))
    each = same.filter(F.size("tokens") >= 2).select("host", "articles", F.xxhash64("support", "low", "high").alias("class"), F.explode("tokens").alias("token"))
    return each.groupBy("host").agg(F.first("articles").alias("articles"), F.collect_list(F.struct("token", "class")).alias("tokens"))


def _with_templates(rows: DataFrame, found: DataFrame, tokens: str) -> DataFrame:
    """``rows`` with what ``found`` knows of their host; a large host's rows are dealt to many tasks."""
    total = found.agg(F.sum(F.size(tokens)), F.count("*")).first()
    if (total[0] or 0) + total[1] <= BROADCAST_TOKENS:
        return rows.join(F.broadcast(found), "host", "left")
    copies = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("part", F.pmod("row_key", F.lit(PARTS)).cast("int")).join(copies.hint("shuffle_hash"), ["host", "part"], "left")


_FACTS = "host string, kind string, a long, b long, c long, d long, n long, chars long"


def _fact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of what the pages of a task say, summed up before the shuffle."""
    counts: dict[tuple, list[int]] = {}
    models: dict[str, tuple[dict[int, int], Counter]] = {}

    def flush() -> pa.RecordBatch:
        cols = list(zip(*[(*key, *value) for key, value in counts.items()], strict=True)) or [()] * 8
        counts.clear()
        types = [pa.string(), pa.string(), *[pa.int64()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [f.split()[0] for f in _FACTS.split(", ")])

    for b in batches:
        tokens = b.column(4)
        offsets, flat = tokens.offsets.to_numpy(), tokens.values
        for i, (host, codes, marks, sizes) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)):
            if host not in models:
                if len(models) > 200:
                    models.clear()
                part = flat.slice(offsets[i], offsets[i + 1] - offsets[i])
                class_of = dict(zip(part.field(0).to_pylist(), part.field(1).to_pylist(), strict=True))
                models[host] = class_of, Counter(class_of.values())
            for kind, a, b_, c, d, chars in _layout(codes, marks, sizes, *models[host]):
                value = counts.setdefault((host, kind, a, b_, c, d), [0, 0])
                value[0] += 1
                value[1] += chars
        if len(counts) > 50_000:
            yield flush()
    yield flush()


def _template_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, articles, facts = (b.column(k).to_pylist() for k in range(3))
        found = [choose([tuple(f.values()) for f in fs], articles=n) for n, fs in zip(articles, facts, strict=True)]
        drop, region = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(drop, pa.list_(pa.int64())), pa.array(region, pa.int64())], ["host", "drop", "region"])


def templates(parsed: DataFrame) -> DataFrame:
    """Rows (host, drop, region): each host's template, as ``choose`` decides it.

    Every page is laid over the classes of its host, to check their order and
    how they nest and to sum the text of their slots. What fewer than half of a
    host's pages say plays no part and is left out, so that a host's facts are
    of the size of its template.
    """
    found = materialize(classes(parsed), "classes")
    rows = parsed.select("row_key", "host", "codes", "marks", F.transform("texts", F.length).alias("sizes"))
    known = _with_templates(rows, found, "tokens").filter("tokens is not null")
    facts = known.select("host", "codes", "marks", "sizes", "tokens").mapInArrow(_fact_rows, _FACTS)
    facts = materialize(facts.groupBy("host", "kind", "a", "b", "c", "d").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")), "facts")
    pages = facts.filter("kind = 'page'").select("host", F.col("n").alias("pages"))
    common = facts.join(pages.hint("shuffle_hash"), "host").filter("2 * n >= pages")
    by_host = common.groupBy("host").agg(F.collect_list(F.struct("kind", "a", "b", "c", "d", "n", "chars")).alias("facts"))
    return by_host.join(found.select("host", "articles"), "host").select("host", "articles", "facts").mapInArrow(_template_rows, "host string, drop array<long>, region long")


def _extract_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = [b.column(k).to_pylist() for k in range(2, 7)]
        out = [extract(codes, marks, texts, drop or (), region or 0) for codes, marks, texts, drop, region in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each input row.

    Each page is parsed once; its tokens are written and read by the steps that
    follow. A null or empty page has an empty text. A host with fewer than
    ``MIN_PAGES`` different articles has no template; its pages are told by
    their elements alone. Repeated rows stay repeated; other columns are not read.
    """
    key = F.xxhash64(id_col, html_col)
    rows = pages.select(key.alias("row_key"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    parsed = materialize(rows.mapInArrow(_parsed_rows, _PARSED), "parsed")
    found = materialize(templates(parsed), "templates")
    joined = _with_templates(parsed, found, "drop")
    return joined.select("page_id", "url", "codes", "marks", "texts", "drop", "region").mapInArrow(_extract_rows, "page_id long, url string, text string, n_chars long")
