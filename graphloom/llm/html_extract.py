"""Main text of web pages by equivalence classes of tokens that share an occurrence vector across the pages of a host.

Deduction. The tokens of a page are its elements (the path of tags from the root, with class, id and role) and its text
nodes (path and text). The occurrence vector of a token is its count on each distinct page of the host; it is folded
by XOR into 64 bits, so that no task holds a host's pages. Tokens with equal vectors form a class. A class is valid if it
has enough pages and tokens and if its tokens follow each other in the same order on all of these pages. Valid classes
nest: an element belongs to the template if its class is valid and the element around it belongs to the template too.

Extraction. What the template does not fix are slots, and the elements of the template that enclose a slot say what it
is. Slots in menus, headers, footers, sidebars, notices, adverts, forms and reader comments are left out; if the
template has an article (or main) element, the slots inside it are the text, else all others are. Text that the template
fixes (the same at one path wherever it occurs) is no slot. An element that belongs to no valid class is part of a slot's
content, whatever its name. A page that holds less than half of its host's most frequent class, or whose host has too few
pages for a template, does not instantiate one: all elements of its own stand in for the template.
"""

from __future__ import annotations

import html
import re
from collections.abc import Collection, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import written

#: A class is valid on at least so many distinct pages of a host, and with so many tokens.
MIN_PAGES, MIN_TOKENS = 3, 2
#: The hosts' root class is on at least this share of the pages; fixed text is too.
MIN_SHARE = 0.5
#: Templates of so many entries (8 bytes each) are broadcast; beyond that they are joined by a shuffle.
BROADCAST_ENTRIES = 2_000_000

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^<>\"']*+(?:\"[^\"]*+\"[^<>\"']*+|'[^']*+'[^<>\"']*+)*+)>")
_TAG_BLIND = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_OTHER = re.compile(r"<[!?/][^>]*+>")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
#: How far up an implied end tag is looked for; tags whose quotes do not close, after which quotes are no longer read.
MAX_LOOK, MAX_BROKEN = 512, 64
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no text of the page.
_RAW = frozenset("script style noscript template svg iframe textarea select title".split())
_BOILERPLATE = frozenset("nav aside footer form button menu dialog head".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
_STOPS = ("article", "body", "div", "section", "main", "td", "li", "blockquote", "button")
#: Whole names in class, id or role of parts that are no main text.
_UNWANTED = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side-bar footer banner cookie cookies cookie-banner consent notice gdpr popup modal overlay ad ads advert adverts advertisement "
    "adsense sponsor sponsored promo promotion comment comments comment-list commentlist replies disqus respond related recommended share sharing social newsletter subscribe signup login search "
    "pagination pager toolbar widget complementary contentinfo alert masthead".split()
)


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _hash(value: str, seed: int = 0) -> int:
    return int.from_bytes(xxhash.xxh64_digest(value.encode("utf-8", "surrogatepass"), seed), "big", signed=True)


def tags_of(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, "/" or "", tag name, attributes) of each tag, in one pass; the name is empty for the text at the end.

    Comments and the content of scripts and the like are skipped. A tag whose quotes do not close ends at the next `>`.
    """
    at = begin = broken = 0
    unclosed: set[str] = set()
    text: list[str] = []
    last = page.rfind(">")
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            text.append(page[begin:at])
            at = begin = len(page) if end < 0 else end + 3
            continue
        if at > last:
            break
        tag = _TAG.match(page, at) if broken < MAX_BROKEN else None
        if tag is None:
            tag = _TAG_BLIND.match(page, at)
            if tag is None:
                if other := _OTHER.match(page, at):
                    text.append(page[begin:at])
                    at = begin = other.end()
                else:
                    at += 1
                continue
            broken += 1
        text.append(page[begin:at])
        name = tag[2].lower()
        yield "".join(text), tag[1], name, tag[3]
        text.clear()
        at = begin = tag.end()
        if name in _RAW and not tag[1] and not tag[3].endswith("/") and name not in unclosed:
            close = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            if close:
                at = begin = close.start()
            elif name in ("script", "style"):
                at = begin = len(page)
            else:
                unclosed.add(name)  # an element like others, then
    yield "".join(text) + page[begin:], "", "", ""


class _Element:
    __slots__ = ("tag", "block", "path", "depth", "wanted", "article", "known", "inline")


def read_page(page: str, template: Collection[int] | None = None) -> tuple[list[tuple[int, str, bool, bool, int]], dict[int, tuple[int, int]]]:
    """The text blocks of a page and its elements.

    A block is (path, text, whether it lies in an unwanted part, whether in an article, where it begins among the page's
    tokens); an element is path: (times, where it comes first). Only elements of `template` have a meaning, those
    without one all have. A block is the text between two tags that are not inline. Open p, li and table parts end
    where HTML lets them.
    """
    root = _Element()
    root.tag, root.block, root.path, root.depth, root.wanted, root.article, root.known, root.inline = "", True, 0, 0, True, False, True, {}
    stack, opened = [root], {}
    blocks: list[tuple[int, str, bool, bool, int]] = []
    seen: dict[int, tuple[int, int]] = {}
    parts: list[str] = []
    place = 0

    def pop_to(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    def flush() -> None:
        nonlocal place
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                e = stack[-1]
                place += 1
                blocks.append((e.path, text, not e.wanted, e.article, place))

    for before, slash, tag, attributes in tags_of(page):
        if before:
            parts.append(before)
        if not tag:
            break
        if tag in _RAW:
            continue
        inline = tag in _INLINE
        if slash:
            if not inline:
                flush()
            if opened.get(tag, 0):
                frame = stack[-1].inline
                if not inline or frame.get(tag, 0):  # an inline element never closes the block around it
                    k = len(stack) - 1
                    while stack[k].tag != tag:
                        k -= 1
                    if inline:
                        for e in stack[k:]:
                            frame[e.tag] -= 1
                    pop_to(k)
            continue
        if tag == "br":
            parts.append("\n")
        if not inline:
            flush()
        if tag in _VOID:
            continue
        if not inline:
            closes = ("p",) if tag in _CLOSES_P else _SIBLINGS.get(tag, ())
            if closes and any(opened.get(c, 0) for c in closes):
                stops = _SCOPES.get(tag, _STOPS)
                for k in range(len(stack) - 1, max(0, len(stack) - 1 - MAX_LOOK), -1):
                    if stack[k].tag in closes:
                        pop_to(k)
                        break
                    if stack[k].tag in stops:
                        break
        up, e = stack[-1], _Element()
        e.tag, e.block = tag, not inline
        if attributes.endswith("/"):
            continue
        if inline and "=" not in attributes:
            e.path, e.depth, e.wanted, e.article, e.known, e.inline = up.path, up.depth, up.wanted, up.article, up.known, up.inline
        else:
            names = sorted((a.lower(), _DIGITS.sub("#", x or y or z)) for a, x, y, z in _ATTRIBUTE.findall(attributes)) if "=" in attributes else []
            words = {w for _, v in names for w in v.lower().split()}
            e.article, e.inline = up.article, up.inline if inline else {}
            if inline:  # part of its block, but it may hold an advert
                e.path, e.depth, e.known = up.path, up.depth, up.known
                e.wanted = up.wanted and not (e.known and template is None and words & _UNWANTED)
            else:
                e.path = _hash(tag + "".join(f"[{a}={v}]" for a, v in names), up.path & 0xFFFFFFFFFFFFFFFF)
                e.depth = up.depth + 1
                e.known = up.known and (template is None or e.path in template)
                is_article = tag in ("article", "main") or "main" in words and ("role", "main") in names
                if e.known:
                    e.article = up.article or is_article
                    boilerplate = tag in _BOILERPLATE or (tag == "header" and not up.article)
                    e.wanted = up.wanted and not boilerplate and not (tag not in ("html", "body", "article", "main") and words & _UNWANTED)
                else:
                    e.wanted = up.wanted
                place += 1
                times, first = seen.get(e.path, (0, place))
                seen[e.path] = times + 1, first
        opened[tag] = opened.get(tag, 0) + 1
        if inline:
            e.inline[tag] = e.inline.get(tag, 0) + 1
        stack.append(e)
    flush()
    return blocks, seen


def main_text(page: str | None, template: Collection[int] | None, fixed: Collection[int] = (), root: Collection[int] = ()) -> str:
    """The slots of one page, given the path hashes of its host's template.

    `root` are the elements of the class that is on most pages. Without a template the page stands for itself; an empty
    one knows no element, and everything is one slot.
    """
    blocks, seen = read_page(page or "", template)
    if template and 2 * sum(p in seen for p in root) < len(root):
        blocks, fixed = read_page(page or "")[0], ()
    kept = [(text, inside) for path, text, unwanted, inside, _ in blocks if not unwanted and path not in fixed]
    article = [text for text, inside in kept if inside]
    return "\n\n".join(article or [text for text, _ in kept])


TOKENS = "host string, page long, path long, text long, place int, times int"


def _tokens(pages: DataFrame) -> DataFrame:
    """`text` is null for elements. A page is known by the hash of its html."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split()[0] for f in TOKENS.split(", ")]
        for batch in batches:
            rows = []
            for url, page in zip(batch.url, batch.html, strict=True):
                page = page or ""
                blocks, seen = read_page(page)
                host, own = host_of(url), _hash(page)
                rows += [(host, own, path, None, first, times) for path, (times, first) in seen.items()]
                texts: dict[tuple[int, int], tuple[int, int]] = {}
                for path, text, _, _, place in blocks:
                    key = (path, _hash(text))
                    times, first = texts.get(key, (0, place))
                    texts[key] = times + 1, first
                rows += [(host, own, path, text, first, times) for (path, text), (times, first) in texts.items()]
            yield pd.DataFrame(rows, columns=columns).astype({"text": "Int64"})

    return pages.select("url", "html").mapInPandas(read, TOKENS)


def valid_classes(tokens: DataFrame, hosts: DataFrame) -> DataFrame:
    """`host`, `path`, `text`, `class`, `support`, `share` of the tokens of valid classes, from `_tokens`' distinct rows.

    Order is checked by each token's predecessor in its class: it must be the same on all pages of the class. The
    windows lie within a page, and a token that few pages have is gone before them.
    """
    vector = tokens.groupBy("host", "path", "text").agg(F.count("*").alias("support"), F.bit_xor(F.xxhash64("page", "times")).alias("class"))
    vector = written(vector.where(f"support >= {MIN_PAGES}"), "vectors")
    classes = vector.groupBy("host", "class", "support").agg(F.count("*").alias("members")).where(f"members >= {MIN_TOKENS}")
    vector = written(vector.join(classes, ["host", "class", "support"]), "members")
    token = F.coalesce("text", "path")
    own = tokens.join(vector.select("host", "path", "text", "class").withColumnsRenamed({"host": "h", "path": "p", "text": "t"}), (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")) & F.col("text").eqNullSafe(F.col("t")))
    line = Window.partitionBy("host", "page", "class").orderBy("place", token)
    before = own.select("host", "path", "text", "class", F.coalesce(F.lag(token).over(line), F.lit(0)).alias("before"))
    broken = before.groupBy("host", "class", "path", "text").agg(F.min("before").alias("low"), F.max("before").alias("high")).where("low <> high").select("host", "class").distinct()
    return vector.join(broken, ["host", "class"], "left_anti").join(hosts, "host").withColumn("share", F.col("support") / F.col("pages"))


def deduce_templates(pages: DataFrame) -> DataFrame:
    """One row per host with a template: `host`, `template` and `root` (paths of elements), `fixed` (paths of text).

    Equal pages count once, so that copies are not mistaken for a template. All steps are aggregations with partial ones
    before the shuffle; a host's lists are no longer than an average page has tokens.
    """
    tokens = written(_tokens(pages).distinct(), "tokens")
    hosts = written(tokens.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    valid = written(valid_classes(tokens, hosts), "classes")
    often = F.col("share") >= MIN_SHARE
    texts = tokens.where("text is not null").groupBy("host", "path").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    fixed = valid.where(F.col("text").isNotNull() & often).join(texts.where("low = high").select("host", "path"), ["host", "path"], "left_semi")
    fixed = fixed.groupBy("host").agg(F.collect_set("path").alias("fixed"))
    elements = valid.where("text is null")
    top = Window.partitionBy("host")
    size = F.max(F.when(often, F.struct("support", "members", "class"))).over(top)
    lists = elements.withColumn("_top", size).groupBy("host").agg(
        F.collect_set("path").alias("template"), F.collect_set(F.when(F.col("class") == F.col("_top.class"), F.col("path"))).alias("root")
    )
    return lists.join(fixed, "host", "left").select("host", "template", "root", F.coalesce("fixed", F.array().cast("array<long>")).alias("fixed"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per row of `pages`: `page_id`, `url`, `text`, `n_chars` (code points of the text).

    Null html is empty and gives the empty text; an empty table gives an empty result. Pages with a null or odd url
    share the host ''. Repeated rows are returned as often as they came and count once in a template. The time of a page
    grows with its length, however deep or broken its tags are. Other columns, whatever their names, are not read.
    Templates within BROADCAST_ENTRIES are broadcast; beyond, the join by host can split a hot host, as its other side
    has one row a host.
    """
    templates = written(deduce_templates(pages), "templates").withColumnRenamed("host", "_host")
    entries = templates.agg(F.sum(F.size("template") + F.size("root") + F.size("fixed")).alias("n")).first().n
    if (entries or 0) <= BROADCAST_ENTRIES:
        templates = F.broadcast(templates)
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    @F.pandas_udf(schema)
    def extract(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for htmls, template, root, fixed in batches:
            rows = zip(htmls, template, root, fixed, strict=True)
            texts = [main_text(h, None) if t is None else main_text(h, set(t), set(f), r) for h, t, r, f in rows]
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?i:[a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    own = pages.select("page_id", "url", "html", host.alias("_host")).join(templates, "_host", "left")
    return own.select("page_id", "url", extract("html", "template", "root", "fixed").alias("x")).select("page_id", "url", "x.text", "x.n_chars")
