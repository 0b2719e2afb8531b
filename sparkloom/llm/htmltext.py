"""Main text of web pages by equivalence-class template deduction.

A page's tokens are its elements, told apart by their path, and its text blocks. For each host, tokens with the same
occurrence vector over its pages (as often as one another on every page) form an equivalence class; classes are found by
(pages, occurrences, sums of hashes of page and count), so nothing but counts is shuffled. A class is large if it has two
elements or more and is on half of the pages. A second pass over the pages tests the large classes: a member stays if its
place among its class is one and the same on every page, and a class nests if each member lies in one and the same gap of the
host's root class (the most frequent, then the largest). What stays is the template. Its elements are walked down from the page
to the innermost that holds three quarters of the text: the article's slot; headings passed on the way belong to it. Text in
the template's classes outside the slot, or in the slot alone in a template element, is the template's own; a template element
in the slot that is mostly links, and the records of a class that recurs on a page with a text of its own, go. What a page has
left in the slot is its text.

Elements that HTML itself defines as no article (nav, footer, aside, form ...) go. Class and id names decide only what the
template leaves open, inside the slot or on pages without one: a name goes if each of its words tells of what lies beside
articles, and no name counts in article and main
elements if nothing else would remain.

Null html is empty; so is the text of pages without any. A null or odd url is a host of its own name. A page that lacks
its host's slot, and a host of fewer than LEAST_PAGES pages or without a template, keep what lies in article and main
elements if that is half of their text, else everything not excluded. Broken markup (unclosed or stray tags, cut-off pages,
unclosed comments) is read as far as it goes. Very long pages are read whole, one at a time. Rows with equal page_id are pages
each; an empty table gives an empty one; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_above, materialise, release, salted_join, slices

#: Share of a host's pages that a class is on, elements a class needs, and pages a host needs for a template.
SHARE, LARGE, LEAST_PAGES = 0.5, 2, 4
#: A slot inside the chosen one is preferred if it holds this share of the text.
DEEPER = 0.75
#: Bytes of templates that are broadcast at most; beyond that they are joined by shuffle, hot hosts dealt over many tasks.
BROADCAST_BYTES = 32 << 20

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes template svg annotation annotation-xml".split())
_DROP = frozenset("nav footer aside form button select dialog menu object audio video canvas head label fieldset datalist".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var math mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mspace mstyle semantics".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
#: Words that tell of what lies beside an article, and words that may stand with them in a name.
_BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside menu menubar nav navbar navigation topnav subnav breadcrumb breadcrumbs "
    "footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments disqus respond reply replies reviews reactions responses pagination pager toolbar search skip".split()
)
_ALONG = frozenset("area bar block box btn button buttons container content form group header icons inner item items left link links list main media page right row section site slot title top unit widget wrap wrapper".split())
_NEVER = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
_PLAIN = _NEVER | {"article", "p"}
#: Elements nested deeper than this aren't told apart by their path; their text stays.
_DEPTH = 512
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class _Node:
    __slots__ = ("tag", "path", "drop", "link", "own")

    def __init__(self, tag: str, path: str, drop: int, link: bool, own: bool = False):
        self.tag, self.path, self.drop, self.link, self.own = tag, path, drop, link, own


_MARKUP, _NAME = 2, 1


def _excluded(tag: str, names: dict[str, str], inside: bool) -> int:
    """Whether an element isn't part of an article: by markup, by name or not (0). inside: it lies in an article or main element."""
    if tag in _DROP or (tag == "header" and not inside):
        return _MARKUP
    if not names:
        return 0
    if "hidden" in names or names.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", names.get("style", "")):
        return _MARKUP
    if names.get("role", "") in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"):
        return _MARKUP
    if tag in _NEVER:
        return 0
    for name in f"{names.get('class', '')} {names.get('id', '')}".split():
        words = {w.lower() for w in _SPLIT.split(name) if w}
        if (words & _BESIDE and words <= _BESIDE | _ALONG) or (words == {"discussion"} and tag in ("ul", "ol")):
            return _NAME
    return 0


def blocks(page: str) -> tuple[list[tuple[str, str, int, int]], list[tuple[int, str]]]:
    """Text blocks (path, text, characters in links, excluded), and the tokens in page order.

    Tokens: an element's begin (1, path) and end (-1, path), a block (0, its path, a zero and its text)."""
    out: list[tuple[str, str, int, int]] = []
    order: list[tuple[int, str]] = []
    stack = [_Node("", "", 0, False)]
    held: list[str] = []
    where, linked = stack[0], 0

    def close() -> None:
        nonlocal held, linked
        if held and (text := " ".join(_html.unescape("".join(held)).split())):
            out.append((where.path, text, linked, where.drop))
            order.append((0, f"{where.path}\0{text}"))
        held, linked = [], 0

    def end(k: int) -> None:
        order.extend((-1, node.path) for node in reversed(stack[k:]) if node.own)
        del stack[k:]

    def add(text: str) -> None:
        nonlocal where, linked
        top = stack[-1]
        if not held:
            where = next(n for n in reversed(stack) if n.tag not in _INLINE)
            if top.drop and not where.drop:
                where = top
        elif top.drop != where.drop:  # an excluded inline element is a block of its own
            close()
            where = next(n for n in reversed(stack) if n.tag not in _INLINE or n.drop)
        held.append(text)
        if top.link:
            linked += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in _INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        if stack[k].own:
                            if held and where is stack[k]:
                                close()
                            order.append((-1, stack[k].path))
                        del stack[k]
                        break
                    if stack[k].tag not in _INLINE:
                        break
            else:
                close()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        end(k)
                        break
            continue
        if tag in _RAW:
            shut = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = shut.end() if shut else n
            continue
        if tag == "br" or tag in _VOID:
            if tag == "br":
                add(" ")
            elif tag == "hr":
                close()
            continue
        parent = stack[-1]
        if tag not in _INLINE:
            close()
            if tag in _ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        end(k)
                        break
                    if stack[k].tag not in _INLINE:
                        break
            for k in range(len(stack) - 1, 0, -1) if tag in _SAME else ():
                if stack[k].tag == tag or (tag in ("dt", "dd") and stack[k].tag in ("dt", "dd")) or (tag in ("td", "th") and stack[k].tag in ("td", "th")):
                    end(k)
                    break
                if stack[k].tag in _SAME[tag]:
                    break
            parent = stack[-1]
        names = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTR.finditer(m[3])} if m[3] else {}
        inside = "/article" in parent.path or "/main" in parent.path
        drop = max(parent.drop, _excluded(tag, names, inside))
        path = parent.path
        own = (tag not in _INLINE or drop > parent.drop) and len(stack) < _DEPTH
        if own:
            label = re.sub(r"\d{2,}", "0", f"{names.get('class', '')}#{names.get('id', '')}") if names else "#"
            path = f"{path}/{tag.replace('/', '|')}{'.' + label.replace('/', '|') if label != '#' else ''}"
            order.append((1, path))
        if not m[3].endswith("/") or tag not in ("p", "div", "span", "a"):
            stack.append(_Node(tag, path, drop, parent.link or tag == "a", own))
        elif own:
            order.append((-1, path))
    close()
    end(1)
    return out, order


def host_of(url: str):
    """The host named by a column of urls; what names none is its own host."""
    found = F.regexp_extract(url, r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.when(found != "", F.lower(found)).otherwise(F.coalesce(F.col(url), F.lit("")))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 1


_COUNT = pa.schema([("host", pa.string()), ("kind", pa.string()), ("token", pa.int64()), ("path", pa.string()), ("n", pa.int64()), ("v1", pa.int64()), ("v2", pa.int64())])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each token is on a page. Sums of v1 and v2 (31 bits each) stand for its occurrence vector."""
    for b in slices(batches, "html", 1 << 22):
        rows = []
        for pid, host, page in zip(*(b.column(k).to_pylist() for k in ("page_id", "host", "html"))):
            seen: dict[tuple[int, str], int] = defaultdict(int)
            for token in blocks(page or "")[1]:
                seen[token] += 1
            rows.append((host, "page", 0, "", 1, 0, 0))
            part = {n: _hash(f"{pid} {n}") for n in set(seen.values())}
            rows += [(host, "element" if kind else "text", _hash(t), t.split("\0")[0], n, part[n] & 0x7FFFFFFF, part[n] >> 32) for (kind, t), n in seen.items() if kind >= 0]
        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows), _COUNT)], schema=_COUNT)


def classes(tokens: list[dict]) -> list[list[dict]]:
    """Large equivalence classes of a host's tokens, the root class first; an element is two tokens, its begin and its end."""
    found: dict[tuple, list[dict]] = {}
    for t in tokens:
        found.setdefault((t["pages"], t["n"], t["v1"], t["v2"]), []).append(t)
    large = [c for c in found.values() if sum(t["kind"] == "element" for t in c) >= LARGE]
    return sorted(large, key=lambda c: (c[0]["n"] > c[0]["pages"], -c[0]["pages"], -len(c), min(t["path"] for t in c)))


_CLASS = pa.schema([("host", pa.string()), ("tokens", pa.list_(pa.int64())), ("class_of", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for host, tokens in zip(b.column("host").to_pylist(), b.column("tokens").to_pylist()):
            found = classes(tokens)
            sizes = [sum(2 if t["kind"] == "element" else 1 for t in c) for c in found]
            out.append((host, [t["token"] for c in found for t in c], [k for k, c in enumerate(found) for _ in c], sizes))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t.type) for k, t in enumerate(_CLASS)], schema=_CLASS)


def places(page: str, class_of: dict[int, int], sizes: list[int]) -> dict[int, list[int]]:
    """For each of the page's tokens in a class: least and greatest place of its begin among the class, the same of its end, of
    its gap in the root class, then the characters of article-like text right in it (links count against it), all its
    characters and those in links, excluded or not."""
    out: dict[int, list[int]] = {}
    texts, order = blocks(page)
    passed = [0] * len(sizes)
    hashes: dict[str, int] = {}
    inside: list[int] = []
    block = 0
    for kind, name in order:
        token = hashes[name] if name in hashes else hashes.setdefault(name, _hash(name))
        k = class_of.get(token)
        if k is not None:
            place, gap = passed[k] % sizes[k], passed[0] if k else 0
            passed[k] += 1
            row = out.get(token)
            if row is None:
                row = out[token] = [place, place, place, place, gap, gap, 0, 0, 0]
                if kind > 0:
                    row[2:4] = [1 << 30, -1]
            at = 2 if kind < 0 else 0
            row[at], row[at + 1] = min(row[at], place), max(row[at + 1], place)
            row[4], row[5] = min(row[4], gap if kind >= 0 else row[4]), max(row[5], gap if kind >= 0 else row[5])
            if kind > 0:
                inside.append(token)
            elif kind < 0 and token in inside:
                del inside[-1 if inside[-1] == token else max(i for i, x in enumerate(inside) if x == token)]
        if kind == 0:
            _, text, linked, drop = texts[block]
            block += 1
            if inside:
                row = out[inside[-1]]
                row[6] += 0 if drop == _MARKUP else max(0, len(text) - 2 * linked)
                row[7] += len(text)
                row[8] += linked
    return out


_PLACE = pa.schema([("host", pa.string()), ("token", pa.int64())] + [(k, pa.int64()) for k in ("b0", "b1", "e0", "e1", "g0", "g1", "chars", "total", "linked")])
_FOLD = (min, max, min, max, min, max, int.__add__, int.__add__, int.__add__)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html", 1 << 22):
        held: dict[tuple[str, int], list[int]] = {}
        for host, page, tokens, class_of, sizes in zip(*(b.column(k).to_pylist() for k in ("host", "html", "tokens", "class_of", "sizes"))):
            for token, row in places(page or "", dict(zip(tokens, class_of)), sizes).items() if tokens else ():
                old = held.get((host, token))
                held[host, token] = row if old is None else [f(x, y) for f, x, y in zip(_FOLD, old, row)]
        rows = [(h, t, *row) for (h, t), row in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(_PLACE)], schema=_PLACE)


def _last(path: str) -> str:
    return path[path.rfind("/") + 1 :].split(".")[0].split("#")[0]


def _under(path: str, top: str) -> bool:
    return not top or path == top or path.startswith(top + "/")


def _within(path: str, slot: str) -> bool:
    """Whether a block lies in the article's slot; where that is no less than the body, in an article or main element."""
    if re.fullmatch(r"(/(html|body)[^/]*)*", slot):
        return re.search(r"/(article|main)\b", path) is not None
    return _under(path, slot)


def template(tokens: list[dict]) -> tuple[list[str], list[int], list[str]]:
    """Slots of the article (the first is the chosen element), hashes of the template's own text blocks, and elements of the
    slot that go. tokens: those in large classes, with their places."""
    kept = [[t for t in c if t["b0"] == t["b1"] and t["e0"] == t["e1"] and t["g0"] == t["g1"]] for c in classes(tokens)]
    kept = [c for c in kept if sum(t["kind"] == "element" for t in c) >= LARGE]  # ordered on every page, nested in one gap
    single = {t["path"]: t for c in kept for t in c if t["kind"] == "element" and t["n"] == t["pages"]}
    mass, total, linked = ({p: 0 for p in [*single, ""]} for _ in range(3))
    for t in tokens:
        at = t["path"] if t["kind"] == "element" else None
        while at is not None:
            if at in mass:
                mass[at], total[at], linked[at] = mass[at] + t["chars"], total[at] + t["total"], linked[at] + t["linked"]
            at = at[: at.rfind("/")] if at else None
    words = [t for c in kept for t in c if t["kind"] == "text" and t["n"] == t["pages"]]
    constant = {t["path"] for t in words}
    at, heads = "", []
    while _last(at) not in ("article", "main"):
        inner = [p for p in single if p != at and _under(p, at) and mass[p] >= DEEPER * max(1, mass[at])]
        if not inner:
            break
        nearest = min(inner, key=lambda p: (p.count("/"), -mass[p], p))
        heads += [p for p in single if _last(p) == "h1" and _under(p, at) and not _under(p, nearest) and p not in constant and mass[p] > 0]
        at = nearest
    if not at:
        return [], [], []
    body_like = re.fullmatch(r"(/(html|body)[^/]*)*", at) is not None
    alone = [] if body_like else [p for p in single if p != at and _under(p, at) and _last(p) not in _PLAIN and mass[p] < (1 - DEEPER) * mass[at]]
    own = sorted(t["token"] for t in words if not _within(t["path"], at) or any(_under(t["path"], p) for p in alone))
    links = {p for p in alone if linked[p] * 2 > total[p]}
    records = set() if body_like else {min((t["path"] for t in c if t["kind"] == "element"), key=len) for c in kept if c[0]["n"] > c[0]["pages"] and any(t["kind"] == "text" for t in c)}
    return [at, *sorted(set(heads))], own, sorted(links | records)


_TEMPLATE = pa.schema([("host", pa.string()), ("slots", pa.list_(pa.string())), ("own", pa.list_(pa.int64())), ("beside", pa.list_(pa.string()))])


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(h, *template(t)) for h, t in zip(*(b.column(k).to_pylist() for k in ("host", "tokens")))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t.type) for k, t in enumerate(_TEMPLATE)], schema=_TEMPLATE)


def main_text(page: str | None, slots: list[str] = (), own: set[int] = frozenset(), beside: list[str] = ()) -> str:
    texts = [x for x in blocks(page or "")[0] if x[3] != _MARKUP]
    if slots and any(_under(x[0], slots[0]) for x in texts):
        texts = [x for x in texts if any(_under(x[0], s) for s in slots)]
    else:
        marked = [x for x in texts if re.search(r"/(article|main)\b", x[0])]
        if 2 * sum(len(x[1]) for x in marked if not x[3]) >= sum(len(x[1]) for x in texts if not x[3]):
            texts = marked or texts
    texts = [x for x in texts if not any(_under(x[0], s) for s in beside)] if beside else texts
    texts = [x for x in texts if _hash(f"{x[0]}\0{x[1]}") not in own] if own else texts
    plain = [x for x in texts if not x[3]] or [x for x in texts if re.search(r"/(article|main)\b", x[0])]
    return "\n\n".join(x[1] for x in plain)


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html", 1 << 22):
        texts = [main_text(p, s or (), set(o or ()), x or ()) for p, s, o, x in zip(*(b.column(k).to_pylist() for k in ("html", "slots", "own", "beside")))]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_TEXT)


def _by_host(pages: DataFrame, found: DataFrame, hosts: DataFrame, size) -> DataFrame:
    """Pages with what is known of their host."""
    bytes_ = found.agg(F.coalesce(F.sum(size + F.length("host")), F.lit(0))).first()[0]
    if bytes_ <= BROADCAST_BYTES:
        return pages.join(F.broadcast(found), "host", "left")
    above = hot_above(hosts.agg(F.sum("pages")).first()[0])
    return salted_join(pages, hosts.select("host", F.col("pages").alias("_sl_n")).join(found, "host", "left"), ["host"], "_sl_n", hosts.where(F.col("pages") > above), above, "page_id")


def templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, slots, own, beside) of hosts with a template, and (host, pages) of all. pages: with their host."""
    ddl = "host string, kind string, token long, path string, n long, v1 long, v2 long"
    counts = pages.mapInArrow(_counts, ddl).groupBy("host", "kind", "token", "path").agg(F.count("*").alias("pages"), *(F.sum(k).alias(k) for k in ("n", "v1", "v2")))
    counts = materialise(counts, "tokens")
    hosts = counts.where("kind = 'page'").select("host", "pages")
    large = hosts.where(F.col("pages") >= LEAST_PAGES).select("host", F.col("pages").alias("host_pages"))
    # tokens on half of the pages at least: twice a page's tokens at most, however many pages a host has
    common = materialise(counts.where("kind <> 'page'").join(large, "host").where(F.col("pages") >= SHARE * F.col("host_pages")).drop("host_pages"), "common")
    lists = common.groupBy("host").agg(F.collect_list(F.struct("kind", "token", "path", "pages", "n", "v1", "v2")).alias("tokens"))
    found = materialise(lists.mapInArrow(_classes, "host string, tokens array<long>, class_of array<int>, sizes array<int>"), "classes")
    size = 12 * F.size("tokens") + 4 * F.size("sizes")
    rows = _by_host(pages, found, hosts, size).select("host", "html", "tokens", "class_of", "sizes")
    sums = [f(k).alias(k) for k, f in zip(("b0", "b1", "e0", "e1", "g0", "g1", "chars", "total", "linked"), (F.min, F.max) * 3 + (F.sum,) * 3)]
    placed = rows.mapInArrow(_places, "host string, token long, b0 long, b1 long, e0 long, e1 long, g0 long, g1 long, chars long, total long, linked long").groupBy("host", "token").agg(*sums)
    tested = common.join(placed, ["host", "token"])
    lists = tested.groupBy("host").agg(F.collect_list(F.struct(*(c for c in tested.columns if c != "host"))).alias("tokens"))
    made = materialise(lists.mapInArrow(_templates, "host string, slots array<string>, own array<long>, beside array<string>"), "templates")
    hosts = materialise(hosts, "hosts")
    for df in (counts, common, found):
        release(df)
    return made, hosts


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.withColumn("host", host_of("url"))
    found, hosts = templates(pages)
    size = F.length(F.concat_ws("", "slots")) + 8 * F.size("own") + F.length(F.concat_ws("", "beside"))
    joined = _by_host(pages, found, hosts, size)
    return joined.select("page_id", "url", "html", "slots", "own", "beside").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
