"""Main text of web pages by wrapper induction: simple tree matching finds the slots of a host's pages, and what varies in them.

1. A page becomes a tree of its block elements, with its lines of text as leaves. Inline elements
   belong to their line, and no part of a line is ever template by itself.
2. The trees of a few pages of a host (REFERENCES of them, chosen by hash, so a bounded sample) are
   matched and merged into its wrapper. It gives slots and says nothing yet of template.
3. Every page of the host is matched with the wrapper. A line's slot is that of the wrapper's line it is
   matched with; a line without a partner has the slot of its nearest matched ancestor and the tags
   below it, so that template which no reference has is found as well.
4. The pages that have a text in a slot are counted, all of them; pages of a host with the same main
   part, or the same lines where none is marked, count as one. A line is template when half of the
   host's pages have its text in its slot, and at least three (both, where a host has two); inside
   an article or main part two pages are no evidence. Lines of varying slots are content.

Tags choose within what varies. Marked-up furniture (navigation, forms, scripts) is never content, but
for a form that holds most of its page. A class, id or role that says menu, advert, comments and the
like is evidence only with another: lines that the host shares, or mostly links; on a page that is
alone on its host it counts by itself, but not for articles, sections, tables and paragraphs. Where a
page marks its article or main part, the text comes from there; elsewhere all lines that vary are
taken, without those that are mostly links, paragraphs and headings excepted.

Counts are made in two steps, by page and by host, each with sums made before the shuffle. Pages move
to the wrapper of their host once for each of the two passes. A host may hold a third of all
pages: Spark splits its share of the join, as each page needs the wrapper alone.

Cases: null html is an empty text, a null url a host of its own; pages that are alone on their host
have no template; an article whose lines are all shared stays whole; repeated rows give repeated
results; broken markup is read as far as it goes; pages of any length and depth are matched exactly;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tree_match as M
from .store import written

#: Pages of a host from which its wrapper is built.
REFERENCES = 4
#: Pages that must share a line, where the host has as many.
LEAST_PAGES = 3
#: Sizes of matchings that are kept for a host.
MEMO = 1 << 17

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>""", re.S)
_CUE = re.compile(r"""(?<![^\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[a-z]+")
#: Elements without an end tag, elements whose content is no markup, furniture by tag, and block elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_FURNITURE = frozenset("head nav footer aside form button select dialog menu object video audio canvas map fieldset".split()) | _RAW
_CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th figcaption dd dt".split())
_BLOCK = _CONTENT | frozenset("html body div article section main header footer nav aside ul ol table thead tbody tfoot tr figure dl hr form address details summary center fieldset".split())
_CUES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu navbar navigation nav topnav sidebar footer copyright cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup comment comments disqus replies respond share sharing social breadcrumb breadcrumbs related recommended recommendations widget login search pagination pager toolbar masthead contentinfo complementary".split()
)
#: What stands in a head; anything else ends it.
_HEAD = frozenset("title meta link style script base noscript template head".split())
#: Blocks that stay though they are mostly links.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Elements that a cue alone never makes furniture.
_TEXT = _CONTENT | frozenset("article main section table".split())
#: Start tags that end an open element of the same group.
_CLOSES = {**{t: ("p",) for t in _BLOCK}, "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("td", "th", "tr", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
_STOPS = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",)}


def _named(above: bytes, text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8, key=above).digest()


def _number(name: bytes) -> int:
    return int.from_bytes(name, "little", signed=True)


class Node:
    __slots__ = ("tag", "cues", "parts", "block", "lines", "wide")

    def __init__(self, tag: str, cues: frozenset[str] = frozenset()):
        self.tag, self.cues = tag, cues
        self.parts: list = []  # strings and nodes in page order
        #: Of block elements: the node of the outline, and its lines by the number of blocks before them.
        self.block: M.Block | None = None
        self.lines: dict[int, M.Block] = {}
        #: A form that holds most of its page.
        self.wide = False

    def nodes(self) -> list[Node]:
        return [x for x in self.parts if type(x) is Node]


def _cues(attributes: str) -> frozenset[str]:
    """The names in class, id and role that are made up of cue words and nothing else."""
    if "=" not in attributes:
        return frozenset()
    names = (n for value in _CUE.findall(attributes) for n in value.strip("\"'").lower().split())
    return frozenset(n for n in names if (words := _PART.findall(n)) and _CUES.issuperset(words))


class _Open:
    """The open elements, innermost last, with the places of each tag."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        self.stack.append(node)

    def close(self, tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        """Ends the innermost open element of `tags`, and all in it; with `stops`, the outermost that no element of them holds apart."""
        own = [self.places[t] for t in tags if self.places.get(t)]
        if not own:
            return
        if stops:
            floor = max((p[-1] for t in stops if (p := self.places.get(t))), default=0)
            found = min((p[k] for p in own if (k := bisect_right(p, floor)) < len(p)), default=None)
        else:
            found = max(p[-1] for p in own)
        if found is not None:
            for node in self.stack[found:]:
                self.places[node.tag].pop()
            del self.stack[found:]


def parse(source: str) -> Node:
    """The tree of a page, however deep."""
    root = Node("html")
    opened, at = _Open(root), 0
    stack, find, last = opened.stack, _MARKUP.search, source.rfind(">")
    while at <= last and (match := find(source, at)):
        if match.start() > at:
            stack[-1].parts.append(source[at : match.start()])
        at = match.end()
        if not match[2]:
            continue
        tag = match[2].lower()
        if match[1]:
            opened.close((tag,), ())
            continue
        if tag not in _HEAD:
            opened.close(("head",), ())
        if tag in ("html", "body"):
            continue
        if tag in _CLOSES:
            opened.close(_CLOSES[tag], _STOPS.get(tag, ()))
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        node = Node(tag, _cues(match[3]))
        stack[-1].parts.append(node)
        if tag not in _VOID and not match[3].endswith("/"):
            opened.push(node)
    stack[-1].parts.append(source[at:])
    return root


def _words(pieces: list[str]) -> str:
    return " ".join(html.unescape("".join(pieces)).split())


def outline(page: Node) -> M.Block:
    """The tree of a page's blocks and lines; each block element of the page knows its own."""
    page.block = root = M.Block(page.tag)
    pieces: list[str] = []
    here, n_blocks, before, forms = page, 0, 0, []

    def done() -> None:
        if pieces and (text := _words(pieces)):
            here.lines[n_blocks] = line = M.Block(M.LINE, _number(_named(b"", text)))
            here.block.kids.append(line)
        pieces.clear()

    todo: list = list(reversed(page.parts))
    while todo:
        one = todo.pop()
        if type(one) is str:
            pieces.append(one)
            before += len(one)
        elif type(one) is tuple:  # the end of a block
            done()
            if here.tag == "form":
                forms.append((here, before - one[2]))
            here, n_blocks = one[:2]
        else:
            if one.tag == "br":
                pieces.append(" ")
            if one.tag in _BLOCK:
                done()
                one.block = M.Block(one.tag)
                here.block.kids.append(one.block)
                todo.append((here, n_blocks + 1, before))
                here, n_blocks = one, 0
            todo += reversed(one.parts)
    done()
    for form, size in forms:
        form.wide = 2 * size > before
    M.settled(root)
    return root


def give_slots(root: M.Block, wrapper: M.Block | None, memo: dict) -> None:
    """Names the slot of each block and line by the wrapper's node it is matched with, or by the tags below one that is."""
    todo: list[tuple[M.Block, M.Block | None]] = [(root, wrapper)]
    if wrapper is not None:
        root.slot = wrapper.slot
    while todo:
        own, other = todo.pop()
        partner = dict(M.aligned(own.kids, other.kids, memo)) if other is not None and own.kids and other.kids else {}
        for k, kid in enumerate(own.kids):
            match = other.kids[partner[k]] if k in partner else None
            kid.slot = match.slot if match is not None else _named(own.slot, kid.tag)
            if kid.kids:
                todo.append((kid, match))


def _mostly_links(node: Node) -> bool:
    size = linked = 0
    todo: list[tuple[object, bool]] = [(node, False)]
    while todo:
        one, in_link = todo.pop()
        if type(one) is str:
            n = len("".join(one.split()))
            size += n
            linked += n if in_link else 0
        else:
            todo += [(x, in_link or one.tag == "a") for x in one.parts]
    return 2 * linked > size


def _is_furniture(node: Node, inside: bool, alone: bool) -> bool:
    """By tag, or by a cue that goes with links; only `alone`, where no other page tells template, by the cue of an element that is no text."""
    if node.tag in _FURNITURE and not node.wide or node.tag == "header" and not inside:
        return True
    return bool(node.cues) and node.tag not in ("article", "main") and (alone and node.tag not in _TEXT or _mostly_links(node))


def _main_parts(page: Node) -> list[Node]:
    """The outermost article and main elements: those outside marked-up furniture, or all where no other has text."""
    clear, other, todo = [], [], [(page, False)]
    while todo:
        node, marked = todo.pop()
        if node is not page:
            marked = marked or node.tag in _FURNITURE and not node.wide or node.tag == "header" or bool(node.cues) and node.tag != "main"
        if node.tag in ("article", "main"):
            (other if marked else clear).append(node)
        else:
            todo += [(x, marked) for x in reversed(node.nodes())]
    return clear if any(True for part in clear for _ in _lines(part, True)) else clear + other


def _lines(root: Node, inside: bool, without: list[Node] = (), alone: bool = False) -> Iterator[tuple[bytes, str, int]]:
    """(slot, text, characters in links) of each line under `root`, in page order; nodes of `without` are left out.

    In paragraphs and headings links count as text.
    """
    pieces: list[str] = []
    linked = 0
    here, n_blocks = root, 0

    def done() -> Iterator[tuple[bytes, str, int]]:
        nonlocal linked
        if pieces and (text := _words(pieces)):
            yield here.lines[n_blocks].slot, text, 0 if here.tag in _PROSE else linked
        pieces.clear()
        linked = 0

    left_out = set(map(id, without))
    todo: list[tuple[object, object]] = [(x, root.tag == "a") for x in reversed(root.parts)]
    while todo:
        one, in_link = todo.pop()
        if type(one) is str:
            pieces.append(one)
            linked += len(one) if in_link else 0
        elif one is None:  # the end of a block
            yield from done()
            here, n_blocks = in_link
        elif id(one) in left_out or _is_furniture(one, inside, alone):
            if one.tag in _BLOCK:
                yield from done()
                n_blocks += 1
        else:
            if one.tag == "br":
                pieces.append(" ")
            if one.tag in _BLOCK:
                yield from done()
                todo.append((None, (here, n_blocks + 1)))
                here, n_blocks = one, 0
            link = in_link or one.tag == "a"
            todo += [(x, link) for x in reversed(one.parts)]
    yield from done()


def _signature(slot: bytes, text: str) -> int:
    return _number(_named(slot, text))


def slotted(source: str, wrapper: M.Block | None = None, memo: dict | None = None) -> Node:
    """A page whose blocks and lines have their slots."""
    page = parse(source)
    give_slots(outline(page), wrapper, {} if memo is None else memo)
    return page


def signatures(page: Node) -> tuple[int, set[int]]:
    """A name for the lines of a page's main parts, or of what is around them where there are none; and the signatures of all its lines."""
    parts = _main_parts(page)
    main = [x for part in parts for x in _lines(part, True)]
    around = list(_lines(page, False, parts))
    name = hash(tuple(sorted({_number(_named(b"", text)) for _, text, _ in main or around})))  # of integers: the same in every process
    return name, {_signature(slot, text) for slot, text, _ in (*main, *around)}


def main_text(page: Node, template: frozenset[int] = frozenset(), n_pages: int = 1) -> str:
    """The lines of the main text; template: the signatures that `n_pages` pages of the host share."""
    alone = n_pages == 1
    parts = _main_parts(page)
    whole = [(_signature(slot, text), text) for part in parts for slot, text, _ in _lines(part, True, alone=alone)]
    lines = [text for sign, text in whole if n_pages < LEAST_PAGES or sign not in template]
    if whole and not lines:  # nothing tells this article from others: it stays
        lines = [text for _, text in whole]
    if not whole:
        lines = [text for slot, text, linked in _lines(page, False, alone=alone) if 2 * linked <= len(text) and _signature(slot, text) not in template]
    return "\n".join(lines)


def wrapper_of(sources: list[str]) -> M.Block:
    """The wrapper of a few pages of one host."""
    return M.numbered(M.merged([outline(parse(x)) for x in sources]))


def _wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [zlib.compress(json.dumps(M.flat(wrapper_of(x.as_py()))).encode()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["host", "wrapper"])


class _Hosts:
    """The wrapper of the present host; pages of a host come together."""

    def __init__(self) -> None:
        self.packed, self.wrapper, self.memo = None, None, {}

    def page(self, source: str | None, packed: bytes | None) -> Node:
        if packed != self.packed or len(self.memo) > MEMO:
            self.packed, self.memo = packed, {}
            self.wrapper = M.unflat(*json.loads(zlib.decompress(packed))) if packed else None
        return slotted(source or "", self.wrapper, self.memo)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, signatures) of each page with lines."""
    hosts = _Hosts()
    for batch in batches:
        rows = []
        for host, source, packed in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4), strict=True):
            name, signs = signatures(hosts.page(source.as_py(), packed.as_py()))
            if signs:
                rows.append((host, name, sorted(signs)))
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["host", "page", "signs"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hosts = _Hosts()
    for batch in batches:
        rows = []
        for k, (page_id, url) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            source, packed, n_pages, template = (batch.column(c)[k].as_py() for c in (3, 4, 5, 6))
            text = main_text(hosts.page(source, packed), frozenset(template or ()), n_pages or 1)
            rows.append((page_id, url, text, len(text)))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "url", "text", "n_chars"])


def wrappers(pages: DataFrame, references: int = REFERENCES) -> DataFrame:
    """(host, wrapper) of each host of `pages` (host, html) with several pages that differ."""
    chosen = F.xxhash64("html").alias("hash")
    # The page with the smallest hash of each class of hashes.
    own = pages.where("html IS NOT NULL").groupBy("host", F.pmod(chosen, F.lit(references)).alias("class")).agg(F.min(F.struct(chosen, "html")).alias("x"), F.max(chosen).alias("last"))
    own = own.groupBy("host").agg(F.array_sort(F.collect_list("x")).alias("x"), F.max("last").alias("last")).where((F.size("x") > 1) | (F.col("last") != F.col("x")[0]["hash"]))
    return own.select("host", F.col("x.html").alias("sources")).mapInArrow(_wrapped, "host string, wrapper binary")


def templates(signed: DataFrame) -> DataFrame:
    """(host, n_pages, template) of each host with several pages that differ: the signatures that enough of them have."""
    signed = written(signed.groupBy("host", "page").agg(F.min("signs").alias("signs")), "signatures")
    several = signed.groupBy("host").agg(F.count("*").alias("n_pages")).where("n_pages > 1")
    shared = signed.select("host", F.explode("signs").alias("sign")).groupBy("host", "sign").agg(F.count("*").alias("n")).where("n > 1")
    least = F.greatest(F.ceil(F.col("n_pages") / 2), F.least("n_pages", F.lit(LEAST_PAGES).cast("long")))
    # At most twice as many signatures of a host as its pages have lines on average.
    return several.join(shared, "host", "left").groupBy("host", "n_pages").agg(F.collect_list(F.when(F.col("n") >= least, F.col("sign"))).alias("template"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", references: int = REFERENCES) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of `pages`."""
    host = F.lower(F.regexp_extract(F.coalesce(pages[url_col], F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    pages = pages.select(host.alias("host"), pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    own = written(wrappers(pages, references), "wrappers")
    # A merge join in both passes, so that a host with very many pages is split.
    signed = pages.join(own.hint("shuffle_merge"), "host", "left").mapInArrow(_signed, "host string, page long, signs array<long>")
    known = written(templates(signed).join(own, "host", "left"), "templates")
    found = pages.join(known.hint("shuffle_merge"), "host", "left").select("host", "page_id", "url", "html", "wrapper", "n_pages", "template")
    return found.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
