"""Main text of web pages by wrappers: union-free regular expressions over the token streams of a host's pages.

A page's stream (tags and texts; inline tags, comments, scripts and styles left out, implied end tags put in) is an expression already: elements with an
expression each, and text slots. Expressions of one host are aligned one after another: what both hold at a place is aligned within, what
only one holds becomes optional, neighbours of one label become one repeated element, neighbouring runs of several labels a repeated group. What the pages of a
slot hold is summed on the way: pages, characters, characters in links, and whether all texts are equal. A task aligns what it reads, then tasks' wrappers of a host are
aligned by FAN at a time, so that a host of any size needs no large task.

The wrapper says which slots are main text. Menus, headers, footers, sidebars, notices, adverts, forms and comments, told by element, role or name, are none. Of
the rest those in an article are, or else those in a main element, or else those in the element whose own slots hold most text out of links over the host's pages, less slots of links and,
on hosts of varied pages, slots of one constant text that is no heading. A page is aligned with its host's wrapper, and the texts in main slots are its blocks. In an article's own header
headings are main text.

Defined cases: null and empty pages give an empty text; pages without a host in their url are one host; markup that is cut off or badly nested is read as browsers do: what is
open ends where the page, the parent or a follower that cannot be within it begins; each of equal rows is a page; an empty table gives no rows;
other columns are not read. Pages of any length are taken whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from html import unescape
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligo.llm.common import cut

FAN = 64
HELD = 5000  # expressions that a task holds before it hands them on
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(?:>|\Z)|<!--.*?(?:-->|\Z)|<(?:[!?]|/(?=[^a-zA-Z]))[^>]*+(?:>|\Z)""", re.DOTALL)
NAMED = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
VOID = frozenset("area base basefont bgsound col embed frame hr img input link meta param source track".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
# an element that begins ends these, up to one of the last
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split()
)
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **{k: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}) for k in ("thead", "tbody", "tfoot")},
    **{h: ({"h1", "h2", "h3", "h4", "h5", "h6"}, None) for h in ("h1", "h2", "h3", "h4", "h5", "h6")},
}
SCOPE = frozenset("table td th caption object template html".split())
NO_TEXT = frozenset("nav footer aside form button select datalist noscript template svg math canvas audio video object dialog menu head fieldset applet".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar form".split())
NO_NAME = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert alerts nav navbar navigation menu menus
    breadcrumb breadcrumbs sidebar widget widgets footer masthead topbar toolbar comment comments commentlist reply replies respond disqus discussion social share sharing sharebar related recommended
    recommendations newsletter subscribe subscription signup login search popup modal overlay pagination pager paywall copyright""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
GROUP = 4  # labels of a repeated group at most
WIDE = 64  # children of an element at most, beyond which they become one repeated group of optional elements
DEEP = 150  # elements within each other; deeper ones count as parts of the last


class Node:
    """An element, group or slot of an expression. `held` is what it stands for: blocks of a page, or sums over pages."""

    __slots__ = ("label", "optional", "repeated", "held", "children")

    def __init__(self, label, held, children=None, optional=False, repeated=False):
        self.label, self.held, self.children, self.optional, self.repeated = label, held, children or [], optional, repeated

    def told(self):
        """As lists, for JSON."""
        return [self.label, int(self.optional) + 2 * int(self.repeated), self.held, [c.told() for c in self.children]]

    @staticmethod
    def read(x):
        return Node(x[0], x[2], [Node.read(c) for c in x[3]], bool(x[1] & 1), bool(x[1] & 2))

    def shape(self) -> str:
        inner = "".join([c.shape() for c in self.children])
        return f"{self.label}{'*' if self.repeated else ''}{'?' if self.optional else ''}" + (f"({inner})" if inner else ";")


def folded(children: list[Node], groups: set[tuple[str, ...]], join) -> list[Node]:
    """Neighbours of one label become one repeated element; neighbours that spell a group, known or met twice in a row, become one repeated group."""
    out: list[Node] = []
    for c in children:
        if out and out[-1].label == c.label:
            one = out[-1] = aligned(out[-1], c, join)
            one.repeated = True
        else:
            out.append(c)
    labels, groups = [c.label for c in out], set(groups)
    for size in range(2, GROUP + 1):
        done: list[Node] = []
        at = 0
        while at < len(out):
            run = tuple(labels[at : at + size])
            if len(run) == size and len(set(run)) == size and (run in groups or run == tuple(labels[at + size : at + 2 * size])):
                groups.add(run)
                name = "(" + " ".join(run) + ")"
                new = Node(name, join(None, None), out[at : at + size])
                if done and done[-1].label == name:
                    new = aligned(done[-1], new, join)
                    new.repeated = True
                    done[-1] = new
                else:
                    done.append(new)
                at += size
            else:
                done.append(out[at])
                at += 1
        out, labels = done, [c.label for c in done]
    return starred(out, join) if len(out) > WIDE else out


def starred(children: list[Node], join) -> list[Node]:
    """One repeated group in which each label is optional, for children in any order and number."""
    by_label: dict[str, Node] = {}
    for c in children:
        for one in c.children if c.label == "{}" else [c]:
            one = Node(one.label, one.held, one.children, True, True)
            by_label[one.label] = aligned(by_label[one.label], one, join) if one.label in by_label else one
    return [Node("{}", join(None, None), [by_label[k] for k in sorted(by_label)], repeated=True)]


def groups_of(children: list[Node]) -> set[tuple[str, ...]]:
    return {tuple(c.label[1:-1].split(" ")) for c in children if c.label[0] == "("}


def aligned(a: Node, b: Node, join) -> Node:
    """One expression for what both of one label stand for."""
    held, optional, repeated = join(a.held, b.held), a.optional or b.optional, a.repeated or b.repeated
    x, y = a.children, b.children
    if [c.label for c in x] == [c.label for c in y]:
        return Node(a.label, held, [aligned(c, d, join) for c, d in zip(x, y, strict=True)], optional, repeated)
    if any(c.label == "{}" for c in (*x, *y)):
        return Node(a.label, held, starred([*x, *y], join), optional, repeated)
    groups = groups_of(x) | groups_of(y)
    if groups:
        x, y = folded(x, groups, join), folded(y, groups, join)
    out: list[Node] = []
    for op, i, i2, j, j2 in SequenceMatcher(None, [c.label for c in x], [c.label for c in y], False).get_opcodes():
        if op == "equal":
            out += [aligned(c, d, join) for c, d in zip(x[i:i2], y[j:j2], strict=True)]
        else:
            for c in (*x[i:i2], *y[j:j2]):
                out.append(Node(c.label, c.held, c.children, True, c.repeated))
    return Node(a.label, held, folded(out, groups, join), optional, repeated)


def put_together(a, b):
    """Blocks of a page that one place holds."""
    return (a or []) + (b or [])


def summed(a, b):
    """[pages, characters, characters in links, least and greatest hash of a text]."""
    if a is None or b is None:
        return a or b or [0, 0, 0, 2**32, -1]
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4])]


def label(name: str, attributes: str) -> str:
    """An element's name, with `!` if it holds no main text, `h` if only headings, and its classes that have no digit."""
    if not attributes.strip():
        return f"{name}!" if name in NO_TEXT else f"{name}^" if name == "header" else name
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in NAMED.finditer(attributes)}
    classes = sorted({c for c in got.get("class", "").split() if not any(x.isdigit() for x in c)})
    head, no = name == "header", name in NO_TEXT or got.get("role", "").lower() in NO_ROLE or "hidden" in got or "display:none" in got.get("style", "").replace(" ", "").lower()
    if name not in ("html", "body", "main"):
        for text in (*got.get("class", "").split(), got.get("id", "")):
            words = [w.lower() for w in WORD.findall(text)]
            for k, w in enumerate(words):
                if not (k and words[k - 1] in ("has", "no", "with", "without", "is")):
                    no, head = no or w in NO_NAME, head or w == "header"
    main = "+" if got.get("role", "").lower() == "main" else ""
    return name + ("!" if no else "^" if head else "") + main + "".join(f".{re.sub(r'[^a-zA-Z_-]', '', c)}" for c in classes)


def parsed(page: str) -> tuple[Node, list[tuple[str, int]]]:
    """The page's expression, whose slots hold numbers of blocks, and the blocks: text, and characters in links."""
    root = Node("page", [])
    stack, names, blocks, deeper = [root], ["page"], [], []
    text: list[str] = []
    link, links, at = False, 0, 0

    def end_block():
        nonlocal links
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                stack[-1].children.append(Node("#", [len(blocks)]))
                blocks.append((whole, min(links, len(whole))))
            text.clear()
        links = 0

    def pop():
        end_block()
        node = stack.pop()
        names.pop()
        node.children = folded(node.children, set(), put_together) if len(node.children) > 1 else node.children
        siblings = stack[-1].children
        if len(siblings) > 1 and siblings[-2].label == node.label:  # folds at once what a long list repeats
            siblings.pop()
            one = siblings[-1] = aligned(siblings[-1], node, put_together)
            one.repeated = True

    def close(wanted, limit):
        """End the nearest of the wanted elements, unless one of the limits is nearer."""
        for k in range(len(names) - 1, 0, -1):
            if names[k] in wanted:
                while len(names) > k:
                    pop()
                return
            if names[k] in limit:
                return

    while True:
        m = TAG.search(page, at)
        part = page[at : m.start()] if m else page[at:]
        if part:
            part = unescape(part) if "&" in part else part
            text.append(part)
            links += len(part) if link else 0
        if not m:
            break
        at = m.end()
        name = m[2].lower() if m[2] else None
        if not name:
            continue
        if name in INLINE:
            if name == "a":
                link = not m[1]
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in RAW and not m[1]:
            end = CLOSE[name].search(page, at)
            at = end.start() if end else len(page)
            continue
        if name in VOID and name != "hr" or name in RAW:
            continue
        if m[1]:
            if name in deeper:
                while deeper.pop() != name:
                    pass
            elif name in names:
                link = False
                close({name}, SCOPE - {name} if name != "li" else {"ul", "ol", *SCOPE})
            continue
        link = False
        end_block()
        if name in ENDS_P and "p" in names:
            close({"p"}, SCOPE)
        if name in SIBLINGS:
            wanted, limit = SIBLINGS[name]
            if limit is None:
                if names[-1] in wanted:
                    pop()
            else:
                while any(n in wanted for n in names[max((k for k, n in enumerate(names) if n in limit), default=0) + 1 :]):
                    close(wanted, limit)
        if name == "hr":
            continue
        if len(stack) > DEEP:
            deeper.append(name)
            continue
        deeper.clear()
        node = Node(label(name, m[3]), [])
        stack[-1].children.append(node)
        stack.append(node)
        names.append(name)
        if m[3].endswith("/") and name in ("svg", "math"):
            pop()
    end_block()
    while len(stack) > 1:
        pop()
    root.children = folded(root.children, set(), put_together)
    return root, blocks


def with_sums(node: Node, blocks: list[tuple[str, int]]) -> Node:
    """The expression with sums over the page in place of block numbers."""
    held = [1 if node.label == "page" else 0, 0, 0, 2**32, -1]
    for b in node.held or ():
        text, links = blocks[b]
        h = crc32(text.encode())
        held = summed(held, [1, len(text), links, h, h])
    return Node(node.label, held, [with_sums(c, blocks) for c in node.children], node.optional, node.repeated)


def name(n: Node) -> str:
    return re.match(r"[^!^+.]*", n.label)[0]


def level(n: Node, over: int) -> int:
    """How sure text within an element is main text by its name, or by those over it."""
    return over if n.label[0] in "({" else max(over, 3 if name(n) == "article" else 2 if name(n) == "main" or "+" in n.label.split(".")[0] else 0)


def judged(wrapper: Node) -> Node:
    """The wrapper with, for each slot, how sure it is main text in place of its sums: 3 in an article, 2 in a main element, 1 by density, else 0; elements have what is so of slots not met in them."""
    pages = wrapper.held[0]

    def passes(n: Node, only_headings: bool) -> tuple[bool, bool]:
        if n.label[0] in "({":
            return False, only_headings
        mark = n.label.split(".")[0]
        return "!" in mark, (only_headings or "^" in mark) and name(n) not in HEADINGS

    found: list[tuple[int, int]] = []

    def weigh(n: Node, dropped: bool, headings: bool, number: list[int]) -> int:
        """Text out of links in the element's own slots and in those of its children without elements within."""
        number[0] += 1
        me = number[0]
        no, headings = passes(n, headings)
        dropped = dropped or no
        own = 0
        for c in n.children:
            if c.label == "#":
                own += 0 if dropped or headings else score(c)
                number[0] += 1
            else:
                inner = weigh(c, dropped, headings, number)
                own += inner if all(g.label == "#" for g in c.children) or c.label[0] in "({" else 0
        found.append((own, -me))
        return own

    def constant(c: Node) -> bool:
        return pages > 2 and c.held[0] > 2 and c.held[3] == c.held[4]

    def score(c: Node) -> int:
        return 0 if constant(c) and varied else max(0, c.held[1] - 3 * c.held[2])

    varied = any(c.held[0] > 2 and c.held[3] != c.held[4] for c in _slots(wrapper))
    weigh(wrapper, False, False, [0])
    best, densest = max(found)

    def told(n: Node, over: int, dropped: bool, headings: bool, dense: bool, number: list[int]) -> Node:
        number[0] += 1
        dense = dense or (best > 0 and number[0] == -densest)
        no, only = passes(n, headings)
        over, out = level(n, over), []
        dropped = dropped or no or only and not over and not dense  # the header of the page and not of its text
        for c in n.children:
            if c.label == "#":
                number[0] += 1
                plain = dense and 2 * c.held[2] <= c.held[1] and not (varied and constant(c) and name(n) not in HEADINGS)
                out.append(Node("#", 0 if dropped or only else over or int(plain), [], c.optional, c.repeated))
            else:
                out.append(told(c, over, dropped, only, dense, number))
        return Node(n.label, 0 if dropped or only else over or int(dense), out, n.optional, n.repeated)

    return told(wrapper, 0, False, False, False, [0])


def levels(page: Node, wrapper: Node, n_blocks: int) -> list[int]:
    """How sure each block of a page is main text, by the slot of the wrapper that it is aligned with."""
    out = [0] * n_blocks

    def both(a, b):  # a page's blocks go along with a slot's level
        return (a or b) if a is None or b is None else [a[0] + b[0], max(a[1], b[1])]

    def tagged(n: Node, page_side: bool) -> Node:
        held = [list(n.held or ()), -1] if page_side else [[], n.held]
        return Node(n.label, held, [tagged(c, page_side) for c in n.children], n.optional, n.repeated)

    def spread(n: Node, over: int) -> None:  # what found no place in the wrapper goes by what it is in
        sure = n.held[1] if n.held else -1
        if sure < 0:
            mark = n.label.split(".")[0]
            sure = over if n.label[0] in "#({" else 0 if "!" in mark or "^" in mark else level(n, over)
        for b in n.held[0] if n.held else ():
            out[b] = sure
        for c in n.children:
            spread(c, sure)

    spread(aligned(tagged(wrapper, False), tagged(page, True), both), 0)
    return out


def _slots(n: Node) -> Iterator[Node]:
    for c in n.children:
        yield from [c] if c.label == "#" else _slots(c)


def host() -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame, fan: int = FAN) -> DataFrame:
    """(host, wrapper): the expression of all pages of each host, as JSON, with sums."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], Node] = {}

        def tell() -> pd.DataFrame:
            by_host: dict[str, Node] = {}
            for (name, _), node in sorted(held.items()):
                by_host[name] = aligned(by_host[name], node, summed) if name in by_host else node
            held.clear()
            return pd.DataFrame({"host": list(by_host), "wrapper": [json.dumps(w.told()) for w in by_host.values()]})

        for batch in batches:
            for name, page in zip(batch["host"], batch["html"], strict=True):
                node = with_sums(*parsed(page))
                key = name, node.shape()
                held[key] = aligned(held[key], node, summed) if key in held else node
                if len(held) >= HELD:
                    yield tell()
        if held:
            yield tell()

    def align(group: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for text in sorted(group["wrapper"]):
            one = Node.read(json.loads(text))
            whole = one if whole is None else aligned(whole, one, summed)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(whole.told())]})

    rows = cut(pages.mapInPandas(read, "host string, wrapper string"), "wrappers")
    most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        parts = max(1, -(-most // fan))
        salt = F.pmod(F.xxhash64("wrapper"), F.lit(parts))
        rows = cut(rows.groupBy("host", salt.alias("salt")).applyInPandas(align, "host string, wrapper string"), "wrappers")
        most = rows.groupBy("host").count().agg(F.max("count")).first()[0]
    return rows


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host().alias("host"))
    known = wrappers(rows.select("host", "html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judgements: dict[str, Node] = {}
        seen: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            texts = []
            for name, page, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper")), strict=True):
                if len(seen) > HELD or len(judgements) > HELD:
                    seen, judgements = {}, {}
                if name not in judgements:
                    judgements[name] = judged(Node.read(json.loads(wrapper)))
                node, blocks = parsed(page)
                slot_of, n_slots = [0] * len(blocks), 0
                for n_slots, n in enumerate(_slots(node), 1):  # pages of one shape share a judgement of their slots
                    for b in n.held:
                        slot_of[b] = n_slots - 1
                    n.held = [n_slots - 1]
                key = name, node.shape()
                if key not in seen:
                    seen[key] = levels(node, judgements[name], n_slots)
                sure = [seen[key][s] for s in slot_of]
                most = max(sure, default=0)
                texts.append("\n".join(t for (t, _), s in zip(blocks, sure, strict=True) if most and s == most))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return rows.join(known, "host").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
