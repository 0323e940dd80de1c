"""Main text of pages by wrappers that are inferred per host.

A wrapper is a union-free regular expression over a page's tokens: tags, fixed
texts, text slots, optional groups and repeated groups. It begins as one page,
in which neighbouring equal runs are folded into a repeated group, and is
aligned with the other pages of the host one by one: texts that differ become a
slot, tags that only one side has become an optional group, a run that one side
has more often becomes a repeated group. Every page takes part: tasks infer
wrappers of their own pages, and these are aligned ``FAN_IN`` partitions at a
time until a host has one, so a host with most pages is not one task.

The wrapper tells which element holds the article: an ``article`` or ``main``
element with slots, else the innermost element that has most of the slots' text
outside of links. What lies around that element is template, whatever its
classes are called. Inside, texts that are the same on every page are template,
and where no tag names the article also elements without slots and those whose
text is nearly all links. Tags of menus, forms and the like are left out; of
class names, only those that say so by themselves; others decide where the
wrapper knows nothing. A fixed text that is one of a repeated group, such as a last
paragraph, is text: the group's texts are one slot.
"""

from __future__ import annotations

import html as html_entities
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import Match, SequenceMatcher
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelog.llm.sizes import give_back, measured
from devicelog.session import written

#: Partitions whose wrappers of a host are aligned in one step.
FAN_IN = 16
#: Nodes held by a task before it hands its wrappers on.
HELD_NODES = 200_000
#: Different pages that must share a text before it counts as template.
LEAST_PAGES = 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
_LEFT_OUT = frozenset("head nav header footer aside form button select option dialog menu".split()) | _RAW
_ROOTS = ("article", "main")
#: Names that are a class by themselves, its last part, or (the unambiguous ones) its first part.
_CLEAR = (
    r"ads?|advert\w*|adsense|sponsor\w*|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|comments?|sidebar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|share|sharing|social|related|recommend\w*|pagination|pager|login|signup|copyright|toolbar"
)
_VAGUE = r"promo\w*|banner|notice|respond|replies|reply|header|masthead|footer|widget|search|disclaimer|hidden"
_NAMED = re.compile(rf"(?:^|[ ])(?:(?:{_CLEAR})(?=$|[-_ ])|(?:[^ ]*[-_])?(?:{_CLEAR}|{_VAGUE})(?=$|[ ]))", re.I)
_HINTED = re.compile(rf"(?:^|[-_ ])(?:{_CLEAR}|{_VAGUE})(?:$|[-_ ])", re.I)


class Token:
    """A tag (``name``, ``key`` with its class and id, whether it closes) or a text.

    ``named`` is 2 for elements whose class says that they are no article, 1 where it hints so.
    """

    __slots__ = ("kind", "name", "key", "text", "named")

    def __init__(self, kind: str, name: str = "", key: str = "", text: str = "", named: int = 0):
        self.kind, self.name, self.key, self.text, self.named = kind, name, key, text, named


def tokens(page: str) -> Iterator[Token]:
    """Tags and texts of a page; comments, declarations and the contents of scripts and the like are left out."""
    at, size = 0, len(page)
    while at < size:
        tag = page.find("<", at)
        if tag < 0:
            tag = size
        if tag > at:
            yield Token("text", text=html_entities.unescape(page[at:tag]))
        found = _TOKEN.match(page, tag)
        if found is None:
            if tag < size:
                yield Token("text", text="<")
            at = tag + 1
            continue
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            yield Token("close", name, name)
            continue
        attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(found[3] or "")}
        names = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).strip()
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(_NAMED.search(names))
        # Numbers in names differ from page to page.
        key = f"{name} {re.sub('[0-9]+', '0', names)}".strip()
        if name in ("html", "body"):  # they hold everything, whatever they are called
            yield Token("open", name, name)
        else:
            yield Token("open", name, key, named=2 if hidden else int(bool(_HINTED.search(names))))
        if name in _RAW and not (found[3] or "").rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            yield Token("close", name, name)


def read(page: str) -> list[Token]:
    """The tokens; an element without class and id gets the name of what it begins with into its key."""
    found = list(tokens(page))
    following = ""
    for token in reversed(found):
        if token.kind == "text":
            following = "#" if token.text.strip() else following
        elif token.name in _INLINE or token.name in _VOID:
            continue
        elif token.kind == "close":
            following = ""
        else:
            own = following
            following = token.name
            if token.key == token.name and token.name not in ("html", "body", *_ROOTS) and own:
                token.key = f"{token.name}>{own}"
    return found


# A wrapper's nodes: ("tag", key), ("text", fixed, on how many pages), ("slot", texts, characters), ("optional", nodes), ("repeat", nodes).


def _shape(node: tuple) -> str:
    if node[0] == "tag":
        return node[1]
    if node[0] in ("text", "slot"):
        return "#"
    return f"({' '.join(_shape(n) for n in node[1])})" + ("?" if node[0] == "optional" else "+")


def _body(node: tuple) -> str:
    return " ".join(_shape(n) for n in node[1]) if node[0] == "repeat" else _shape(node)


def page_nodes(page: str) -> list[tuple]:
    """Block tags, links and texts; other inline tags belong to their text."""
    nodes: list[tuple] = []
    parts: list[str] = []

    def end() -> None:
        text = " ".join("".join(parts).split())
        if text:
            nodes.append(("text", text, 1))
        parts.clear()

    for token in read(page):
        if token.kind == "text":
            parts.append(token.text)
        elif token.name in _VOID:
            parts.append(" ")
        elif token.name == "a" or token.name not in _INLINE:
            end()
            key = "a" if token.name == "a" else token.key
            nodes.append(("tag", f"<{key}>" if token.kind == "open" else f"</{token.name}>"))
    end()
    return nodes


def merged(a: list[tuple], b: list[tuple], apart: bool = False) -> list[tuple]:
    """Two equally shaped runs as one, of one page or of pages ``apart``."""
    out = []
    for x, y in zip(a, b):
        if x[0] in ("text", "slot") and y[0] in ("text", "slot"):
            if x[0] == y[0] == "text" and x[1] == y[1]:
                out.append(("text", x[1], x[2] + y[2] if apart else max(x[2], y[2])))
            else:
                both = [(n[1], n[2]) if n[0] == "slot" else (1, len(n[1])) for n in (x, y)]
                out.append(("slot", both[0][0] + both[1][0], both[0][1] + both[1][1]))
        elif x[0] in ("optional", "repeat"):
            out.append((x[0], merged(x[1], y[1], apart)))
        else:
            out.append(x)
    return out


def folded(nodes: list[tuple]) -> list[tuple]:
    """Neighbouring equal runs that begin with a tag, as repeated groups; groups of groups too.

    A run begins again at one of the next eight places with its first tag."""
    while True:
        out: list[tuple] = []
        shapes = [_shape(n) for n in nodes]
        later: dict[str, list[int]] = {}
        again: list[list[int]] = [[]] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            if shapes[i].startswith(("<", "(")) and not shapes[i].startswith("</"):
                again[i] = later.get(shapes[i], [])
                later[shapes[i]] = [i, *again[i][:7]]
        at = 0
        while at < len(nodes):
            for next_ in again[at]:
                size = end = next_ - at
                if shapes[at:next_] != shapes[next_ : next_ + size]:
                    continue
                body, end = nodes[at:next_], next_
                while end + size <= len(nodes) and shapes[end : end + size] == shapes[at:next_]:
                    body = merged(body, nodes[end : end + size])
                    end += size
                out.append(("repeat", body[0][1]) if size == 1 and body[0][0] == "repeat" else ("repeat", body))
                at = end
                break
            else:
                out.append(nodes[at])
                at += 1
        if len(out) == len(nodes):
            return out
        nodes = out


def _flat(wrapper: list[tuple], side: int) -> list[tuple[tuple, object]]:
    """Nodes with the mark of their optional group, None outside of any."""
    flat: list[tuple[tuple, object]] = []
    for i, node in enumerate(wrapper):
        if node[0] == "optional":
            flat.extend((n, (side, i)) for n in node[1])
        else:
            flat.append((node, None))
    return flat


class _Runs(SequenceMatcher):
    """The runs that ``SequenceMatcher`` finds, at any size: the longest common run of two ranges comes from the
    suffix automaton of the second, in time linear in both, where the plain search takes their product."""

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> Match:
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        # Of each state: its moves, its suffix link, the length of its longest run and where that ends first.
        moves: list[dict[str, int]] = [{}]
        link, size, ends = [-1], [0], [-1]
        whole = 0
        for j in range(blo, bhi):
            x, at, whole = self.b[j], whole, len(moves)
            moves.append({})
            link.append(0)
            size.append(size[at] + 1)
            ends.append(j)
            while at >= 0 and x not in moves[at]:
                moves[at][x] = whole
                at = link[at]
            if at < 0:
                continue
            to = moves[at][x]
            if size[to] > size[at] + 1:  # longer runs end elsewhere too: the state is split
                split = len(moves)
                moves.append(moves[to].copy())
                link.append(link[to])
                size.append(size[at] + 1)
                ends.append(ends[to])
                link[to] = split
                while at >= 0 and moves[at].get(x) == to:
                    moves[at][x] = split
                    at = link[at]
                to = split
            link[whole] = to
        best, at, length = Match(alo, blo, 0), 0, 0
        for i in range(alo, ahi):
            x = self.a[i]
            while at and x not in moves[at]:
                at = link[at]
                length = size[at]
            at = moves[at].get(x, 0)
            length = length + 1 if at else 0
            if length > best.size:
                best = Match(i - length + 1, ends[at] - length + 1, length)
        return best


def _matches(left: list[str], right: list[str]) -> Iterator[tuple[bool, int, int, int, int]]:
    """Runs of both sides in order, and whether they are equal."""
    least = min(len(left), len(right))
    head = next((i for i in range(least) if left[i] != right[i]), least)
    tail = next((i for i in range(least - head) if left[-1 - i] != right[-1 - i]), least - head)
    a, b = len(left) - tail, len(right) - tail
    yield True, 0, head, 0, head
    for kind, i, j, k, m in _Runs(None, left[head:a], right[head:b], autojunk=False).get_opcodes():
        yield kind == "equal", head + i, head + j, head + k, head + m
    yield True, a, len(left), b, len(right)


def aligned(wrapper: list[tuple], other: list[tuple]) -> list[tuple]:
    """A wrapper of what either wrapper (a page's nodes are one) matches; nodes of optional groups match like all others."""
    a, b = _flat(wrapper, 0), _flat(other, 1)
    out: list[tuple[tuple, object]] = []
    for i, (same, i0, i1, j0, j1) in enumerate(_matches([_body(n) for n, _ in a], [_body(n) for n, _ in b])):
        if not same:
            out.extend((n, group or (2, i)) for n, group in a[i0:i1])
            out.extend((n, group or (3, i)) for n, group in b[j0:j1])
            continue
        for (x, group), (y, other_group) in zip(a[i0:i1], b[j0:j1]):
            if "repeat" in (x[0], y[0]):
                bodies = [n[1] if n[0] == "repeat" else [n] for n in (x, y)]
                out.append((("repeat", merged(*bodies, apart=True)), group or other_group))
            else:
                out.append((merged([x], [y], apart=True)[0], group or other_group))
    nodes: list[tuple] = []
    for group, own in groupby(out, key=lambda pair: pair[1]):
        run = [n for n, _ in own]
        nodes.extend([("optional", run)] if group else run)
    return nodes


class HostWrapper:
    """A wrapper with the number of its pages and the smallest hashes of a few different ones."""

    def __init__(self, nodes: list[tuple], pages: int, hashes: Iterable[int]):
        self.nodes, self.pages, self.hashes = nodes, pages, sorted(set(hashes))[:LEAST_PAGES]

    @classmethod
    def of(cls, page: str) -> HostWrapper:
        return cls(folded(page_nodes(page)), 1, [xxhash.xxh64_intdigest(page)])

    def with_(self, other: HostWrapper) -> HostWrapper:
        return HostWrapper(aligned(self.nodes, other.nodes), self.pages + other.pages, self.hashes + other.hashes)

    def dumps(self) -> str:
        return json.dumps([self.nodes, self.pages, self.hashes], ensure_ascii=False)

    @classmethod
    def loads(cls, text: str) -> HostWrapper:
        def node(n: list) -> tuple:
            return (n[0], [node(m) for m in n[1]]) if n[0] in ("optional", "repeat") else tuple(n)

        nodes, pages, hashes = json.loads(text)
        return cls([node(n) for n in nodes], pages, hashes)


def infer(pages: list[str]) -> HostWrapper:
    wrapper = HostWrapper([], 0, [])
    for page in dict.fromkeys(pages):
        wrapper = wrapper.with_(HostWrapper.of(page)) if wrapper.pages else HostWrapper.of(page)
    return wrapper


def _name(key: str) -> str:
    return re.split("[> ]", key)[0]


def _opened(stack: list[str], name: str) -> None:
    """Close what an opening tag ends: paragraphs, list items, cells and rows."""
    if name not in _INLINE and name not in _VOID:
        closes = {"li": "li", "td": "td", "th": "th", "tr": "tr", "dd": "dd", "dt": "dt"}.get(name, "p")
        if stack and _name(stack[-1]) == closes:
            stack.pop()


def rules_of(wrapper: HostWrapper) -> dict:
    """The path of the article's element; texts and elements below it that are template."""
    stack: list[str] = []
    # What stands where: path, class-named element above it if any, whether it is a link's, the node.
    places: list[tuple[list[str], str | None, bool, tuple]] = []

    def walk(nodes: list[tuple]) -> None:
        for node in nodes:
            if node[0] in ("optional", "repeat"):
                walk(node[1])
            elif node[0] == "tag" and node[1].startswith("</"):
                if any(_name(k) == node[1][2:-1] for k in stack):
                    while _name(stack.pop()) != node[1][2:-1]:
                        pass
            elif node[0] == "tag":
                _opened(stack, _name(node[1][1:-1]))
                stack.append(node[1][1:-1])
            else:
                # Around an article's element neither tags nor names say anything.
                inner = next((i + 1 for i in range(len(stack) - 1, -1, -1) if _name(stack[i]) in _ROOTS), 0)
                if not any(_name(k) in _LEFT_OUT for k in stack[inner:]):
                    paths = ["/".join(stack[: i + 1]) for i in range(len(stack)) if stack[i] != "a"]
                    named = next((i for i in range(inner, len(stack)) if _NAMED.search(stack[i].partition(" ")[2])), None)
                    places.append((paths, None if named is None else "/".join(stack[: named + 1]), "a" in stack, node))

    walk(wrapper.nodes)
    size = lambda n: n[2] if n[0] == "slot" else len(n[1]) * n[2]
    varies = lambda n: n[0] == "slot" or wrapper.pages < 2
    mass: Counter[str] = Counter()
    for paths, _, link, node in places:
        if varies(node) and not link:
            mass.update(dict.fromkeys(paths, size(node)))
    # A name does not count against an element that holds most of the text.
    most = max(mass.values(), default=0)
    slots, linked, fixed = Counter(), Counter(), Counter()
    once: set[str] = set()
    common: list[tuple[str, str]] = []
    for paths, named, link, node in places:
        if named is not None and mass[named] < 0.6 * most:
            continue
        (linked if link else slots if varies(node) else fixed).update(dict.fromkeys(paths, size(node)))
        if node[0] == "text" and node[2] < 2:
            once.update(paths)
        if node[0] == "text" and node[2] == wrapper.pages and not link and paths:
            common.append((paths[-1], node[1]))
    name_of = lambda path: _name(path.rpartition("/")[2])
    own = [p for p in slots.keys() | fixed.keys() if name_of(p) in _ROOTS]
    if own:
        root = max(own, key=lambda p: (slots[p] > 0, name_of(p) == "article", slots[p] + fixed[p], p))
    else:
        blocks = [p for p in slots if name_of(p) in ("div", "section", "td", "body")]
        if not blocks:
            return {}
        most = max(slots[p] for p in blocks)
        root = max((p for p in blocks if slots[p] >= 0.6 * most), key=lambda p: (p.count("/"), slots[p], p))
    below = root + "/"
    several = len(wrapper.hashes) >= LEAST_PAGES and slots[root] > 0
    template: set[str] = set()
    if not own:
        for p in slots.keys() | fixed.keys() | linked.keys():
            still = several and not slots[p] and p not in once and not linked[p]
            links = linked[p] > 4 * (slots[p] + fixed[p]) and name_of(p) in ("div", "section", "ul", "ol", "table")
            if p.startswith(below) and (still or links):
                template.add(p)
    texts = [c for c in common if several and c[0].startswith(below)]
    return {"root": root, "template": sorted(template), "texts": sorted(set(texts))}


def extract(page: str, rules: dict) -> str:
    """The text of the article; a page without the wrapper's element is read by its own tags."""
    found = read(page)
    paths: list[str] = []
    stack: list[str] = []
    for token in found:  # the path of each open element, as the wrapper names it
        if token.kind == "open" and token.name not in _VOID and (token.name == "a" or token.name not in _INLINE):
            _opened(stack, token.name)
            stack.append("a" if token.name == "a" else token.key)
        elif token.kind == "close" and any(_name(k) == token.name for k in stack):
            while _name(stack.pop()) != token.name:
                pass
        paths.append("/".join(stack))
    opened = [(t, p) for t, p in zip(found, paths) if t.kind == "open"]
    root = rules.get("root")
    known = root is not None and any(p == root for t, p in opened)
    name = None if known else next((r for r in _ROOTS if any(t.name == r for t, _ in opened)), None)
    in_article = name is not None or (known and _name(root.rpartition("/")[2]) in _ROOTS)
    template = set(rules.get("template", ())) if known else set()
    texts = {tuple(t) for t in rules.get("texts", ())} if known else set()

    parts: list[str] = []
    block: list[str] = []
    # Open elements: name, whether its text counts, whether it is the article's element or inside.
    open_: list[tuple[str, bool, bool]] = [("", True, not known and name is None)]

    def end(path: str) -> None:
        text = " ".join("".join(block).split())
        if text and (path, text) not in texts:
            parts.append(text)
        block.clear()

    path = ""
    for token, after in zip(found, paths):
        _, counts, inside = open_[-1]
        if token.kind == "text":
            if counts and inside:
                block.append(token.text)
            continue
        if token.name in _VOID:
            block.append(" ")
            continue
        if token.name not in _INLINE:
            end(path)
        path = after
        if token.kind == "open":
            if token.name not in _INLINE:
                closes = {"li": "li", "td": "td", "th": "th", "tr": "tr", "dd": "dd", "dt": "dt"}.get(token.name, "p")
                if open_[-1][0] == closes:
                    open_.pop()
                    _, counts, inside = open_[-1]
            is_root = not inside and (after == root if known else token.name == name)
            # Inside the article its own header is text; a hint in a name decides only where no wrapper is known.
            tagged = token.name in _LEFT_OUT and not (token.name == "header" and inside and in_article)
            out = tagged or token.named == 2 or (token.named == 1 and not known and name is None) or after in template
            surrounds = not inside and (known or name is not None) and token.name not in _RAW and token.name != "head"
            open_.append((token.name, True if is_root or surrounds else counts and not out, inside or is_root))
        elif any(e[0] == token.name for e in open_[1:]):
            while open_.pop()[0] != token.name:
                pass
    end(path)
    return " ".join(parts)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """host and ``rules`` (JSON) of each host, from all of its pages; exact copies in a task count once."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, HostWrapper] = {}
        seen: set[tuple[str, int]] = set()
        part = 0

        def rows() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.string()), pa.array([part] * len(held), pa.int32())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([w.dumps() for w in held.values()], pa.string())], names=["host", "part", "wrapper"])

        nodes = 0
        for batch in batches:
            for host, page, part in zip(*(column.to_pylist() for column in batch.columns)):
                key = (host, xxhash.xxh64_intdigest(page))
                if key in seen:
                    continue
                seen.add(key)
                before = len(held[host].nodes) if host in held else 0
                own = HostWrapper.of(page)
                held[host] = held[host].with_(own) if host in held else own
                nodes += len(held[host].nodes) - before
                if nodes > HELD_NODES:
                    yield rows()
                    held.clear()
                    seen.clear()
                    nodes = 0
        if held:
            yield rows()
        give_back()

    def join(table: pa.Table) -> pa.Table:
        whole = None
        for text in sorted(table.column("wrapper").to_pylist()):
            own = HostWrapper.loads(text)
            whole = whole.with_(own) if whole else own
        names = ["host", "part", "wrapper"]
        return pa.Table.from_arrays([table.column("host").slice(0, 1), table.column("part").slice(0, 1), pa.array([whole.dumps()], pa.string())], names=names)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules = [json.dumps(rules_of(HostWrapper.loads(w)), ensure_ascii=False) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rules, pa.string())], names=["host", "rules"])

    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"), F.spark_partition_id().alias("part"))
    schema = "host string, part int, wrapper string"
    parts = written(rows.filter("length(html) > 0").mapInArrow(begin, schema))
    last = parts.agg(F.max("part")).first()[0] or 0
    while True:
        last //= FAN_IN
        parts = written(parts.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("host", "part").applyInArrow(join, schema))
        if not last:
            return parts.select("host", "wrapper").mapInArrow(finish, "host string, rules string")


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages have an empty text; pages without a url share the host
    ""; repeated rows stay; an empty table gives an empty result; other columns
    make no difference. Inline elements join, all others are set apart by a space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, rules in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if rules is not None and rules not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[rules] = json.loads(rules)
                texts.append(extract(page or "", known[rules] if rules is not None else {}))
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    of_host = measured(wrappers(pages), "octet_length(host) + octet_length(rules) + 48").withColumnRenamed("host", "of")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    joined = rows.join(of_host, host_of(F.col("url")) == F.col("of"), "left").select("page_id", "url", "html", "rules")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
