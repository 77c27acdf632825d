"""Main text of web pages by wrappers inferred per host.

A page is a stream of tokens: block tags, labelled by name and class, and text. The pages of a host are aligned one
after another into a wrapper, a regular expression without unions: tags that stand one after another are folded into
repeated groups; where two streams do not agree, what only one has becomes optional; texts that differ become slots.
Wrappers are mergeable: each task aligns the pages that it sees, and the tasks' wrappers of a host are aligned in turn,
so that a host with a third of all pages is no single task's work. A wrapper's slots and fixed texts, with the share of
links in each, decide what of the host's pages is main text: the outermost articles; else the main element or an element
named as content; else the smallest element around nearly all text in slots; else the body; but for articles without
fixed texts and lists of links. Menus, headers, footers, sidebars,
notices, adverts, forms, comments and the like are no main text. Tags and roles tell them anywhere. Of class names and
ids, inside a root only those tell them that say nothing else ("comments-area", not "side-effects"); outside one, a part
is enough ("post-header"), but an element so marked may still hold the root. The page, its body, main and articles are
never told by class or id.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import if_small, slices, stored

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_OPEN_END = re.compile(r"<!--|<!\[CDATA\[")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe textarea title svg math object audio video canvas select".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
BOILER_TAGS = frozenset("nav header footer aside form menu dialog button fieldset head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Parts of class names and ids that mark what is no main text.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer foot cookie cookies consent gdpr notice notices alert popup modal overlay lightbox comment comments disqus respond reply replies discussion "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search widget toolbar pagination pager skip copyright".split()
)
CONTENT_WORDS = frozenset("content article post entry story main text body".split())
#: Words that leave a name's meaning as it is.
FRAME_WORDS = frozenset("area block bar box button buttons column container group inline inner left link links list item outer panel right section slot top bottom unit wrap wrapper".split())
#: Boilerplate words that inside a main text name other things too, in classes and ids, and those that headings' ids have.
SOFT_WORDS = frozenset("side discussion popup header".split())
SUBJECTS = SOFT_WORDS | frozenset("advertising alert banner copyright cookies footer login menu navigation notice notices overlay promotion recommendations recommended related reply search sharing social sponsor subscription toolbar widget".split())
#: Elements that no class or id makes boilerplate.
UNMARKED = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What marks an element as boilerplate: a part of a name; a name that says nothing else but may name other things inside
#: a main text; a tag, a role or a name that is clear anywhere.
PART_OF_NAME, NAME, CLEAR = 1, 2, 3
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Deeper tags count to the last one within.
DEPTH = 200
#: Longer labels are cut and get a hash of the whole.
LABEL = 80
FIXED_PAGES = 3
OPEN, CLOSE, TEXT = 0, 1, 2


def _mark(value: str, subjects: frozenset, heading_id: bool) -> tuple[int, bool]:
    """How a class or id marks its element as boilerplate, 0 for not at all, and whether it says that it is content."""
    mark, whole = 0, False
    for name in value.split():
        parts = {p.lower() for p in _PART.findall(name) if not p.isdigit()}
        boiler = parts & BOILER_WORDS
        rest = parts - BOILER_WORDS - FRAME_WORDS
        if not boiler:
            whole |= bool(rest) and rest <= CONTENT_WORDS
        elif rest - CONTENT_WORDS:
            mark = max(mark, PART_OF_NAME)
        else:
            mark = max(mark, CLEAR if boiler - subjects and not heading_id else NAME)
    return mark, whole


def _label(tag: str, attributes: str) -> tuple[str, int, bool]:
    """The tag's label, how it is marked as boilerplate, and whether it is named as content, by its name, class, id or role."""
    mark, content, whole, names = CLEAR if tag in BOILER_TAGS else 0, tag == "main", False, []
    if "=" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = next(filter(None, values), "")
            if name.lower() == "role":
                mark = CLEAR if value.lower() in BOILER_ROLES else mark
                content |= value.lower() == "main"
            else:
                own, says = _mark(value, SUBJECTS if name.lower() == "id" else SOFT_WORDS, name.lower() == "id" and tag in HEADINGS)
                mark, whole = mark if tag in UNMARKED else max(mark, own), whole or says
                content |= not CONTENT_WORDS.isdisjoint(p.lower() for p in _PART.findall(value))
                names.append(re.sub(r"\d+", "#", value))
    if whole and mark == PART_OF_NAME:
        mark = 0
    label = ".".join([tag, *names])
    return label if len(label) <= LABEL else f"{label[:LABEL]}#{_text_hash(label)}", mark, content


def _tags(page: str) -> Iterator[tuple[re.Match, int]]:
    """Tags and comments, and where text goes on after each: for an element of RAW, after its own end tag, whatever
    stands in between; for a comment without an end, at the page's end."""
    at, last = 0, page.rfind(">") + 1
    for m in _OPEN_END.finditer(page, last):  # what starts after the last > and ends nowhere
        last = len(page)
        break
    while True:
        for m in _TOKEN.finditer(page, at, last):
            tag = (m[2] or m[5] or "").lower()
            if not tag and m.end() == last and _OPEN_END.match(m[0]) and not m[0].endswith(("-->", "]]>")):
                yield m, len(page)
                return
            if tag in RAW and not (m[1] or m[4]) and not (tag in ("svg", "math") and (m[3] or m[6] or "").endswith("/")):
                end = _RAW_END[tag].search(page, m.end())
                at = end.end() if end else len(page)
                yield m, at
                break
            yield m, m.end()
        else:
            return


def tokens(page: str) -> Iterator[tuple]:
    """(OPEN, label, tag, boilerplate mark, content?, block?), (CLOSE, block?), (TEXT, text, in a link?), well nested."""
    stack: list[tuple[str, bool]] = []  # (tag, block?)
    links = at = 0
    for m, after in _tags(page):
        if m.start() > at:
            yield TEXT, entities.unescape(page[at : m.start()]), links > 0
        at = after
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        end, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        inline = tag in INLINE
        if end:
            if tag == "a":
                links = max(0, links - 1)
            if any(t == tag for t, _ in stack) and (not inline or _reachable(stack, tag)):
                while stack:
                    t, block = stack.pop()
                    yield CLOSE, block
                    if t == tag:
                        break
            continue
        if tag in RAW:
            continue
        if tag in VOID:
            if tag == "hr":
                yield OPEN, "hr", tag, 0, False, True
                yield CLOSE, True
            else:
                yield TEXT, " ", links > 0
            continue
        label, mark, content = _label(tag, attributes)
        links += tag == "a"
        if inline and not mark:
            continue
        if tag in _CLOSES_P and stack and stack[-1][0] == "p":
            yield CLOSE, stack.pop()[1]
        if tag in _SAME:
            same, within = _SAME[tag]
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in same or stack[i][0] in within), None)
            close = k is not None and stack[k][0] in same
            while close and len(stack) > k:
                yield CLOSE, stack.pop()[1]
        if not inline:
            links = 0
        stack.append((tag, not inline))
        yield OPEN, label, tag, mark, content, not inline
    if at < len(page):
        yield TEXT, entities.unescape(page[at:]), links > 0
    while stack:
        yield CLOSE, stack.pop()[1]


def _reachable(stack: list[tuple[str, bool]], tag: str) -> bool:
    """An inline element's end tag does not close blocks."""
    for t, block in reversed(stack):
        if t == tag:
            return True
        if block:
            return False
    return False


# A wrapper: [label, optional, repeated, pages, chars, link chars, hashes of the texts that all pages have there, kind,
# children]. Its kind: x boilerplate, y and w marked by name and by part of a name, a article, m named as content, blank;
# wm is both.
def _node(label: str, kind: str = "") -> list:
    return [label, False, False, 1, 0, 0, [], kind, []]


def page_tree(page: str) -> list:
    root = _node("")
    path, extra, texts = [root], 0, [""]
    for token in tokens(page):
        if token[0] == TEXT:
            texts[-1] += token[1]
            n = len("".join(token[1].split()))
            path[-1][4] += n
            path[-1][5] += n if token[2] else 0
        elif token[0] == OPEN:
            if extra or len(path) > DEPTH:
                extra += 1
                continue
            node = _node(token[1], "x" if token[3] == CLEAR else "y" if token[3] == NAME else ("w" if token[3] else "") + ("a" if token[2] == "article" else "m" if token[4] else ""))
            path[-1][8].append(node)
            path.append(node)
            texts.append("")
        elif extra:
            extra -= 1
        else:
            _close(path.pop(), texts.pop())
    _close(root, texts.pop())
    return root


def _close(node: list, text: str) -> None:
    text = " ".join(text.split())
    node[6] = [_text_hash(text)] if text else []
    node[8] = fold(node[8])


def _text_hash(text: str) -> str:
    from xxhash import xxh64_hexdigest

    return xxh64_hexdigest(text)


def fold(items: list[list], longest: int = 3) -> list[list]:
    """Repeated neighbours become one: single items, and groups of up to `longest` items that recur in turn."""
    for size in range(1, longest + 1):
        out: list[list] = []
        for item in items:
            out.append(item)
            while len(out) >= 2 * size and [x[0] for x in out[-size:]] == [x[0] for x in out[-2 * size : -size]]:
                last, before = out[-size:], out[-2 * size : -size]
                for a, b in zip(before, last):
                    merge(a, b, same_page=True)
                    a[2] = True
                del out[-size:]
        items = out
    return items


def merge(a: list, b: list, same_page: bool = False) -> None:
    """Aligns b into a, both with the same label: children by their longest common row of labels; the rest is optional."""
    a[1], a[2] = a[1] or b[1], a[2] or b[2]
    a[3] = max(a[3], b[3]) if same_page else a[3] + b[3]
    a[4], a[5] = a[4] + b[4], a[5] + b[5]
    a[6] = sorted({*a[6], *b[6]} if same_page else {*a[6]} & {*b[6]})
    a[7] = a[7] or b[7]
    x, y = a[8], b[8]
    if [i[0] for i in x] == [i[0] for i in y]:
        for p, q in zip(x, y):
            merge(p, q, same_page)
        return
    out, i, j = [], 0, 0
    for p, q in [*common_row([c[0] for c in x], [c[0] for c in y]), (len(x), len(y))]:
        for only in (*x[i:p], *y[j:q]):
            only[1] = True
            out.append(only)
        if p < len(x):
            merge(x[p], y[q], same_page)
            out.append(x[p])
        i, j = p + 1, q + 1
    a[8] = fold(out)


#: Cells of the table of a longest common row; beyond it, equal labels are paired by their turn.
TABLE = 250_000


def common_row(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places (i, j), both ascending, where x[i] == y[j]: as many as there can be, or, where a table of len(x) times
    len(y) is too large, as many as there can be of the pairs of a label's k-th places in x and in y."""
    start = 0
    while start < min(len(x), len(y)) and x[start] == y[start]:
        start += 1
    end = 0
    while end < min(len(x), len(y)) - start and x[-1 - end] == y[-1 - end]:
        end += 1
    a, b = x[start : len(x) - end], y[start : len(y) - end]
    n, m = len(a), len(b)
    inner: list[tuple[int, int]] = []
    if n * m <= TABLE:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < n and j < m:
            if a[i] == b[j]:
                inner.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        places: dict[str, list[int]] = {}
        for j in range(m - 1, -1, -1):
            places.setdefault(b[j], []).append(j)
        pairs = [(i, places[label].pop()) for i, label in enumerate(a) if places.get(label)]
        ends: list[int] = []  # the least last j of an ascending row of each length
        rows: list[int] = []
        before = [-1] * len(pairs)
        for k, (_, j) in enumerate(pairs):
            at = bisect_left(ends, j)
            before[k] = rows[at - 1] if at else -1
            ends[at : at + 1], rows[at : at + 1] = [j], [k]
        k = rows[-1] if rows else -1
        while k >= 0:
            inner.append(pairs[k])
            k = before[k]
        inner.reverse()
    return [*((i, i) for i in range(start)), *((start + i, start + j) for i, j in inner), *((len(x) - end + k, len(y) - end + k) for k in range(end))]


def expression(wrapper: list) -> str:
    """The wrapper as a regular expression over tags, #text, and #fixed for texts that all pages have."""
    inner = ("" if not wrapper[4] else "#fixed" if wrapper[6] and not wrapper[2] else "#text") + "".join(expression(c) for c in wrapper[8])
    body = f"<{wrapper[0]}>{inner}</>" if wrapper[0] else inner
    return f"({body})" + ("*" if wrapper[1] and wrapper[2] else "?" if wrapper[1] else "+") if wrapper[1] or wrapper[2] else body


#: Elements whose text the wrapper does not call fixed within a root: they name or list what is around them.
NAMING = frozenset("h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption pre".split())
#: Elements that a search for the root does not go into.
LEAVES = NAMING | frozenset("p blockquote ul ol dl table figure".split())
#: Share of the text in slots that a root must hold of that around it.
MOST = 0.8


def _slots(node: list) -> int:
    """Characters of a wrapper's part that stand in slots, outside links, and not in what is marked as boilerplate."""
    if node[7] in ("x", "y"):
        return 0
    own = 0 if node[6] and not node[2] else node[4] - node[5]
    return own + sum(_slots(c) for c in node[8])


def _has_text(node: list) -> bool:
    """Whether a wrapper's part has a heading or a paragraph with text in a slot."""
    return node[7] not in ("x", "y") and (node[0].split(".")[0] in HEADINGS | {"p"} and _slots(node) > 0 or any(map(_has_text, node[8])))


def slot_root(wrapper: list) -> str:
    """The path of the smallest element around nearly all text in slots, "" for the page: from the page inwards while
    one element holds MOST of it and nothing beside that has a heading or a paragraph with text in slots."""
    node, path = wrapper, ""
    while node[8]:
        best = max(node[8], key=_slots)
        beside = [c for c in node[8] if c is not best]
        if best[2] or best[0].split(".")[0] in LEAVES or _slots(best) < MOST * _slots(node) or not _slots(best) or any(map(_has_text, beside)):
            break
        node, path = best, f"{path}>{best[0]}"
    return path


def rule_of(wrapper: list) -> dict:
    """What of a host's pages is main text. Paths are rows of labels.

    roots: pairs of a kind and paths; the first of which a page has some holds its main text. Those under a mark by part
    of a name, unless repeated, come last of those told by tags and names, and after them, as kind "slot", the element
    that the wrapper's slots tell. fixed, links: paths of texts that are the same on FIXED_PAGES pages or more, and of
    those mostly links; they are left out but in articles.
    """
    groups: dict[str, list[str]] = {k: [] for k in ("a", "main", "m", "wa", "wmain", "wm")}
    fixed, links = {}, []
    todo = [(wrapper, "", "", False)]
    while todo:
        node, path, under, inside = todo.pop()
        kind = node[7]
        if kind == "x":
            continue
        if kind in ("y", "w", "wm") and not inside:
            under = "y" if kind == "y" or under == "y" else "w"
        if under != "y" and not inside and not (under and node[2]):
            if kind == "a":
                groups[under + "a"].append(path)
            elif kind[-1:] == "m":
                groups[under + ("main" if node[0].split(".")[0] == "main" else "m")].append(path)
        if node[6] and node[3] >= FIXED_PAGES:
            fixed[path] = node[6]
        if node[4] and 2 * node[5] > node[4] and node[0] not in ("p", "h1", "h2", "h3"):
            links.append(path)
        todo += [(c, f"{path}>{c[0]}", under, inside or kind == "a") for c in node[8]]
    groups["slot"] = [p for p in [slot_root(wrapper)] if p and wrapper[3] >= FIXED_PAGES]
    return {"roots": [[k, sorted(set(g))] for k, g in groups.items() if g], "fixed": fixed, "links": sorted(set(links))}


def main_text(page: str | None, rule: dict) -> str:
    """The page's main text under its host's rule: blocks in page order, white space within a block as one blank."""
    if not page:
        return ""
    stream = list(tokens(page))
    paths, present = [""], set()
    for token in stream:
        if token[0] == OPEN:
            paths.append(f"{paths[-1]}>{token[1]}" if len(paths) <= DEPTH else paths[-1])
            present.add(paths[-1])
        elif token[0] == CLOSE:
            paths.pop()
    kind, roots = next(((k, set(g)) for k, g in rule["roots"] if present.intersection(g)), (None, None))
    blocks = _blocks(stream, rule, roots, PART_OF_NAME, kind)
    if not blocks and kind in (None, "slot"):  # all of the page is within an element with a telling part of a name
        blocks = _blocks(stream, rule, None, NAME, None)
    return "\n".join(blocks)


def _blocks(stream: list[tuple], rule: dict, roots: set | None, least: int, kind: str | None) -> list[str]:
    """The blocks of the roots, or without any of the body, where marks from `least` on count.

    Outside articles, what the wrapper knows as fixed or as a list of links goes; where nothing else is in named roots,
    as on a host whose pages are all alike, it stays.
    """
    blocks: list[tuple[str, bool]] = []
    text: list[str] = []
    path, inside, boiler = [""], [roots is None], [False]
    named = kind not in (None, "slot")

    def frame(block: str) -> bool:
        if kind in ("a", "wa"):
            return False
        if named and path[-1].rpartition(">")[2].split(".")[0] in NAMING:
            return False
        return _text_hash(block) in rule["fixed"].get(path[-1], ()) or path[-1] in rule["links"]

    def flush() -> None:
        if text:
            block = " ".join("".join(text).split())
            if block:
                blocks.append((block, frame(block)))
            text.clear()

    for token in stream:
        if token[0] == TEXT:
            if inside[-1] and not boiler[-1]:
                text.append(token[1])
        elif token[0] == OPEN:
            if token[5]:
                flush()
            deep = len(path) > DEPTH
            path.append(path[-1] if deep else f"{path[-1]}>{token[1]}")
            root = not deep and path[-1] in (roots or ())
            boiler.append(not root and (boiler[-1] or token[3] >= (CLEAR if named and inside[-1] else least)))
            inside.append(inside[-1] or root)
        else:
            if token[1]:
                flush()
            path.pop(), inside.pop(), boiler.pop()
    flush()
    kept = [b for b, out in blocks if not out]
    return kept if kept or not named else [b for b, _ in blocks]


#: Parts in which the wrappers of one host are merged before they meet.
TURNS = 64
#: Hosts whose wrappers a task holds before it passes them on.
HELD_HOSTS = 2000


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, turn, wrapper) of the pages that a task sees; of equal pages of a host one counts."""
    from xxhash import xxh64_intdigest

    held: dict[str, tuple[list, set]] = {}
    turn = TaskContext.get().partitionId()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"host": list(held), "turn": [turn] * len(held), "wrapper": [json.dumps(w) for w, _ in held.values()]})

    for batch in batches:
        for part in slices(batch, "html"):
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                of = xxh64_intdigest(page or "")
                if host not in held:
                    held[host] = page_tree(page or ""), {of}
                elif of not in held[host][1]:
                    held[host][1].add(of)
                    merge(held[host][0], page_tree(page or ""))
            if len(held) > HELD_HOSTS:
                yield out()
                held = {}
    if held:
        yield out()


def _align(last: bool):
    """Rows sorted by host and turn: the wrappers of a host (and, but for the last step, turn) become one; at last its rule."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, wrapper = None, None
        done: list[tuple] = []
        names = ["host", "rule", "expression"] if last else ["host", "turn", "wrapper"]

        def row() -> tuple:
            return (key[0], json.dumps(rule_of(wrapper)), expression(wrapper)) if last else (*key, json.dumps(wrapper))

        for frame in frames:
            for host, turn, text in zip(frame["host"], frame["turn"], frame["wrapper"]):
                if wrapper is not None and key == (host, 0 if last else turn):
                    merge(wrapper, json.loads(text))
                    continue
                if wrapper is not None:
                    done.append(row())
                key, wrapper = (host, 0 if last else turn), json.loads(text)
            if len(done) > 500:
                yield pd.DataFrame(done, columns=names)
                done = []
        if wrapper is not None:
            done.append(row())
        yield pd.DataFrame(done, columns=names)

    return run


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, rule, expression of every host of pages (url, html). Pages without a host's name share one wrapper."""
    hosted = pages.select(host_of(F.col("url")).alias("host"), "html")
    partial = hosted.mapInArrow(_infer, "host string, turn long, wrapper string")
    # a host in many tasks is first merged in TURNS parts
    parts = partial.withColumn("turn", F.pmod("turn", F.lit(TURNS))).repartition("host", "turn").sortWithinPartitions("host", "turn", "wrapper")
    dealt = parts.mapInPandas(_align(False), "host string, turn long, wrapper string").repartition("host").sortWithinPartitions("host", "wrapper")
    return stored(dealt.mapInPandas(_align(True), "host string, rule string, expression string"), "wrappers")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict] = {}
    for batch in batches:
        for part in slices(batch, "html"):
            texts = []
            for page, rule in zip(part.column("html").to_pylist(), part.column("rule").to_pylist()):
                if rule not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[rule] = json.loads(rule)
                texts.append(main_text(page, known[rule]))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


#: Rules are some hundred bytes each.
BROADCAST_HOSTS = 20_000


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Null and empty html give an empty text; null url and null page_id stay; repeated rows are pages of their own. Texts
    are whole however long. An empty table gives no rows. Other columns are ignored.
    """
    rules = wrappers(pages).select("host", "rule")
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    kinds = dict(pages.dtypes)
    return hosted.join(if_small(rules, BROADCAST_HOSTS), "host").select("page_id", "url", "html", "rule").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages; nulls, empty and long pages, repeated rows, other columns and an empty table as in extract()."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
