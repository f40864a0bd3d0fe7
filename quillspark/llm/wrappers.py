"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page is a stream of tags and text. Its elements, by tag, class and id (digits
in those count as equal), give a regular expression without unions: items in
order, each once, optional (?) or repeated (+), and text slots (#). Adjacent
equal elements fold into a repeated one, as do adjacent equal runs of elements
of any length. Two expressions are aligned item by item, by the longest common
subsequence of their elements; matched items are aligned inside in turn, what
only one side has becomes optional, and what comes to stand beside its equal is
folded. Aligning all pages of a host leaves the host's wrapper, in which every
slot knows on how many pages it has text, how much, how much of it in links,
and whether that text is the same on all. All steps work down from the top with
a list of work, so depth costs no recursion.

The wrapper's slots decide. A slot is template text if it has the same text on
all of three pages or more; it carries weight if its text isn't that and not
linked. A page's stream is then matched with its host's wrapper, which tells
the slot of each text, and the page takes the most telling place that holds half
of its weight at least: its article elements, its main elements, containers that
their classes call content, else the least containers that hold all weight of
the host (else the place with most, else what isn't left out for good).

Left out are items that are navigation, headers (but those within an article),
footers, sidebars, forms, scripts, notices, adverts or comments, by element or by
class. A class counts only as a whole name (``notice``, not ``notice-board``),
beside classes that say something else only for plain cases such as adverts; it
doesn't count where the element holds more than half of the host's weight. Left
out too are template blocks: elements with a class, id or role that the wrapper
requires (no ? down from the place chosen) and whose slots are all template text
while others differ. Equal text in elements without a name stays.

Expressions are counted once in a batch, then merged ``FAN`` at a time by hash of
the expression, level by level until a host has one, so no task sees all pages
of a large host. Wrappers go to the pages by broadcast while they take
``BROADCAST`` bytes at most, else by a join.

Defined results: null or empty html, and pages without text, give an empty
text; a page without a host in its url belongs to the host ''; repeated rows
give equal texts; other columns are ignored; an empty table gives no rows;
elements may nest to any depth.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import slices, small_batches, stored, table

FAN, BROADCAST, HELD = 512, 32_000_000, 8_000_000
#: Elements, then words of class names and ids, whose content is no article text.
DROP_TAGS = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea label input menu dialog object head title meta link".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs header footer masthead comment comments respond disqus reply replies reactions cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended toolbar widget pagination pager skip hidden copyright".split()
)
#: Those of them that hold the articles of others.
OTHERS_WORDS = frozenset("comment comments respond disqus reply replies reactions related recommended".split())
#: Those that count beside other classes, and the words that may stand in one name with them.
FIRM_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsored sidebar nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus cookie cookies consent gdpr newsletter".split())
NEUTRAL_WORDS = frozenset("area bar block bottom box container item left list panel primary right secondary section site slot top unit wrap wrapper".split())
MAIN_WORDS = frozenset("article main content post entry story".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements of controls and code that stand within a line: they end no block.
WITHIN = INLINE | frozenset("button label input select textarea svg iframe object script style noscript template meta link".split())
#: Controls whose words belong to the line that they stand in, if that line has text of its own, and elements that hold lines.
CONTROLS = frozenset("button label".split())
LINES = frozenset("h1 h2 h3 h4 h5 h6 p li dd dt td th blockquote pre figcaption".split())
CONTAINERS = frozenset("html body div section article main center table tbody tr td".split())
#: An opening of one of these ends an open p.
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An opening of the first ends an open one of the others, up to the given container.
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(<)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[a-z]+")
_TAG = re.compile(r"[^.#@]*")
_NAMES = re.compile(r"[.#@]")
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://([^/?#]*)")


def element(tag: str, attributes: str) -> str:
    """An element's name in expressions: tag, role, classes and id."""
    if not attributes or "=" not in attributes:
        return tag
    found = sorted((m[1].lower(), _DIGITS.sub("0", (m[2] or m[3] or m[4] or "").strip().lower())) for m in _ATTRIBUTE.finditer(attributes))
    return tag + "".join({"class": ".", "id": "#", "role": "@"}[k] + ".".join(v.split()) for k, v in found if v).replace("/", "")


def stream(page: str) -> Iterator[tuple[str, str]]:
    """Events of a page: ("open", element), ("close", tag) in balance, and ("text", raw text)."""
    stack: list[str] = []
    held: Counter[str] = Counter()
    at, end = 0, len(page)

    def close(tag: str) -> Iterator[tuple[str, str]]:
        while stack:
            top = stack.pop()
            held[top] -= 1
            yield "close", top
            if top == tag:
                return

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:]
            break
        if m.start() > at:
            yield "text", page[at : m.start()]
        at = m.end()
        if m[4]:
            yield "text", "<"
        elif m[2]:
            tag = m[2].lower()
            if m[1]:
                if held[tag]:
                    yield from close(tag)
                continue
            if tag in CLOSES_P and held["p"]:
                for back in reversed(stack):
                    if back == "p":
                        yield from close("p")
                        break
                    if back in ("button", "table"):
                        break
            if tag in SIBLINGS:
                names, bounds = SIBLINGS[tag]
                if any(held[n] for n in names):
                    for back in reversed(stack):
                        if back in names:
                            yield from close(back)
                            break
                        if back in bounds:
                            break
            yield "open", element(tag, m[3])
            if tag in VOID or m[3].endswith("/"):
                yield "close", tag
                continue
            if tag in _RAW_END:
                stop = _RAW_END[tag].search(page, at)
                at = stop.end() if stop else end
                yield "close", tag
                continue
            stack.append(tag)
            held[tag] += 1
    while stack:
        yield "close", stack.pop()


# An item is [name, mark, lists, told]. Marks are "", "?", "+" and "*". The lists are those of the items inside, one
# for each element that was folded into the item; join() makes them one. A text slot is ["#", mark, [], told], a
# repeated run of elements is ["(names)", mark, runs, None]. Told is what a slot holds: numbers of a page's texts,
# or a tuple of pages, characters, those in links, and the least and greatest hash of a page's text there.


def _either(a: str, b: str) -> str:
    """The mark that allows what either mark does."""
    optional, repeated = {"?", "*"} & {a, b}, {"+", "*"} & {a, b}
    return "*" if optional and repeated else "?" if optional else "+" if repeated else ""


def _absorb(into: list, item: list) -> None:
    into[2] += item[2]
    x, y = into[3], item[3]
    into[3] = (x[0] + y[0], x[1] + y[1], x[2] + y[2], min(x[3], y[3]), max(x[4], y[4])) if type(x) is tuple else x + y if x is not None else None


def _names(items: list) -> list[str]:
    return [x[0] for x in items]


def fold(items: list) -> list:
    """Items with adjacent equal elements, and adjacent equal runs, made one repeated item."""
    out: list = []
    seen: dict[str, list[int]] = {}  # places of a name in out
    group = None  # the last group's place

    def drop(n: int) -> list:
        gone = out[-n:]
        del out[-n:]
        for x in gone:
            seen[x[0]].pop()
        return gone

    for item in items:
        name = item[0]
        if out and out[-1][0] == name:
            last = out[-1]
            last[1] = _either(last[1], item[1]) if name == "#" else _either(_either(last[1], item[1]), "+")
            _absorb(last, item)
            continue
        places = seen.setdefault(name, [])
        places.append(len(out))
        out.append(item)
        if name[0] == "(":
            group = len(out) - 1
            continue
        if group is not None and len(out) - 1 - group == len(out[group][2][0]) and _names(out[group + 1 :]) == _names(out[group][2][0]):
            out[group][2].append(drop(len(out) - 1 - group))
            out[group][1] = _either(out[group][1], "+")
            continue
        for before in reversed(places[:-1]):
            run = len(out) - 1 - before
            if before + 1 < run:
                break
            if group is not None and group >= len(out) - 2 * run:
                break
            if out[-2][0] == out[-2 - run][0] and _names(out[-2 * run : -run]) == _names(out[-run:]):
                second, first = drop(run), drop(run)
                label = f"({' '.join(_names(first))})"
                group = len(out)
                seen.setdefault(label, []).append(group)
                out.append([label, "+", [first, second], None])
                break
    return out


def common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by rows of bits."""
    begin, n, m = 0, len(x), len(y)
    while begin < min(n, m) and x[begin] == y[begin]:
        begin += 1
    while n > begin and m > begin and x[n - 1] == y[m - 1]:
        n, m = n - 1, m - 1
    places: dict[str, int] = {}
    for j in range(begin, m):
        places[y[j]] = places.get(y[j], 0) | 1 << (j - begin)
    rows, row, every = [], (1 << (m - begin)) - 1, (1 << (m - begin)) - 1
    for i in range(begin, n):  # a bit is 0 where the subsequence grows
        hit = row & places.get(x[i], 0)
        row = ((row + hit) | (row - hit)) & every
        rows.append(row)
    found, i, j = [], n - begin, m - begin
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                found.append((i + begin, j + begin))
    return [*((k, k) for k in range(begin)), *reversed(found), *((n + k, m + k) for k in range(len(x) - n))]


def regroup(items: list, groups: list[list[str]]) -> list:
    """Items with runs of the given names made groups."""
    for names in groups:
        out, at, n = [], 0, len(names)
        while at < len(items):
            if items[at][0] == names[0] and _names(items[at : at + n]) == names:
                out.append([f"({' '.join(names)})", "", [items[at : at + n]], None])
                at += n
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def _groups(items: list) -> list[list[str]]:
    return [_names(x[2][0]) for x in items if x[0][0] == "("]


def align(a: list, b: list) -> list:
    """The items that cover both lists of folded items; what is inside them is yet to be joined."""
    if not a or not b:
        for x in a or b:
            x[1] = _either(x[1], "?")
        return fold(a or b)
    if (x := _names(a)) != (y := _names(b)):
        more, less = _groups(a), _groups(b)
        a, b = regroup(a, less) if less else a, regroup(b, more) if more else b
        x, y = _names(a), _names(b)
    out, i, j = [], 0, 0
    for k, m in [*common(x, y), (len(a), len(b))]:
        for one in [*a[i:k], *b[j:m]]:
            one[1] = _either(one[1], "?")
            out.append(one)
        if k < len(a):
            a[k][1] = _either(a[k][1], b[m][1])
            _absorb(a[k], b[m])
            out.append(a[k])
        i, j = k + 1, m + 1
    return out if x == y else fold(out)


def join(lists: list[list]) -> list:
    """The expression that covers all lists of items, whatever is inside them joined in turn. The lists are used up."""
    top = ["", "", lists, None]
    work = [top]
    while work:
        item = work.pop()
        held = fold(item[2][0])
        for other in item[2][1:]:
            held = align(held, fold(other))
        item[2] = [held]
        work += [x for x in held if x[2]]
    return top[2][0]


def tree(events: list[tuple[str, str]]) -> tuple[list, list[str], list[bool]]:
    """A page's items, its texts and which of them are in links."""
    top: list = []
    open_, names, links = [top], [""], 0
    texts, linked = [], []
    for kind, value in events:
        if kind == "text":
            if not value.isspace():
                if open_[-1] and open_[-1][-1][0] == "#":
                    open_[-1][-1][3].append(len(texts))
                else:
                    open_[-1].append(["#", "", [], [len(texts)]])
                texts.append(value)
                linked.append(links > 0)
        elif kind == "open":
            inside: list = []
            open_[-1].append([value, "", [inside], None])
            open_.append(inside)
            names.append(value)
            links += _tag(value) == "a"
        else:
            open_.pop()
            links -= _tag(names.pop()) == "a"
    return top, texts, linked


def expression(page: str) -> tuple[str, list[tuple]]:
    """A page's expression, in writing, and what each of its slots holds."""
    top, texts, linked = tree([*stream(page)])
    shape, slots = write(join([top]))
    told = []
    for numbers in slots:
        h = xxhash.xxh3_64()
        for t in sorted(numbers):
            h.update(texts[t].encode("utf-8", "surrogatepass"))
        chars = sum(len(texts[t]) for t in numbers)
        told.append((1, chars, sum(len(texts[t]) for t in numbers if linked[t]), h.intdigest() - (1 << 63), h.intdigest() - (1 << 63)))
    return shape, told


def write(items: list) -> tuple[str, list]:
    """An expression as a line of tokens - a mark (. for none) and a name, ``/`` at an element's end - and what its slots hold."""
    out: list[str] = []
    told = []
    work: list = [*reversed(items)]
    while work:
        x = work.pop()
        if x == "/":
            out.append(x)
        elif x[0] == "#":
            out.append((x[1] or ".") + "#")
            told.append(x[3])
        else:
            out.append((x[1] or ".") + ("(" if x[0][0] == "(" else x[0]))
            work.append("/")
            work += reversed(x[2][0])
    return " ".join(out), told


def parse(shape: str, told: list[tuple]) -> list:
    """The items of an expression in writing."""
    top: list = []
    open_, slots = [top], iter(told)
    for token in shape.split(" ") if shape else ():
        if token == "/":
            open_.pop()
            if open_[-1][-1][0] == "(":
                open_[-1][-1][0] = f"({' '.join(_names(open_[-1][-1][2][0]))})"
            continue
        mark = token[0].strip(".")
        if token[1:] == "#":
            open_[-1].append(["#", mark, [], tuple(next(slots))])
        else:
            inside: list = []
            open_[-1].append([token[1:], mark, [inside], None])
            open_.append(inside)
    return top


def _tag(name: str) -> str:
    return _TAG.match(name)[0]


def _words(name: str) -> list[list[str]]:
    """The words of each class, id and role of an element."""
    return [w for w in map(_PARTS.findall, _NAMES.split(name)[1:]) if w]


def dropped(name: str) -> int:
    """Whether an element is no part of an article: 2 for always, 1 for unless it holds most text."""
    tag = _tag(name)
    if tag in DROP_TAGS:
        return 1 if tag == "form" else 2
    if tag in ("article", "main", "body", "html"):
        return 0
    words = _words(name)
    plain = [w for w in words if DROP_WORDS.issuperset(w)]
    firm = [w for w in words if not FIRM_WORDS.isdisjoint(w) and (DROP_WORDS | NEUTRAL_WORDS).issuperset(w)]
    told = {*firm[0]} if firm else {*plain[0]} if plain and len(plain) == len(words) else set()
    return 0 if not told else 2 if told & OTHERS_WORDS else 1


def landmark(name: str) -> int:
    """What an element's name says of its content."""
    tag, words = _tag(name), _words(name)
    if tag == "article":
        return ARTICLE
    if tag == "main" or words == [["main"]]:
        return MAIN
    return CONTENT if tag in ("div", "section", "td") and any(not MAIN_WORDS.isdisjoint(w) and DROP_WORDS.isdisjoint(w) for w in words) else 0


#: What is known of a place: in an article, a main element, a container called content, one of the least containers
#: of the host's weight; left out unless nothing else is there, left out; in a template block, template text.
ARTICLE, MAIN, CONTENT, LEAST, WEAK, NEVER, BLOCK, SAME = (1 << i for i in range(8))


def decide(wrapper: list) -> list[int]:
    """What is known of each item of a wrapper, in the order of its writing."""
    items, parent = [], []  # in writing order; groups count as their parent
    work = [(x, -1) for x in reversed(wrapper)]
    while work:
        x, above = work.pop()
        items.append(x)
        parent.append(above)
        if x[2]:
            work += [(y, len(items) - 1) for y in reversed(x[2][0])]
    n = len(items)
    real = [*range(n)]  # the element an item is or, for groups, is in
    for i, x in enumerate(items):
        if x[0][0] == "(":
            real[i] = real[parent[i]] if parent[i] >= 0 else -1
    up = [real[p] if p >= 0 else -1 for p in parent]
    known = [0] * n
    out = [0] * n  # how an element is left out
    lines = {p for p, x in zip(up, items, strict=True) if x[0] == "#" and p >= 0 and _tag(items[p][0]) in LINES}
    for i, x in enumerate(items):
        if real[i] != i:
            known[i] = known[real[i]] if real[i] >= 0 else 0
            continue
        above = known[up[i]] if up[i] >= 0 else 0
        if x[0] != "#":
            out[i] = dropped(x[0])
            if above & (ARTICLE | MAIN | CONTENT) and _tag(x[0]) == "header" or _tag(x[0]) in CONTROLS and up[i] in lines:
                out[i] = 0
        known[i] = above | (landmark(x[0]) if x[0] != "#" else 0) | (NEVER if out[i] == 2 else 0)
    slots = [i for i, x in enumerate(items) if x[0] == "#"]
    same = {i for i in slots if items[i][3][0] > 2 and items[i][3][3] == items[i][3][4]}
    if len(same) == len([i for i in slots if not known[i] & NEVER]):
        same = set()  # all pages alike: nothing differs that could tell
    weight = [0] * n
    for i in slots:
        if i not in same and not known[i] & NEVER:
            weight[i] = items[i][3][1] - items[i][3][2]
    mass = [*weight]
    for i in range(n - 1, -1, -1):
        if up[i] >= 0 and real[i] == i:
            mass[up[i]] += mass[i]
    total = sum(weight)
    for i in range(n):
        above = known[up[i]] if up[i] >= 0 else 0
        known[i] |= above & WEAK
        if out[i] == 1 and 2 * mass[i] <= total:
            known[i] |= WEAK
    # The least containers that hold all weight.
    inner: dict[int, list[int]] = defaultdict(list)
    for i in range(n):
        if real[i] == i:
            inner[up[i]].append(i)
    open_mass = [w if not known[i] & WEAK else 0 for i, w in enumerate(weight)]
    for i in range(n - 1, -1, -1):
        if up[i] >= 0 and real[i] == i:
            open_mass[up[i]] += open_mass[i]
    least, wide = {-1} if not any(open_mass) else set(), [-1] if any(open_mass) else []
    while wide:
        at = wide.pop()
        below = [i for i in inner[at] if open_mass[i]]
        if any(items[i][0] == "#" or _tag(items[i][0]) not in CONTAINERS for i in below):
            least.add(at)
        else:
            wide += below
    for i in range(n):
        if i in least or -1 in least or (up[i] if real[i] == i else real[i]) >= 0 and known[up[i] if real[i] == i else real[i]] & LEAST:
            known[i] |= LEAST
    # Template blocks: named, required down from a place, all slots the same, while others of the place differ.
    differ = [0] * n
    alike = [0] * n
    for i in slots:
        if not known[i] & (NEVER | WEAK):
            differ[i], alike[i] = int(items[i][3][3] != items[i][3][4]), int(i in same)
    fixed = [i in same or items[i][0] != "#" for i in range(n)]
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            differ[parent[i]] += differ[i]
            alike[parent[i]] += alike[i]
            fixed[parent[i]] = fixed[parent[i]] and fixed[i]
    everywhere = sum(differ[j] for j in range(n) if parent[j] < 0)
    place = [-2] * n  # the innermost place whose items are required down to here
    for i, x in enumerate(items):
        above = place[parent[i]] if parent[i] >= 0 else -1
        place[i] = -2 if x[1] in ("?", "*") else above
        named = x[0][0] not in "#(" and _NAMES.search(x[0]) is not None and _tag(x[0]) not in INLINE and _tag(x[0]) not in LINES
        here = everywhere if place[i] == -1 else differ[place[i]] if place[i] >= 0 else 0
        if place[i] != -2 and named and fixed[i] and alike[i] and here:
            known[i] |= BLOCK
        if x[0] != "#" and (landmark(x[0]) or i in least):
            place[i] = i
    for i in range(n):
        if parent[i] >= 0:
            known[i] |= known[parent[i]] & BLOCK
        if i in same:
            known[i] |= SAME
    return known


def prepared(shape: str, known: list[int]) -> tuple:
    """A wrapper for matching: names of its items, its groups, and of each item what is known and the items inside."""
    numbers = iter(range(len(known)))
    top: list = []
    open_: list = [top]
    for token in shape.split(" ") if shape else ():
        if token == "/":
            open_.pop()
        elif token[1:] == "#":
            open_[-1].append(["#", known[next(numbers)], None])
        else:
            inside: list = []
            open_[-1].append([token[1:], known[next(numbers)], inside])
            open_.append(inside)
    work, every = [top], []
    while work:
        items = work.pop()
        every.append(items)
        work += [x[2] for x in items if x[2] is not None]
    done: dict[int, tuple] = {}
    for items in reversed(every):
        for x in items:
            if x[2] is not None:
                x[2] = done[id(x[2])]
                if x[0] == "(":
                    x[0] = f"({' '.join(x[2][0])})"
        done[id(items)] = ([x[0] for x in items], [x[2][0] for x in items if x[0][0] == "("], items)
    return done[id(top)]


_NOTHING: tuple = ([], [], [])


def places(wrapper: tuple, top: list, count: int) -> list[int]:
    """What is known of each text of a page, by matching the page's items with its host's wrapper."""
    found = [0] * count
    work = [(wrapper, [top], 0, "")]
    while work:
        (names, groups, held), lists, above, within = work.pop()
        for one in lists:
            items = fold(one)
            if groups:
                items = regroup(items, groups)
            here = _names(items)
            line = within in LINES and "#" in here
            match = {i: i for i in range(len(items))} if here == names else dict(common(here, names)) if names else {}
            for i, x in enumerate(items):
                if i in match:
                    known, inside = held[match[i]][1:]
                else:
                    known, inside = above & ~SAME, _NOTHING
                    if x[0][0] not in "#(":
                        spared = above & (ARTICLE | MAIN | CONTENT) and _tag(x[0]) == "header" or line and _tag(x[0]) in CONTROLS
                        left = 0 if spared else dropped(x[0])
                        known |= landmark(x[0]) | (NEVER if left == 2 else WEAK if left else 0)
                if x[0] == "#":
                    for t in x[3]:
                        found[t] = known
                else:
                    work.append((inside, x[2], known, within if x[0][0] == "(" else _tag(x[0])))
    return found


def extract(page: str, wrapper: tuple = _NOTHING) -> str:
    """The text of a page by its host's wrapper, as blocks between empty lines."""
    events = [*stream(page)]
    top, texts, linked = tree(events)
    known = places(wrapper, top, len(texts))
    weight = [0 if link or k & (NEVER | WEAK | BLOCK | SAME) else len(t) for t, link, k in zip(texts, linked, known, strict=True)]
    total = sum(weight)

    def told(kind: int, without: int) -> str:
        return _read(events, [bool(k & kind or not kind) and not k & without for k in known])

    kinds = (ARTICLE, MAIN, CONTENT)
    for kind in kinds:
        held = sum(w for w, k in zip(weight, known, strict=True) if k & kind)
        if held and 2 * held >= total:
            kept = [bool(k & kind) and not k & (NEVER | WEAK | BLOCK) for k in known]
            if kind == ARTICLE and any(kept):
                # What its main says before the article is headline and standfirst.
                kept = [here or i < kept.index(True) and bool(w and k & MAIN) for i, (here, w, k) in enumerate(zip(kept, weight, known, strict=True))]
            if text := _read(events, kept):
                return text
    if total and (text := told(LEAST, NEVER | WEAK | BLOCK)):
        return text
    # Texts without weight: links alone, template text alone, or in what is left out otherwise.
    for without in (NEVER | WEAK | BLOCK, NEVER | WEAK, NEVER):
        for kind in (*kinds, LEAST, 0):
            if text := told(kind, without):
                return text
    return ""


def _read(events: list[tuple[str, str]], kept: list[bool]) -> str:
    """The kept texts of a page, block by block."""
    blocks: list[str] = []
    text: list[str] = []
    number = 0

    def end() -> None:
        if text and (block := " ".join(entities.unescape("".join(text)).split())):
            blocks.append(block)
        text.clear()

    for kind, value in events:
        if kind == "text":
            if value.isspace():
                text.append(" ")
            else:
                if kept[number]:
                    text.append(value)
                number += 1
        elif (tag := _tag(value) if kind == "open" else value) not in WITHIN:
            end()
        elif tag == "br" and kind == "open":
            text.append(" ")
    end()
    return "\n\n".join(blocks)


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


_TOLD = pa.list_(pa.struct([("pages", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))
_SHAPES = "host string, shape string, told array<struct<pages:long,chars:long,linked:long,low:long,high:long>>"


def _added(x: list[tuple], y: list[tuple]) -> list[tuple]:
    return [(a[0] + b[0], a[1] + b[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4])) for a, b in zip(x, y, strict=True)]


def _rows(found: list[tuple[str, str, list[tuple]]]) -> pa.RecordBatch:
    told = [[dict(zip(("pages", "chars", "linked", "low", "high"), t, strict=True)) for t in r[2]] for r in found]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.string()), pa.array(told, _TOLD)], ["host", "shape", "told"])


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (url, html) to expressions by host, equal ones added up while they are held."""
    held: dict[tuple[str, str], list[tuple]] = {}
    size = 0
    for batch in slices(batches, "html"):
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            shape, told = expression(page)
            key = (host(url), shape)
            if key in held:
                held[key] = _added(held[key], told)
            else:
                held[key] = told
                size += len(shape) + 200 * len(told)
        if size > HELD:
            yield _rows([(*k, t) for k, t in held.items()])
            held, size = {}, 0
    yield _rows([(*k, t) for k, t in held.items()])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host, part and shape: one expression for each host and part."""
    key, wrapper, last, told = None, None, None, []

    def settled() -> tuple[str, list[tuple]]:
        return write(join([wrapper, parse(last, told)]) if wrapper is not None else parse(last, told))

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            new, these = (row["host"], row["part"]), [tuple(t.values()) for t in row["told"]]
            if new == key and row["shape"] == last:
                told = _added(told, these)
                continue
            if new != key:
                if key is not None:
                    done.append((key[0], *settled()))
                key, wrapper = new, None
            else:
                wrapper = join([wrapper, parse(last, told)]) if wrapper is not None else parse(last, told)
            last, told = row["shape"], these
        if done:
            yield _rows(done)
    if key is not None:
        yield _rows([(key[0], *settled())])


def wrappers(pages: DataFrame) -> DataFrame:
    """host and its wrapper: shape, and what each slot holds."""
    level = stored(pages.select("url", "html").mapInArrow(_infer, _SHAPES), "shapes")
    while True:
        sizes = level.groupBy("host").agg(F.count("*").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= 1:
            return level
        parted = level.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("shape"), F.ceil(F.col("n") / FAN)))
        parted = parted.select("host", "part", "shape", "told").repartition("host", "part").sortWithinPartitions("host", "part", "shape")
        level = stored(parted.mapInArrow(_merge, _SHAPES), "shapes")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row."""
    small_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = batch.column("shape").to_pylist()
            known = [decide(parse(s, [tuple(x.values()) for x in t])) for s, t in zip(shapes, batch.column("told").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("shape"), pa.array(known, pa.list_(pa.int64()))], ["host", "shape", "known"])

    ruled = stored(wrappers(pages).mapInArrow(rules, "host string, shape string, known array<long>"), "rules")
    size = ruled.agg(F.sum(F.octet_length("shape") + 8 * F.size("known") + F.octet_length("host"))).first()[0] or 0
    asked = pages.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#]*@)?([^/?#@]*)", 1)))
    joined = asked.join(F.broadcast(ruled) if size <= BROADCAST else ruled, "host", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, tuple] = {}
        for batch in slices(batches, "html"):
            texts = []
            for name, page, shape, known in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("shape").to_pylist(), batch.column("known"), strict=True):
                if name not in ready:
                    if len(ready) > 1_000:
                        ready.clear()
                    ready[name] = prepared(shape or "", known.as_py() or [])
                texts.append(extract(page, ready[name]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "host", "shape", "known").mapInArrow(read, "page_id long, url string, text string")


def op5_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
