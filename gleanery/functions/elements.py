"""The elements of a page as intervals, and selectors with combinators over them.

A selector is a comma list of alternatives, each a row of compounds joined by a space
(descendant), `>` (child), `+` (next sibling) or `~` (later sibling), with an optional
`@attribute` at the end. A compound is made of a tag or `*`, `#id`, `.class`,
`[attr]`, `[attr=value]` (also `~=`, `|=`, `^=`, `$=`, `*=`) and the positions
`:first-child`, `:last-child`, `:only-child`, `:nth-child(an+b)` and the same
`of-type`. Any other form is an error, not read as something else.

A page is scanned once. Each element keeps its interval, its parent and its place among
its siblings; a step of a selector is reached by what the parent, the ancestors or the
siblings have reached before, so matching is linear in the page too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, functions as F

from gleanery.functions.selectors import FIELD_ATTRIBUTES

# Fixed values of HTML: elements without content, and open elements that a tag ends, up to
# the elements named last.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TABLE = frozenset({"table"})
IMPLIED_ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), _TABLE),
    "td": (frozenset({"td", "th"}), _TABLE | {"tr"}),
    "th": (frozenset({"td", "th"}), _TABLE | {"tr"}),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
# Tags that end an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)(?=[\s/>])(?P<raw_rest>[^>]*+)>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<rest>(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'<>]++)))?")


class Element:
    """One element: its tag, what stands after the name in its tag, and its interval."""

    __slots__ = (
        "tag", "rest", "start", "inner", "inner_end", "parent", "nth", "nth_of_type", "previous",
        "children", "of_type", "last_child", "_attributes",
    )

    def __init__(self, tag: str, rest: str, start: int, inner: int, parent: int):
        self.tag, self.rest, self.start, self.inner, self.parent = tag, rest, start, inner, parent
        self.inner_end, self.nth, self.nth_of_type, self.previous = inner, 1, 1, 0
        self.children, self.of_type, self.last_child = 0, None, 0
        self._attributes = None

    def attributes(self) -> dict[str, str]:
        """Names in lower case; the first of a repeated name counts."""
        if self._attributes is None:
            self._attributes = {}
            for name, double, single, bare in _ATTRIBUTE.findall(self.rest):
                self._attributes.setdefault(name.lower(), double or single or bare)
        return self._attributes

    def add_child(self, number: int, child: Element) -> None:
        if self.of_type is None:
            self.of_type = {}
        self.children += 1
        self.of_type[child.tag] = self.of_type.get(child.tag, 0) + 1
        child.nth, child.nth_of_type, child.previous = self.children, self.of_type[child.tag], self.last_child
        self.last_child = number


def elements(page: str) -> list[Element]:
    """All elements in page order after a root that holds them. An element ends at its end
    tag, where its parent ends, or where a tag implies its end."""
    root = Element("", "", 0, 0, -1)
    root.inner_end = len(page)
    found, stack = [root], [0]
    # Where in the stack the open elements of a tag are, so that no end is searched for.
    depths: dict[str, list[int]] = {}

    def close_from(depth: int, at: int) -> None:
        for number in reversed(stack[depth:]):
            found[number].inner_end = at
            depths[found[number].tag].pop()
        del stack[depth:]

    def innermost(tags) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    for match in _MARKUP.finditer(page):
        raw = match["raw"]
        tag = raw or match["tag"]
        if tag is None:
            continue
        tag, at = tag.lower(), match.start()
        if match["end"]:
            if depths.get(tag):
                close_from(depths[tag][-1], at)
            continue
        if tag in IMPLIED_ENDS:
            ended, until = IMPLIED_ENDS[tag]
            depth = max(innermost(until) + 1, 1)
            open_ones = [d for t in ended for d in depths.get(t, ())[-1:] if d >= depth]
            if open_ones:
                close_from(_outermost(ended, depths, depth) if tag == "tr" else max(open_ones), at)
        if tag in ENDS_PARAGRAPH and found[stack[-1]].tag == "p":
            close_from(len(stack) - 1, at)
        rest = match["raw_rest"] if raw else match["rest"]
        element = Element(tag, rest, at, match.end("raw_rest") + 1 if raw else match.end(), stack[-1])
        found[stack[-1]].add_child(len(found), element)
        found.append(element)
        if raw:
            element.inner_end = match.end()
        elif tag not in VOID and not (tag == "svg" and rest.endswith("/")):
            depths.setdefault(tag, []).append(len(stack))
            stack.append(len(found) - 1)
    close_from(1, len(page))
    return found


def _outermost(tags: frozenset[str], depths: dict[str, list[int]], depth: int) -> int:
    """The outermost open element of the tags from a depth on: a row ends its row and cells."""
    return min(d for t in tags for d in depths.get(t, ()) if d >= depth)


# --- selectors --------------------------------------------------------------------

_NAME = r"-?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff-]*"
_PART = re.compile(
    rf"(?P<tag>\*|{_NAME})"
    rf"|\#(?P<id>[\w\u0080-\U0010ffff-]+)"
    rf"|\.(?P<cls>[\w\u0080-\U0010ffff-]+)"
    rf"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>\"[^\"]*\"|'[^']*'|[^\]\s\"']+)\s*)?\]"
    rf"|:(?P<position>first-child|last-child|only-child|first-of-type|last-of-type|only-of-type"
    rf"|nth-child|nth-of-type|nth-last-child|nth-last-of-type)(?:\(\s*(?P<nth>[^()]*?)\s*\))?"
)
_NTH = re.compile(r"(?:(?P<a>[+-]?\d*)n(?:\s*(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+)|(?P<word>odd|even))")
_ATTRIBUTE_END = re.compile(r"@([\w:-]+)\s*$")


class UnreadableSelector(ValueError):
    def __init__(self, text: str):
        super().__init__(f"unreadable selector: {text.strip()}")


@dataclass
class Compound:
    tag: str = "*"
    tests: list[tuple] = field(default_factory=list)

    def matches(self, page: list[Element], element: Element) -> bool:
        if self.tag != "*" and self.tag != element.tag:
            return False
        for kind, *args in self.tests:
            if kind == "attr":
                name, op, value = args
                have = element.attributes().get(name)
                if have is None or not _compared(have, op, value):
                    return False
            else:
                of_type, from_end, a, b = args
                parent = page[element.parent]
                nth = element.nth_of_type if of_type else element.nth
                if from_end:
                    nth = (parent.of_type[element.tag] if of_type else parent.children) + 1 - nth
                steps = nth - b
                if (steps != 0) if a == 0 else (steps % a != 0 or steps // a < 0):
                    return False
        return True


def _compared(have: str, op: str | None, value: str) -> bool:
    if op is None:
        return True
    if op == "=":
        return have == value
    if op == "~=":
        return value in have.split()
    if op == "|=":
        return have == value or have.startswith(value + "-")
    if not value:
        return False
    return have.startswith(value) if op == "^=" else have.endswith(value) if op == "$=" else value in have


def _nth(text: str | None, selector: str) -> tuple[int, int]:
    found = _NTH.fullmatch((text or "").lower())
    if found is None:
        raise UnreadableSelector(selector)
    if found["word"]:
        return 2, int(found["word"] == "odd")
    if found["only"]:
        return 0, int(found["only"])
    a = int(found["a"] + "1" if found["a"] in ("", "+", "-") else found["a"])
    return a, int((found["sign"] or "") + (found["b"] or "0"))


def _compound(text: str, at: int, selector: str) -> tuple[Compound, int]:
    made, first = Compound(), at
    while part := _PART.match(text, at):
        if part["tag"]:
            if at != first:
                break
            made.tag = part["tag"].lower()
        elif part["id"]:
            made.tests.append(("attr", "id", "=", part["id"]))
        elif part["cls"]:
            made.tests.append(("attr", "class", "~=", part["cls"]))
        elif part["attr"]:
            value = part["value"] or ""
            value = value[1:-1] if value[:1] in ("'", '"') else value
            made.tests.append(("attr", part["attr"].lower(), part["op"], value))
        else:
            name = part["position"]
            numbered = name.startswith("nth")
            if numbered != (part["nth"] is not None):
                raise UnreadableSelector(selector)
            of_type, last = name.endswith("of-type"), "last" in name
            if name.startswith("only"):
                made.tests += [("nth", of_type, False, 0, 1), ("nth", of_type, True, 0, 1)]
            else:
                made.tests.append(("nth", of_type, last, *(_nth(part["nth"], selector) if numbered else (0, 1))))
        at = part.end()
    if at == first:
        raise UnreadableSelector(selector)
    return made, at


@dataclass
class Path:
    """One alternative: compounds with the combinator before each, and the attribute read."""

    steps: list[tuple[str, Compound]]
    attribute: str | None

    def matched(self, page: list[Element]) -> list[int]:
        """Elements that match, in page order."""
        steps = self.steps
        if len(steps) == 1:
            own = steps[0][1]
            return [k for k in range(1, len(page)) if own.matches(page, page[k])]
        last = 1 << (len(steps) - 1)
        reached, above, earlier = [0] * len(page), [0] * len(page), [0] * len(page)
        found = []
        for k in range(1, len(page)):
            element = page[k]
            parent, previous = element.parent, element.previous
            if previous > 0:
                earlier[k] = earlier[previous] | reached[previous]
            before = {" ": above[parent], ">": reached[parent], "~": earlier[k]}
            before["+"] = reached[previous] if previous > 0 else 0
            mask = 0
            for i, (combinator, compound) in enumerate(steps):
                if (i == 0 or before[combinator] >> (i - 1) & 1) and compound.matches(page, element):
                    mask |= 1 << i
            reached[k] = mask
            above[k] = above[parent] | mask
            if mask & last:
                found.append(k)
        return found


def parse_selector(selector: str, attribute: str | None = None) -> list[Path]:
    """The alternatives of a selector, in order; `attribute` is read where one names none."""
    paths, at = [], 0
    while True:
        steps: list[tuple[str, Compound]] = []
        combinator = ""
        own = attribute
        while True:
            at += len(selector[at:]) - len(selector[at:].lstrip())
            compound, at = _compound(selector, at, selector)
            steps.append((combinator, compound))
            joined = re.compile(r"\s*([>+~])\s*|\s+(?=[^\s,@])").match(selector, at)
            if joined is None:
                break
            combinator, at = joined[1] or " ", joined.end()
        ending = re.compile(r"\s*(?:@([\w:-]+)\s*)?(,|$)").match(selector, at)
        if ending is None:
            raise UnreadableSelector(selector)
        paths.append(Path(steps, ending[1].lower() if ending[1] else own))
        at = ending.end()
        if ending[2] != ",":
            return paths


# --- items ------------------------------------------------------------------------

_UNSEEN = re.compile(r"(?is)<(?:script|style)\b.*?(?:</(?:script|style)\s*>|\Z)|<!--.*?(?:-->|\Z)|<[a-z/!?][^>]*+(?:>|\Z)|&nbsp;|&#160;")


def _is_blank(markup: str) -> bool:
    return not markup.strip() or not _UNSEEN.sub(" ", markup).strip()


def read_items(page: str, fields: dict[str, list[Path]], every: bool = False) -> list[list[tuple[str, list[str]]]]:
    """Per container (or for the page, where none is named) the candidates of each field.

    A candidate is an attribute or the markup inside an element. Elements belong to the
    innermost container around them. Candidates come in the order of the alternatives, then
    of the page, up to the first that is not blank, or all of them with `every`.
    """
    table = elements(page)
    if "container" in fields:
        starts = sorted({k for path in fields["container"] for k in path.matched(table)})
    else:
        starts = [0]
    is_start = [False] * len(table)
    for k in starts:
        is_start[k] = True
    owner = [0] * len(table)
    for k in range(1, len(table)):
        parent = table[k].parent
        owner[k] = parent if is_start[parent] else owner[parent]
    found: dict[int, dict[str, list[str]]] = {k: {} for k in starts}
    for name, paths in fields.items():
        if name == "container":
            continue
        done: set[int] = set()
        for path in paths:
            for k in path.matched(table):
                item = owner[k]
                if item in done or item not in found:
                    continue
                if path.attribute:
                    value = table[k].attributes().get(path.attribute, "")
                else:
                    value = page[table[k].inner : table[k].inner_end]
                found[item].setdefault(name, []).append(value)
                if not every and not _is_blank(value):
                    done.add(item)
    return [list(found[k].items()) for k in starts]


FOUND = "items array<map<string,array<string>>>, error string"


def _reader(every: bool):
    kind = pa.struct(
        [("items", pa.list_(pa.map_(pa.string(), pa.list_(pa.string())))), ("error", pa.string())]
    )

    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[tuple, dict[str, list[Path]] | str] = {}
        for pages, selectors in batches:
            rows = []
            for page, listed in zip(pages.to_pylist(), selectors.to_pylist()):
                if page is None or listed is None:
                    rows.append(None)
                    continue
                rule = tuple(listed)
                if rule not in known:
                    if len(known) > 10_000:
                        known.clear()
                    try:
                        known[rule] = {n: parse_selector(s or "", FIELD_ATTRIBUTES.get(n)) for n, s in rule}
                    except UnreadableSelector as error:
                        known[rule] = str(error)
                fields = known[rule]
                if isinstance(fields, str):
                    rows.append({"items": None, "error": fields})
                else:
                    rows.append({"items": read_items(page, fields, every), "error": None})
            yield pa.array(rows, kind)

    return F.arrow_udf(read, FOUND)


def page_items(markup: Column, selectors: Column, every: bool = False) -> Column:
    """Struct of `items` (field -> candidates, one map per container) and `error` (a
    selector that cannot be read). Null where the page or the selectors are null."""
    return _reader(every)(markup, selectors)


# A leaf form that a pattern reads: one compound with one test at most.
LEAF = r"""^\s*(?:[A-Za-z][A-Za-z0-9-]*)?(?:\.[\w-]+|#[\w-]+|\[\s*[\w:-]+\s*(?:=\s*["']?[^"'\],]*["']?\s*)?\])?(?:@[\w:-]+)?\s*$"""


def needs_elements(selectors: Column) -> Column:
    """Whether a map of selectors has a container, or one that is not a list of leaf forms."""
    plain = F.forall(
        F.map_values(selectors),
        lambda listed: F.forall(F.split(listed, ","), lambda s: F.rlike(s, F.lit(LEAF)) & (F.trim(s) != "")),
    )
    return F.coalesce(F.map_contains_key(selectors, "container") | ~plain, F.lit(False))
