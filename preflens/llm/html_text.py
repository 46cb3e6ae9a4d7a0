"""Main text of HTML pages by markup and by strings repeated over a host's pages.

1. Markup. A page becomes blocks of text in one pass. Elements that are never main
   text (menus, headers, footers, sidebars, forms, scripts, adverts, comments, by
   tag, role, class or id) are left out; if the page has an `article` or `main`
   element, only what lies inside counts. Where text lies decides against names: a
   part of the layout that wraps all of the main elements and a `main` or more than
   half of the prose stays, more prose beside the main elements than in them counts
   too, and if nothing is left, frames that hold the article or paragraphs open.
2. Host suffix array. The blocks of a page are one stream of tokens. Of the
   suffixes of all streams those at anchors are kept (the smallest name among the
   starts in a string of LONG tokens, so equal strings have equal anchors), named
   by doubling over tokens, and grouped by (host, name). Names found on enough
   pages of a host are candidates.
3. The strings of LONG tokens whose anchor is a candidate are named as a whole and
   grouped by (host, name). Those found on LEAST_PAGES pages of a host or more are
   boilerplate. Pages of a host with equal streams count as one page.
4. Exactly the tokens that lie in such a string are cut out; all others stay.

Names are 64-bit hashes; strings of a host with one name count as equal.

Copies of one article stay whole, since they are one page; copies that differ in
a token are different pages. No page is compared with pages of other hosts.

Defined cases: null html gives no blocks and an empty text, a null url the host
''. Pages without any markup are one block. Repeated rows are equal streams. Broken markup never fails: unknown
or unclosed elements end with their parent, an unclosed comment or script ends with
the page, a tag with an unclosed quote ends at its first `>`, and `<` that starts no
tag, as in `a <b and c> d`, is text. An empty table gives no rows. Only the three
named columns are read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .store import saved

LONG = 20
ANCHOR = 8
WINDOW = LONG - ANCHOR + 1
#: Distinct pages of a host on which boilerplate stands.
LEAST_PAGES = 4

#: A block of so many words outside links is prose.
PROSE = 20

_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")
_NAME = re.compile(r"[a-zA-Z][^\s/><]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=<]+)(\s*=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "textarea", "select", "title"}
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in _RAW}
_VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_INLINE = set("a abbr b big cite code del em font i ins kbd mark q s samp small span strong sub sup time tt u var".split())
_KNOWN = _BLOCK | _RAW | _VOID | _INLINE
#: A start tag of these ends an open element of the same name.
_SAME_ENDS = {"li", "dt", "dd", "tr", "td", "th"}
#: Attributes that stand without a value.
_BARE = set("allowfullscreen async autofocus autoplay checked compact controls default defer disabled hidden inert itemscope loop multiple muted nomodule noshade nowrap open playsinline readonly required reversed selected".split())
#: Never main text, whatever lies inside.
_NEVER = {"button", "dialog", "head", "label", "input", "option"}
#: Left out, but unclosed or misused they may wrap a whole page.
_FRAME = {"nav", "footer", "aside", "menu", "form", "header"}
#: Words of a class, id or role that name what is no main text.
_WORDS = set(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus footer form header login masthead menu modal nav navbar navigation newsletter "
    "notice notices pagination popup promo promoted promotion related respond search share sharing sidebar signup "
    "social sponsor sponsored subscribe toolbar widget".split()
)
#: Words of parts of a layout; elements named by them may wrap the main text.
_LAYOUT = set("banner form header masthead menu modal nav navbar navigation search sidebar toolbar widget".split())
#: Words that name the head of an article inside main text.
_HEADS = {"banner", "header", "masthead"}
#: A name that starts so tells of a layout (has-sidebar), not of the element itself.
_MODIFIERS = {"has", "no", "not", "with", "without"}
#: Inside main text these are left out by tag, role or being hidden, not by a word of their class or id.
_PROSE = set("h1 h2 h3 h4 h5 h6 hgroup header p a blockquote pre b i em strong span mark cite q code".split())
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")

KEPT, FRAME, LAYOUT, SIDE, GONE = range(5)


def _side_words(value: str, heads_count: bool) -> set[str]:
    found: set[str] = set()
    for name in value.split():
        words = [w.lower() for w in _SPLIT.split(name) if w]
        if words and words[0] not in _MODIFIERS:
            found.update(w for w in words if w in _WORDS and (heads_count or w not in _HEADS))
    return found


def _kind(tag: str, named: dict[str, str], inside: bool) -> int:
    """How sure it is that an element is no main text."""
    if not named and tag not in _NEVER and tag not in _FRAME:
        return KEPT
    if tag in _NEVER or "hidden" in named or named.get("aria-hidden", "").strip().lower() == "true":
        return GONE
    if "style" in named and _NO_DISPLAY.search(named["style"]):
        return GONE
    if tag in _FRAME and not (tag == "header" and inside):
        return LAYOUT if tag == "form" else FRAME
    if tag in ("body", "html", "article", "main"):
        return KEPT
    if "role" in named and _side_words(named["role"], True):
        return FRAME
    if inside and tag in _PROSE:
        return KEPT
    found = _side_words(named.get("class", ""), not inside) | _side_words(named.get("id", ""), not inside)
    return KEPT if not found else LAYOUT if found <= _LAYOUT else SIDE


class _Scanner:
    """Start and end tags of a page, each character looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}

    def past(self, start: int) -> int:
        end = self.page.find(">", start)
        return len(self.page) if end < 0 else end + 1

    def tag(self, at: int) -> tuple[int, str, dict[str, str], bool, bool]:
        """End, name, attributes, whether it closes itself, and whether it is text, of what starts at the `<` at `at`."""
        page = self.page
        found = _NAME.match(page, at + 1)
        tag, here = found[0].lower(), found.end()
        named: dict[str, str] = {}
        bare, valued, itself = False, False, False
        while True:
            found = _ATTRIBUTE.match(page, here)
            if not found:
                break
            key, here = found[1].lower(), found.end()
            value = ""
            if found[2]:
                valued = True
                quote = page[here : here + 1]
                if quote in self.last and quote:
                    end = page.find(quote, here + 1) if self.last[quote] > here else -1
                    value = page[here + 1 : end] if end >= 0 else ""
                    # The quote was never closed, or what closes it opens the next tag's value.
                    if end < 0 or (value.endswith("=") and ">" in value and "<" in value):
                        return self.past(here), tag, named, False, False
                    here = end + 1
                else:
                    unquoted = _UNQUOTED.match(page, here)
                    value, here = unquoted[0], unquoted.end()
            elif key not in _BARE and "-" not in key:
                bare = True
            named.setdefault(key, value)  # the first of a name counts
        while here < len(page) and (page[here].isspace() or page[here] in "/="):
            itself = page[here] == "/" or (itself and page[here].isspace())
            here += 1
        closed = page[here : here + 1] == ">"
        # Prose such as `a <b and c> d`, or an unknown name that no `>` ends.
        is_text = (bare and not valued and tag not in _BLOCK | _RAW | _VOID) or (not closed and tag not in _KNOWN)
        return here + closed, tag, named, itself, is_text


class _Page:
    """What decides about a page's text: its elements that are not plainly kept, in the order in which they start,
    and its blocks as segments of text by the innermost such element (0: none)."""

    def __init__(self, page: str):
        self.parent, self.kind, self.inside, self.linked = [-1], [KEPT], [False], [False]
        self.main_element = [False]
        self.blocks: list[list[tuple[int, str, int]]] = []  # element, text, words
        self.held: list[tuple[int, str]] = []
        self._read(page)
        self.close()

    def close(self) -> None:
        if self.held:
            self.blocks.append([(e, t, len(t.split())) for e, t in self.held])
            self.held = []

    def _read(self, page: str) -> None:
        scanner = _Scanner(page)
        stack: list[tuple[str, int]] = [("", 0)]  # tag, element
        places: dict[str, list[int]] = {}  # places of a tag's open elements in the stack
        open_blocks: list[int] = [0]
        at, size = 0, len(page)

        def pop() -> None:
            tag, _ = stack.pop()
            places[tag].pop()
            if open_blocks[-1] == len(stack):
                open_blocks.pop()

        def text(start: int, end: int) -> None:
            if start < end:
                self.held.append((stack[-1][1], page[start:end]))

        while at < size:
            lt = page.find("<", at)
            if lt < 0:
                break
            text(at, lt)
            plain = _PLAIN.match(page, lt)
            if plain:
                at, ends, tag, named, itself = plain.end(), bool(plain[1]), plain[2].lower(), {}, False
            else:
                after = page[lt + 1 : lt + 2]
                if page.startswith("<!--", lt):
                    at = page.find("-->", lt + 2)
                    at = size if at < 0 else at + 3
                    continue
                if after in ("!", "?"):
                    at = scanner.past(lt)
                    continue
                ends = after == "/"
                first = page[lt + 2 : lt + 3] if ends else after
                if not (first.isascii() and first.isalpha()):
                    text(lt, lt + 1)
                    at = lt + 1
                    continue
                at, tag, named, itself, is_text = scanner.tag(lt + ends)
                if is_text and not ends:
                    text(lt, at)
                    continue
            if tag in _BLOCK:
                self.close()
            elif tag == "br":
                self.held.append((stack[-1][1], " "))
            if ends:
                place = places.get(tag)
                # The end of an inline element ends no block that started inside it.
                if place and (tag in _BLOCK or place[-1] > open_blocks[-1]):
                    floor = place[-1]
                    while len(stack) > floor:
                        pop()
                continue
            if tag in _VOID or itself:
                continue
            if tag in _RAW:
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else size
                continue
            nearest = stack[open_blocks[-1]][0]
            if tag in _BLOCK and (nearest == "p" or (nearest == tag and tag in _SAME_ENDS)):
                floor = open_blocks[-1]
                while len(stack) > floor:
                    pop()
            element = stack[-1][1]
            kind = _kind(tag, named, self.inside[element])
            is_main = tag in ("article", "main")
            if kind != KEPT or is_main or (tag == "a" and not self.linked[element]):
                self.parent.append(element)
                self.kind.append(kind)
                self.inside.append(self.inside[element] or is_main)
                self.linked.append(self.linked[element] or tag == "a")
                self.main_element.append(tag == "main")
                element = len(self.parent) - 1
            places.setdefault(tag, []).append(len(stack))
            if tag in _BLOCK:
                open_blocks.append(len(stack))
            stack.append((tag, element))
        else:
            return
        text(at, size)

    def _summed(self, own: list[int]) -> list[int]:
        """Sums over an element and all inside it."""
        total = list(own)
        for e in range(len(total) - 1, 0, -1):
            total[self.parent[e]] += total[e]
        return total

    def _out(self, opened: list[bool]) -> list[bool]:
        out = [False] * len(self.parent)
        for e in range(1, len(out)):
            out[e] = out[self.parent[e]] or (self.kind[e] != KEPT and not opened[e])
        return out

    def _kept(self, out: list[bool]) -> list[tuple[bool, int, str]]:
        """Whether inside main elements, words of prose, and text of every block that is left."""
        found = []
        for segments in self.blocks:
            left = [s for s in segments if not out[s[0]]]
            words = " ".join(references.unescape("".join([s[1] for s in left])).split())
            if words:
                unlinked = sum([s[2] for s in left if not self.linked[s[0]]])
                found.append((self.inside[left[0][0]], unlinked if unlinked >= PROSE else 0, words))
        return found

    def main(self) -> list[str]:
        size = len(self.parent)
        barred = self._out([k in (KEPT, FRAME, LAYOUT) for k in self.kind])  # surely no main text
        prose, words, mains, paragraphs = ([0] * size for _ in range(4))
        for segments in self.blocks:
            counted = [(e, n) for e, _, n in segments if not barred[e]]
            if counted:
                element = counted[0][0]
                unlinked = sum(n for e, n in counted if not self.linked[e])
                if unlinked >= PROSE:
                    prose[element] += unlinked
                    paragraphs[element] += 1
                if self.inside[element]:
                    words[element] += sum(n for _, n in counted)
        for e in range(size):
            mains[e] = int(self.main_element[e] and not barred[e])
        prose, words, mains, paragraphs = map(self._summed, (prose, words, mains, paragraphs))
        kind = self.kind
        opened = [
            kind[e] == LAYOUT
            and words[e] == words[0]
            and (mains[e] > 0 or 2 * prose[e] > prose[0] or (prose[0] == 0 and words[e] > 0))
            or (kind[e] == SIDE and mains[e] > 0)
            for e in range(size)
        ]
        found = self._kept(self._out(opened))
        if not found:
            # A frame that was never closed, or holds the article.
            opened = [
                opened[e] or (kind[e] in (FRAME, LAYOUT) and (words[e] > 0 or paragraphs[e] >= 3)) for e in range(size)
            ]
            found = self._kept(self._out(opened))
        inner = [b for b in found if b[0]]
        beside = sum(n for is_inner, n, _ in found if not is_inner)
        has_main = any(self.inside[e] and not barred[e] for e in range(size))
        if has_main and beside <= sum(n for _, n, _ in inner):
            found = inner
        return [text for _, _, text in found]


def blocks(page: str | None) -> list[str]:
    """Blocks of text that markup does not rule out, in page order, white space collapsed."""
    return _Page(page or "").main()


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    name = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return name ^ (name >> np.uint64(32))


def _names(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the strings of ANCHOR tokens and of LONG tokens at every place, by doubling."""
    name = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), dtype=np.uint64, count=len(tokens))
    n, short = 1, name
    while 2 * n <= LONG:
        name = _joined(name[:-n], name[n:])
        n *= 2
        short = name if n == ANCHOR else short
    rest = LONG - n
    return short, _joined(name[: len(name) - rest], name[rest:]) if rest else name


def _strings(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The name of the anchor and of the whole of the string of LONG tokens at every place."""
    if len(tokens) < LONG:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    short, whole = _names(tokens)
    windows = np.lib.stride_tricks.sliding_window_view(short, WINDOW)
    return windows.min(axis=1).view(np.int64), whole.view(np.int64)


def anchors(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and names of all strings of LONG tokens."""
    whole = _strings(tokens)[1]
    return np.arange(len(whole)), whole


def _packed(parts: list[str]) -> bytes:
    """Blocks as they travel: a block has no line break."""
    return zstandard.compress("\n".join(parts).encode("utf-8", "surrogatepass"))


def _unpacked(packed: bytes) -> list[str]:
    text = zstandard.decompress(packed).decode("utf-8", "surrogatepass")
    return text.split("\n") if text else []


def _signed_digest(text: str) -> np.int64:
    return np.uint64(xxhash.xxh3_64_intdigest(text)).view(np.int64)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [blocks(h) for h in batch["html"]]
        yield pd.DataFrame(
            {
                "page_id": batch["page_id"],
                "url": batch["url"],
                "host": [_signed_digest(_host(u)) for u in batch["url"]],
                "blocks": [_packed(b) for b in found],
                "stream": [_signed_digest(" ".join(b)) for b in found],
            }
        )


def _host(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


def _stream(parts) -> list[str]:
    return " ".join(parts).split(" ")


def _suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The anchors of every page."""
    for batch in batches:
        row, host, name = [], [], []
        for r, h, b in zip(batch["row_id"], batch["host"], batch["blocks"]):
            found = np.unique(_strings(_stream(_unpacked(b)))[0])
            row.append(np.full(len(found), r))
            host.append(np.full(len(found), h))
            name.append(found)
        if row:
            yield pd.DataFrame({"row_id": np.concatenate(row), "host": np.concatenate(host), "name": np.concatenate(name)})


def _long_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The strings of LONG tokens whose anchors are candidates."""
    for batch in batches:
        row, host, stream, name = [], [], [], []
        for r, h, d, b, candidates in zip(*(batch[c] for c in ("row_id", "host", "stream", "blocks", "names"))):
            anchor, whole = _strings(_stream(_unpacked(b)))
            found = np.unique(whole[np.isin(anchor, candidates)])
            row.append(np.full(len(found), r))
            host.append(np.full(len(found), h))
            stream.append(np.full(len(found), d))
            name.append(found)
        if row:
            fields = {"row_id": row, "host": host, "stream": stream, "name": name}
            yield pd.DataFrame({k: np.concatenate(v) for k, v in fields.items()})


def _without(parts: list[str], marked: set[int]) -> list[str]:
    """Blocks without the tokens that lie in a marked string of LONG tokens."""
    tokens = [p.split(" ") for p in parts]
    stream = [t for p in tokens for t in p]
    starts = np.flatnonzero(np.isin(anchors(stream)[1], np.fromiter(marked, np.int64, len(marked))))
    steps = np.zeros(len(stream) + 1, dtype=np.int64)
    steps[starts] += 1
    steps[starts + LONG] -= 1
    gone = np.cumsum(steps[:-1]) > 0
    edges = np.cumsum([0, *[len(p) for p in tokens]])
    out = []
    for k, p in enumerate(tokens):
        kept = [t for t, g in zip(p, gone[edges[k] : edges[k + 1]]) if not g]
        if kept:
            out.append(" ".join(kept))
    return out


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [
            "\n".join(b if n is None or not len(n) else _without(b, set(map(int, n))))
            for b, n in zip(map(_unpacked, batch["blocks"]), batch["names"])
        ]
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})


def _on_enough_pages(names: DataFrame) -> DataFrame:
    """host, name of the names that stand on enough pages of their host."""
    return names.groupBy("host", "name").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES).select("host", "name")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text of every row of `pages`."""
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(pages[key].alias("page_id"), pages[url].alias("url"), pages[html].alias("html"))
    parsed = saved(
        rows.mapInPandas(_parsed, f"page_id {kind}, url string, host long, blocks binary, stream long").withColumn(
            "row_id", F.monotonically_increasing_id()
        )
    )
    suffixes = parsed.select("row_id", "host", "blocks").mapInPandas(_suffixes, "row_id long, host long, name long")
    # Equal streams are not merged yet, so these are more than the names on enough pages, never less.
    candidates = saved(_on_enough_pages(suffixes))
    near = suffixes.join(candidates, ["host", "name"]).groupBy("row_id").agg(F.collect_list("name").alias("names"))
    strings = saved(
        parsed.select("row_id", "host", "stream", "blocks")
        .join(near, "row_id")
        .mapInPandas(_long_strings, "row_id long, host long, stream long, name long")
    )
    marked = saved(_on_enough_pages(strings.select("host", "name", "stream").distinct()))
    # Names go to the pages they stand on, so a host of many pages makes no large list.
    names = strings.join(marked, ["host", "name"]).groupBy("row_id").agg(F.collect_list("name").alias("names"))
    return (
        parsed.join(names, "row_id", "left")
        .select("page_id", "url", "blocks", "names")
        .mapInPandas(_texts, f"page_id {kind}, url string, text string")
    )


@query("op9_html_extraction")
def op9_html_extraction(spark, sf_dir):
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )
