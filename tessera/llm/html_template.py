"""HTML extraction by ordered, nested equivalence classes of tokens across a host's pages.

A token is a tag or a text, told apart by the path of structural elements it stands in. Over
the pages of one host it has an occurrence vector: how often it occurs on each page. Tokens
with equal vectors form an equivalence class; the class with the vector (1, ..., 1) is the
outermost one, classes with other vectors repeat inside its slots. A class is a candidate if it
occurs on a share ``SUPPORT`` of the host's pages with tokens, and on two at least. The occurrences of
its tokens have roles: the token of the class before it (the order) and the slot of the class around
it (the nesting). A role is valid if it is found on as many pages. The occurrences with valid roles
are the host's template: its block tags bound the slots, inside ``article`` and ``main`` too, and a
slot that holds template text only is template text. The rule is the same at every host size.
Pages with equal content count once: those with the same sentences, if these are most of a page's
text, else those with the same text.

1. One parse turns each page into numbers of its tokens, which are written; of pages with equal content one
   is taken on. Each task sums, for each (host, token), the pages, the occurrences and a fingerprint of the
   vector (the exclusive or of a hash of page and count); partial sums meet in one
   aggregate, so a host with a third of all pages is a row per token and task.
2. The token numbers join their host's candidates; each task counts the pages of each role, and the sums meet in
   one aggregate again.
3. Pages join their host's template, lists of hashes bounded by what a page can hold
   (broadcast if Spark finds it small, else a join that splits skewed hosts), and are cut into slots in one pass. A
   task builds a host's template once.

Tags and class names choose among the slots. Those of ``main``, or of the ``article`` elements if these hold
half of the text, are the result, template text included, unless it is mostly links or reads as a
control ("Share this", "More"); else those slots of the body that are no template text and not mostly links, with the headings of their
element. Elements of navigation, headers and footers, asides, forms, scripts, styles, and
elements whose class, id or role names an advert, a notice, a menu or comments, do not belong to it;
a class name never rules out an element that holds the article, main, or most of the text of a
page without them. On a page without them whose host has no template, what stands before the first and after the last
sentence in mere containers goes. If nothing is left, the rules are dropped one by one: links, template text, class names.

Parsing is linear in a page's length, however broken its tags are; a ``<`` without a later ``>`` is text.

Defined results: a null or empty page has an empty text; a null or unusual url is the host "";
unclosed and misplaced tags are closed as far as needed; repeated rows are pages like any
others; an empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

#: share of a host's pages with tokens on which a class has to occur
SUPPORT = 0.5

#: fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul xmp".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
BOILERPLATE = frozenset("head nav header footer aside form menu button select dialog fieldset".split())
MAIN = frozenset(("article", "main"))
ROLES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-?bar|menu|nav\w*|breadcrumbs?|header|footer|cookies?|consent|"
                   r"notice|popup|modal|newsletter|subscribe|share|social|related|recommend\w*|comments?|replies|disqus|widget|toolbar|login|search)(?:$|[\s_-])")
#: class names that tell a comment or teaser from the article: the word begins the name
ARTICLE_ROLES = re.compile(r"(?:^|\s)(?:ads?|advert\w*|sponsor\w*|promo\w*|teaser|related|recommend\w*|comments?|repl(?:y|ies)|disqus|widget)(?:$|[\s_-])")
#: words that begin, or are, the texts of controls
CONTROLS = re.compile(r"(?:share|tweet|follow|subscribe|sign up|log ?in|advertisement|related|comments?|print|copy link)\b"
                      r"|(?:(?:read|see|show|load|learn) )?more\W*$|(?:continue|keep) reading\W*$", re.I)

#: a quotation mark without its partner is a character of the tag
PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
OPENS_NOTHING = re.compile("<[!?]")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset(("", "html", "body", "div", "section", "center", "table", "tr", "td"))
SENTENCE = re.compile(r"(?:\S+\s+){2,}+.*[.!?…。！？][\"'”’»)\]]*$", re.S)
DIGITS = re.compile("[0-9]+")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open" | "close" | "text", name, attributes or text) of a page; raw elements and comments give no text."""
    at, n = 0, page.rfind(">") + 1  # every tag that begins before n ends by then
    while at < n:
        m = PIECE.search(page, at, n)
        if m is None:
            break
        if m.start() > at:
            yield "text", "", page[at:m.start()]
        at = m.end()
        if m.group(2):
            name = m.group(2).lower()
            if m.group(1):
                yield "close", name, ""
            else:
                yield "open", name, m.group(3)
                if name in RAW and not m.group(3).endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(page, at)
                    if name == "xmp":
                        yield "text", "xmp", page[at:end.start() if end else len(page)]
                    at = end.end() if end else len(page)
                    yield "close", name, ""
        elif at == n and not m.group().endswith(">"):
            return  # an open comment holds the rest
    rest = OPENS_NOTHING.search(page, at)
    if at < (end := rest.start() if rest else len(page)):
        yield "text", "", page[at:end]


def roles_of(attributes: str) -> str:
    return " ".join((a or b or c).lower() for _, a, b, c in ATTRIBUTE.findall(attributes))


class Walk:
    """A page as tokens and texts, with the open elements kept as a browser would.

    ``items`` are (element, path (a hash), token, is tag, in link, text) in page order; of each element,
    ``marks`` has whether its tag and whether its class names rule it out, ``chars`` its own text.
    """

    def __init__(self, page: str):
        self.names, self.parents, self.paths = [""], [-1], [0]
        self.marks: list[tuple[bool, bool]] = [(False, False)]
        self.chars = [0]
        self.items: list[tuple[int, int, str, bool, bool, str]] = []
        names, paths, add = self.names, self.paths, self.items.append
        stack, inside, links = [0], 0, 0  # inside: open article and main elements
        opened: dict = defaultdict(int)  # elements on the stack, by name

        def pop() -> str:
            nonlocal inside
            name = names[stack.pop()]
            opened[name] -= 1
            inside -= name in MAIN
            return name

        for kind, name, value in events(page):
            top = stack[-1]
            if kind == "text":
                text = value if name else entities.unescape(value)
                words = " ".join(text.split())
                self.chars[top] += len(words)
                add((top, paths[top], "text:" + words, False, links > 0, text))
                continue
            if name == "a":
                links = max(0, links + (1 if kind == "open" else -1))
            if not (name in BLOCK or name in RAW):
                if name == "br":
                    add((top, paths[top], "", False, links > 0, " "))
                else:
                    add((top, paths[top], kind + ":" + name, True, links > 0, ""))
                continue
            if kind == "open":
                if name in CLOSES_P and opened["p"]:
                    while pop() != "p":
                        pass
                if name in ("li", "dt", "dd", "td", "th", "tr") and names[stack[-1]] == name:
                    pop()
                top, roles = stack[-1], roles_of(value) if value else ""
                label = f"{name}.{DIGITS.sub('0', roles)}"  # numbers in ids tell pages, not places
                add((top, paths[top], "open:" + label, True, links > 0, ""))
                if name not in VOID:
                    if name == "main" or not roles or name in ("html", "body"):
                        named = False
                    elif name == "header" and inside:
                        named = bool(ROLES.search(roles.replace("header", "")))
                    else:
                        named = bool((ARTICLE_ROLES if name == "article" else ROLES).search(roles))
                    # a header of the article itself is not the page's header
                    tagged = name in BOILERPLATE and not (name == "header" and inside) or name in RAW and name != "xmp"
                    names.append(name)
                    self.parents.append(top)
                    paths.append(xxhash.xxh64_intdigest(f"{paths[top]}/{label}"))
                    self.marks.append((tagged, named))
                    self.chars.append(0)
                    stack.append(len(names) - 1)
                    opened[name] += 1
                    inside += name in MAIN
            else:
                if opened[name]:
                    while pop() != name:
                        pass
                add((stack[-1], paths[stack[-1]], "close:" + name, True, links > 0, ""))

    def areas(self) -> list[tuple[str, bool, bool]]:
        """("main" | "article" | "", ruled out by a tag, by a class name) of each element."""
        names, parents, marks = self.names, self.parents, self.marks
        n = len(names)
        tagged, chars, mains = [False] * n, [0] * n, [0] * n
        for e in range(1, n):
            tagged[e] = tagged[parents[e]] or marks[e][0]
        for e in range(n - 1, -1, -1):
            if not tagged[e]:
                chars[e] += self.chars[e]
                mains[e] += names[e] in MAIN and not marks[e][1]
                if e:
                    chars[parents[e]] += chars[e]
                    mains[parents[e]] += mains[e]
        out = [("", False, False)]
        for e in range(1, n):
            area, _, named = out[parents[e]]
            if marks[e][1] and not named:
                # an element that holds the article, or most of the text of a page without one, is kept
                named = names[e] == "article" or not (mains[e] or not mains[0] and 2 * chars[e] > chars[0])
            if names[e] in MAIN and area != "main":
                area = names[e]
            out.append((area, tagged[e], named))
        return out


    def tokens(self) -> list[int | None]:
        """The number of each item's token; none of a text without words and of a line break."""
        return [token_id(path, token) if token and token != "text:" else None for _, path, token, *_ in self.items]

    def content(self) -> int:
        """Equal for pages with equal content."""
        texts = [token for _, _, token, tag, link, _ in self.items if not tag and not link and token != "text:" and token]
        sentences = [t for t in texts if SENTENCE.match(t[5:])]
        if 2 * sum(map(len, sentences)) >= sum(map(len, texts)):
            texts = sentences
        return xxhash.xxh64_intdigest("\x00".join(texts).encode("utf-8", "surrogatepass")) - (1 << 63)


def token_id(path: int, token: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\x00{token}".encode("utf-8", "surrogatepass")) - (1 << 63)


def is_block_edge(token: str) -> bool:
    name = token.partition(":")[2].partition(".")[0]
    return name in BLOCK or name in RAW


def roles(walk: Walk, classes: dict[int, int]) -> list[int]:
    return token_roles(walk.tokens(), classes)


def token_roles(tokens: list[int | None], classes: dict[int, int]) -> list[int]:
    """For each token a hash of it, the token of its class before it and the slot around it; 0 if it is in no class."""
    first, last, latest = {}, {}, {}
    for t in tokens:
        if (c := classes.get(t)) is not None:
            first.setdefault(c, t)
            last[c] = t
    spans: list[int] = []  # open classes; a slot is the class and its latest token
    opened: set[int] = set()

    def end(c: int):
        while c in opened:
            opened.discard(spans.pop())

    out = []
    for t in tokens:
        if (c := classes.get(t)) is None:
            out.append(0)
            continue
        if t == first[c]:
            end(c)  # the class begins again: what is open in it is over
            latest.pop(c, None)
        around = next((d for d in reversed(spans) if d != c), None)
        out.append((xxhash.xxh64_intdigest(f"{t}:{latest.get(c)}:{around}:{latest.get(around)}") >> 1) or 1)
        latest[c] = t
        if t == first[c] and t != last[c]:
            spans.append(c)
            opened.add(c)
        elif t == last[c]:
            end(c)
    return out


class Block(NamedTuple):
    text: str
    area: str
    named: bool  # ruled out by a class name
    linked: float  # share of characters in links
    slot: int
    element: int


def main_text(page: str | None, classes: dict[int, int], valid: frozenset | set) -> str:
    """The blocks of the chosen slots, joined by two \n; classes of the host's tokens and their valid roles."""
    if not page:
        return ""
    walk = Walk(page)
    areas = walk.areas()
    blocks: list[Block] = []
    varied: set[int] = set()  # slots with a text that is not template text
    parts: list[str] = []
    linked = total = slot = 0
    area, named, top = "", False, 0

    def close():
        nonlocal parts, linked, total
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, area, named, linked / max(1, total), slot, top))
        parts, linked, total = [], 0, 0

    for (element, _, token, tag, link, text), role in zip(walk.items, roles(walk, classes) if valid else repeat(0)):
        if tag:
            if is_block_edge(token):
                close()
                slot += role in valid
            continue
        own, tagged, ruled_out = areas[element]
        if tagged:
            continue
        if token and token != "text:" and role not in valid:
            varied.add(slot)
        area, named, top = own, ruled_out, element
        parts.append(text)
        total += len(text)
        linked += len(text) * link
    close()
    return "\n\n".join(b.text for b in chosen(walk, blocks, varied, bool(valid)))


def chosen(walk: Walk, blocks: list[Block], varied: set[int], template: bool) -> list[Block]:
    """The blocks of the main text; ``varied`` slots hold more than template text."""
    def in_areas(left: list[Block]) -> list[Block]:
        """Those of main, or of the articles if they hold half of the text; template text elsewhere does not count."""
        marked = [b for b in left if b.area]
        size = sum(len(b.text) for b in left if b.area or b.slot in varied)
        return marked if any(b.area == "main" for b in marked) or 2 * sum(len(b.text) for b in marked) >= size else []

    plain = [b for b in blocks if not b.named]
    if marked := in_areas(plain):
        return [b for b in marked if b.slot in varied or b.linked < 0.5 and not CONTROLS.match(b.text)] or marked
    if left := [b for b in plain if b.slot in varied]:
        left = [b for b in left if b.area or b.linked < 0.5] or left
        return with_headings(walk, plain, left) if template else without_edges(walk, left)
    for left in (plain, blocks):
        if left:
            return in_areas(left) or [b for b in left if b.linked < 0.5] or left
    return []


def with_headings(walk: Walk, blocks: list[Block], kept: list[Block]) -> list[Block]:
    """``kept`` and the headings that stand in one element with the kept block after them."""
    own = {id(b) for b in kept}
    following = None  # the next block that is no heading
    for b in reversed(blocks):
        if walk.names[b.element] not in HEADINGS:
            following = b
        elif following is not None and id(following) in own and walk.parents[b.element] == walk.parents[following.element] and b.linked < 0.5:
            own.add(id(b))
    return [b for b in blocks if id(b) in own]


def without_edges(walk: Walk, blocks: list[Block]) -> list[Block]:
    """Without what stands in mere containers before the first and after the last sentence, if there is one."""
    said = [k for k, b in enumerate(blocks) if SENTENCE.match(b.text)]
    if not said:
        return blocks
    return [b for k, b in enumerate(blocks) if said[0] <= k <= said[-1] or walk.names[b.element] not in CONTAINERS]


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def token_numbers(pages: DataFrame) -> DataFrame:
    """row, host, content, tokens of each page with tokens: the numbers of its tokens in order."""
    columns = ["row", "host", "content", "tokens"]

    def parse(batches):
        for batch in batches:
            rows = []
            for row, name, page in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "html"))):
                if page:
                    walk = Walk(page)
                    if tokens := [t for t in walk.tokens() if t is not None]:
                        rows.append((row, name, walk.content(), tokens))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([*zip(*rows)] or [[]] * 4, kinds)], columns)

    return pages.mapInArrow(parse, "row long, host string, content long, tokens array<long>")


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """host, token, n_pages (of the token), vector (fingerprint); the token 0 stands for the pages."""
    columns = ["host", "token", "n_pages", "vector"]

    def count(batches):
        sums: dict = defaultdict(lambda: [0, 0])

        def rows():
            return pa.RecordBatch.from_arrays([*map(pa.array, zip(*((*k, *v) for k, v in sums.items())))], columns)

        for batch in batches:
            for row, name, tokens in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "tokens"))):
                sums[name, 0][0] += 1
                for t, n in Counter(tokens).items():
                    s = sums[name, t]
                    s[0] += 1
                    s[1] ^= xxhash.xxh64_intdigest(f"{row}:{n}") >> 1
            if len(sums) > 200_000:
                yield rows()
                sums.clear()
        if sums:
            yield rows()

    found = pages.mapInArrow(count, "host string, token long, n_pages long, vector long").groupBy("host", "token")
    found = found.agg(F.sum("n_pages").alias("n_pages"), F.bit_xor("vector").alias("vector"))
    return found.where("token = 0 or n_pages >= 2")  # a token of one page is in no template


def enough() -> Column:
    return F.greatest(F.lit(2.0), F.col("pages") * SUPPORT)


def candidates(vectors: DataFrame) -> DataFrame:
    """of (the host), pages, tokens and classes (arrays of equal order) of the classes with enough support."""
    sizes = vectors.where("token = 0").select(F.col("host").alias("of"), F.col("n_pages").alias("pages"))
    found = vectors.where("token <> 0").join(sizes, F.col("host") == F.col("of")).where(F.col("n_pages") >= enough())
    found = found.groupBy("of", "pages").agg(F.sort_array(F.collect_list(F.struct("token", "vector"))).alias("t"))
    return found.select("of", "pages", F.col("t.token").alias("tokens"), F.col("t.vector").alias("classes"))


class HostTemplates(dict):
    """A host's template, built when its first page comes; of a bounded number of hosts."""

    def of(self, name: str, build):
        if name not in self:
            if len(self) >= 1_000:
                self.clear()
            self[name] = build()
        return self[name]


def templates(pages: DataFrame, found: DataFrame) -> DataFrame:
    """of (the host), tokens, classes and valid (the roles that enough pages have)."""
    columns = ["of", "pages", "role", "n"]

    def count(batches):
        sums: dict = defaultdict(int)
        known = HostTemplates()

        def rows():
            return pa.RecordBatch.from_arrays([*map(pa.array, zip(*((*k, v) for k, v in sums.items())))], columns)

        for batch in batches:
            own, classes = batch.column("own"), batch.column("classes")
            for k, (name, n, tokens) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("of", "pages", "tokens")))):
                for role in set(token_roles(tokens, known.of(name, lambda: dict(zip(own[k].as_py(), classes[k].as_py()))))) - {0}:
                    sums[name, n, role] += 1
            if len(sums) > 200_000:
                yield rows()
                sums.clear()
        if sums:
            yield rows()

    hosts = found.withColumnRenamed("tokens", "own")
    joined = pages.join(hosts, F.col("host") == F.col("of")).select("of", "pages", "tokens", "own", "classes")
    rows = joined.mapInArrow(count, "of string, pages long, role long, n long")
    rows = rows.groupBy("of", "pages", "role").agg(F.sum("n").alias("n")).where(F.col("n") >= enough())
    return found.join(rows.groupBy("of").agg(F.sort_array(F.collect_set("role")).alias("valid")), "of").select("of", "tokens", "classes", "valid")


def extract(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    own = own.withColumn("host", host(F.col("url")))
    scratch = C.Scratch(pages.sparkSession, "html-template")
    parsed = scratch.write(token_numbers(own.select(F.monotonically_increasing_id().alias("row"), "host", "html")), "tokens")
    once = parsed.groupBy("host", "content").agg(F.min("row").alias("row")).select("row")
    parsed = scratch.write(parsed.join(once, "row", "left_semi").select("row", "host", "tokens"), "distinct")
    found = scratch.write(candidates(occurrence_vectors(parsed)), "candidates")
    per_host = scratch.write(templates(parsed, found), "templates")
    joined = own.join(per_host, F.col("host") == F.col("of"), "left")

    @F.pandas_udf("string")
    def text_of(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        known = HostTemplates()
        for hosts, pages, tokens, classes, valid in parts:
            texts = []
            for name, page, t, c, v in zip(hosts, pages, tokens, classes, valid):
                template = known.of(name, lambda: (dict(zip(t.tolist(), c.tolist())), frozenset(v.tolist()))) if isinstance(name, str) else ({}, frozenset())
                texts.append(main_text(page if isinstance(page, str) else None, *template))
            yield pd.Series(texts)

    out = joined.select("page_id", "url", text_of("of", "html", "tokens", "classes", "valid").alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
