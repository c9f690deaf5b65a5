"""Main text of web pages by structure and nearest-URL page differencing.

A page is read into lines, one for each block of text. Every page is paired with the page of the same host whose URL path
is nearest, the two pages' lines are aligned by longest common subsequence, and shared lines are the host's template.
Marks check that in both directions. What only differs from page to page and is still not the page's text (menus, headers,
footers, forms, adverts, comments ...) is left out by its elements and names, and where a page marks its article, so is
what lies outside. And pages share lines of their articles too (notices of license, quotations), which are main text: an
article is differenced against both neighbors, and a shared line stays where it is running text (paragraphs, headings,
items, quotes, tables), and goes where it stands loose in a division or is nothing but a link.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from html import unescape
from itertools import accumulate, takewhile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

RAW = "script|style|title|textarea|noscript|template|svg|iframe|select|object"
#: What may stand in a tag after its name: quotes count after an equals sign only.
INSIDE_TAG = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b{INSIDE_TAG}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)({INSIDE_TAG})>", re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head nav footer aside form button menu dialog fieldset datalist".split())
#: Words that mark a part of the page's frame wherever they stand in a class, id or role.
FRAME_WORDS = frozenset(
    """ad ads adbox adslot advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo
    cookie cookies disqus footer gdpr masthead modal nav navbar navigation newsletter pager pagination paywall popup promo promoted promotion recommended
    related share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets""".split()
)
#: Words that do so as the last word of a name, as in site-search, and not in search-tips.
LAST_WORDS = frozenset("alert banner dropdown foot header hidden menu notice notification overlay replies reply search skip tags teaser".split())
#: Words for what holds something; before them stands the word that counts.
HOLDERS = frozenset(
    "area bar block body box button buttons col container content group holder icons inner item items label link links list module outer panel row section slot text title unit wrap wrapper".split()
)
#: Of these, the words that mark even an article element as not the page's own.
OTHER_ARTICLES = frozenset("ad ads advert advertisement comment comments promo promoted related replies reply sponsored teaser widget".split())
#: Elements that hold anything: a line right in one of them is not marked as running text.
DIVISIONS = frozenset("address center details div hgroup section summary".split())
#: An element closes an open one of these kinds that it cannot lie in.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",)}


def marks_of(name: str) -> set[str]:
    """The frame words of one class, id or role."""
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
    found = FRAME_WORDS.intersection(words)
    while len(words) > 1 and words[-1] in HOLDERS:
        words.pop()
    return found | LAST_WORDS.intersection(words[-1:])


def frame_words(name: str, attributes: str) -> set[str]:
    """The frame words among an element's class, id and role; 'hidden' also for elements that are not shown.

    Of an article's or main element's names only the first parts count: has-comments says nothing of what it is.
    """
    if not attributes or attributes == "/":
        return set()
    found: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            for own in value.split():
                found |= marks_of(re.match(r"[a-z0-9]*", own)[0]) if name in ("article", "main") else marks_of(own)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            found.add("hidden")
    return found


def blocks(html: str) -> tuple[list[str], list[str], bool]:
    """The article's blocks, the other blocks that no mark leaves out, and whether the page marks an article."""
    return page_lines(html)[:3]


def page_lines(html: str) -> tuple[list[str], list[str], bool, list[int]]:
    """What ``blocks`` gives, and the places of the article's blocks that are not marked as running text."""
    inside: list[str] = []
    outside: list[str] = []
    pieces: list[str] = []
    loose: list[int] = []
    #: Open elements: name, whether it starts a left-out part, whether it is the article, and the left-out forms around it.
    stack: list[tuple[str, bool, bool, int]] = []
    skip = article = forms = links = 0
    marked = plain = False

    def is_loose() -> bool:
        for name, _, own, _ in reversed(stack):
            if own:
                return not plain
            if name in BLOCK:
                return name in DIVISIONS or not plain and name not in HEADINGS
        return False

    def close() -> None:
        nonlocal plain
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                if article and is_loose():
                    loose.append(len(inside))
                (inside if article else outside).append(text)
            pieces.clear()
        plain = False

    def leave(k: int) -> None:
        nonlocal skip, article, forms, links
        while len(stack) > k:
            name, left_out, own, around = stack.pop()
            article -= own
            links -= name == "a"
            if left_out:
                skip, forms = skip - 1, forms - (name == "form")
            skip, forms = skip + around, forms + around

    at = 0
    for m in TOKEN.finditer(html):
        if not skip and m.start() > at:
            pieces.append(html[at : m.start()])
            plain = plain or not links and any(map(str.isalnum, unescape(pieces[-1])))
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            close()
        elif name in ("br", "td", "th"):
            pieces.append(" ")
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    leave(k)
                    break
            continue
        if name in VOID or m[4].endswith("/") and name not in BLOCK:
            continue
        if name == "body":
            leave(0)
        for other in CLOSES.get(name, ()):
            if stack and stack[-1][0] == other:
                leave(len(stack) - 1)
        if name == "p" or name in HEADINGS:
            while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "a", *HEADINGS):
                leave(len(stack) - 1)
        words = frame_words(name, m[4])
        own = name in ("article", "main") or name != "body" and "main" in m[4] and re.search(r"role\s*=\s*[\"']?main\b", m[4]) is not None
        around = 0
        if own:
            left_out = bool(words & OTHER_ARTICLES) or "hidden" in words
            if not left_out and not article and skip and skip == forms:  # a form around the whole article, as some sites have
                around, skip, forms = forms, 0, 0
        elif article:  # an article's own header is part of it
            left_out = name in SKIPPED or bool(words - {"header"})
        else:
            left_out = name in SKIPPED or name == "header" or bool(words) and name not in ("html", "body")
        main = own and not left_out and not skip
        marked = marked or main
        stack.append((name, left_out, main, around))
        links += name == "a"
        skip, article, forms = skip + left_out, article + main, forms + (left_out and name == "form")
    if not skip and at < len(html):
        pieces.append(re.sub(r"<[a-zA-Z/!?][^>]*\Z", "", html[at:]))
        plain = plain or not links and any(map(str.isalnum, unescape(pieces[-1])))
    close()
    return inside, outside, marked, loose


#: Equal pairs of lines up to which an alignment visits them one by one.
MATCHES = 100_000


def shared_with_starts(own: list, other: list) -> list[int]:
    """The length of a longest common subsequence of ``own`` and each start of ``other``, by rows of bits."""
    masks: dict[object, int] = {}
    for x, places in places_of(other).items():
        bits = bytearray(len(other) // 8 + 1)
        for j in places:
            bits[j >> 3] |= 1 << (j & 7)
        masks[x] = int.from_bytes(bits, "little")
    full = (1 << len(other)) - 1
    row = full
    for x in own:
        both = row & masks.get(x, 0)
        row = ((row + both) | (row - both)) & full
    return [0, *accumulate(bit == "0" for bit in reversed(f"{row:0{len(other)}b}"))] if other else [0]


def places_of(lines: list) -> dict[object, list[int]]:
    where: dict[object, list[int]] = {}
    for j, x in enumerate(lines):
        where.setdefault(x, []).append(j)
    return where


def aligned(own: list, other: list) -> list[int]:
    """The places in ``own`` of a longest common subsequence with ``other``; halved while there are too many equal pairs."""
    where = places_of(other)
    if len(own) > 1 and sum(len(where.get(x, ())) for x in own) > MATCHES:
        k, n = len(own) // 2, len(other)
        left, right = shared_with_starts(own[:k], other), shared_with_starts(own[:k - 1 : -1], other[::-1])
        cut = max(range(n + 1), key=lambda j: left[j] + right[n - j])
        return aligned(own[:k], other[:cut]) + [k + i for i in aligned(own[k:], other[cut:])]
    tails: list[int] = []
    last: list[tuple[int, object]] = []  # for each length, the place in ``own`` and the chain before it
    for i, x in enumerate(own):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            chain = (i, last[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                last.append(chain)
            else:
                tails[k], last[k] = j, chain
    found: list[int] = []
    chain = last[-1] if last else None
    while chain:
        found.append(chain[0])
        chain = chain[1]
    return found[::-1]


def shared_lines(own: list, other: list) -> set[int]:
    """The places in ``own`` of a longest common subsequence with ``other``; runs of one line count as one line."""

    def folded(lines: list) -> list[int]:
        return [i for i, x in enumerate(lines) if not i or lines[i - 1] != x]

    mine = folded(own)
    found: set[int] = set()
    for place in aligned([own[i] for i in mine], [other[i] for i in folded(other)]):
        i = mine[place]
        found.add(i)
        while i + 1 < len(own) and own[i + 1] == own[i]:
            i += 1
            found.add(i)
    return found


def host_and_path(url: str | None) -> tuple[str, str]:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    return (m[1].lower(), m[2].rstrip("/")) if m else ("", url or "")


def common_start(a: str, b: str) -> int:
    """How many path parts two paths have in common from the first on, and then how many characters."""
    parts = zip(a.split("/"), b.split("/"), strict=False)
    same = 0
    for x, y in parts:
        if x != y:
            return same * 10_000 + sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(x, y, strict=False)))
        same += 1
    return same * 10_000


def template_lines(row: dict, before: dict | None, after: dict | None) -> set[int]:
    """The places of a page's lines that its neighbors share.

    Outside articles the nearest one counts: of two neighbors of one host the one with the longer common path; of equals,
    the one before. In an article both neighbors have to share a line (or the only one). A neighbor with just the same
    lines is a copy of the page and says nothing of what is template, so the other one is taken; a page without any has no
    template.
    """
    near = [x for x in (before, after) if x and x["host"] == row["host"] and x.get("article") == row.get("article") and x["lines"] != row["lines"]]
    if not near:
        return set()
    if row.get("article"):
        return set.intersection(*(shared_lines(row["lines"], x["lines"]) for x in near))
    return shared_lines(row["lines"], max(near, key=lambda x: common_start(row["path"], x["path"]))["lines"])


def own_lines(row: dict, before: dict | None, after: dict | None) -> list:
    """The lines of a page that its neighbors do not share."""
    template = template_lines(row, before, after)
    return [x for i, x in enumerate(row["lines"]) if i not in template]


#: Pages in their hosts' path order, each line a hash. state: 0 to be finished, 1 only there as a neighbor, 2 a result.
#: key: the page's host and lines; shared: the places of template lines.
PLACED = "article boolean, host string, path string, page_id long, url string, key binary, state int, lines array<long>, shared array<int>"
#: So many pages or fewer are brought together in one task.
EDGES = 4_000


def names_of(kinds: str) -> list[str]:
    return [x.split()[0] for x in kinds.split(", ")]


def differences(whole: bool):
    """The function that finishes the pages of sorted partitions; pages without template are left out.

    A page at an edge of a partition has its neighbor in another one, so it is handed on unfinished, with its neighbor on
    the other side; ``whole`` says that the partition is all there is.
    """
    import pyarrow as pa

    types = (pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    names = names_of(PLACED)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

        def finished(before: dict | None, row: dict, after: dict | None) -> list[dict]:
            template = set() if row["state"] else template_lines(row, before, after)
            return [row | {"state": 2, "shared": sorted(template), "lines": None}] if template else []

        first: list[tuple[int, dict]] = []
        last: list[tuple[int, dict]] = []
        at = 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if len(last) == 2 or whole and last:
                    out += finished(last[0][1] if len(last) == 2 else None, last[-1][1], row)
                if len(first) < 2:
                    first.append((at, row))
                last = [*last[-1:], (at, row)]
                at += 1
            yield made(out)
        if whole and last:
            yield made(finished(last[0][1] if len(last) == 2 else None, last[-1][1], None))
        elif last:
            edges = {i: r | {"state": 1} for i, r in [*first, *last]}
            yield made(list((edges | dict([first[0], last[-1]])).values()))

    return finish


#: What a page is to the differencing, and its lines.
HASHED = "article boolean, host string, path string, page_id long, url string, key binary, state int, lines array<long>"
#: loose: the places in an article that are not running text, null for pages without article.
READ = "page_id long, url string, key binary, lines array<string>, loose array<int>"


def key_of(article: bool, host: str, lines: list[str]) -> bytes:
    """128 bits for the pages of one host that have just the same lines."""
    import xxhash

    return xxhash.xxh3_128_digest(f"{article:d} {len(host)} {host} " + "\n".join(lines))


def reader(hashed: bool):
    """The function that parses page_id, url and html to rows of HASHED or READ."""
    import pyarrow as pa
    import xxhash

    page = (pa.int64(), pa.string(), pa.binary())
    types = (pa.bool_(), pa.string(), pa.string(), *page, pa.int32(), pa.list_(pa.int64())) if hashed else (*page, pa.list_(pa.string()), pa.list_(pa.int32()))
    names = names_of(HASHED if hashed else READ)

    def hashes(lines: list[str]) -> list[int]:
        return [xxhash.xxh3_64_intdigest(x) - 2**63 for x in lines]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for page_id, url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    inside, outside, marked, loose = page_lines(html.as_py() or "")
                    host, path = host_and_path(url)
                    lines = inside if marked else outside
                    key = key_of(marked, host, lines)
                    if not hashed:
                        rows.append((page_id, url, key, lines, loose if marked else None))
                        continue
                    if lines:
                        rows.append((marked, host, path, page_id, url, key, 0, hashes(lines)))
                    if marked and outside:
                        rows.append((False, host, path, page_id, url, key, 1, hashes(outside)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return read


def template_places(pages: DataFrame) -> DataFrame:
    """key and shared: the places of the lines that neighbors share, for the pages of ``pages`` that have any.

    Pages of one host with just the same lines are one, at the first of their URLs.
    """
    lines = stored(pages.mapInArrow(reader(True), HASHED), "lines")
    path = F.translate("path", "/", "\x01")  # part by part, so that a-b does not come between a and a/b
    rank = F.struct(path, "page_id", "url", "path", "lines")
    once = lines.filter("state = 0").groupBy("article", "host", "key").agg(F.min(rank).alias("r"))
    once = once.select("article", "host", "r.path", "r.page_id", "r.url", "key", F.lit(0).alias("state"), "r.lines")
    left = once.unionByName(lines.filter("state = 1")).withColumn("shared", F.lit(None).cast("array<int>"))
    order = ["article", "host", path, "page_id", "url", "state", "key"]
    many, parts, found = lines.count(), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), []
    while many or not found:
        whole = many <= EDGES
        dealt = left.repartition(1) if whole else left.repartitionByRange(parts, *order)
        placed = stored(dealt.sortWithinPartitions(*order).mapInArrow(differences(whole), PLACED), "placed")
        found.append(placed.filter("state = 2").select("key", "shared"))
        left = placed.filter("state < 2")
        many = left.count()
        parts = max(2, many // EDGES)
    return reduce(DataFrame.unionByName, found)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    Needs page_id, url and html; other columns are ignored. Null and empty html gives the empty text, a null url the
    empty host. Repeated rows are pages of their own. Every page is differenced: the neighbors of a page that marks an
    article are those before and after it in (host, path, page_id, url) order that do so too, by the articles' lines; those
    of others are the pages that have lines outside an article, by these lines. Partitions do not matter.

    Pages are parsed twice, for hashes of lines that are sorted and compared, and for the text, which is not stored.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    read = pages.mapInArrow(reader(False), READ).join(template_places(pages), "key", "left")
    template = F.when(F.col("loose").isNull(), F.col("shared")).otherwise(F.array_intersect("shared", "loose"))
    own = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), template), lambda i: F.get("lines", i))
    lines = F.when(F.col("shared").isNull(), F.col("lines")).otherwise(own)
    result = read.select("page_id", "url", F.array_join(lines, "\n").alias("text"))
    return result.withColumn("n_chars", F.length("text").cast("long"))
