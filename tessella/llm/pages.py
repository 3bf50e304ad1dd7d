"""Main text of web pages, by structure and nearest-URL page differencing.

A page is cut into text blocks. Menus, headers, footers, sidebars, notices, adverts, forms and comments that say so by
element, role, or a class or id made of such words only are left out; a form around the page's text is none. Where the page marks its article (article or main), its lines are the text's.
Every page is compared with its nearest neighbour that is no copy of it: pages sorted by host and URL path stand beside
those of the most similar path, the text lines of both are aligned by longest common subsequence, and shared lines are
deleted as the site's furniture. Pages of equal lines are passed over; up to REACH distinct pages on either side are
looked at. A neighbour is a copy by the text outside the lines that all of these share. The article mark protects
shared content: a shared line of an article goes only if most pages that differ from it have it.

Defined cases: null and empty pages have the empty text; a null URL is a host and path of their own (both empty);
broken markup is read as far as it goes; repeated rows, even of one page_id, are pages each; a page whose only
neighbours are copies keeps all lines; an empty table gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.textbits import modest_batches, tidy
from tessella.session import materialize

#: Elements whose content is no text, whether closed or not, and those only if closed.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)
    |<(script|style|title|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)
    |<(noscript|template|svg|iframe|select|object|button|canvas|math)\b[^>]*>.*?</\2\s*>
    |<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>"']|"[^"]*"|'[^']*')*+)>
    |</?[a-zA-Z][^>]*>|<[!?][^>]*>""",
    re.S | re.I | re.X,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_BREAKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_HOLDS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figure footer form head header html li main menu nav ol section table tbody td tfoot th thead tr ul".split())
_OUT = frozenset("nav footer aside form menu dialog".split())
_CLOSES_ITSELF = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words that say furniture in a class or id, those of them that say reader comments, and words that say nothing: fixed
#: values. A name counts if it is made of these only, so "ad-box" does and "has-sidebar" or "social-history" do not.
_COMMENTS = re.compile(r"comments?|disqus\w*|respond|repl(?:y|ies)")
_HINTS = re.compile(rf"ads?|advert\w*|banners?|sponsor\w*|promo\w*|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|footer|masthead|cookies?|consent|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|signup|shar(?:e|ing)|social|related|recommend\w*|widgets?|toolbar|pag(?:er|ination)|{_COMMENTS.pattern}")
_NEUTRAL = re.compile(r"box|boxes|block|bar|wrap|wrapper|container|holder|list|links?|buttons?|icons?|left|right|top|bottom|upper|lower|main|primary|secondary|site|page|global|section|area|zone|slot|unit|inner|outer|items?|group|panel|row|col|column|content|post|posts|article|articles|stor(?:y|ies)|news|entry|user|reader|form|media|this|mobile|desktop|sticky|fixed|first|last|small|large|header|\d+(?:x\d+)?")
_HEADER, _TITLED = re.compile("header"), re.compile(r"posts?|articles?|stor(?:y|ies)|entry|content|section")
_ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar".split())


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw and not raw.isspace() else {}


@lru_cache(maxsize=10_000)
def _made_of(name: str, what: re.Pattern) -> bool:
    """Whether a class or id is made of such words, at least one, and neutral ones; a header of a text is none."""
    words = [w for w in re.split("[-_]+", name.lower()) if w]
    if what is _HEADER and any(_TITLED.fullmatch(w) for w in words):
        return False
    return any(what.fullmatch(w) for w in words) and all(what.fullmatch(w) or _NEUTRAL.fullmatch(w) for w in words)


def _says(attrs: dict[str, str], what: re.Pattern) -> bool:
    return any(_made_of(name, what) for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split())


def _holds_text(page: str, start: int) -> bool:
    """Whether a form that starts there holds the page's text: an article, a heading or several paragraphs."""
    closed = re.compile("</form", re.I).search(page, start)
    inner = page[start : closed.start() if closed else len(page)]
    return bool(re.search(r"<(?:article|main|h1)\b", inner, re.I)) or len(re.findall(r"<p\b", inner, re.I)) > 2


def _left_out(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    if name in ("article", "main"):
        return _says(attrs, _COMMENTS)
    if name in ("body", "html"):
        return False
    if name in _OUT or name == "header" and not in_article or "hidden" in attrs or attrs.get("role", "").lower() in _ROLES:
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    return ("class" in attrs or "id" in attrs) and (_says(attrs, _HINTS) or not in_article and _says(attrs, _HEADER))


def blocks(page: str) -> list[tuple[str, bool]]:
    """The page's text blocks in order, without what is left out: text, and whether an article or main holds it."""
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, left out, in an article, left out as comments
    skip = inside = skip_block = False

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, inside))

    last = 0
    for m in _TOKEN.finditer(page):
        if not skip and not skip_block and m.start() > last:
            held.append(page[last : m.start()])
        last = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if name not in _BREAKS:
            continue
        flush()
        skip_block = False
        if m["end"]:
            if name in _HOLDS and any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
        else:
            attrs = _attributes(m["attrs"])
            if name not in _HOLDS:
                skip_block = bool(attrs) and _left_out(name, attrs, inside)
                continue
            if m["attrs"].endswith("/"):
                continue
            if name in _CLOSES_ITSELF:
                while stack and stack[-1][0] in _CLOSES_ITSELF[name]:
                    stack.pop()
            gone = _left_out(name, attrs, inside) and not (name == "form" and _holds_text(page, m.end()))
            comments = gone and _says(attrs, _COMMENTS)
            if stack and stack[-1][1]:
                # An article ends an advert or the like that was never closed, but not comments or a left-out element.
                freed = name in ("article", "main") and not gone and not any(x[3] or x[0] in _OUT for x in stack)
                gone = gone or not freed
                comments = comments or stack[-1][3]
            stack.append((name, gone, bool(stack and stack[-1][2]) or name in ("article", "main"), comments))
        skip, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
    if not skip and not skip_block and last < len(page):
        held.append(page[last:])
    flush()
    return out


#: Cells of a table of common lengths; longer pages are split instead (Hirschberg's method).
CELLS = 1_000_000
#: Distinct pages on either side of a page that it may be compared with.
REACH = 4


def _lengths(x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
    """After each line of x, the common lengths with every prefix of y."""
    row = np.zeros(len(y) + 1, np.int32)
    yield row
    for line in x:
        after = row.copy()
        after[1:] = np.maximum(row[1:], np.where(y == line, row[:-1] + 1, 0))
        row = np.maximum.accumulate(after)
        yield row


def _aligned(x: np.ndarray, y: np.ndarray) -> list[int]:
    if not len(x) or not len(y):
        return []
    if (len(x) + 1) * (len(y) + 1) > CELLS and len(x) > 1:
        half = len(x) // 2
        for upper in _lengths(x[:half], y):
            pass
        for lower in _lengths(x[half:][::-1], y[::-1]):
            pass
        cut = int(np.argmax(upper + lower[::-1]))
        return [*_aligned(x[:half], y[:cut]), *[half + i for i in _aligned(x[half:], y[cut:])]]
    rows = list(_lengths(x, y))
    i, j, found = len(x), len(y), []
    while i and j:
        if x[i - 1] == y[j - 1]:
            found.append(i - 1)
            i, j = i - 1, j - 1
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return found[::-1]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence with b."""
    first, last = 0, 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    middle = _aligned(np.array(a[first : len(a) - last]), np.array(b[first : len(b) - last]))
    return [*range(first), *[first + i for i in middle], *range(len(a) - last, len(a))]


def _furniture_of(lines: list[int], sizes: list[int], others: list[list[int]], marked: bool) -> list[int]:
    """Places of the page's furniture lines. others: distinct pages of the host, the nearest first."""
    sets = [set(o) for o in others]
    shared = [sum(n for x, n in zip(lines, sizes, strict=True) if x in s) for s in sets]
    met = [i for i, n in enumerate(shared) if n]
    far = [i for i in met if 2 * shared[i] <= sum(sizes)]
    if marked:
        # Near copies prove nothing here: a line of an article goes if most pages that differ from it have it too.
        differ = [s for s, n in zip(sets, shared, strict=True) if 2 * n <= sum(sizes)]
        usual = {x for x in lines if sum(x in s for s in differ) >= max(2, len(differ) // 2 + 1)}
        return [i for i in common_lines(lines, others[far[0]]) if lines[i] in usual] if usual else []
    if not met:
        return []
    size_of = lambda keep: sum(n for x, n in zip(lines, sizes, strict=True) if keep(x))
    everywhere = set(lines).intersection(*[sets[i] for i in met]) if len(met) > 1 else set()
    content = size_of(lambda x: x not in everywhere)
    own = size_of(lambda x: not any(x in sets[i] for i in met))
    if 2 * own <= content:
        # No page of its own beside a template: only pages that share less than half tell furniture.
        everywhere = set(lines).intersection(*[sets[i] for i in far]) if far else set()
        content = size_of(lambda x: x not in everywhere)
    for i in met:
        if 2 * size_of(lambda x, s=sets[i]: x in s and x not in everywhere) <= content:
            return common_lines(lines, others[i])
    return []


def _near(path: str, pages: list[tuple[str, list[int]]]) -> list[list[int]]:
    """Lines of the pages, those of the longest common start of the path first."""
    alike = lambda p: next((i for i, (x, y) in enumerate(zip(path, p[0], strict=False)) if x != y), min(len(path), len(p[0])))
    return [lines for _, lines in sorted(pages, key=lambda p: -alike(p))]


def _beside(rows: list[tuple], seed: list[tuple]) -> Iterator[list[tuple[str, list[int]]]]:
    """Before each row (host, path, lines) is met: the last distinct pages of its host, REACH + 1 at most, latest first."""
    seen: dict[tuple, str] = {}
    now = None
    for n, (host, path, lines) in enumerate([*seed, *rows]):
        if host != now:
            now, seen = host, {}
        if n >= len(seed):
            yield [(p, list(x)) for x, p in reversed(seen.items())]
        key = tuple(lines)
        seen.pop(key, None)
        seen[key] = path
        if len(seen) > REACH + 1:
            del seen[next(iter(seen))]


def _edge(rows: list[tuple]) -> set[int]:
    """Numbers of the rows that are the last distinct pages of the last row's host, REACH + 1 at most."""
    out: dict[tuple, int] = {}
    for n in range(len(rows) - 1, -1, -1):
        if rows[n][0] != rows[-1][0] or len(out) > REACH:
            break
        out.setdefault(tuple(rows[n][2]), n)
    return set(out.values())


def _text_lines(page: str | None) -> tuple[list[str], bool]:
    """The lines of the page's text and whether it marks an article; if so, they are the article's."""
    found = blocks(page or "")
    inside = [t for t, held in found if held]
    return (inside, True) if inside else ([t for t, _ in found], False)


def _furniture(pages: DataFrame) -> DataFrame:
    """id, tag, deleted: the shared lines of pages. pages: id, tag, url, html."""

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marked = zip(*map(_text_lines, batch.column(4).to_pylist()), strict=True) if batch.num_rows else ([], [])
            hashes = [[zlib.crc32(t.encode()) | zlib.adler32(t.encode()) << 31 for t in ts] for ts in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hashes, pa.list_(pa.int64())), pa.array([[len(t) for t in ts] for ts in texts], pa.list_(pa.int32())), pa.array(marked, pa.bool_())], ["id", "tag", "host", "path", "lines", "sizes", "marked"])

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), list(batches)
        rows = [r for batch in held for r in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
        last, first = _edge(rows), {len(rows) - 1 - n for n in _edge(rows[::-1])}
        at = 0
        for batch in held:
            n = batch.num_rows
            mine = range(at, at + n)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(mine, pa.int64()), pa.array([i in first for i in mine]), pa.array([i in last for i in mine]), *batch.columns], ["part", "at", "first", "last", *batch.schema.names])
            at += n

    url = F.coalesce("url", F.lit(""))
    keyed = pages.select("id", "tag", F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1)).alias("host"), F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1).alias("path"), "html")
    columns = "id bigint, tag bigint, host string, path string, lines array<bigint>, sizes array<int>, marked boolean"
    lined = materialize(keyed.mapInArrow(cut, columns), "page-lines")
    schema = f"part int, at bigint, first boolean, last boolean, {columns}"
    placed = materialize(lined.repartitionByRange("host", "path", "id", "tag").sortWithinPartitions("host", "path", "id", "tag").mapInArrow(place, schema), "placed-pages")
    # Pages at the ends of a partition, a bounded number each, are what its neighbours are compared with.
    ends: dict[str, dict[int, list[tuple]]] = {"first": {}, "last": {}}
    for r in placed.where("first or last").select("part", "at", "first", "last", "host", "path", "lines").orderBy("part", "at").collect():
        for name in ends:
            if r[name]:
                ends[name].setdefault(r["part"], []).append((r["host"], r["path"], r["lines"]))
    parts = sorted(ends["first"])
    around, before = {}, []
    for p in parts:
        around[p] = [before]
        before = [x for x in [*before, *ends["last"][p]] if x[0] == ends["last"][p][-1][0]]
        before = [before[n] for n in sorted(_edge(before))]
    after: list[tuple] = []
    for p in reversed(parts):
        around[p].append(after)
        after = [x for x in [*after, *reversed(ends["first"][p])] if x[0] == ends["first"][p][0][0]]
        after = [after[n] for n in sorted(_edge(after))]
    sent = pages.sparkSession.sparkContext.broadcast(around)

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: int, rows: list[tuple]) -> pa.RecordBatch:
            before, after = sent.value[part]
            pages = [r[2:5] for r in rows]
            later = list(_beside(pages[::-1], after))[::-1]
            gone = []
            for (_, _, _, path, lines, sizes, marked), earlier, next_ones in zip(rows, _beside(pages, before), later, strict=True):
                near = [p for pair in zip_longest(earlier, next_ones) for p in pair if p and p[1] != lines]
                distinct = list({tuple(p[1]): p for p in reversed(near)}.values())[::-1]
                gone.append(_furniture_of(lines, sizes, _near(path, distinct), marked))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["id", "tag", "deleted"])

        now, rows = None, []
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and rows:
                    yield done(now, rows)
                    rows = []
                now = part
                rows.append(tuple(row))
        if rows:
            yield done(now, rows)

    met = placed.repartition("part").sortWithinPartitions("part", "at").select("part", "id", "tag", "host", "path", "lines", "sizes", "marked")
    out = met.mapInArrow(compare, "id bigint, tag bigint, deleted array<int>")
    return out.where(F.size("deleted") > 0).dropDuplicates(["id", "tag"])


def extract(pages: DataFrame) -> DataFrame:
    """Rows page_id, url, text: the main text of every page, its blocks joined by newlines."""
    modest_batches(pages.sparkSession)
    own = pages.select("page_id", "url", "html", F.coalesce(F.col("page_id").cast("bigint"), F.lit(-(2**63))).alias("id"), F.xxhash64("html", "url").alias("tag"))
    deleted = _furniture(own.select("id", "tag", "url", "html")).withColumnsRenamed({"id": "found_id", "tag": "found_tag"})
    joined = own.join(deleted, (F.col("id") == F.col("found_id")) & (F.col("tag") == F.col("found_tag")), "left")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, gone in zip(*(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                drop = set(gone or ())
                out.append("\n".join(t for i, t in enumerate(_text_lines(page)[0]) if i not in drop))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], ["page_id", "url", "text"])

    return joined.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html", "deleted").mapInArrow(run, "page_id bigint, url string, text string")
