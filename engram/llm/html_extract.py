"""Main text of web pages: page structure, then a suffix array per host.

Each page is parsed once into blocks. The markup decides what it can: text in ``article``
(or ``main``) is content; menus, headers, footers, sidebars, notices, adverts, forms and
comments, by element, role or class, are not. For pages whose markup names no content
region the host decides: the token streams of the host's pages (without their articles) are
concatenated, a suffix array is built by prefix doubling up to ``min_run`` tokens, and runs
that start on at least ``min_pages`` distinct pages, and ``min_share`` of the host's, are boilerplate. Blocks mostly covered
by such runs go; the unique ones stay. Content inside an article is never removed for
being repeated, since mirrors and syndicated articles repeat too.

A host's distinct pages are cut into chunks of about ``chunk_pages`` pages and ``chunk_chars``
characters by a hash of their text, so a host with a third of all pages is many tasks of
bounded size. A chunk's array names its distinct
runs and counts their pages; the counts are then summed over the chunks of the host by 128
bits of each run, so a run counts whichever chunks its pages lie in.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import covered, mix, stage, windows, word_hashes

#: Most rows of the table of large hosts that is broadcast (some 10 MB); salts of the join beyond it.
BROADCAST_HOSTS, SALTS = 100_000, 256

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object svg math canvas select textarea title head audio video".split())
_CHROME = frozenset("nav header footer aside form menu dialog button".split())
_BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul center caption".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_NAMES = re.compile(
    r"(?:^|[_-])(?:ad|ads|advert\w*|adsense|adsby\w*|adslot|sponsor\w*|promo\w*|banner|sidebar|side-bar|aside|nav|navbar|navigation|navi|menu\w*|breadcrumbs?|"
    r"cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"comments?|commentlist|respond|repl(?:y|ies)|reactions|disqus|discussion|social|share|sharing|related|recommend\w*|widget|pagination|pager|toolbar|skip-link|search)(?=$|[_-])",
    re.I,
)
#: Of these names, the ones that also occur in the names of a text's own parts; inside an article they count only as a class of their own, or with a usual other half.
_VAGUE_WORDS = (
    r"(?:sponsor\w*|promo\w*|banner|menu\w*|navigation|notice|notification|alert|overlay|subscription|login|discussion|social|share|sharing|related|recommend\w*|widget|search|"
    r"cookies?|consent|aside|reactions?|responses?|reply)"
)
_SURE = re.compile(
    r"(?:^|[_-])(?:ad|ads|advert|adverts|advertis\w*|adsense|adsby\w*|adslot|sidebar|side-bar|nav|navbar|navi|breadcrumbs?|cookie-(?:bar|banner|notice|consent)|gdpr|popup|modal|newsletter|subscribe|signup|"
    r"comments?|commentlist|respond|replies|disqus|pagination|pager|toolbar|skip-link|(?:readers?|users?|visitors?)[_-](?:comments?|reactions?|repl(?:y|ies)|responses?|feedback|letters|opinions))(?=$|[_-])",
    re.I,
)
_VAGUE = re.compile(
    rf"(?:(?:post|article|entry|site|page|site-wide|social)[_-])?{_VAGUE_WORDS}"
    r"(?:[_-](?:posts?|articles?|links?|stories|items?|reading|news|buttons?|bar|box|form|list|icons?|container|wrapper|area|media|block|tools|message|banner|widget))*",
    re.I,
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What stands above readers' comments.
_COMMENTS = re.compile(r"(?:\d+ )?(?:(?:reader|user|latest|all) ?)?(?:comments|replies|responses|reactions)(?: ?\(?\d+\)?)?:?", re.I)
#: Names of the head and foot of a page; in an article, or where it is named after one, a header holds its title.
_PAGE_NAMES = re.compile(r"(?:^|[_-])(?:footer|foot|header|masthead|topbar)(?=$|[_-])", re.I)
_FOOT = re.compile(r"(?:^|[_-])(?:footer|foot)(?=$|[_-])", re.I)
#: Names of parts of a text.
_OF_TEXT = re.compile(r"(?:article|entry|post|story|content)[_-]", re.I)
#: Names that say what a page has or lacks, and not what the element is.
_STATES = re.compile(r"(?:no|not|non|without|has|have|with|is|hide|show)[_-]", re.I)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</?[a-zA-Z](?:[^<>"']|"[^"]*"|'[^']*')*>|<[/!?][^>]*(?:>|\Z)|</?[a-zA-Z][^<>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")


def _named(words: str, in_article: bool) -> bool:
    """Whether a class or id names a part of the page that isn't its text."""
    for word in words.split():
        if _STATES.match(word):
            continue
        if _NAMES.search(word) or (_FOOT if in_article or _OF_TEXT.match(word) else _PAGE_NAMES).search(word):
            return True
    return False


def _named_in_text(name: str, classes: str, ident: str, in_article: bool) -> bool:
    """The same inside the content: headings are never judged by their names, paragraphs by classes only, and vague words count as a class of their own."""
    if name in _HEADINGS:
        return False
    for word in classes.split() + (ident.split() if name != "p" else []):
        ends = _FOOT if in_article or _OF_TEXT.match(word) else _PAGE_NAMES
        if not _STATES.match(word) and (_SURE.search(word) or ends.search(word) or word in classes.split() and _VAGUE.fullmatch(word)):
            return True
    return False


def _is_chrome(name: str, attrs: str, inside: int, in_article: bool) -> bool:
    if name in _CHROME and not (name == "header" and inside):
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    a = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in _ROLES:
        return True
    if name == "article" and not inside and not re.search(r"comment", a.get("class", ""), re.I):
        return False
    if inside:
        return _named_in_text(name, a.get("class", ""), a.get("id", ""), in_article)
    return _named(a.get("class", ""), in_article) or _named(a.get("id", ""), in_article)


def _is_region(name: str, attrs: str) -> bool:
    """Whether an element holds the page's content by its name or role."""
    if name in ("article", "main"):
        return True
    return "role" in attrs.lower() and any(k.lower() == "role" and v.strip("\"'").lower() in ("main", "article") for k, v in _ATTR.findall(attrs))


OTHER, CONTENT, CHROME = 0, 1, 2


class _Open:
    """The open elements that matter, each with the kind of the text around it; no tag costs a walk over them."""

    def __init__(self):
        self.stack: list[tuple[str, int, int, bool]] = []  # name, kind around it, blocks before it, whether it is a region of content
        self.below: defaultdict[str, list[int]] = defaultdict(list)  # by name, the block elements below each
        self.n_blocks = self.regions = 0

    def push(self, name: str, kind: int, before: int = 0, region: bool = False) -> None:
        self.stack.append((name, kind, before, region))
        self.regions += region
        self.below[name].append(self.n_blocks)
        self.n_blocks += name in _BLOCK

    def pop(self) -> tuple[str, int]:
        name, kind, _, region = self.stack.pop()
        self.regions -= region
        self.n_blocks = self.below[name].pop()
        return name, kind

    def close(self, name: str) -> int:
        """Closes elements up to the last of that name, which is open; the kind of the text after it."""
        while True:
            popped, kind = self.pop()
            if popped == name:
                return kind

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    def articles(self) -> int:
        return self.regions

    def comments_begin(self, n_out: int) -> bool:
        """Whether the heading at the top is the first block of a container inside a region."""
        return len(self.stack) > 1 and self.stack[-1][0] in _HEADINGS and self.stack[-2][0] in ("section", "div") and not self.stack[-2][3] and self.stack[-2][2] == n_out

    def turn(self, kind: int) -> None:
        """Gives the container of the top element another kind from here on."""
        name, _, before, region = self.stack[-1]
        self.stack[-1] = (name, kind, before, region)


def _closed(page: str, name: str) -> set[int]:
    """Where the elements of that name begin that are closed."""
    waiting, out = [], set()
    for m in re.finditer(rf"<(/?){name}(?=[\s/>])", page, re.I):
        if not m[1]:
            waiting.append(m.start())
        elif waiting:
            out.add(waiting.pop())
    return out


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of the page's blocks in order; character references decoded, white space folded.

    An article inside a menu, sidebar or the like is a part of it, unless that was never closed. Readers' comments are no
    content: what is named so, an article inside another one that has text before it, and a section that begins with a heading such as "Comments".
    """
    page = page or ""
    prose, headless = 0, False  # paragraphs of content so far; whether no head is closed from here on
    out: list[tuple[int, str]] = []
    opened, text = _Open(), []
    kind, at, n = OTHER, 0, len(page)
    chrome = ("", 0)  # name and place of the menu around the current text
    closed: dict[str, set[int]] = {}

    def close() -> None:
        nonlocal prose
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if line and kind == CONTENT and len(line) < 60 and _COMMENTS.fullmatch(line) and opened.comments_begin(len(out)):
                opened.turn(CHROME)
                out.append((CHROME, line))
            elif line:
                prose += kind == CONTENT and opened.top() not in _HEADINGS
                out.append((kind, line))
            text.clear()

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at, tag = m.end(), m.group()
        if tag.startswith("<![CDATA["):
            text.append(html.escape(tag[9:].removesuffix("]]>")))
            continue
        end = tag[1:2] == "/"
        name_at = re.match(r"[a-zA-Z][^\s/>]*", tag[2:] if end else tag[1:])
        if name_at is None:  # comment, doctype or processing instruction
            continue
        name = name_at.group().lower()
        attrs = "" if end else tag[1 + len(name) :]
        if not end and name in _RAW:
            if not tag.endswith("/>"):
                stop = None if headless and name == "head" else re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                if name == "head" and not stop and not headless:  # a head that is never closed ends where the body begins
                    stop = re.compile(r"(?=<body\b)", re.I).search(page, at)
                    headless = stop is None
                at = stop.end() if stop else (at if name == "head" else n)
            continue
        if name == "br":
            text.append(" ")
            continue
        inside = opened.articles()
        if name in ("td", "th"):
            text.append(" ")
            if opened.top() in ("td", "th"):  # a cell ends the one before it
                close()
                kind = opened.pop()[1]
            if not end and kind != CHROME and _is_chrome(name, attrs, inside, bool(opened.below["article"])):
                close()
                opened.push(name, kind)
                kind, chrome = CHROME, (name, m.start())
            continue
        if name not in _BLOCK and name not in _CHROME:
            if not end and name not in _VOID and kind != CHROME and _is_chrome(name, attrs, inside, bool(opened.below["article"])):
                close()
                opened.push(name, kind)
                kind, chrome = CHROME, (name, m.start())
            elif end and opened.below[name] and opened.below[name][-1] == opened.n_blocks:
                close()
                kind = opened.close(name)
            continue
        close()
        if name == "tr" and opened.top() in ("td", "th"):
            kind = opened.pop()[1]
        if end:
            if opened.below[name]:
                kind = opened.close(name)
            continue
        if opened.top() == "p":  # a block ends an open paragraph
            kind = opened.pop()[1]
        if name in _VOID or tag.endswith("/>"):
            continue
        region = _is_region(name, attrs)
        if name in ("article", "main") and kind == CHROME and not inside and not _is_chrome(name, attrs, 1, True):
            if chrome[0] not in closed:
                closed[chrome[0]] = _closed(page, chrome[0])
            if chrome[1] not in closed[chrome[0]]:
                opened, kind = _Open(), OTHER
        inside = opened.articles()
        comment = name == "article" and bool(opened.below["article"]) and prose > 0 and not _OF_TEXT.search(attrs) and kind != CHROME
        opened.push(name, kind, len(out), region and kind != CHROME)
        if kind != CHROME:
            if comment or _is_chrome(name, attrs, inside, bool(opened.below["article"])):
                kind, chrome = CHROME, (name, m.start())
            elif region:
                kind = CONTENT
    close()
    return out


def _hashes(block: str) -> np.ndarray:
    return word_hashes(block[1:].encode("utf-8", "surrogatepass").split())


def _run_keys(words: np.ndarray, width: int) -> list[tuple[int, int]]:
    """128-bit keys of a block's runs; a block of fewer tokens is one run, of its own kind."""
    width, tag = (width, 0) if len(words) >= width else (len(words), len(words))
    both = [mix(windows(words, width, which) + np.uint64(tag)).view(np.int64).tolist() for which in (0, 1)] if width else [[], []]
    return list(zip(*both, strict=True))


def distinct_runs(streams: list[np.ndarray], pages: list[int], wanted: list[bool], width: int) -> list[tuple[int, int, int, bool]]:
    """(key, key, number of pages, wanted) of every distinct run of ``width`` tokens inside a block.

    A suffix array of the concatenation by prefix doubling, as deep as runs are long:
    neighbours in it with equal names share a prefix of ``width`` tokens. A run is wanted if
    a wanted block has it. Blocks of fewer tokens are runs as a whole.
    """
    short: dict[tuple[int, int], tuple[set[int], list[bool]]] = {}
    for s, page, want in zip(streams, pages, wanted, strict=True):
        if 0 < len(s) < width:
            got = short.setdefault(_run_keys(s, width)[0], (set(), []))
            got[0].add(page)
            got[1].append(want)
    out = [(a, b, len(on), any(want)) for (a, b), (on, want) in short.items()]
    lengths = np.array([len(s) + 1 for s in streams], np.int64)
    if lengths.sum() <= width:
        return out
    ends, own = np.cumsum(lengths) - 1, np.repeat(np.arange(len(streams)), lengths)
    text = np.concatenate([np.append(s, np.uint64(0)) for s in streams])
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, depth = len(rank), 1
    while depth < width:
        step = min(depth, width - depth)
        nxt = np.full(n, -1, np.int64)
        nxt[: n - step] = rank[step:]
        order = np.lexsort((nxt, rank))
        a, b = rank[order], nxt[order]
        name = np.zeros(n, np.int64)
        name[1:] = np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        rank[order] = name
        depth += step
    at = np.flatnonzero(np.arange(n) + width <= ends[own])
    if not len(at):
        return out
    _, first, name = np.unique(rank[at], return_index=True, return_inverse=True)
    pairs = np.unique(np.column_stack([name, np.array(pages)[own[at]]]), axis=0)
    counts = np.bincount(pairs[:, 0])
    hit = np.bincount(name, np.array(wanted, np.float64)[own[at]]) > 0
    keys = [mix(windows(text, width, which)[at[first]]).view(np.int64).tolist() for which in (0, 1)]
    return out + list(zip(*keys, counts.tolist(), hit.tolist(), strict=True))


PARSED = "page_id long, url string, host string, content string, other array<string>, open boolean"
TEXTS = "host string, a long, b long, text string"


def extract(pages: DataFrame, min_run: int = 8, min_pages: int = 3, min_share: float = 0.02, chunk_pages: int = 1000, chunk_chars: int = 16_000_000) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (and from_host: decided by the suffix array).

    Null html is empty, with empty text; pages whose url is null or names no host share one host;
    a null page_id stays null; repeated rows are kept, each with its text. Pages of a host that
    are equal outside their articles count as one, so copies of a page make nothing boilerplate.
    Texts of any length are parsed whole. An empty table gives an empty result; other columns
    are ignored.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page_id, url, page in zip(b["page_id"], b["url"], b["html"], strict=True):
                got = blocks(page)
                content = [t for k, t in got if k == CONTENT]
                other = [("-" if k == CHROME else "+") + t for k, t in got if k != CONTENT]
                m = re.match(r"\s*[a-zA-Z][-+.\w]*://([^/?#\s]*)", url or "")
                rows.append((page_id, url, m[1].lower() if m else "", "\n\n".join(content), other, not content))
            out = pd.DataFrame(rows, columns=["page_id", "url", "host", "content", "other", "open"])
            yield out.astype({"page_id": "Int64"})

    # Staged once: decided pages are answered from here, and only token streams are shuffled.
    parsed = stage(pages.select("page_id", "url", "html").mapInPandas(parse, PARSED), "parsed")
    key = {"a": F.xxhash64("other"), "b": F.xxhash64(F.lit(1), "other")}
    distinct = parsed.withColumns(key).groupBy("host", "a", "b").agg(F.first("other").alias("other"), F.max("open").alias("open"))
    distinct = stage(distinct, "pages")
    n_chunks = F.greatest(F.ceil(F.count("*") / F.lit(chunk_pages)), F.ceil(F.sum(F.length(F.array_join("other", ""))) / F.lit(chunk_chars)))
    hosts = stage(distinct.groupBy("host").agg(F.count("*").alias("pages"), n_chunks.cast("int").alias("chunks")), "hosts")
    # Hosts of more than one chunk are a small part of the hosts; the join is a broadcast only
    # behind a count, and otherwise salted, so that a large host is never one task's.
    large = hosts.where("chunks > 1").select("host", "chunks")
    if large.count() <= BROADCAST_HOSTS:
        dealt = distinct.join(F.broadcast(large), "host", "left")
    else:
        salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = distinct.withColumn("salt", F.pmod("a", F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")
    dealt = dealt.withColumn("chunk", F.pmod("b", F.coalesce("chunks", F.lit(1))).cast("int")).drop("chunks")

    def name_runs(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        streams, pages_of, wanted = [], [], []
        for k, (other, is_open) in enumerate(zip(group["other"], group["open"], strict=True)):
            for t in other:
                streams.append(_hashes(t))
                pages_of.append(k)
                wanted.append(bool(is_open) and t.startswith("+"))
        out = pd.DataFrame(distinct_runs(streams, pages_of, wanted, min_run), columns=["a", "b", "n", "wanted"])
        return out.assign(host=key[0], chunk=key[1])[["host", "chunk", "a", "b", "n", "wanted"]]

    runs = dealt.select("host", "chunk", "other", "open").groupBy("host", "chunk").applyInPandas(name_runs, "host string, chunk int, a long, b long, n long, wanted boolean")
    runs = stage(runs, "runs")
    common = runs.groupBy("host", "a", "b").agg(F.sum("n").alias("n"), F.max("wanted").alias("any")).where((F.col("n") >= min_pages) & F.col("any"))
    common = common.join(hosts.select("host", "pages"), "host").where(F.col("n") >= F.col("pages") * F.lit(min_share))
    marks = runs.where("wanted").select("host", "chunk", "a", "b").join(common.select("host", "a", "b"), ["host", "a", "b"], "left_semi")

    def decide(key: tuple, group: pd.DataFrame, marked: pd.DataFrame) -> pd.DataFrame:
        known, texts = set(zip(marked["a"], marked["b"], strict=True)), []
        for other in group["other"]:
            kept = []
            for t in other:
                if t.startswith("+"):
                    words = _hashes(t)
                    starts = np.array([i for i, k in enumerate(_run_keys(words, min_run)) if k in known], np.int64)
                    if covered(starts, min_run, len(words)).mean() <= 0.5:
                        kept.append(t[1:])
            texts.append("\n\n".join(kept))
        return group[["host", "a", "b"]].assign(text=texts)

    undecided = dealt.where("open").select("host", "chunk", "a", "b", "other")
    by_host = undecided.groupBy("host", "chunk").cogroup(marks.groupBy("host", "chunk")).applyInPandas(decide, TEXTS)
    shown = ["page_id", "url", "text", F.length("text").cast("long").alias("n_chars")]  # code points
    rest = parsed.where("open").withColumns(key).select("page_id", "url", "host", "a", "b").join(by_host, ["host", "a", "b"]).select(*shown, F.lit(True).alias("from_host"))
    decided = parsed.where("NOT open").withColumnRenamed("content", "text").select(*shown, F.lit(False).alias("from_host"))
    return decided.unionByName(rest)
