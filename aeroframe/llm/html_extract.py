"""Main text of web pages: page structure first, then a suffix array over each host.

Every page is parsed once into blocks with a structural class: chrome (menus,
notices, forms and the like), article, or open. Evidence can remove open blocks and
short article blocks: those of a host's pages are concatenated into one token
stream, whose suffix array (prefix doubling) and common prefixes show on how many
distinct pages the runs of every block stand. Open blocks covered by runs of other
pages are boilerplate. Inside an article a block goes only if it is short and all of
it stands on most pages of the host; anything else that repeats there is text that
pages happen to share, and stays.

Pages count once for each different html. The pages of a large host are dealt to
buckets of bounded size; the suffix array of a bucket counts its runs, the counts are
summed over the host and joined back, so what is removed depends on neither the size
of a host nor the deal. Many copies of one page are split over groups of their own.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Tokens of the shortest repeated run that counts.
MIN_RUN = 8
#: Counters of runs for each large host.
CELLS = 4096
#: Pages, and bytes of html, of one suffix array, about (a single page may have more).
BUCKET_PAGES, BUCKET_BYTES = 128, 8 << 20
#: An article block is a notice if it has at most NOTICE_WORDS words and stands on NOTICE_PAGES pages and NOTICE_SHARE of all.
NOTICE_WORDS, NOTICE_PAGES, NOTICE_SHARE = 40, 10, 0.6
#: An open block is boilerplate if so much of it is covered by runs of OPEN_PAGES pages (SHORT_PAGES for a block shorter than a run).
OPEN_SHARE, OPEN_PAGES, SHORT_PAGES = 0.8, 2, 3
#: Large hosts or pages with many copies that are broadcast, at most; beyond that they are joined by shuffle.
BROADCAST_HOSTS = 100_000

CHROME, OPEN, CONTENT, MAIN, ARTICLE = 0, 1, 2, 3, 4

_INSIDE = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""  # of a tag: nothing is tried twice, so broken markup costs no more than whole
_SKIPPED = "script|style|noscript|template|svg|iframe|object|textarea|select|math|title|canvas|audio|video"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_SKIPPED})\b{_INSIDE}>(?:(?<=/>)|.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_INSIDE}(?=>)|[^<>]*+)>|<[!?][^<>]*+>", re.S | re.I)
_ATTR = re.compile(r"([a-zA-Z:-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
_DROP_TAGS = frozenset("nav footer aside form dialog menu head button label fieldset".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_DROP_NAMES = frozenset(
    "ad ads adv adbox adslot adsense advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar topnav subnav sidenav navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription "
    "signup comment comments commentlist commentslist respond reply replies disqus share sharing social related recommended recommendations pagination pager widget widgets login search banner toolbar skip copyright".split()
)
_CONTENT_NAMES = frozenset("article post entry story content".split())
_CLOSED_BY = {"p": _BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in _ATTR.finditer(text)}


def _region(tag: str, attrs: str, inside: int) -> int | None:
    """The class an element gives to what it holds, or None if it changes nothing."""
    if tag in _DROP_TAGS or (tag == "header" and inside < CONTENT):
        return CHROME
    found = ARTICLE if tag == "article" else MAIN if tag == "main" else None
    if attrs:
        a = _attributes(attrs)
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
            return CHROME
        if a.get("role") in _DROP_ROLES:
            return CHROME
        if tag not in ("html", "body", "main"):
            names = set(_NAME.findall(a.get("class", "") + " " + a.get("id", "")))
            if names & _DROP_NAMES or ("header" in names and inside < CONTENT and found is None):
                return CHROME
            if found is None and (a.get("itemprop") == "articlebody" or (tag in ("div", "section", "td") and names & _CONTENT_NAMES)):
                found = CONTENT
        if found is None and a.get("role") in ("main", "article"):
            found = MAIN
    return found


def blocks(page: str | None) -> list[tuple[int, float, str]]:
    """(class, share of characters in links, text) of every block with text, in page order."""
    out: list[tuple[int, float, str]] = []
    if not page:
        return out
    page = page.replace("\x00", "�")
    stack: list[tuple[str, int]] = []
    here, links, parts, linked = OPEN, 0, [], 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = entities.unescape(text)
            if text := " ".join(text.split()):
                out.append((here, min(1.0, linked / len(text)), text))
            parts, linked = [], 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            flush()
        elif tag == "br" or tag == "td" or tag == "th":
            parts.append(" ")
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag == "a":
                        links = max(0, links - 1)
                    here = stack[k][1]
                    del stack[k:]
                    break
                if tag not in _BLOCK and stack[k][0] in _BLOCK:
                    break  # an inline end tag does not reach out of its block
            if tag == "a" and not any(t == "a" for t, _ in stack):
                links = 0
            continue
        if tag in _VOID or m[4].endswith("/"):
            continue
        while stack and tag in _CLOSED_BY.get(stack[-1][0], ()):
            here = stack.pop()[1]
        if tag in _BLOCK:
            # formatting left open inside a paragraph does not keep it open
            k = len(stack) - 1
            while k >= 0 and stack[k][0] not in _BLOCK:
                k -= 1
            if k >= 0 and stack[k][0] == "p":
                here = stack[k][1]
                del stack[k:]
                links = 0
        stack.append((tag, here))
        if tag == "a":
            links += 1
        elif here != CHROME and (region := _region(tag, m[4], here)) is not None and (region == CHROME or region > here):
            if tag not in _BLOCK:
                flush()
            here = region
    if at < len(page):
        parts.append(re.sub(r"<[a-zA-Z/!?][^<]*\Z", "", page[at:]))  # a tag cut off by the end is markup
    flush()
    return out


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and how many tokens each shares with the one before (0 for the first).

    Prefix doubling: ranks by the first 1, 2, 4, ... tokens until all differ; the
    shared lengths are read off the ranks of all levels.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, rank = np.unique(tokens, return_inverse=True)
    levels = [rank.astype(np.int64) + 1]
    size = 1
    while levels[-1].max() < n:
        then = np.zeros(n, np.int64)
        then[: max(n - size, 0)] = levels[-1][size:]
        _, rank = np.unique(levels[-1] * (n + 2) + then, return_inverse=True)
        levels.append(rank.astype(np.int64) + 1)
        size *= 2
    order = np.argsort(levels[-1])
    a, b = order[1:].copy(), order[:-1].copy()
    shared = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        # equal ranks mean 2^k equal tokens only where neither suffix ends before
        same &= np.maximum(a, b) + (1 << k) <= n
        shared[1:] += same << k
        a, b = a + (same << k), b + (same << k)
    return order, shared


def run_pages(tokens: np.ndarray, page: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Per position, on how many distinct pages the run of ``need`` tokens that begins there stands (0 where none is asked for)."""
    order, shared = suffix_array(tokens)
    out = np.zeros(len(tokens), np.int64)
    for length in np.unique(need[need > 0]):
        group = np.cumsum(shared < length)  # suffixes that share so many tokens
        p = page[order]
        pairs = np.unique(group * (int(page.max()) + 1) + p)
        distinct = np.bincount(pairs // (int(page.max()) + 1), minlength=int(group[-1]) + 1)
        found = np.empty(len(tokens), np.int64)
        found[order] = distinct[group]
        mine = need == length
        out[mine] = found[mine]
    return out


Page = list[tuple[int, float, str]]


def open_to_evidence(page: Page) -> list[bool]:
    """Which blocks of a page the evidence of its host can remove: open ones, and short ones of an article."""
    level = max((k for k, _, _ in page), default=CHROME)
    return [k != CHROME and k == level and (k < CONTENT or MIN_RUN <= t.count(" ") + 1 <= NOTICE_WORDS) for k, _, t in page]


class Runs:
    """The runs of all blocks that evidence can remove: MIN_RUN words from each place on, or a whole shorter block."""

    def __init__(self, pages: list[Page]) -> None:
        self.blocks = [(n, t, k) for n, p in enumerate(pages) for (k, _, t), can in zip(p, open_to_evidence(p), strict=True) if can]
        self.page = np.array([n for n, _, _ in self.blocks], np.int64)
        self.words = c.Words(pa.array([t for _, t, _ in self.blocks], pa.large_string()))
        self.name, self.at = self.words.grams(MIN_RUN, short=True)
        self.block = self.words.doc[self.at].astype(np.int64)

    def pages(self) -> np.ndarray:
        """On how many of these pages each run stands, by the suffix array over all blocks."""
        w = self.words
        if not len(self.at):
            return np.zeros(0, np.int64)
        ends = w.first[1:]
        tokens = np.insert(w.hash, ends, np.uint64(1))  # one token for the end of a block: a whole short block is a run with its end
        page = np.insert(self.page[w.doc], ends, self.page)
        need = np.zeros(len(tokens), np.int64)
        count = w.count[self.block]
        need[self.at + self.block] = np.where(count < MIN_RUN, count + 1, MIN_RUN)
        return run_pages(tokens, page, need)[self.at + self.block]

    def boilerplate(self, pages: np.ndarray, total: int) -> np.ndarray:
        """Which blocks go, given the pages of each run and of the host."""
        n = len(self.blocks)
        w = self.words
        short = w.count[self.block] < MIN_RUN
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, self.block, pages)
        hit = pages >= np.where(short, SHORT_PAGES, OPEN_PAGES)
        depth = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(depth, self.at[hit], 1)
        np.add.at(depth, np.minimum(self.at[hit] + MIN_RUN, w.first[1:][self.block[hit]]), -1)
        covered = c.per_doc((np.cumsum(depth)[:-1] > 0).astype(np.int64), w.first)
        article = np.array([k >= CONTENT for _, _, k in self.blocks], bool)
        return np.where(article, least >= max(NOTICE_PAGES, NOTICE_SHARE * total), covered >= OPEN_SHARE * np.maximum(w.count, 1)) & (w.count > 0)


def texts_of(pages: list[Page], gone: np.ndarray) -> list[str]:
    """Main text of each page, given which of the blocks open to evidence are boilerplate."""
    at = 0
    out = []
    for p in pages:
        level = max((k for k, _, _ in p), default=CHROME)
        kept = []
        for (k, link, text), can in zip(p, open_to_evidence(p), strict=True):
            drop = k == CHROME or k < level or (k < CONTENT and link > 0.5)
            if can:
                drop |= bool(gone[at])
                at += 1
            if not drop:
                kept.append(text)
        out.append("\n\n".join(kept))
    return out


def main_texts(pages: list[Page]) -> list[str]:
    """Main text of each page, given the blocks of all (different) pages of a host."""
    runs = Runs(pages)
    return texts_of(pages, runs.boilerplate(runs.pages(), len(pages)))


_SEP = "\x00"


def _pack(found: Page) -> bytes:
    head = bytes(k * 16 + min(15, int(link * 15)) for k, link, _ in found)
    return pa.compress(len(head).to_bytes(4, "little") + head + _SEP.join(t for _, _, t in found).encode("utf-8", "surrogatepass"), "zstd", asbytes=True)


def _unpack(data: bytes, size: int) -> Page:
    raw = pa.decompress(data, size, "zstd", asbytes=True)
    n = int.from_bytes(raw[:4], "little")
    if not n:
        return []
    texts = raw[4 + n :].decode("utf-8", "surrogatepass").split(_SEP)
    return [(h >> 4, (h & 15) / 15, t) for h, t in zip(raw[4 : 4 + n], texts, strict=True)]


def _host() -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _cells(pages: list[Page]) -> pa.Array:
    """Per page, for each different run, twice its counter, and one more if it stands in an open block."""
    runs = Runs(pages)
    is_open = np.array([k < CONTENT for _, _, k in runs.blocks], bool)
    page, name = (runs.page[runs.block], runs.name) if len(runs.name) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    opened = is_open[runs.block] if len(name) else np.zeros(0, bool)
    order = np.lexsort((~opened, name, page))
    page, name, opened = page[order], name[order], opened[order]
    first = np.ones(len(page), bool)
    first[1:] = (page[1:] != page[:-1]) | (name[1:] != name[:-1])
    page, value = page[first], (name[first] % np.uint64(CELLS)).astype(np.int32) * 2 + opened[first]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(page, np.arange(len(pages) + 1)), pa.int32()), pa.array(value.astype(np.int32)))


def _parsed(rows: DataFrame, keep: list[str], evidence_only: bool = False) -> DataFrame:
    """Packed blocks of each page beside the columns ``keep``; of pages for evidence only the blocks that it can remove, and
    the counters of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.tidy(batches):
            for part in c.slices(batch, "html"):
                found = [blocks(x) for x in part.column("html").to_pylist()]
                if evidence_only:
                    found = [[b for b, can in zip(p, open_to_evidence(p), strict=True) if can] for p in found]
                sizes = [4 + len(p) + sum(len(t.encode("utf-8", "surrogatepass")) for _, _, t in p) + max(0, len(p) - 1) for p in found]
                more = {"cells": _cells(found)} if evidence_only else {}
                yield pa.record_batch([*(part.column(k) for k in keep), pa.array(sizes, pa.int32()), pa.array([_pack(p) for p in found], pa.binary()), *more.values()], [*keep, "size", "packed", *more])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.select(*keep, "html").mapInArrow(run, f"{kinds}, size int, packed binary" + ", cells array<int>" * evidence_only)


def _pages(group: pa.Table) -> list[Page]:
    return [_unpack(data, n) for data, n in zip(group.column("packed").to_pylist(), group.column("size").to_pylist(), strict=True)]


def _evidence(rows: DataFrame) -> DataFrame:
    """host, bucket, run, pages: for runs that stand in a bucket of a large host, on how many pages of the whole host.

    Left out are runs on a single page, and those of article blocks alone that cannot stand on enough pages: each
    host has CELLS counters, a run adds one to its counter for each page, so a counter below what a notice
    needs shows that all its runs are below it too. Counters that open blocks use are kept whole. What is left
    does not depend on how pages are dealt.
    """
    parsed = _parsed(rows.where("buckets is not null"), ["host", "bucket", "content", "total"], evidence_only=True)
    once = c.stash(parsed.dropDuplicates(["host", "content"]), "evidence")
    cells = once.select("host", "total", F.explode("cells").alias("v")).groupBy("host", F.shiftright("v", 1).alias("cell"))
    cells = cells.agg(F.count("*").alias("n"), F.max(F.col("v").bitwiseAND(F.lit(1))).alias("open"), F.max("total").alias("total"))
    full = cells.where((F.col("open") == 1) | (F.col("n") >= F.greatest(F.lit(NOTICE_PAGES), NOTICE_SHARE * F.col("total"))))
    full = full.groupBy("host").agg(F.collect_list("cell").alias("full"))  # CELLS at most
    once = once.drop("cells", "total").join(F.broadcast(full) if c.small_enough(full, BROADCAST_HOSTS // 10) else full, "host", "left")

    def count(group: pa.Table) -> pa.Table:
        runs = Runs(_pages(group))
        n = runs.pages()
        name, first = np.unique(runs.name, return_index=True)
        use = np.isin(name % np.uint64(CELLS), np.array(group.column("full")[0].as_py() or [], np.uint64))
        name, n = name[use], n[first][use]
        return pa.table({"host": pa.array([group.column("host")[0].as_py()] * len(n), pa.string()), "bucket": pa.array(np.full(len(n), group.column("bucket")[0].as_py(), np.int32)), "run": pa.array(name.view(np.int64)), "n": pa.array(n)})

    counted = c.stash(once.groupBy("host", "bucket").applyInArrow(count, "host string, bucket int, run long, n long"), "runs")
    totals = counted.groupBy("host", "run").agg(F.sum("n").alias("pages")).where("pages > 1")
    return counted.join(totals, ["host", "run"]).select("host", "bucket", "run", "pages")


def extract(pages: DataFrame, bucket_pages: int = BUCKET_PAGES) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Null or empty html gives an empty text; a page without a readable host is
    compared with the other pages without one. Repeated rows each give a row, but
    equal html counts as one page. Very long pages are parsed whole. Blocks of equal
    standing keep page order. An empty table gives no row; other columns are ignored,
    whatever their names.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", _host()).withColumn("content", F.xxhash64("html"))
    contents = c.stash(rows.groupBy("host", "content").agg(F.count("*").alias("copies"), F.first(F.length("html")).alias("chars")), "contents")
    hosts = contents.groupBy("host").agg(F.count("*").alias("total"), F.sum("chars").alias("chars"), F.max("copies").alias("most"))
    hosts = hosts.withColumn("buckets", F.ceil(F.greatest(F.col("total") / bucket_pages, F.col("chars") / BUCKET_BYTES)).cast("int"))
    large = hosts.where((F.col("buckets") > 1) | (F.col("most") > bucket_pages)).select("host", "total", F.greatest("buckets", F.lit(1)).alias("buckets"))
    crowds = contents.where(F.col("copies") > bucket_pages).select("host", "content", F.ceil(F.col("copies") / bucket_pages).cast("int").alias("parts"))
    near = lambda df: F.broadcast(df) if c.small_enough(df, BROADCAST_HOSTS) else df
    rows = rows.join(near(large), "host", "left").join(near(crowds), ["host", "content"], "left")
    rows = rows.withColumn("bucket", F.pmod("content", F.coalesce("buckets", F.lit(1))).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))).cast("int"))
    parsed = _parsed(rows, ["page_id", "url", "host", "content", "total", "bucket", "part"])
    # what a bucket knows of the host goes to each part of it
    split = crowds.join(large, "host").groupBy("host", F.pmod("content", "buckets").cast("int").alias("bucket")).agg(F.max("parts").alias("parts"))
    known = _evidence(rows).join(near(split), ["host", "bucket"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).select("host", "bucket", "part", "run", "pages")

    def compare(group: pa.Table, evidence: pa.Table) -> pa.Table:
        group = group.sort_by([("page_id", "ascending"), ("url", "ascending")])
        content, total = group.column("content").to_numpy(), group.column("total").to_pylist()
        kinds, first, of = np.unique(content, return_index=True, return_inverse=True)
        found: list[str] = []
        if group.num_rows and total[0] is None:  # the whole host
            found = main_texts(_pages(group.take(pa.array(first))))
        elif group.num_rows:
            run, n = evidence.column("run").to_numpy().view(np.uint64), evidence.column("pages").to_numpy()
            order = np.argsort(run)
            run, n = run[order], n[order]
            for k in range(0, len(first), 32):  # each page by itself
                several = _pages(group.take(pa.array(first[k : k + 32])))
                runs = Runs(several)
                at = np.minimum(np.searchsorted(run, runs.name), max(len(run) - 1, 0))
                seen = np.where(run[at] == runs.name, n[at], 1) if len(run) else np.ones(len(runs.name), np.int64)
                found += texts_of(several, runs.boilerplate(seen, total[0]))
        texts = pa.array(found, pa.string()).take(pa.array(of.astype(np.int64))) if found else pa.array([], pa.string())
        sizes = np.array([len(t) for t in found], np.int64)
        return pa.table({"page_id": group.column("page_id"), "url": group.column("url"), "text": texts, "n_chars": pa.array(sizes[of] if found else sizes)})

    keys = ["host", "bucket", "part"]
    return parsed.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(compare, "page_id long, url string, text string, n_chars long")
