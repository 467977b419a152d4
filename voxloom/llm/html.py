"""Main text of web pages: structure first, then the repeated runs of a host.

A page is cut into text blocks. Elements whose tag, class, id or role marks a
menu, header, footer, sidebar, notice, advert, form or reader comments are left
out; blocks inside an article (or else a main element) are marked as main, and others go, if they hold the
share MAIN_LEAST of the page's remaining text; a smaller article is a card beside the
text, and the other blocks stay with it. Then the pages of a host are put together: their token streams are concatenated, a
suffix array of the concatenation is built by prefix doubling (to the depth of
the shortest run that counts), and suffixes that are neighbours in it with an
equal beginning are runs that distinct pages repeat. That depth settles all longer
substrings too: one that enough pages repeat consists of shortest runs that these
pages repeat, so both cover the same tokens. Blocks that such runs cover
wholly are boilerplate; blocks of unique runs stay. Outside of marked main text a
run counts once MIN_PAGES pages and the share SHARE of the pages hold it; inside,
where quoted passages are legitimate, the larger share MAIN_SHARE is asked for. A
page most of which is repeated is a copy of another page, and keeps its blocks.

Shares are taken of at most SHARE_PAGES pages, so that what many pages of a large
host repeat counts, however many others there are.

A host of more than CHUNK_CHARS characters is dealt by the hash of the page over
as many chunks as that asks for, each with a suffix array of its own. Pages of a run
are summed over all chunks of the host, in two steps so that few digests travel: first
every chunk sends how many pages hold the runs of each slot (a slot takes the runs of
many digests), those of one page too; a run whose slot does not reach the pages asked
for does not reach them either. Of the other slots each chunk sends the 64-bit digests
of the runs with their pages, and gets back the runs that count. Its pages thus lose
the blocks that they would lose if one task held the whole host, and no task does.

Defined results: null and empty html give an empty text. Pages without a host
are judged by structure alone. Rows are independent otherwise; repeated ids stay
separate rows, and repeated pages count as pages of the host.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import checkpointed, slices
from voxloom.llm.urlgraph import host_of

RUN, MIN_PAGES, SHARE, MAIN_SHARE, MAIN_PAGES = 6, 3, 0.1, 0.5, 10
#: Share of a page's text that an article or main element holds at least if it is the main text.
MAIN_LEAST = 0.2
#: Pages of a host of which shares are taken; on hosts with more, a fixed number of pages is asked for.
SHARE_PAGES = 1_000
CHUNK_CHARS = 4_000_000
#: Large hosts whose list (about 50 bytes each) may be sent to all executors.
BROADCAST_HOSTS = 100_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|select|svg|iframe|object|title)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT_TAGS = frozenset("nav footer aside form button dialog menu head label".split())
#: Words in a class, id or role that mark what is not the article.
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars aside footer complementary contentinfo cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations trending widget widgets pager pagination toolbar search searchform skip skiplink form".split()
)
_WORDS = re.compile(r"[a-z]+")


def _marked_out(tag: str, attrs: str, main: bool) -> bool:
    if tag in _OUT_TAGS or (tag == "header" and not main):
        return True
    if tag in ("html", "body", "main") or "=" not in attrs:
        return False
    for m in _NAMED.finditer(attrs):
        words = set(_WORDS.findall((m[1] or m[2] or m[3] or "").lower()))
        if words & _OUT_WORDS or ("header" in words and not main):
            return True
    return False


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(1 if inside an article or main element, text) of every block that its structure does not rule out."""
    out: list[tuple[int, str]] = []
    buffer: list[str] = []
    article, main, skip, depth = 0, 0, "", 0

    def flush() -> None:
        if buffer:
            if text := " ".join("".join(buffer).split()):
                out.append((2 if article else 1 if main else 0, text))
            buffer.clear()

    for m in _TOKEN.finditer(page or ""):
        if (raw := m["text"]) is not None:
            if not skip:
                buffer.append(entities.unescape(raw))
            continue
        if m["tag"] is None:
            if not skip and m[0].startswith("<![CDATA["):
                buffer.append(m[0][9:-3])
            continue
        tag, closing, attrs = m["tag"].lower(), bool(m["close"]), m["attrs"] or ""
        empty = tag in _VOID or attrs.endswith("/") and tag not in _BLOCKS
        if skip:
            if tag == skip and not empty:
                depth += -1 if closing else 1
            if not depth or (skip == "p" and tag in _BLOCKS) or (skip == "head" and tag == "body"):
                skip = ""
            elif tag in ("article", "main") and not closing and skip not in ("article", "aside", "form", "nav", "section") and not _marked_out(tag, attrs, False):
                skip = ""  # a part that was never closed ends where the article begins
            if skip or closing or tag == "body":
                continue
        if tag in _BLOCKS:
            flush()
        elif tag == "br":
            buffer.append(" ")
        if closing:
            article -= tag == "article" and article > 0
            main -= tag == "main" and main > 0
            continue
        if not empty and _marked_out(tag, attrs, bool(article or main)):
            skip, depth = tag, 1
            continue
        article += tag == "article"
        main += tag == "main" or (tag == "div" and 'role="main"' in attrs)
    flush()
    total = sum(len(text) for _, text in out)
    for least in (2, 1):
        own = [text for kind, text in out if kind >= least]
        if own and sum(map(len, own)) >= MAIN_LEAST * total:
            return [(1, text) for text in own]
    return [(min(kind, 1), text) for kind, text in out]


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix among all by its first ``depth`` tokens (prefix doubling); equal beginnings have equal ranks."""
    n = len(tokens)
    rank, have = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while have < depth:
        step = min(have, depth - have)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:] if n > step else after[: n - step]
        rank = np.unique(rank * (n + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


def least_pages(pages: int, main: int) -> float:
    """Pages that must hold a run before it counts, by the pages of the whole host."""
    shared = min(pages, SHARE_PAGES)
    return max(MAIN_PAGES, MAIN_SHARE * shared) if main else max(MIN_PAGES, SHARE * shared)


def _stream(pages: list[list[tuple[int, str]]], run: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """Tokens of the pages in a row, the page of each, and (page, block, first token, tokens) of each block."""
    stream: list[int] = []
    where: list[tuple[int, int, int, int]] = []
    owner: list[int] = []
    for p, own in enumerate(pages):
        for b, (_, text) in enumerate(own):
            words = [xxhash.xxh64_intdigest(w) >> 1 for w in text.split()]
            where.append((p, b, len(stream), len(words)))
            stream += words
            # Marks after a block let a short block be a run of its own, and keep runs from crossing pages.
            stream += [-1] * max(1, run - len(words))
            owner += [p] * (len(stream) - len(owner))
        stream.append(-2 - p)
        owner.append(p)
    return np.array(stream, np.int64), np.array(owner, np.int64), where


def _ranks_held(stream: np.ndarray, owner: np.ndarray, pages: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each suffix by its first ``run`` tokens, and the number of pages that hold each rank."""
    rank = suffix_ranks(stream, run)
    pairs = np.unique(rank * pages + owner)
    return rank, np.bincount(pairs // pages, minlength=int(rank.max()) + 1)


def _digests(stream: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    """64-bit digests of the runs that begin at the given tokens; they depend on the tokens alone."""
    out = np.zeros(len(at), np.uint64)
    for i in range(run):
        out = (out ^ stream[at + i].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def run_pages(pages: list[list[tuple[int, str]]], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(digest, number of pages that hold it) of every run in some pages of a host, those of one page too."""
    stream, owner, where = _stream(pages, run)
    if not where:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    rank, held = _ranks_held(stream, owner, len(pages), run)
    # A long block's end and the mark after it may equal a block that is one token shorter than a run.
    starts = np.concatenate([np.arange(start, start + max(1, n - run + 2)) for _, _, start, n in where])
    ranks, first = np.unique(rank[starts], return_index=True)
    return _digests(stream, starts[first], run), held[ranks].astype(np.int32)


def slots_of(digests: np.ndarray, parts: int, total: int) -> np.ndarray:
    """Slot of each digest: ``parts`` ranges of digests, each of as many slots as ``range_slots`` tells."""
    width = range_slots(total)
    return (digests % np.uint64(parts)).astype(np.int64) * width + (digests // np.uint64(parts) % np.uint64(width)).astype(np.int64)


def range_slots(total: int) -> int:
    """So many that runs of few pages which share a slot seldom reach together what one run must reach."""
    return max(256, int(CHUNK_CHARS / least_pages(total, 0)))


def _pack(slots: np.ndarray, counts: np.ndarray) -> bytes:
    values = np.concatenate([np.diff(slots, prepend=0), counts]).astype("<i4")
    return zlib.compress(values.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    values = np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel().astype(np.int64)
    half = len(values) // 2
    return np.cumsum(values[:half]), values[half:]


def host_slots(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sum the chunks' counts of one range of a host's slots; each chunk gets back those of its slots that may count."""
    total = int(pdf["total"].iloc[0])
    sums = np.zeros(range_slots(total), np.int64)
    own = [_unpack(p) for p in pdf["slots"]]
    for slots, counts in own:
        sums[slots] += counts
    kept = sums >= least_pages(total, 0)
    rows = [(pdf["host"].iloc[0], part, r, _pack(i, sums[i])) for part, r, (slots, _) in zip(pdf["part"], pdf["range"], own, strict=True) if len(i := slots[kept[slots]])]
    return pd.DataFrame(rows, columns=["host", "part", "range", "slots"])


def pages_of_runs_in(pages: list[list[tuple[int, str]]], slots: np.ndarray, parts: int, total: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """As ``run_pages``, of the runs in the given slots."""
    stream, owner, where = _stream(pages, run)
    if not where or not len(slots):
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    starts = np.concatenate([np.arange(start, start + max(1, n - run + 2)) for _, _, start, n in where])
    digests = _digests(stream, starts, run)
    wanted = np.isin(slots_of(digests, parts, total), slots)
    known, at = np.unique(digests[wanted], return_inverse=True)
    pairs = np.unique(at * len(pages) + owner[starts[wanted]])
    return known, np.bincount(pairs // len(pages), minlength=len(known)).astype(np.int32)


def _covered(pages: list[list[tuple[int, str]]], where: list[tuple[int, int, int, int]], held: np.ndarray, total: int, run: int) -> list[list[bool]]:
    out = [[False] * len(own) for own in pages]
    size = np.zeros(len(pages))
    gone = np.zeros(len(pages))
    for p, b, start, n in where:
        starts = np.flatnonzero(held[start : start + max(1, n - run + 1)] >= least_pages(total, pages[p][b][0]))
        covered = np.zeros(n, bool)
        for s in starts:
            covered[s : s + run] = True
        out[p][b] = bool(n) and bool(covered.all())
        size[p] += n
        gone[p] += n * out[p][b]
    for p in np.flatnonzero(gone * 2 > size):
        if any(kind for kind, _ in pages[p]):
            out[p] = [False] * len(out[p])
    return out


def repeated_blocks(pages: list[list[tuple[int, str]]], run: int = RUN) -> list[list[bool]]:
    """For each block of each page of one host: whether runs that other pages repeat cover it wholly."""
    stream, owner, where = _stream(pages, run)
    if not where:
        return [[False] * len(own) for own in pages]
    rank, held = _ranks_held(stream, owner, len(pages), run)
    return _covered(pages, where, held[rank], len(pages), run)


def repeated_blocks_of_chunk(pages: list[list[tuple[int, str]]], total: int, digests: np.ndarray, counts: np.ndarray, run: int = RUN) -> list[list[bool]]:
    """As ``repeated_blocks``, for some pages of a host of ``total`` pages, with the runs' pages counted over the host."""
    stream, _, where = _stream(pages, run)
    held = np.zeros(len(stream), np.int64)
    if len(digests) and where:
        order = np.argsort(digests)
        known, counts = digests[order], counts[order]
        starts = np.concatenate([np.arange(start, start + max(1, n - run + 1)) for _, _, start, n in where])
        own = _digests(stream, starts, run)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        held[starts] = np.where(known[at] == own, counts[at], 0)
    return _covered(pages, where, held, total, run)


def host_totals(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sum the chunks' counts of one range of a host's runs; each chunk gets back those of its runs that count."""
    digests = [np.frombuffer(d, np.uint64) for d in pdf["digests"]]
    if not digests:
        return pdf[["host", "part", "digests", "counts"]]
    every, at = np.unique(np.concatenate(digests), return_inverse=True)
    sums = np.bincount(at, np.concatenate([np.frombuffer(c, np.int32) for c in pdf["counts"]])).astype(np.int64)
    kept = sums >= least_pages(int(pdf["total"].iloc[0]), 0)
    rows, start = [], 0
    for part, own in zip(pdf["part"], digests, strict=True):
        i = at[start : start + len(own)]
        start += len(own)
        if len(i := i[kept[i]]):
            rows.append((pdf["host"].iloc[0], part, every[i].tobytes(), sums[i].tobytes()))
    return pd.DataFrame(rows, columns=["host", "part", "digests", "counts"])


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row."""
    own = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    large = checkpointed(own.groupBy("host").agg(F.sum(F.length("html")).alias("chars"), F.count("*").alias("total")).where(F.col("chars") > CHUNK_CHARS).select(F.col("host").alias("large"), F.ceil(F.col("chars") / CHUNK_CHARS).alias("parts"), "total"))
    bounded = F.broadcast(large) if large.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else large
    dealt = own.join(bounded, F.col("host") == F.col("large"), "left").withColumn("part", F.pmod(F.xxhash64("id", "url", "html"), F.coalesce("parts", F.lit(1))))
    id_type = pages.schema[key].dataType
    carried = ["id", "url", "host", "part", "parts", "total"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                packed = [zlib.compress(json.dumps(blocks(t)).encode(), 1) for t in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(packed, pa.binary())], [*carried, "blocks"])

    def unpacked(pdf: pd.DataFrame) -> list[list[tuple[int, str]]]:
        return [[(k, t) for k, t in json.loads(zlib.decompress(b))] for b in pdf["blocks"]]

    def written(pdf: pd.DataFrame, own: list[list[tuple[int, str]]], drop: list[list[bool]]) -> pd.DataFrame:
        texts = ["\n\n".join(t for (_, t), d in zip(b, gone, strict=True) if not d) for b, gone in zip(own, drop, strict=True)]
        return pd.DataFrame({key: pdf["id"], url: pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    def clean(pdf: pd.DataFrame) -> pd.DataFrame:
        own = unpacked(pdf)
        return written(pdf, own, repeated_blocks(own) if pdf["host"].iloc[0] else [[False] * len(b) for b in own])

    def by_range(pdf: pd.DataFrame, ranges: np.ndarray, made: dict[str, Callable[[np.ndarray], bytes]]) -> pd.DataFrame:
        used, starts = np.unique(ranges, return_index=True)
        rows = [(pdf["host"].iloc[0], pdf["part"].iloc[0], pdf["total"].iloc[0], r, *(f(i) for f in made.values())) for r, i in zip(used, np.split(np.arange(len(ranges)), starts[1:]), strict=True)] if len(used) else []
        return pd.DataFrame(rows, columns=["host", "part", "total", "range", *made])

    def count_slots(pdf: pd.DataFrame) -> pd.DataFrame:
        digests, counts = run_pages(unpacked(pdf))
        width = range_slots(int(pdf["total"].iloc[0]))
        slots, at = np.unique(slots_of(digests, int(pdf["parts"].iloc[0]), int(pdf["total"].iloc[0])), return_inverse=True)
        sums = np.bincount(at, counts, minlength=len(slots)).astype(np.int64)
        return by_range(pdf, slots // width, {"slots": lambda i: _pack(slots[i] % width, sums[i])})

    def count(pdf: pd.DataFrame, slots: pd.DataFrame) -> pd.DataFrame:
        parts, total = int(pdf["parts"].iloc[0]), int(pdf["total"].iloc[0])
        wanted = np.concatenate([np.empty(0, np.int64), *(r * range_slots(total) + _unpack(s)[0] for r, s in zip(slots["range"], slots["slots"], strict=True))])
        digests, counts = pages_of_runs_in(unpacked(pdf), wanted, parts, total) if len(wanted) else (np.empty(0, np.uint64), np.empty(0, np.int32))
        ranges = (digests % np.uint64(parts)).astype(np.int64)
        order = np.argsort(ranges, kind="stable")
        return by_range(pdf, ranges[order], {"digests": lambda i: digests[order[i]].tobytes(), "counts": lambda i: counts[order[i]].tobytes()})

    def clean_chunk(pdf: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        own = unpacked(pdf)
        digests, counts = (np.concatenate([np.empty(0, t), *(np.frombuffer(x, t) for x in hits[c])]) for c, t in (("digests", np.uint64), ("counts", np.int64)))
        return written(pdf, own, repeated_blocks_of_chunk(own, int(pdf["total"].iloc[0]), digests, counts))

    made = T.StructType([T.StructField(key, id_type), T.StructField(url, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    parsed = T.StructType([T.StructField("id", id_type), T.StructField("url", T.StringType()), T.StructField("host", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("part", "parts", "total")], T.StructField("blocks", T.BinaryType())])
    many = F.coalesce(F.col("parts") > 1, F.lit(False)) & (F.col("host") != "")
    packed = lambda rows: rows.select(*carried, "html").mapInArrow(parse, parsed)
    whole, chunks = packed(dealt.where(~many)), packed(dealt.where(many))
    sketched = chunks.groupBy("host", "part").applyInPandas(count_slots, "host string, part long, total long, range long, slots binary")
    slots = sketched.groupBy("host", "range").applyInPandas(host_slots, "host string, part long, range long, slots binary")
    counted = chunks.groupBy("host", "part").cogroup(slots.groupBy("host", "part")).applyInPandas(count, "host string, part long, total long, range long, digests binary, counts binary")
    hits = counted.groupBy("host", "range").applyInPandas(host_totals, "host string, part long, digests binary, counts binary")
    return whole.groupBy("host", "part").applyInPandas(clean, made).unionByName(chunks.groupBy("host", "part").cogroup(hits.groupBy("host", "part")).applyInPandas(clean_chunk, made))
