"""Operator 2: main text of HTML pages by a suffix array over each host's token streams, with markup zones.

The parser cuts a page into blocks and gives each a zone: ``chrome`` (menus, headers, footers, sidebars, notices, adverts,
forms, comments), ``body`` (inside an article or main element) or ``open`` (neither). The token streams of a host's blocks outside
articles are concatenated in shards and sorted as suffixes; neighbours of the suffix array that share ``RUN`` tokens (or a whole
shorter block) and come from distinct pages are repeats, which are gathered across shards by their first tokens. (Every longer
repeat is covered by such runs, and every position of it starts or lies in one.) On pages with open text, whether they have an
article or not, open text that runs cover is boilerplate and goes; unique runs stay. Chrome goes by its markup, and body blocks
are kept whole, since articles may quote or copy each other.

Where a page has no article and repeats cover all of its open text, the page is a copy of another one as a whole, and its open text is kept.

Defined results: null html is an empty page; a page without text gives an empty string; repeated rows are a page each but
count as one page when runs are counted (same page_id); a null page_id gets a row like any other, a null url is a host of its own; pages
of any length are read whole; extra columns, whatever their names, are ignored; empty tables give no row.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import mix64, staged

#: A repeated run must have this many tokens, or be a whole block.
RUN = 8
#: Characters outside articles that a shard of a host holds, or one page.
SHARD = 4_000_000
#: Elements by what they mean for the main text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "title", "xmp", "noembed", "noframes")
_CHROME = frozenset("nav header footer aside form menu dialog button select option fieldset label legend datalist output input head".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebar|side|widget\w*|cookies?|consent|gdpr|notices?|"
    r"alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|social|share|sharing|related|recommend\w*|comments?|disqus|respons\w*|replies|reply|pagination|pager|toolbar|skip\w*|hidden)(?:$|[\s_-])"
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Comments, declarations and elements whose content isn't markup: whichever begins first ends where it ends.
_SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(" + "|".join(_RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: Names of what readers write.
_READERS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|respons\w*|replies|reply)(?:$|[\s_-])")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def is_chrome(name: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element holds what isn't main text, by its name, class, id or role; inside: in an article.

    The outermost article is chrome only if it is named as what readers write; one inside it may be any kind of chrome.
    """
    if name in _CHROME:
        return True
    if not attributes.strip():
        return False
    names = None if name in ("body", "html") else _READERS if name in ("article", "main") and not inside else _NAMES
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if (key == "role" and value in _ROLES) or (key in ("class", "id") and names and names.search(value)):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of each block with text, in page order; references decoded, white space folded."""
    page = _SKIPPED.sub(" ", page or "")
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, opens chrome, opens the article
    chrome = article = 0
    text: list[str] = []

    def flush() -> None:
        if text:
            words = html_lib.unescape("".join(text)).split()
            text.clear()
            if words:
                out.append(("chrome" if chrome else "body" if article else "open", " ".join(words)))

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m[2].lower()
        if name == "br":
            text.append(" ")
            continue
        # A page's or a section's header inside an article heads it; only elsewhere it is chrome.
        marks = not m[1] and name not in _VOID and not (name == "header" and article) and is_chrome(name, m[3], article > 0)
        body = name in ("article", "main")
        if name in _BLOCK or marks or any(n == name and c for n, c, _ in stack[-1:]):
            flush()
        if m[1]:
            if any(n == name for n, _, _ in stack):
                while True:
                    n, c, b = stack.pop()
                    chrome, article = chrome - c, article - b
                    if n == name:
                        break
        elif name not in _VOID and not m[3].endswith("/"):
            if name == "p":
                while any(n == "p" for n, _, _ in stack) and stack[-1][0] not in ("article", "main", "div", "section", "body", "td", "li"):
                    n, c, b = stack.pop()
                    chrome, article = chrome - c, article - b
                    if n == "p":
                        break
            stack.append((name, marks, body))
            chrome, article = chrome + marks, article + body
    text.append(re.sub(r"<[^>]*\Z", "", page[at:]))
    flush()
    return out


def tokens(text: str) -> np.ndarray:
    """64-bit hashes of a block's words."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in text.split()], np.uint64)


def suffix_array(stream: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a token stream sorted by their suffixes to at least the given depth, and whether each equals its predecessor so far."""
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth:
        after = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)])[: len(rank)]
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
    order = np.argsort(rank, kind="stable")
    return order, np.concatenate([[False], rank[order][1:] == rank[order][:-1]])


def _host() -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def repeated_runs(parsed: DataFrame, run: int = RUN) -> DataFrame:
    """Rows (host, prefix) of the runs of tokens that at least two pages of a host share; run: a power of two.

    A host's streams are dealt into shards of a bounded size, so that no host has to fit in one task. A repeat leaves the suffix
    array of its shard as one row with the least and the largest page, and so does each suffix without equal neighbours.
    """

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shard = pdf["outside"].map(lambda texts: sum(map(len, texts))).cumsum() // SHARD
            for (host, _), rows in pdf.groupby(["host", shard], sort=False):
                found = _shard(rows["page_key"].tolist(), rows["outside"].tolist(), run)
                if found is not None:
                    yield pd.DataFrame({"host": host, "prefix": found[0], "low": found[1], "high": found[2]})

    rows = parsed.select("host", "page_key", "outside").filter(F.size("outside") > 0)
    found = rows.mapInPandas(sort, "host string, prefix long, low long, high long")
    return found.groupBy("host", "prefix").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("host", "prefix")


def _shard(keys: list[int], pages_blocks: list, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """First tokens (hashed), least and largest page of each distinct run in the suffix array of some pages of a host."""
    streams, pages, lengths = [], [], []
    for key, texts in zip(keys, pages_blocks, strict=True):
        for text in texts:
            t = tokens(text)
            # So many end marks that no run goes on into the next block, and a shorter block is a run of its own.
            streams += [t, np.zeros(run, np.uint64)]
            pages += [key] * (len(t) + run)
            lengths += [*range(len(t), 0, -1), *[0] * run]
    if not streams:
        return None
    stream, pages, lengths = np.concatenate(streams), np.array(pages, np.int64), np.array(lengths)
    order, equal = suffix_array(stream, run)
    counted = _counted(lengths, run)[order]
    # Neighbours that share the run have the same number in this count; suffixes that don't count are left out.
    same = np.cumsum(~equal)[counted]
    order = order[counted]
    if not len(order):
        return None
    starts = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    pages = pages[order]
    return _prefixes(stream, lengths, run)[order[starts]].view(np.int64), np.minimum.reduceat(pages, starts), np.maximum.reduceat(pages, starts)


def _counted(lengths: np.ndarray, run: int) -> np.ndarray:
    """Suffixes with a whole run left, and the first one of each shorter block; lengths: tokens left of the block."""
    first = np.concatenate([[True], lengths[:-1] <= 1])[: len(lengths)]
    return (lengths >= run) | (first & (lengths > 0))


def _prefixes(stream: np.ndarray, lengths: np.ndarray, run: int) -> np.ndarray:
    """Hash of the first ``run`` tokens of each suffix, or of the whole rest of its block where that is shorter."""
    n = np.minimum(lengths, run)
    out = mix64(n.astype(np.uint64))
    with np.errstate(over="ignore"):
        for k in range(run):
            at = np.minimum(np.arange(len(stream)) + k, len(stream) - 1)
            out = np.where(k < n, mix64(out * np.uint64(31) + stream[at]), out)
    return out


def parse_pages(pages: DataFrame) -> DataFrame:
    """Rows with a page's blocks in order, their zones, and the text of those outside articles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept, zones, outside = [], [], []
            for page in pdf["html"]:
                found = blocks(page)
                kept.append([t for z, t in found if z == "body"])
                zones.append("".join(z[0] for z, _ in found))
                outside.append([t for z, t in found if z != "body"])
            yield pdf[["row", "no_id", "url", "host", "page_key"]].assign(kept=kept, zones=zones, outside=outside)

    own = F.col("page_id").cast("long")
    rows = pages.select(
        F.coalesce(own, F.lit(0)).alias("row"),
        own.isNull().alias("no_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(_host(), F.lit("")).alias("host"),
        F.coalesce(own, F.xxhash64("url", "html")).alias("page_key"),
        F.col("html").cast("string").alias("html"),
    )
    schema = "row long, no_id boolean, url string, host string, page_key long, kept array<string>, zones string, outside array<string>"
    return rows.mapInPandas(run, schema)


def _joined(kept: list[str], zones: str, outside: list[str], hits: set[int], run: int) -> str:
    """Main text of a page with open blocks; hits: the tokens outside articles, by number, at which repeats start."""
    body, others, out, spare, at = iter(kept), iter(outside), [], [], 0
    for zone in zones:
        text = next(body if zone == "b" else others)
        if zone == "b":
            out.append(text)
            continue
        words = text.split()
        if zone == "o":
            covered = np.zeros(len(words), bool)
            for a in range(len(words)):
                if at + a in hits:
                    covered[a : a + run] = True
            spare.append(text)
            if not covered.all():
                out.append(" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c))
        at += len(words)
    return "\n".join(out or spare)


def extract(pages: DataFrame, run: int = RUN) -> DataFrame:
    """Rows (page_id, url, text, n_chars)."""
    parsed = staged(parse_pages(pages), "parsed").withColumn("key", F.xxhash64("host", "page_key", "zones", "outside"))
    is_open = F.contains("zones", F.lit("o"))
    opened = parsed.filter(is_open)
    # Repeats are asked for where markup leaves text undecided: on hosts of such pages, over all text outside articles there.
    hosts = opened.select("host").distinct()
    runs = staged(repeated_runs(parsed.join(hosts.hint("merge"), "host", "left_semi"), run), "runs")  # so that the join below can split a hot host's runs

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of each page outside articles, by the number of their first token."""
        for pdf in batches:
            for key, host, outside in zip(pdf["key"], pdf["host"], pdf["outside"], strict=True):
                streams = [tokens(t) for t in outside]
                left = np.concatenate([np.arange(len(t), 0, -1) for t in streams])
                asked = _counted(left, run)
                prefix = _prefixes(np.concatenate(streams), left, run)[asked]
                yield pd.DataFrame({"key": key, "host": host, "at": np.flatnonzero(asked).astype(np.int32), "prefix": prefix.view(np.int64)})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = zip(pdf["kept"], pdf["zones"], pdf["outside"], pdf["hits"], strict=True)
            texts = [_joined(list(kept), zones, list(outside), set() if hits is None else set(hits), run) for kept, zones, outside, hits in rows]
            yield pdf[["row", "no_id", "url"]].assign(text=texts)

    asked = opened.select("key", "host", "outside").mapInPandas(ask, "key long, host string, at int, prefix long").distinct()
    hit = asked.join(runs.hint("merge"), ["host", "prefix"]).groupBy("key").agg(F.collect_set("at").alias("hits"))
    settled = parsed.filter(~is_open).select("row", "no_id", "url", F.array_join("kept", "\n").alias("text"))
    mixed = opened.join(hit.hint("merge"), "key", "left").mapInPandas(join, "row long, no_id boolean, url string, text string")
    both = settled.unionByName(mixed)
    return both.select(F.when(~F.col("no_id"), F.col("row")).alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 2 over the whole of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
