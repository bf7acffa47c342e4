"""Main text of web pages: markup guards the article, suffix arrays per host take boilerplate out of everything else.

Of each page, elements that are no article text by their kind (menus, footers, forms and the like) go. Text in an article
or main element is guarded. All other text of all pages of a host is searched for long substrings that distinct pages
share; they go and the unique runs stay. A page is its guarded text; one without any is what is left of the rest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, packed, schema_of, slices

#: Boilerplate is a run of at least so many tokens that at least so many pages of a host share (RUN is a power of two).
RUN, PAGES = 8, 3
#: A run that holds more than one in so many of all occurrences is found by broadcast, so that none fills a task.
HEAVY = 1000

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe|template|svg|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([\w:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
_DROP = frozenset("nav footer aside form button dialog menu head search fieldset object canvas audio video".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Containers that such a class or id, as a whole, marks as something else than the article: adverts and widgets anywhere,
#: and outside articles also the page's furniture, whose names an article may give to parts of its own.
_BOXES = frozenset("div section ul ol li table center ins article".split())
_ADVERTS = frozenset("ad ads advert adverts advertisement cookie-banner cookie-notice newsletter promo share share-bar social sponsored".split())
_NAMES = _ADVERTS | frozenset(
    "banner breadcrumb breadcrumbs footer header menu nav navbar navigation notice pagination sidebar site-footer site-header".split()
)
#: Part of a class or id that marks readers' comments, anywhere.
_COMMENTS = re.compile(r"(?:^|[-_])(?:comments?|commentlist|disqus|respond)(?:[-_]|$)")


def _off(name: str, rest: str, inside: bool) -> bool:
    """Whether an element holds something else than article text."""
    if name in _DROP or name == "header":
        return not (inside and name == "header")
    if not rest or ("=" not in rest and "hidden" not in rest.lower()):
        return False
    for key, value in _ATTR.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in _ROLES:
            return True
        if key in ("class", "id") and name in _BOXES:
            names = value.split()
            if any(map(_COMMENTS.search, names)) or (_ADVERTS if inside else _NAMES).intersection(names):
                return True
    return False


def blocks(page: str | None) -> tuple[list[str], list[bool]]:
    """Text blocks in page order, and for each whether it is guarded: in an article, or in main where no article has text.

    Unclosed, misnested and cut off markup is read as far as it goes. Character references are decoded once.
    """
    page = page or ""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, bool, str]] = []  # element, whether it is off, where its text goes
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append((text, stack[-1][2] if stack else ""))

    def close(at: int) -> None:
        flush()
        del stack[at:]

    pos = 0
    for m in _TAG.finditer(page):
        off = bool(stack) and stack[-1][1]
        if m.start() > pos and not off:
            run.append(html.unescape(page[pos : m.start()]))
        pos = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "br":
                run.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in ("article", "main", "body", "td", "th") and name in ("p", "li", "span", "b", "i", "a"):
                    break
            else:
                if name in _BLOCK and not off:
                    flush()
            continue
        rest = m["rest"]
        if name in _BLOCK:
            if not off:
                flush()
            if stack and stack[-1][0] == "p":
                stack.pop()
            if name == "li":
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ("ul", "ol", "menu"):
                        break
                    if stack[k][0] == "li":
                        close(k)
                        break
        elif name in ("br", "td", "th") and not off:
            run.append(" ")
        if name in _VOID or rest.endswith("/") and name not in _BLOCK:
            continue
        where = stack[-1][2] if stack else ""
        off = bool(stack) and stack[-1][1]
        if name in _BLOCK or name in _DROP or rest:
            kind = "main" if name == "main" or re.search(r"role\s*=\s*[\"']?main\b", rest, re.I) else name
            gone = off or _off(name, rest, bool(where))
            if kind in ("article", "main") and not gone and where != "article":
                where = kind
            if gone and not off:
                flush()
            if name in _BLOCK or name in _DROP or gone:
                stack.append((name, gone, where))
    if pos < len(page) and not (stack and stack[-1][1]):
        run.append(html.unescape(page[pos:]))
    flush()
    guard = next((k for k in ("article", "main") if any(where == k for _, where in out)), None)
    return [text for text, _ in out], [where == guard for _, where in out]


def suffix_ranks(ids: np.ndarray, run: int = RUN) -> np.ndarray:
    """Ranks of all suffixes of the stream ids by their first ``run`` tokens: a suffix array by prefix doubling.

    Two suffixes have one rank exactly if their longest common prefix has ``run`` tokens or more. A substring of any greater
    length that pages share is covered by the runs that begin at each of its tokens, all of which those pages share.
    """
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < run:
        second = np.zeros(n, np.int64)
        second[:-depth] = rank[depth:] + 1
        rank = np.unique(rank * (n + 2) + second, return_inverse=True)[1].astype(np.int64)
        depth *= 2
    return rank


def host_runs(pages: list[int], streams: list[list[list[str]]]) -> tuple[list[bytes], list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct runs of some pages of one host: hashes of 128 bits, for each where it begins, and the page and token of those.

    A stream is the page's stretches of unguarded tokens; runs don't cross stretches, for which marks stand in the stream.
    """
    words, owner, at = [], [], []
    vocabulary: dict[str, int] = {}
    for page, found in zip(pages, streams):
        spot = 0
        for tokens in found:
            words += [*(vocabulary.setdefault(w, len(vocabulary)) for w in tokens), -1 - len(words)]
            owner += [page] * (len(tokens) + 1)
            at += range(spot, spot + len(tokens) + 1)
            spot += len(tokens)
    names, ids = [*vocabulary], np.array(words, np.int64)
    whole = np.ones(len(ids), bool)  # starts of runs that end before a mark
    for k in np.flatnonzero(ids < 0):
        whole[max(0, k - RUN + 1) : k + 1] = False
    starts = np.flatnonzero(whole)
    if not len(starts):
        return [], [], np.empty(0, np.int64), np.empty(0, np.int32)
    rank = suffix_ranks(ids)[starts]
    order = np.argsort(rank, kind="stable")
    groups = np.split(starts[order], np.flatnonzero(np.diff(rank[order])) + 1)
    keys = [xxhash.xxh3_128_digest(" ".join([names[i] for i in ids[g[0] : g[0] + RUN]]).encode("utf-8", "replace")) for g in groups]
    return keys, groups, np.array(owner, np.int64), np.array(at, np.int32)


def stretches(blocks_: list[str], guarded: list[bool]) -> list[list[str]]:
    """Tokens of unguarded blocks; blocks with no guarded one between them make one stretch."""
    out, fresh = [], True
    for text, guard in zip(blocks_, guarded):
        if guard:
            fresh = True
            continue
        if fresh:
            out.append([])
            fresh = False
        out[-1] += text.split(" ")
    return out


def main_text(blocks_: list[str], guarded: list[bool], starts: list[int]) -> list[str]:
    """The guarded blocks; where there are none, all blocks less the runs that begin at those tokens."""
    if any(guarded):
        return [text for text, guard in zip(blocks_, guarded) if guard]
    gone = {i for s in starts for i in range(s, s + RUN)}
    out, at = [], 0
    for text in blocks_:
        words = text.split(" ")
        out.append(" ".join(w for i, w in enumerate(words, at) if i not in gone))
        at += len(words)
    return [text for text in out if text]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and other columns of pages without html, then text and n_chars (code points), one row per page.

    A null or empty page has empty text. Hosts come from the url; pages without one make up a host. Tasks build suffix
    arrays over the pages of a host that they read, which leaves one row for each distinct run there; the pages of each
    run are then counted over the whole host, however large it is. A page whose text is all guarded needs no run and skips
    that. Repeated rows are pages of their own. Columns of pages called text or n_chars are replaced.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = packed(pages, ("html", "text", "n_chars"), html=F.col("html"), host=host)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [blocks(h.as_py()) for h in b.column("html")]
            cols = [pa.array([x for x, _ in found], pa.list_(pa.string())), pa.array([g for _, g in found], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("host"), *cols], names=["_row", "host", "blocks", "guarded"])

    parsed = rows.mapInArrow(parse, schema_of(rows, "_row,host", "blocks array<string>, guarded array<boolean>"))
    parsed = materialize(parsed.withColumn("page", F.monotonically_increasing_id()))
    loose = F.exists("guarded", lambda g: ~g)
    done = parsed.where(~loose).select("_row", "blocks")
    if not parsed.where(loose).isEmpty():
        done = done.unionByName(_without_shared(parsed.where(loose)))
    text = F.array_join("blocks", "\n")
    return done.select("_row.*", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def _without_shared(loose: DataFrame) -> DataFrame:
    """(_row, blocks) of pages with unguarded text, less the runs that enough pages of their host share."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hosts: dict[str, tuple[list, list]] = {}
            for host, page, text, guard in zip(*(b.column(c).to_pylist() for c in ("host", "page", "blocks", "guarded"))):
                held = hosts.setdefault(host, ([], []))
                held[0].append(page)
                held[1].append(stretches(text, guard))
            for host, held in hosts.items():
                keys, groups, owner, at = host_runs(*held)
                spots = np.concatenate([*groups, np.empty(0, np.int64)]).astype(np.int64)
                pairs = pa.StructArray.from_arrays([pa.array(owner[spots]), pa.array(at[spots])], names=["page", "at"])
                ends = np.cumsum([0, *map(len, groups)]).astype(np.int32)
                cols = [
                    pa.array([host] * len(keys), pa.string()),
                    pa.array(keys, pa.binary()),
                    pa.array([len(np.unique(owner[g])) for g in groups], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pairs),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["host", "run", "pages", "spots"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            left = [main_text(x, g, s or []) for x, g, s in zip(*(b.column(c).to_pylist() for c in ("blocks", "guarded", "starts")))]
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(left, pa.list_(pa.string()))], names=["_row", "blocks"])

    slim = loose.select("host", "page", "blocks", "guarded")
    made = materialize(slim.mapInArrow(runs, "host string, run binary, pages bigint, spots array<struct<page:bigint,at:int>>"))
    shared = materialize(made.groupBy("host", "run").agg(F.sum("pages").alias("n")).where(F.col("n") >= PAGES))
    total = shared.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * HEAVY > total
    hot = F.broadcast(shared.where(heavy).select("host", "run"))  # fewer than HEAVY rows
    cold = made.join(hot, ["host", "run"], "left_anti").join(shared.where(~heavy).select("host", "run"), ["host", "run"], "left_semi")
    spots = made.join(hot, ["host", "run"], "left_semi").unionByName(cold).select(F.explode("spots").alias("s"))
    starts = spots.groupBy("s.page").agg(F.collect_list("s.at").alias("starts"))  # at most one for each token of the page
    return loose.join(starts, "page", "left").select("_row", "blocks", "guarded", "starts").mapInArrow(cut, schema_of(loose, "_row", "blocks array<string>"))
