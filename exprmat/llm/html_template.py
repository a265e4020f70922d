"""Main text of web pages by equivalence-class template deduction.

Pages are read as tokens: element paths (tags with their class and id, from the root) and the text runs
below them. Over the pages of one host, a token's occurrence vector says how often each page has it.
Tokens with equal vectors form an equivalence class; vectors are never gathered, but told apart by sums of
page hashes times counts, which combine map-side, so a host with a third of all pages is no hot group. A
class that covers enough pages and has element paths is valid; classes nest by their paths into the host's
template. A text run whose class is that of an element it is nested in belongs to the template, wherever it
stands; what is left are the template's slots, and each slot has its share of linked text. Hosts of few pages
use the template of all pages together. Copies of a page (equal but for head, scripts, styles and comments)
count as one.

Extraction drops elements that are no article by tag or name (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments), and on every page the template's own text and slots that are
mostly links. Article marks are a prior for slots: the main slots are the marked ones, unless the host's other
slots hold more than ``MARK_WEIGHT`` times their varying unlinked text; then all slots are. A page without
text in its marked slots gives that of the others.

Cases: a null or empty html, and one without text, give an empty text; unclosed, crossed and cut-off
markup is read as far as it goes; a URL without host counts to a host of its own name; repeated rows each
get a row; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from exprmat.llm.common import pin, small_side

#: Pages that a host needs for a template of its own, and share of them that a valid class covers.
MIN_PAGES = 4
SUPPORT = 0.5
#: A slot with a larger share of linked text is a menu.
LINKED = 0.5
#: What a character in a marked slot counts for, against one in another slot.
MARK_WEIGHT = 4
HOST_ROWS = 200_000
#: Characters of a token's text: all, linked, and unlinked ones in and out of marked elements.
SIZES = ("chars", "linked", "main", "free")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|object|xmp|noembed|noframes"
#: Elements that are never part of an article, and words of classes, ids and roles that say so.
NOT_ARTICLE = frozenset("nav header footer aside form menu button select dialog head figure_ad".split())
NAMES = ("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation "
         "menu breadcrumb breadcrumbs header masthead footer cookie cookies consent notice notices gdpr alert popup modal overlay newsletter "
         "subscribe signup login search share sharing social related recommended comment comments commentlist respond disqus replies "
         "reply widget toolbar pagination pager skip complementary contentinfo").split()
NOT_NAMED = re.compile(r"(?:^|[\s_\-])(?:" + "|".join(NAMES) + r")(?=$|[\s_\-\d])", re.I)
IS_NAMED = re.compile(r"(?:^|[\s_\-])(?:article|main|content|post|entry|story)(?:[_\-](?:body|content|text|main|inner))?(?=$|\s)", re.I)
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + RAW + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:\-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<(?P<broken>[a-zA-Z][^>]*)(?:>|\Z)", re.S | re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: What doesn't tell copies of a page apart.
UNSEEN = r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>"

OUT, MAIN, FREE = 0, 1, 2


def runs(page: str) -> Iterator[tuple[str, int, bool, str]]:
    """Text runs in order: path, place (dropped, in a marked article, neither), within a link, text.
    A run of None text marks the start of the element of that path; block elements yield a blank."""
    # open elements: tag, path, place, in link, whether the article mark came from it
    stack: list[tuple[str, str, int, bool]] = [("", "", FREE, False)]
    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            top = stack[-1]
            yield top[1], top[2], top[3], page[at:m.start()]
        at = m.end()
        tag = m.group("tag")
        if not tag:
            continue
        tag = tag.lower()
        top = stack[-1]
        if tag not in INLINE:
            yield top[1], top[2], top[3], " "
        if m.group("close"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        attrs = m.group("attrs")
        names = " ".join(a or b or c for a, b, c in NAMED.findall(attrs)) if "=" in attrs else ""
        if tag in VOID:
            continue
        if tag in ("p", "li"):  # these end their like
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE and stack[k][0] != "p":
                    break
            top = stack[-1]
        path = f"{top[1]}/{tag}" + (f".{names.replace('/', '|')}" if names else "")
        place = top[2]
        if place != OUT:
            if tag in NOT_ARTICLE or tag not in ("html", "body", "article", "main") and names and NOT_NAMED.search(names) \
                    and not IS_NAMED.search(names) or "hidden" in attrs and re.search(r"(?:^|\s)hidden(?:\s|=|$|/)", attrs):
                place = OUT
            elif tag in ("article", "main") or names and tag in ("div", "section", "td") and IS_NAMED.search(names):
                place = MAIN
        stack.append((tag, path, place, top[3] or tag == "a"))
        yield path, place, False, None
        if m.group(0).endswith("/>") and tag in ("svg", "path"):
            stack.pop()
    if at < len(page):
        top = stack[-1]
        yield top[1], top[2], top[3], page[at:]


def plain(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def _key(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_host(url: Column) -> Column:
    """Host of a URL, lower-case; the URL itself where it has none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host).otherwise(F.concat(F.lit("?"), F.coalesce(url, F.lit(""))))


def token_vectors(pages: DataFrame) -> DataFrame:
    """Of each host's tokens: element path or text run (``text``), its path above, pages that have it, the
    vector's two sums, the characters of its text, of linked text, and of unlinked text in and out of marked
    elements; and the same of the host ``*`` over the pages that are ``pooled`` (all, without that column). Takes ``host, page, html, pooled``."""
    if "pooled" not in pages.columns:
        pages = pages.withColumn("pooled", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, int, bool], list[int]] = {}
            above: dict[int, int] = {}
            for host, page, html, pooled in zip(*(b.column(c).to_pylist() for c in ("host", "page", "html", "pooled")), strict=True):
                seen: Counter = Counter()
                size: dict[tuple[int, bool], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
                keys: dict[str, int] = {}
                for path, place, linked, text in runs(html):
                    k = keys.get(path)
                    if k is None:
                        k = keys[path] = _key(path)
                        if k not in above:
                            above[k] = _key(path.rpartition("/")[0])
                    if text is None:
                        seen[k, False] += 1
                    elif place != OUT and not text.isspace():
                        n, t = len(text), _key(path, text)
                        seen[t, True] += 1
                        above[t] = k
                        for c in (size[k, False], size[t, True]):
                            c[0] += n
                            c[1 if linked else 2 if place == MAIN else 3] += n
                h1, h2 = page & 0x7FFFFFFF, (page >> 31) & 0x7FFFFFFF
                for (k, is_text), n in seen.items():
                    for whose in (host, "*") if pooled else (host,):
                        s = sums.setdefault((whose, k, is_text), [0] * 7)
                        s[0] += 1
                        s[1] += h1 * n
                        s[2] += h2 * n
                        if (k, is_text) in size:
                            for j, x in enumerate(size[k, is_text], 3):
                                s[j] += x
            rows = [(h, k, above[k], t, *s) for (h, k, t), s in sums.items()]
            cols = zip(*rows, strict=True) if rows else [()] * 11
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)],
                                             names=["host", "token", "parent", "text", "pages", "f1", "f2", *SIZES])

    part = pages.mapInArrow(run, "host string, token long, parent long, text boolean, pages long, f1 long, f2 long, "
                            + ", ".join(f"{c} long" for c in SIZES))
    wide = "decimal(38,0)"
    return part.groupBy("host", "token", "text").agg(
        F.first("parent").alias("parent"), F.sum("pages").alias("pages"), *(F.sum(F.col(c).cast(wide)).alias(c) for c in ("f1", "f2")),
        *(F.sum(c).alias(c) for c in SIZES))


def valid_classes(vectors: DataFrame, host_pages: DataFrame) -> DataFrame:
    """Tokens of the valid equivalence classes: those that cover enough pages and hold an element path.
    ``nested_in`` is the class of the path above (by its vector); the root class has none."""
    enough = vectors.join(host_pages, "host").where(F.col("pages") >= F.greatest(F.lit(2.0), SUPPORT * F.col("n_pages")))
    cls = F.struct("pages", "f1", "f2")
    tokens = enough.withColumn("cls", cls)
    named = tokens.where("not text").select("host", "cls").distinct()
    above = tokens.where("not text").select("host", F.col("token").alias("parent"), F.col("cls").alias("nested_in"))
    return tokens.join(named, ["host", "cls"], "left_semi").join(above, ["host", "parent"], "left").select(
        "host", "token", "text", "cls", F.when(~F.col("nested_in").eqNullSafe(F.col("cls")), F.col("nested_in")).alias("nested_in"),
        "parent", *SIZES)


def _template(tokens: list[dict], main: int, free: int) -> tuple[list[int], list[int], bool]:
    """Of a host's valid tokens: keys of the template's own text runs, those of slots that are mostly links,
    and whether slots out of marked elements are main slots too. ``main`` and ``free``: unlinked characters of
    the host's pages in and out of marked elements."""
    paths = {t["token"]: t for t in tokens if not t["text"]}
    fixed = []
    for t in tokens:
        # all elements that a valid token is nested in are valid
        up = paths.get(t["parent"]) if t["text"] else None
        while up is not None and up["cls"] != t["cls"]:
            up = paths.get(up["parent"])
        if up is not None:
            fixed.append(t["token"])
            main -= t["main"]
            free -= t["free"]
    return fixed, [k for k, t in paths.items() if t["linked"] > LINKED * t["chars"]], free > MARK_WEIGHT * main


def templates(pages: DataFrame) -> DataFrame:
    """``host, fixed, menus, every``: keys of the template's own text runs, and of slots that are mostly
    links, and whether all other slots are main slots, or the marked ones. Host ``*`` is the template of all
    pages. Copies count once a host, and once in all. Takes ``host, html``."""
    body = F.regexp_replace("html", UNSEEN, "")
    known = pages.select("host", "html", F.xxhash64(body).alias("c1"), F.xxhash64(F.reverse(body)).alias("c2"))
    contents = pin(known.groupBy("host", "c1", "c2").agg(F.count("*").alias("rows")), "html-contents")
    n = contents.groupBy("host").agg(F.count("*").alias("n_pages"))
    apart = contents.groupBy("c1", "c2").agg(F.sum("rows").alias("rows"), F.min("host").alias("first_host"))
    total = apart.agg(F.count("*").alias("n_pages")).select(F.lit("*").alias("host"), "n_pages")
    # only the html of contents that several rows have moves; the others are read where they lie
    copied = pin(apart.where("rows > 1").select("c1", "c2", "first_host"), "html-copied")
    copied = small_side(copied, copied.count())
    single = known.join(copied.select("c1", "c2"), ["c1", "c2"], "left_anti").withColumn("pooled", F.lit(True))
    several = (known.join(copied, ["c1", "c2"]).dropDuplicates(["host", "c1", "c2"])
               .withColumn("pooled", F.col("host") == F.col("first_host")))
    # a page stands for its content, so its place in the vectors does not depend on which copy is read
    columns = ["host", F.col("c1").alias("page"), "html", "pooled"]
    everything = pin(token_vectors(single.select(*columns).union(several.select(*columns))), "html-vectors")
    classes = valid_classes(everything, n.where(F.col("n_pages") >= MIN_PAGES).union(total))
    texts = everything.where("text").groupBy("host").agg(F.sum("main").alias("all_main"), F.sum("free").alias("all_free"))
    # a host's valid tokens are at most twice as many as those of one of its pages
    found = classes.groupBy("host").agg(F.collect_list(F.struct("token", "parent", "text", "cls", *SIZES)).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = zip(*(_template(r["tokens"], r["all_main"] or 0, r["all_free"] or 0) for r in b.to_pylist()), strict=True)
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_())
            made = [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)] if b.num_rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column("host"), *made], names=["host", "fixed", "menus", "every"])

    return pin(found.join(texts, "host", "left").mapInArrow(run, "host string, fixed array<long>, menus array<long>, every boolean"),
               "html-templates")


def main_text(page: str, fixed: frozenset[int], menus: frozenset[int], every: bool = False) -> str:
    main: list[str] = []
    rest: list[str] = []
    for path, place, _, text in runs(page):
        if text is None or place == OUT or not text.isspace() and (_key(path) in menus or _key(path, text) in fixed):
            continue
        (main if every or place == MAIN else rest).append(text)
    # a marked article may be an empty shell
    return plain(main) or plain(rest)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"),
                        page_host(url).alias("host"))
    known = templates(rows.select("host", "html"))
    n_known = known.count()
    pool = known.where("host = '*'").first()
    everywhere = (frozenset(pool["fixed"]), frozenset(pool["menus"]), pool["every"]) if pool else (frozenset(), frozenset(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets: dict[str, tuple[frozenset[int], frozenset[int], bool]] = {}
            out = []
            for i, page in enumerate(b.column("html").to_pylist()):
                host = b.column("host")[i].as_py()
                if host not in sets:
                    f, m = b.column("fixed")[i].as_py(), b.column("menus")[i].as_py()
                    sets[host] = everywhere if f is None else (frozenset(f), frozenset(m), b.column("every")[i].as_py())
                out.append(main_text(page, *sets[host]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()),
                                              pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(small_side(known.where("host <> '*'"), n_known, HOST_ROWS), "host", "left")
    return joined.select("page_id", "url", "html", "host", "fixed", "menus", "every").mapInArrow(run, "page_id long, url string, text string, n_chars long")
