"""Main-text extraction by deducing each host's page template from equivalence classes of tokens.

1. Tokens are structural elements and whole text blocks, told apart by their role: the path of elements they stand in
   (names with digits made equal). Tokens of a host that have the same occurrence vector over its distinct pages form an
   equivalence class; the vector is kept as an order-free hash, so classes of a host of any size are found by plain
   aggregation. A class is valid if it is large (MIN_TOKENS), frequent (MIN_PAGES, or all pages of a smaller host), holds
   an element, and nests: all its outermost elements lie in one place of the classes around it. A host has as many
   classes as its pages have types and parts; together they are its template.
2. Elements of valid classes that stand once on their pages are the template's slots. What pages hold in a slot, beside
   text blocks of the template, is its data; the mean number of words of data is the slot's weight. Text blocks are of
   the template if they share their vector with their own element or with a slot, on MIN_TEXT_PAGES pages at least.
3. On a page the slot of greatest weight holds the main text, with the slots within it, within the article or main
   element around it, headings before it, and slots of at least a fifth of its weight. Names and tags that tell of menus,
   adverts and the like are a prior: each takes a slot's weight down to a tenth, and parts so named are cut out of the
   main text. A page whose main text would be template text alone keeps that.

Pages with the same html count once for their host, so copies of a page never turn its article into template. A page
that is the only one of its host is its own template, without template text.

Defined results: a null html is an empty page with an empty text; null urls share a host; repeated rows get equal
texts; broken markup is read as browsers do, unclosed elements end with their parent; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.bpe import slices
from weft.llm.common import durable, table

#: A class is large from this many tokens on, and frequent from this many distinct pages.
MIN_TOKENS, MIN_PAGES = 2, 3
#: Text blocks are of the template from this many distinct pages on.
MIN_TEXT_PAGES = 8
#: A word in a link weighs this much of another; a name that tells of other things takes a weight down to this part.
LINK_WEIGHT, PRIOR = 0.2, 0.1
#: Slots of at least this share of the main slot's weight are main text too.
BESIDE = 0.2
#: Templates of up to this many tokens in all are sent to every task; beyond it they are joined by host and SALTS parts.
BROADCAST_TOKENS, SALTS = 200_000, 16

#: Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = set("aside button canvas datalist dialog footer head iframe input menu nav noscript object script search select style svg template textarea title video audio".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HEADINGS = ("h1", "h2")
#: Elements that hold text or items themselves are never slots.
LEAVES = set("address blockquote br caption center dd dt figcaption h1 h2 h3 h4 h5 h6 hr legend li optgroup option p pre summary td th tr title".split())
NAMES = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright discussion disqus footer form menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion recommended related respond replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
HEADERS = {"header", "masthead"}
#: Names with one of these tell of a state or a neighbour, not of the element itself.
STATES = set("has is no not with without open closed".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|noscript|iframe|template|svg)\b[^>]*+>(?:.*?</\1\s*+>|.*)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_ROLES_AND_NAMES = ("class", "hidden", "id", "role")
_NAME = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
#: Kinds of tokens.
SLOT, LEAF, TEXT = range(3)


def _attributes(text: str) -> list[tuple[str, str]]:
    """The attributes that tell an element's use, in lower case."""
    found = ((name.lower(), "".join(value).lower()) for name, *value in _ATTRIBUTE.findall(text)) if text else ()
    return [x for x in found if x[0] in _ROLES_AND_NAMES]


#: What an element is by tag and names: main text or neutral, a header, other things by name, other things by tag.
PLAIN, HEADER, NAMED, OTHER = range(4)


def _use(tag: str, attributes: list[tuple[str, str]], in_article: bool) -> int:
    if tag in SKIPPED:
        return OTHER
    found = NAMED if tag == "form" else PLAIN
    if tag == "header" and not in_article:
        found = HEADER
    for name, value in attributes:
        if name in ("class", "id"):
            for one in value.split():
                parts = _NAME.findall(one)
                if not STATES.isdisjoint(parts):
                    continue
                if not NAMES.isdisjoint(parts):
                    found = max(found, NAMED)
                elif not in_article and not HEADERS.isdisjoint(parts):
                    found = max(found, HEADER)
        elif name == "hidden" or value in ROLES:
            return OTHER
    return found


class Page:
    """The elements and text blocks of one page.

    elements: (tag, hash of path, number of parent, use, whether it can be a slot), the first being the page itself;
    blocks: (number of element, text, hash of path and text, weight), in page order.
    """

    def __init__(self, html: str):
        self.elements: list[tuple[str, int, int, int, bool]] = [("", 0, -1, PLAIN, True)]
        self.blocks: list[tuple[int, str, int, float]] = []
        self._stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, number, in an article
        self._text: list[tuple[str, bool]] = []
        links, at = 0, 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                self._text.append((html[at : m.start()], links > 0))
            at = m.end()
            tag = m[3] or m[6]
            if tag is None:
                if m[1]:  # its content is never main text
                    self._element(m[1].lower(), [], False)
                continue
            tag, closing = tag.lower(), m[2] or m[5]
            if tag == "a":
                links = max(0, links - 1) if closing else links + 1
            if tag in BLOCK:
                self._flush()
            if closing:
                if tag not in BLOCK and any(x[0] == tag for x in self._stack):
                    self._flush()  # an inline element that is no main text
                self._close(tag)
            else:
                text_of = m[4] or m[7] or ""
                attributes = _attributes(text_of)
                if tag in BLOCK:
                    self._open(tag, attributes, text_of.endswith("/"))
                elif _use(tag, attributes, self._stack[-1][2]):
                    self._flush()
                    self._open(tag, attributes, text_of.endswith("/"))
        if at < len(html):
            self._text.append((html[at:], links > 0))
        self._flush()

    def _element(self, tag: str, attributes: list[tuple[str, str]], in_article: bool) -> int:
        parent = self._stack[-1][1]
        role = _DIGITS.sub("0", f"{tag} {attributes}")
        path = xxhash.xxh64_intdigest(role.encode(), self.elements[parent][1]) >> 1 or 1
        use = _use(tag, attributes, in_article)
        self.elements.append((tag, path, parent, use, tag in BLOCK and tag not in LEAVES))
        return len(self.elements) - 1

    def _open(self, tag: str, attributes: list[tuple[str, str]], closed: bool) -> None:
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and any(x[0] == tag for x in self._stack[-3:]):
            # The next paragraph, item, row or cell ends the last one, unless a list or table stands between.
            for k in (1, 2, 3):
                if k < len(self._stack) and self._stack[-k][0] == tag:
                    del self._stack[-k:]
                    break
                if self._stack[-k][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "body"):
                    break
        inside = self._stack[-1][2]
        number = self._element(tag, attributes, inside)
        if tag not in VOID and not closed:
            self._stack.append((tag, number, inside or tag == "article"))

    def _close(self, tag: str) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == tag:
                del self._stack[k:]
                return

    def _flush(self) -> None:
        if self._text:
            block = " ".join(unescape("".join(t for t, _ in self._text)).split())
            if block:
                words, linked = block.count(" ") + 1, sum(len(t.split()) for t, link in self._text if link)
                number = self._stack[-1][1]
                token = xxhash.xxh64_intdigest(block.encode(), self.elements[number][1]) >> 1 or 1
                self.blocks.append((number, block, token, words - (1 - LINK_WEIGHT) * min(linked, words)))
            self._text.clear()

    def tokens(self) -> dict[int, tuple[int, int, int]]:
        """Token to kind (SLOT, LEAF, TEXT), the token around it, and how often the page has it."""
        found: dict[int, tuple[int, int, int]] = {}
        for _, path, parent, _, wide in self.elements[1:]:
            found[path] = SLOT if wide else LEAF, self.elements[parent][1], found.get(path, (0, 0, 0))[2] + 1
        for number, _, token, _ in self.blocks:
            found[token] = TEXT, self.elements[number][1], found.get(token, (0, 0, 0))[2] + 1
        return found

    def slots(self, known) -> list[int]:
        """The number of the slot each element lies in, by the paths that are slots."""
        out = [0]
        for k, (_, path, parent, _, wide) in enumerate(self.elements[1:], 1):
            out.append(k if wide and path in known else out[parent])
        return out

    def _use_below(self, number: int, root: int) -> int:
        """The strongest use of the elements from ``number`` up to, and without, ``root``; headers of an article are its own."""
        most, own = PLAIN, self.elements[root][0] in ("article", "main", "section")
        while number != root and number >= 0:
            use = self.elements[number][3]
            most = max(most, PLAIN if use == HEADER and own else use)
            number = self.elements[number][2]
        return most

    def _within(self, number: int, root: int) -> bool:
        while number > root:
            number = self.elements[number][2]
        return number == root

    def weights(self, known, texts) -> dict[int, float]:
        """The weight of the data in each slot, by path."""
        of = self.slots(known)
        found = {self.elements[k][1]: 0.0 for k in set(of)}
        for number, _, token, weight in self.blocks:
            if token not in texts and self._use_below(number, of[number]) < NAMED:
                found[self.elements[of[number]][1]] += weight
        return found

    def main_text(self, weights: dict[int, float], texts) -> str:
        """The main text by the weights of the template's slots and the template's text blocks."""
        of = self.slots(weights)
        rank: dict[int, float] = {}
        for k in dict.fromkeys(of):
            uses, up = [], k
            while up >= 0:
                uses.append(self.elements[up][3])
                up = self.elements[up][2]
            if OTHER not in uses:
                rank[k] = weights.get(self.elements[k][1], 0.0) * PRIOR ** sum(u != PLAIN for u in uses)
        main = max(rank, key=lambda k: (rank[k], k))
        if not rank[main]:
            return ""
        region, up = main, main
        while up >= 0:
            if self.elements[up][0] in ("article", "main"):
                region = up
            up = self.elements[up][2]
        beside = {k for k, w in rank.items() if w >= BESIDE * rank[main] and not self._within(k, region) and not self._within(main, k)}
        first = next((i for i, b in enumerate(self.blocks) if self._within(b[0], main)), len(self.blocks))
        kept = []
        for i, (number, text, token, _) in enumerate(self.blocks):
            if self._within(number, region):
                ok = self._use_below(number, region) < NAMED and (self._use_below(number, region) != HEADER)
            elif of[number] in beside:
                ok = self._use_below(number, of[number]) == PLAIN
            elif rank.get(of[number], 0.0) >= BESIDE * rank[main]:  # around the main slot
                ok = self._use_below(number, of[number]) == PLAIN
            else:
                ok = i < first and self.elements[number][0] in HEADINGS and self._use_below(number, 0) == PLAIN
            if ok:
                kept.append((text, token in texts))
        own = [t for t, old in kept if not old]
        return " ".join(own or [t for t, _ in kept])


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def _own(pages: DataFrame, url: str, html: str) -> DataFrame:
    return pages.select(url_host(F.col(url)).alias("host"), F.col(html).alias("html"))


def deduce_templates(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(host, slots, texts): the tokens of each host's valid classes that are slots, and those that are text."""

    def run(batches):
        names = ("host", "page", "token", "kind", "around", "count")
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int32())
        for b in slices(batches, "html"):
            rows: list[tuple] = []
            for h, x in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                key = xxhash.xxh64_intdigest((x or "").encode()) >> 1
                rows.append((h, key, -1, LEAF, -1, 1))  # stands for the page itself
                rows += ((h, key, t, *x) for t, x in Page(x or "").tokens().items())
            yield pa.record_batch({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows), kinds)})

    found = _own(pages, url, html).mapInArrow(run, "host string, page long, token long, kind byte, around long, count int")
    found = found.groupBy("host", "page", "token").agg(F.max("kind").alias("kind"), F.max("around").alias("around"), F.max("count").alias("count"))
    vectors = found.groupBy("host", "token").agg(
        F.max("kind").alias("kind"), F.max("around").alias("around"), F.max("count").alias("most"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("page", "count")).alias("vector")
    )
    vectors = durable(vectors)  # read twice: pages are parsed once
    of_host = vectors.filter("token = -1").select("host", F.col("n").alias("pages"))
    # Rows per token of a host that enough pages have; the page's own row goes.
    vectors = durable(vectors.filter("token <> -1").join(of_host, "host").filter(F.col("n") >= F.least(F.lit(MIN_PAGES), F.col("pages"))).drop("pages"))
    outer = vectors.filter(F.col("kind") != TEXT).select("host", F.col("token").alias("around"), F.col("vector").alias("around_vector"))
    vectors = durable(vectors.join(outer, ["host", "around"], "left"))
    top = (F.col("kind") == SLOT) & ~F.col("vector").eqNullSafe(F.col("around_vector"))
    classes = vectors.groupBy("host", "vector").agg(
        F.count(F.lit(1)).alias("size"),
        F.max(F.when(F.col("kind") == SLOT, 1).otherwise(0)).alias("has_slot"),
        F.max(F.when(F.col("kind") != TEXT, 1).otherwise(0)).alias("has_element"),
        (F.max(F.when(top, F.col("around"))) != F.min(F.when(top, F.col("around")))).alias("apart"),
    )
    valid = classes.filter((F.col("size") >= MIN_TOKENS) & (F.col("has_element") == 1) & ~F.coalesce("apart", F.lit(False))).select("host", "vector", "has_slot")
    mine = vectors.join(valid, ["host", "vector"])
    slot = (F.col("kind") == SLOT) & (F.col("most") == 1)
    text = (F.col("kind") == TEXT) & (F.col("n") >= MIN_TEXT_PAGES) & ((F.col("has_slot") == 1) | F.col("vector").eqNullSafe(F.col("around_vector")))
    # A token of a template stands on MIN_PAGES pages at least, so a template is smaller than its pages.
    return mine.filter(slot | text).groupBy("host").agg(F.collect_list(F.when(slot, F.col("token"))).alias("slots"), F.collect_list(F.when(text, F.col("token"))).alias("texts"))


def _with_template(own: DataFrame, templates: DataFrame) -> DataFrame:
    """``own`` with its host's template: sent to every task if small, else joined by host and a salt."""
    size = templates.agg(F.sum(F.size("slots") + F.size("texts"))).first()[0] or 0
    if size <= BROADCAST_TOKENS:
        return own.join(F.broadcast(templates), "host", "left")
    salted = templates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return own.withColumn("_salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "_salt"], "left").drop("_salt")


class _Templates:
    """The template of a batch's rows; rows of one host mostly follow each other."""

    def __init__(self):
        self._host, self._made = object(), None

    def get(self, b: pa.RecordBatch, i: int, make):
        host = b.column("host")[i].as_py()
        if host != self._host:
            self._host, self._made = host, make(lambda c: b.column(c)[i].as_py() or ())
        return self._made


def weigh_slots(pages: DataFrame, templates: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """``templates`` (host, slots, texts) with ``weights``: the mean weight of each slot's data on the pages that have it;
    the slot 0 is the page itself."""

    def run(batches):
        last = _Templates()
        for b in slices(batches, "html"):
            sums: dict[tuple[str, int], list[float]] = {}
            for i, (h, x) in enumerate(zip(b.column("host").to_pylist(), b.column("html").to_pylist())):
                known, texts = last.get(b, i, lambda c: (frozenset(c("slots")), frozenset(c("texts"))))
                for path, w in Page(x or "").weights(known, texts).items():
                    s = sums.setdefault((h, path), [0.0, 0])
                    s[0] += w
                    s[1] += 1
            keys, values = zip(*sums.items())
            yield pa.record_batch({"host": pa.array([k[0] for k in keys], pa.string()), "slot": pa.array([k[1] for k in keys], pa.int64()), "w": pa.array([v[0] for v in values], pa.float64()), "n": pa.array([v[1] for v in values], pa.int64())})

    joined = _with_template(_own(pages, url, html), templates).select("host", "html", "slots", "texts")
    sums = joined.mapInArrow(run, "host string, slot long, w double, n long").groupBy("host", "slot").agg((F.sum("w") / F.sum("n")).alias("w"))
    weights = sums.groupBy("host").agg(F.collect_list(F.struct("slot", F.round("w", 6).alias("w"))).alias("x"))
    return weights.join(templates.select("host", "texts"), "host", "left").select("host", F.transform("x", lambda v: v["slot"]).alias("slots"), F.transform("x", lambda v: v["w"]).alias("weights"), F.coalesce("texts", F.array().cast("array<bigint>")).alias("texts"))


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    templates = durable(weigh_slots(pages, durable(deduce_templates(pages, url=url, html=html)), url=url, html=html))
    own = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), url_host(F.col(url)).alias("host"))
    joined = _with_template(own, templates).select("id", "url", "html", "host", "slots", "weights", "texts")

    def run(batches):
        last = _Templates()
        for b in slices(batches, "html"):
            out = []
            for i, x in enumerate(b.column("html").to_pylist()):
                weights, texts = last.get(b, i, lambda c: (dict(zip(c("slots"), c("weights"))), frozenset(c("texts"))))
                out.append(Page(x or "").main_text(weights, texts))
            yield pa.record_batch({id_col: b.column("id"), url: b.column("url"), "text": pa.array(out, pa.string()), "n_chars": pa.array([len(x) for x in out], pa.int64())})

    kind = dict(pages.dtypes)
    return joined.mapInArrow(run, f"`{id_col}` {kind[id_col]}, `{url}` {kind[url]}, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_extraction": op9_html_extraction}
ORACLES: dict[str, str] = {}
