"""Main text of web pages by wrappers: union-free regular expressions, inferred per host.

A page's token stream (tags with their classes, and texts) is read as nested
elements.  Equal neighbours in an element fold into a repeated group `( ... )+`;
streams of the same host are then aligned one after another: what both have is
matched, what one lacks becomes optional `( ... )?`, texts that differ become
slots `#`, texts that agree stay fixed.  The result is the host's wrapper, one for
the pages with an article or main element and one for those without.  Its content
region is the innermost container with most of the slot text, inside or outside
an article or main element; one of these is preferred to a container in it, and is
the region where no container has most of the slots or the host shows no template.

A block of text is template if it stands at the same place of the tree (the keys of
the elements down to it) on more than one page and on most pages (TEMPLATE_SHARE) of
the host, or of those of the host's pages that have, or lack, an article or main
element.  Headings, paragraphs and quotations are what articles are made of: there a
place is fixed only if PROSE_PAGES pages or more have it and all but a few of these
(PROSE_SHARE) have this text there, so a headline or a sentence that some pages share
stays, and where such texts would be most of a page's prose the host's pages are
versions of one text and keep it.  Headings in an article or main element, and list
items that stand directly in one, are never template.  Pages without text don't
count, and copies of a page count once.

Elements and whole classes that say navigation, adverts, comments and the like are
left out before; inside an article or main element only if every class of the
element says so (`side effects` stays), and tables there never.

Wrappers are merged in steps: within a batch, then over salted parts of a host,
then per host, so that a host with a third of all pages is no single task's work
(a wrapper's size follows the template, not the number of pages).  The regions
are kept as a table and joined to the pages by host.

Null html has no text; pages without a host are their own group; repeated rows
repeat (and count once for the template); very long and very deep pages are parsed
whole, one at a time; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as html_entities
import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batch, staged, table

# Fixed values of HTML: elements without an end tag, elements that begin a block, elements whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
ITEM = frozenset("li dt dd".split())
IN_TABLES = frozenset("table tbody thead tfoot tr td th caption".split())
CONTAINER = frozenset("html body div section main article table tbody tr td center".split())
#: A start tag that ends an open element of these kinds (up to the nearest of the second kinds).
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: Elements, and words of class, id and role, that are never main text.
ASIDE = frozenset("head nav header footer aside form script style template noscript iframe svg button select textarea dialog object".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert comment comments "
    "reply replies disqus sidebar side menu nav navigation navbar breadcrumb breadcrumbs header footer share sharing social related recommended newsletter subscribe signup "
    "popup modal widget pagination pager toolbar masthead complementary contentinfo".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies disqus ad ads advert sponsored promo teaser teasers related recommended".split())
#: Elements of running text: a word counts only where it is a whole class, id or role, not a part of one.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: A text at one place of so much of a host's pages is template; of running text so much of the pages that have the place, and so many pages.
TEMPLATE_SHARE, PROSE_SHARE, PROSE_PAGES = 0.6, 0.95, 3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: In a wrapper, what is in elements deeper than this stands in the one at this depth (pages are parsed and read at every depth).
DEPTH = 48
#: Open elements that keep a block from ending a paragraph around them.
HOLDS = "td th div article section body li table".split()

_TAG = re.compile(r"""<(?:!--(?:.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_DIGITS = re.compile(r"\d+")


class Element:
    __slots__ = ("tag", "key", "skip", "kids", "path", "inside")

    def __init__(self, tag: str, key: str, skip: bool, path: int = 0, inside: bool = False):
        self.tag, self.key, self.skip, self.kids, self.path, self.inside = tag, key, skip, [], path, inside


def _element(tag: str, attributes: str, parent: Element, inside: bool = False) -> Element:
    """inside: an article or main element is open around it."""
    key, skip = tag, tag in ASIDE
    if "=" in attributes:
        words: set[str] = set()
        classes: list[str] = []
        for m in _ATTRIBUTE.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "class":
                classes = value.split()
                key = f"{tag}.{'.'.join(sorted(_DIGITS.sub('0', value).split()))}"
            words.update(value.split() if tag in PROSE else _WORD.findall(value))
        bad = COMMENT_WORDS if tag == "article" else ASIDE_WORDS
        said = tag not in ("html", "body", "main") and not words.isdisjoint(bad)
        if said and inside and tag not in PROSE and tag != "article":
            said = tag not in IN_TABLES and all(not bad.isdisjoint(_WORD.findall(c)) for c in classes)
        skip = skip or said
    return Element(tag, key, skip, zlib.crc32(key.encode("utf-8", "surrogatepass"), parent.path), inside)


def parse(page: str) -> Element:
    """Nested elements with their texts (markup that browsers forgive is forgiven)."""
    root = Element("", "", False)
    stack, at, n = [root], 0, len(page)
    places: dict[str, list[int]] = {}  # of each tag's open elements in the stack, so that no search walks a deep stack

    def nearest(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def end(i: int) -> None:
        for x in reversed(stack[i:]):
            places[x.tag].pop()
        del stack[i:]

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if i := nearest((tag,)):
                end(i)
            continue
        if tag in BLOCK and tag != "option":
            if (i := nearest(("p",))) > nearest(HOLDS):  # a block ends an open paragraph
                end(i)
        if tag in CLOSES:
            ends, bound = CLOSES[tag]
            if (i := nearest(ends)) > nearest(bound):
                end(i)
        new = _element(tag, m[3], stack[-1], bool(places.get("article") or places.get("main")))
        stack[-1].kids.append(new)
        if tag in RAW:
            last = re.compile(f"</{tag}", re.I).search(page, at)
            if last is None:
                at = n
            else:
                close = page.find(">", last.end())
                at = n if close < 0 else close + 1
            new.skip = True
        elif tag not in VOID and not m[3].endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            stack.append(new)
    return root


def squeeze(text: str) -> str:
    return " ".join(html_entities.unescape(text).split())


def text_hash(text: str) -> int:
    """64 bits, signed as Spark's long."""
    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


# --- wrappers: [key, optional, repeated, children]; a text is ["#", optional, repeated, hash or null, length] --------------------
def expression(e: Element) -> list:
    """The wrapper of one page: its elements, equal neighbours folded. Elements that are never main text are left out of the alignment."""
    done: dict[int, list] = {}
    order, todo = [], [(e, 0)]
    while todo:
        x, depth = todo.pop()
        order.append((x, kids := x.kids if depth < DEPTH else _flat(x)))
        todo += [(k, depth + 1) for k in kids if isinstance(k, Element) and not k.skip]
    for x, inner in reversed(order):
        kids = []
        for k in inner:
            if isinstance(k, Element):
                if not k.skip:
                    kids.append(done.pop(id(k)))
            elif k and not k.isspace():
                plain = squeeze(k)
                if plain:
                    kids.append(["#", False, False, text_hash(plain), len(plain)])
        done[id(x)] = [x.key, False, False, fold(kids)]
    return done[id(e)]


def _flat(e: Element) -> list[str]:
    """The texts in an element, at every depth."""
    found, todo = [], list(reversed(e.kids))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            found.append(x)
        elif not x.skip:
            todo += reversed(x.kids)
    return found


def fold(kids: list[list], longest: int = 4) -> list[list]:
    """Tandem repeats of up to `longest` nodes become repeated nodes or repeated groups."""
    for period in range(1, longest + 1):
        out, i = [], 0
        while i < len(kids):
            unit, times = kids[i : i + period], 1
            keys = [k[0] for k in unit]
            while len(unit) == period and [k[0] for k in kids[i + times * period : i + (times + 1) * period]] == keys:
                times += 1
            if times == 1:
                out.append(kids[i])
                i += 1
                continue
            for t in range(1, times):
                unit = [align(a, b) for a, b in zip(unit, kids[i + t * period : i + (t + 1) * period], strict=True)]
            if period == 1:
                unit[0][2] = True
                out.append(unit[0])
            else:
                out.append(["(" + " ".join(keys) + ")", False, True, unit])
            i += times * period
        kids = out
    return kids


def align(a: list, b: list) -> list:
    """The least common generalisation of two nodes of the same key."""
    if a[0] == "#":
        return ["#", a[1] or b[1], a[2] or b[2], a[3] if a[3] == b[3] else None, a[4] + b[4]]
    kids = []
    keys_a, keys_b = [k[0] for k in a[3]], [k[0] for k in b[3]]
    if keys_a == keys_b:
        kids = [align(x, y) for x, y in zip(a[3], b[3], strict=True)]
    else:
        for what, i0, i1, j0, j1 in SequenceMatcher(None, keys_a, keys_b, autojunk=False).get_opcodes():
            if what == "equal":
                kids += [align(x, y) for x, y in zip(a[3][i0:i1], b[3][j0:j1], strict=True)]
            else:  # a mismatch: what either side has alone is optional
                kids += [[k[0], True, *k[2:]] for k in (*a[3][i0:i1], *b[3][j0:j1])]
        kids = fold(kids)
    return [a[0], a[1] or b[1], a[2] or b[2], kids]


def union_free_expression(w: list) -> str:
    """A wrapper as text."""
    if w[0] == "#":
        body = "#" if w[3] is None else f"'{w[3] & (1 << 64) - 1:016x}'"
    elif w[0].startswith("("):
        body = "( " + " ".join(map(union_free_expression, w[3])) + " )"
    else:
        body = f"<{w[0]}>" + " ".join(map(union_free_expression, w[3])) + f"</{w[0].split('.')[0]}>"
    return body + "+" * w[2] + "?" * w[1]


def slot_mass(w: list) -> int:
    return (w[4] if w[3] is None else 0) if w[0] == "#" else sum(map(slot_mass, w[3]))


def text_mass(w: list) -> int:
    return w[4] if w[0] == "#" else sum(map(text_mass, w[3]))


def _is_article(key: str) -> bool:
    return key.split(".")[0] in ("article", "main")


def region(w: list, pages: int, share: float = 0.6) -> dict:
    """path: the keys down to the container of the main text; articles: the article and main elements in it have most of its slots."""
    mass = slot_mass if pages > 1 and slot_mass(w) else text_mass  # one page alone shows no slots
    path, here = [], w
    while not _is_article(here[0]):
        total = mass(here)
        inner = [k for k in here[3] if k[0] != "#" and k[0].split(".")[0] in CONTAINER and not k[2] and mass(k) >= share * total > 0]
        if not inner:
            break
        here = inner[0]
        path.append(here[0])
    inside, todo = 0, [here]
    while todo:
        x = todo.pop()
        if _is_article(x[0]):
            inside += mass(x)
        elif x[0] != "#":
            todo += x[3]
    return {"path": path, "articles": 2 * inside >= mass(here) > 0, "slots": mass is slot_mass}


# --- extraction ------------------------------------------------------------------------------------------------------
def _articles(top: Element) -> list[Element]:
    """Outermost article and main elements, in page order."""
    found, todo = [], [top]
    while todo:
        x = todo.pop()
        if x.tag in ("article", "main"):
            inner = [k for k in x.kids if isinstance(k, Element)]
            if x.tag == "main" and any(k.tag == "article" and not k.skip for k in inner):
                todo += reversed(inner)
                continue
            found.append(x)
            continue
        todo += [k for k in reversed(x.kids) if isinstance(k, Element) and not k.skip]
    return found


def shape(root: Element) -> str:
    """Pages of a host with and without an article or main element have wrappers of their own."""
    return "article" if _articles(root) else ""


def _regions(root: Element, rule: dict | None, fixed: frozenset[int]) -> list[Element]:
    if not rule or not (fixed or rule["slots"]):  # neither slots nor a template are seen: as the page itself says
        found = _articles(root)
        if found or not rule:
            return found or [root]
    here = root
    for key in rule["path"]:
        step = next((k for k in here.kids if isinstance(k, Element) and k.key == key and not k.skip), None)
        if step is None:  # another layout
            return _articles(here) or [here]
        here = step
    return (_articles(here) if rule["articles"] else []) or [here]


class Block(NamedTuple):
    """A block's text, whether it is a list item directly in an article or main element, and the element that it stands in."""

    text: str
    item: bool
    owner: Element | None

    @property
    def prose(self) -> bool:
        return self.owner is not None and self.owner.tag in PROSE

    @property
    def place(self) -> int:
        """Where it stands: the keys down to it."""
        return text_hash(f"place {self.owner.path if self.owner else 0}")

    @property
    def known(self) -> int:
        """The text at its place."""
        return text_hash(f"{self.owner.path if self.owner else 0} {self.text}")

    @property
    def stays(self) -> bool:
        """Never template."""
        return self.item or (self.prose and self.owner.inside and self.owner.tag in HEADINGS)


def blocks(regions: list[Element]) -> Iterator[Block]:
    held: list[str] = []
    article = item = False
    owner = None
    todo: list = list(reversed(regions))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            held.append(x)
            continue
        if not isinstance(x, tuple):
            if x.tag == "br":
                held.append(" ")
                continue
            if x.skip:
                continue
            if x.tag not in BLOCK:
                todo += reversed(x.kids)
                continue
        text = squeeze("".join(held))
        held.clear()
        if text:
            yield Block(text, item, owner)
        if isinstance(x, tuple):  # a block ends
            article, item, owner = x
            continue
        todo.append((article, item, owner))
        owner = x
        if x.tag in CONTAINER:
            article, item = x.tag in ("article", "main"), False
        item = item or (article and x.tag in ITEM)
        todo += reversed(x.kids)
    text = squeeze("".join(held))
    if text:
        yield Block(text, item, owner)


def main_text(page: str | None, rule: dict | None = None, fixed: frozenset[int] = frozenset()) -> str:
    """rule, fixed: the region and the hashes of template texts at their places, of the page's host and shape."""
    return _main_text(parse(page), rule, fixed) if page else ""


def _main_text(root: Element, rule: dict | None, fixed: frozenset[int]) -> str:
    found = list(blocks(_regions(root, rule, fixed)))
    if fixed:
        template = [not b.stays and b.known in fixed for b in found]
        prose = sum(len(b.text) for b in found if b.prose)
        lost = sum(len(b.text) for b, t in zip(found, template, strict=True) if t and b.prose)
        versions = 2 * lost > prose
        found = [b for b, t in zip(found, template, strict=True) if not t or (versions and b.prose)]
    return "\n\n".join(b.text for b in found)


# --- operator ---------------------------------------------------------------------------------------------------------
PART = pa.schema([("host", pa.string()), ("shape", pa.string()), ("salt", pa.int32()), ("pages", pa.int64()), ("wrapper", pa.string())])
PART_DDL = "host string, shape string, salt int, pages long, wrapper string"
SALTS = 64


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[tuple[str, str], tuple[int, list]] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root = parse(page or "")
            if next(blocks([root]), None) is None:
                continue
            key, new = (host, shape(root)), expression(root)
            pages, old = found.get(key, (0, None))
            found[key] = (pages + 1, align(old, new) if old else new)
        yield record_batch(PART, [(host, kind, zlib.crc32(f"{host}{pages}{slot_mass(w)}".encode()) % SALTS, pages, json.dumps(w)) for (host, kind), (pages, w) in found.items()])


SEEN = pa.schema([("host", pa.string()), ("shape", pa.string()), ("page", pa.int64()), ("text", pa.int64()), ("place", pa.int64())])
SEEN_DDL = "host string, shape string, page long, text long, place long"
#: Instead of a place: of the page itself, of a place of running text, of a text that isn't running.
WHOLE, PLACE, LOOSE = -1, -2, -3


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each page at their places, and the places; the page is known by a hash of its texts."""
    for batch in batches:
        rows: list[tuple] = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root = parse(page or "")
            found = list(blocks([root]))
            if not found:
                continue
            kind = shape(root)
            known = int.from_bytes(hashlib.blake2b("\n".join(b.text for b in found).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
            texts = {(0, WHOLE)}
            for b in found:
                if b.stays:
                    continue
                place = b.place if b.prose else LOOSE
                texts.add((b.known, place))
                if b.prose:
                    texts.add((place, PLACE))
            rows += [(host, kind, known, t, p) for t, p in texts]
        yield record_batch(SEEN, rows)


def template_texts(pages: DataFrame) -> DataFrame:
    """host, fixed_article, fixed_other: hashes of the template texts at their places, of its pages with and without an article or main element. pages: host, html.

    Counts of (host, text) add up from every task; of a host only the texts on more than one page meet its numbers of pages.
    """
    seen = pages.select("host", "html").mapInArrow(_seen, SEEN_DDL).distinct()
    of = lambda kind: F.count(F.when(F.col("shape") == kind, 1))
    counts = staged(seen.groupBy("host", "text", "place").agg(of("article").alias("a"), of("").alias("o")).where(f"place = {WHOLE} or a + o > 1"), "texts")
    whole = counts.where(f"place = {WHOLE}").select(F.col("host").alias("_host"), F.col("a").alias("_a"), F.col("o").alias("_o"))
    places = counts.where(f"place = {PLACE}").select(F.col("host").alias("_phost"), F.col("text").alias("_place"), F.col("a").alias("_pa"), F.col("o").alias("_po"))
    texts = counts.where(f"place not in ({WHOLE}, {PLACE})").join(whole, F.col("host") == F.col("_host")).join(places, (F.col("host") == F.col("_phost")) & (F.col("place") == F.col("_place")), "left")
    often = lambda n, of: (n > 1) & (n >= TEMPLATE_SHARE * of)
    fixed_at = lambda n, of: (n >= PROSE_PAGES) & (n >= PROSE_SHARE * of)
    a, o, loose = F.col("a"), F.col("o"), F.col("place") == LOOSE
    every = loose & often(a + o, F.col("_a") + F.col("_o"))
    texts = texts.withColumn("_in_a", F.when(loose, every | often(a, F.col("_a"))).otherwise(fixed_at(a, F.col("_pa")))).withColumn("_in_o", F.when(loose, every | often(o, F.col("_o"))).otherwise(fixed_at(o, F.col("_po"))))
    fixed = lambda part: F.collect_list(F.when(F.col(part), F.col("text")))  # noqa: E731  (at most 1 / TEMPLATE_SHARE times a page's texts)
    return texts.where("_in_a or _in_o").groupBy("host").agg(fixed("_in_a").alias("fixed_article"), fixed("_in_o").alias("fixed_other"))


def _merge_sorted(last: bool):
    """Wrappers sorted by their group (host, shape and salt, or host and shape): one each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pages, held = None, 0, None
        rows: list[tuple] = []

        def done() -> tuple:
            return (*group, pages, json.dumps(region(held, pages) if last else held))

        for batch in batches:
            for host, kind, salt, n, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (host, kind, 0 if last else salt)
                if key != group:
                    if group is not None:
                        rows.append(done())
                    group, pages, held = key, n, json.loads(w)
                else:
                    pages, held = pages + n, align(held, json.loads(w))
                if len(rows) >= 256:
                    yield record_batch(PART, rows)
                    rows = []
        if group is not None:
            rows.append(done())
        yield record_batch(PART, rows)

    return run


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return pages.select(host.alias("host"), F.col("html").cast("string").alias("html"), F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"))


def host_regions(pages: DataFrame) -> DataFrame:
    """host, rule_article, rule_other: rules (JSON) of its pages with and without an article or main element. pages: host, html."""
    parts = pages.select("host", "html").mapInArrow(_infer, PART_DDL)
    salted = parts.repartition("host", "shape", "salt").sortWithinPartitions("host", "shape", "salt", "pages", "wrapper").mapInArrow(_merge_sorted(False), PART_DDL)
    whole = salted.repartition("host", "shape").sortWithinPartitions("host", "shape", "pages", "wrapper").mapInArrow(_merge_sorted(True), PART_DDL)
    rule = lambda kind: F.max(F.when(F.col("shape") == kind, F.col("wrapper")))
    return whole.groupBy("host").agg(rule("article").alias("rule_article"), rule("").alias("rule_other"))


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, k, u, article, other, fixed_article, fixed_other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                root = parse(page or "")
                rule, fixed = (article, fixed_article) if shape(root) else (other, fixed_other)
                rows.append((k, u, _main_text(root, json.loads(rule) if rule else None, frozenset(fixed or ()))))
            yield record_batch(TEXTS, rows)

    keyed = with_host(pages)
    rules = staged(host_regions(keyed).join(template_texts(keyed), "host", "left"), "regions").withColumnRenamed("host", "_host")
    # A left join: the regions are broadcast only where their measured size is under Spark's limit.
    joined = keyed.join(rules, F.col("host") == F.col("_host"), "left").select("html", F.col("page_id").cast("long").alias("page_id"), "url", "rule_article", "rule_other", "fixed_article", "fixed_other")
    return joined.mapInArrow(run, "page_id long, url string, text string")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
