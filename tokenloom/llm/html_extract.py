"""HTML extraction by equivalence classes of tokens over the pages of a host.

A page is a sequence of tokens: its elements, each in its role (the path of open elements with their classes
and ids), and its runs of text. Tokens of a host with the same occurrence vector over the host's pages form a
class; Spark sums a digest of (page, occurrences), so equal sums are equal vectors and no host is gathered.
The class of elements on the most pages is the template's skeleton; classes of several tokens that
stand on enough pages and lie inside the skeleton's span nest in it. Their elements delimit the slots, and for
each Spark sums how much of a page's text stands in it, links apart. The innermost element that holds most
of the text of its pages is the article's slot; it is widened to an element around it that adds a heading and little
else. A page's text is what stands in that slot, less the text runs of the template. Lists of
tags and names only take furniture away inside the slot, and stand in for pages without a template.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise
from .url_filter import url_host

#: A class nests in the template from so many tokens, pages and share of the host's pages on.
CLASS_TOKENS, CLASS_PAGES, CLASS_SHARE = 2, 3, 0.3
#: The skeleton stands on at least this share of the host's pages that have elements.
SKELETON_SHARE = 0.5
#: What stands on this share of the pages needs no company in its class; from so many pages on, this also holds inside an article.
WHOLE_SHARE, ARTICLE_PAGES = 0.8, 8
#: The article's slot holds this share of its pages' text; it is widened while that adds at most this share.
MAIN_SHARE, WIDER_SHARE = 0.6, 0.25
#: Templates are broadcast only up to so many tokens; beyond, a host's pages go to tasks so many at a time, its template before them.
BROADCAST_TOKENS, PART_PAGES = 500_000, 4_096

# Fixed values of the HTML standard and common class names.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn del em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img big".split())
FURNITURE = frozenset("head nav header footer aside form script style noscript template iframe button select textarea option svg canvas object menu dialog title datalist".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies footer header masthead menu modal nav navbar navigation "
    "newsletter notice notices popup promo promoted promotion related share sharing sidebar social sponsor sponsored subscribe subscription toolbar topbar widget disqus reply replies respond".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
#: Elements of text, which hold parts of an article but are none.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Beyond these a slot is not widened.
OUTERMOST = ((), ("html",), ("html", "body"))

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[a-z]+")
_SIGN = re.compile(r"[0-9]{2,}|[^a-z0-9-]+")
_SPACE = re.compile(r"\s+")


def _furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in FURNITURE and not (tag == "header" and in_article):
        return True
    low = attributes.lower()
    if not any(x in low for x in ("class", "id", "role", "hidden")) or tag in ("html", "body", "article", "main") and "comment" not in low:
        return False
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes):
        return True
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() in ("class", "id") and not NAMES.isdisjoint(_NAME.findall(value)):
            return True
        if name.lower() == "role" and value in ROLES or name.lower() == "aria-hidden" and value == "true":
            return True
    return False


def _sign(attributes: str) -> str:
    """Classes and id of an element, numbers apart, so that an element keeps its role from page to page."""
    low = attributes.lower()
    if "class" not in low and "id" not in low:
        return ""
    signs = [_SIGN.sub(".", "".join(values).lower()) for name, *values in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id")]
    return "".join(f".{x}" for x in signs)


class Roles:
    """The roles of a page's elements, numbered as they first come up: a role is its parent's number and a step (tag and sign).

    The root is 0; parents have smaller numbers than what is in them. A role's digest comes from its parent's."""

    def __init__(self) -> None:
        self.parent, self.step, self.depth, self.digest, self.linked, self.textual = [0], [""], [0], [0], [False], [False]
        self._known: dict[tuple[int, str], int] = {}

    def __len__(self) -> int:
        return len(self.parent)

    def number(self, parent: int, step: str) -> int:
        n = self._known.get((parent, step))
        if n is None:
            n = self._known[parent, step] = len(self.parent)
            tag = step.partition(".")[0]
            self.parent.append(parent)
            self.step.append(step)
            self.depth.append(self.depth[parent] + 1)
            self.digest.append(_step_digest(self.digest[parent], step))
            self.linked.append(self.linked[parent] or tag == "a")
            self.textual.append(self.textual[parent] or tag in TEXTUAL)
        return n

    def path(self, n: int) -> tuple[str, ...]:
        steps = []
        while n:
            steps.append(self.step[n])
            n = self.parent[n]
        return tuple(reversed(steps))

    def outermost(self, n: int) -> bool:
        return self.depth[n] <= 2 and self.path(n) in OUTERMOST


def runs(page: str) -> tuple[list[tuple[int, int, str, int, int]], Roles]:
    """(role, area, text, block, within) of elements (text '') and text runs in page order, and the page's roles.

    Areas: 0 furniture, 1 plain, 2 inside an article or main element. Runs of one block share its number. ``within`` is
    the depth of the innermost element that is furniture by its kind, 0 outside of any. Time and memory are linear in the page.
    """
    out: list[tuple[int, int, str, int, int]] = []
    roles = Roles()
    stack: list[tuple[str, int, int, int]] = [("", 0, 1, 0)]
    opened: Counter = Counter()  # so that an end tag without a start costs no search
    at, block, n = 0, 0, len(page)

    def text(upto: int) -> None:
        if upto > at:
            out.append((stack[-1][1], stack[-1][2], page[at:upto], block, stack[-1][3]))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(n)
            break
        follows = page[lt + 1 : lt + 2]
        if not (follows.isalpha() and follows.isascii() or follows in ("/", "!", "?") and follows):
            end = page.find("<", lt + 1)
            end = n if end < 0 else end
            text(end)
            at = end
            continue
        text(lt)
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(page, lt)
        if not m:
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        at, closing, tag, attributes = m.end(), m[1], m[2].lower(), m[3]
        if tag not in INLINE and tag != "br":
            block += 1
        if closing:
            while opened[tag]:
                opened[last := stack.pop()[0]] -= 1
                if last == tag:
                    break
            continue
        if tag not in INLINE and tag not in VOID:
            if opened["p"]:  # a block ends an open paragraph and what is in it; only inline elements are open inside
                while opened["p"] and (stack[-1][0] == "p" or stack[-1][0] in INLINE):
                    opened[stack.pop()[0]] -= 1
            if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and stack[-1][0] == tag:
                opened[stack.pop()[0]] -= 1
        _, role, area, within = stack[-1]
        role = roles.number(role, f"{tag}{_sign(attributes) if attributes else ''}")
        if _furniture(tag, attributes, area == 2):
            area, within = 0, roles.depth[role]
        elif area == 1 and (tag in ("article", "main") or 'role="main"' in attributes):
            area = 2
        out.append((role, area, "", block, within))
        if tag == "br":
            out.append((role, stack[-1][2], " ", block, within))
        elif tag in RAW:
            low = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            end = low.start() if low else n
            if tag not in ("script", "style"):
                stack.append((tag, role, 0, roles.depth[role]))
                text(end)
                stack.pop()
            at = end
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append((tag, role, area, within))
            opened[tag] += 1
    return out, roles


def _digest(seed: int, text: str) -> int:
    """64 bits with a sign, as Spark's long."""
    found = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed & 0xFFFFFFFFFFFFFFFF)
    return found - (found >> 63 << 64)


@lru_cache(1 << 16)
def _known_step(parent: int, step: str) -> int:
    return _digest(parent, step)


def _step_digest(parent: int, step: str) -> int:
    # Long attributes are not kept in a worker that lives on.
    return _known_step(parent, step) if len(step) <= 64 else _digest(parent, step)


def _clean(text: str) -> str:
    return _SPACE.sub(" ", entities.unescape(text)).strip()


def masses(found: list[tuple[int, int, str, int, int]], roles: Roles) -> tuple[list[list[int]], int]:
    """Characters of text inside each role, and how many of them stand in links; and those of the page that do not."""
    inside = [[0, 0] for _ in range(len(roles))]
    total = 0
    for role, _, text, _, _ in found:
        size = len(text.strip())
        inside[role][0] += size
        if roles.linked[role]:
            inside[role][1] += size
        else:
            total += size
    for role in range(len(roles) - 1, 0, -1):  # what is in a role comes after it
        up = inside[roles.parent[role]]
        up[0] += inside[role][0]
        up[1] += inside[role][1]
    return inside, total


def main_role(roles: Roles, slots: dict[int, tuple[int, int, int]]) -> int | None:
    """Of a page's roles the one of the article's slot; ``slots``: (text, linked text, text of the pages outside of links) of template elements.

    The innermost slot, no text element, with MAIN_SHARE of its pages' text; of equally deep ones the one with most text, then
    the largest digest. Then the elements around it while each adds a heading, at most WIDER_SHARE to it in all, and mostly no links."""
    known = {r: slots[roles.digest[r]] for r in range(1, len(roles)) if roles.digest[r] in slots}
    fit = [r for r, (text, linked, pages) in known.items() if text > linked and text - linked >= MAIN_SHARE * pages and not roles.textual[r]]
    if not fit:
        return None
    best = max(fit, key=lambda r: (roles.depth[r], known[r][0], roles.digest[r]))
    # Where the way down to a role leaves the way down to the slot.
    way, leaves = [False] * len(roles), [0] * len(roles)
    r = best
    while r:
        way[r], r = True, roles.parent[r]
    for r in range(1, len(roles)):
        leaves[r] = r if way[r] else leaves[roles.parent[r]]
    headed = {leaves[r] for r in known if not way[r] and roles.step[r].partition(".")[0] in HEADINGS}
    while (outer := roles.parent[best]) in known and not roles.outermost(outer):
        more, links = known[outer][0] - known[best][0], known[outer][1] - known[best][1]
        if outer not in headed or more > WIDER_SHARE * known[best][0] or 2 * links > more:
            break
        best = outer
    return best if not roles.outermost(best) else None  # the whole body is no slot


def main_text(page: str, everywhere: frozenset[int], in_article: frozenset[int], slots: dict[int, tuple[int, int, int]] | None = None) -> tuple[str, bool]:
    """The blocks of the article, and whether the template's slot gave them.

    Without such a slot: of the article that the page marks, if it holds text, else of all that is not furniture."""
    found, roles = runs(page)
    main = main_role(roles, slots) if slots else None
    inside = [False] * len(roles)
    if main:
        for r in range(main, len(roles)):
            inside[r] = r == main or inside[roles.parent[r]]
    for wanted, known in ((3, in_article), (2, in_article), (1, everywhere)):
        if wanted == 3 and not main:
            continue
        blocks: list[list[tuple[str, bool]]] = []
        last = None
        for role, area, text, block, within in found:
            if not text or (area != wanted if wanted < 3 else within > roles.depth[main] or not inside[role]):
                continue
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append((text, not text.strip() or bool(known) and _digest(roles.digest[role], _clean(text)) in known))
        # A block goes if all of it is the template's: a repeated word in emphasis is no furniture.
        lines = [x for x in (_clean("".join(t for t, _ in b)) for b in blocks if not all(of for _, of in b)) if x]
        if lines:
            return "\n".join(lines), wanted == 3
    return "", False


def templates(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(host, everywhere, in_article, slots): digests of the text runs of each host's template, and its elements with their text."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page", "token", "times", "place", "kind", "text", "linked", "page_text"]
        for batch in batches:
            hosts, rows = [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = _digest(0, text)
                first: dict[tuple[int, int], int] = {}
                counts: Counter = Counter()
                found, roles = runs(text)
                held, total = masses(found, roles)
                inside: dict[int, list[int]] = {}
                for i, (role, area, run, _, _) in enumerate(found):
                    if run and not (run := _clean(run)):
                        continue
                    code = _digest(roles.digest[role], run) if run else roles.digest[role]
                    kind = (area or 4 if run else 0, code)  # elements 0, text of furniture 4, else its area
                    counts[kind] += 1
                    first.setdefault(kind, i)
                    if not run:
                        inside[code] = held[role]
                if inside:
                    counts[(3, 0)] = 1  # the root, on every page with elements
                    first.setdefault((3, 0), 0)
                for (kind, code), c in counts.items():
                    hosts.append(h)
                    rows.append((key, code, c, first[kind, code], kind, *(inside[code] if not kind else (0, 0)), total))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *[pa.array(x, pa.int64()) for x in columns]], ["host", *names])

    schema = "host string, page long, token long, times long, place long, kind long, text long, linked long, page_text long"
    found = pages.select(F.col(host).alias("host"), F.col(html).alias("html")).where("html is not null").mapInArrow(tokens, schema)
    vectors = found.groupBy("host", "kind", "token").agg(
        F.sum(F.xxhash64("page", "times").cast("decimal(20,0)")).alias("vector"), F.count("*").alias("pages"), F.avg("place").alias("place"),
        *[F.sum(c).alias(c) for c in ("text", "linked", "page_text")],
        F.max(F.when(F.col("kind") == 3, F.col("page"))).alias("high"), F.min(F.when(F.col("kind") == 3, F.col("page"))).alias("low"),
    )
    vectors = materialise(vectors.where((F.col("pages") >= CLASS_PAGES) & ((F.col("kind") != 3) | (F.col("high") != F.col("low")))))
    roots = materialise(vectors.where("kind = 3").select("host", F.col("pages").alias("all_pages")))
    elements = F.sum(F.when(F.col("kind") == 0, 1).otherwise(0))
    classes = vectors.where("kind <> 3").groupBy("host", "vector").agg(
        F.count("*").alias("members"), elements.alias("elements"), F.max("pages").alias("support"), F.min("place").alias("first"), F.max("place").alias("last")
    )
    classes = materialise(classes.join(roots, "host"))
    widest = F.max_by(F.struct("first", "last"), F.struct("support", "elements", "vector")).alias("span")
    skeleton = classes.where((F.col("elements") > 0) & (F.col("support") >= F.col("all_pages") * SKELETON_SHARE)).groupBy(F.col("host").alias("of")).agg(widest)
    whole = F.col("support") >= F.col("all_pages") * WHOLE_SHARE
    nested = (
        classes.join(skeleton, F.col("host") == F.col("of"), "left")
        .where(whole | (F.col("members") >= CLASS_TOKENS) & (F.col("first") >= F.col("span.first")) & (F.col("last") <= F.col("span.last")))
        .select("host", "vector", "all_pages", whole.alias("whole"))
    )
    members = vectors.where("kind <> 3").join(nested, ["host", "vector"])
    often = F.col("pages") >= F.col("all_pages") * CLASS_SHARE
    in_article = (F.col("kind") != 0) & F.col("whole") & (F.col("all_pages") >= ARTICLE_PAGES)
    slot = F.when(F.col("kind") == 0, F.struct("token", "text", "linked", "page_text"))
    return members.groupBy("host").agg(
        F.collect_set(F.when(often & F.col("kind").isin(1, 4), F.col("token"))).alias("everywhere"),
        F.collect_set(F.when(often & in_article, F.col("token"))).alias("in_article"), F.collect_list(slot).alias("slots"),
    )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, from_template of every page: the article's blocks, one line each.

    ``from_template`` tells whether the template's slot gave the text. A null html is empty; its text is empty. Pages
    whose url has no host are one host. Hosts with fewer than ``CLASS_PAGES`` pages, or with one page repeated, have
    no template. Repeated rows keep a row each; an empty table gives no rows; other columns are not carried.
    """
    host = fresh(pages, "page_host")
    keyed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), url_host(F.col(url_col)).alias(host))
    known = materialise(templates(keyed, host, "html"))
    kind = dict(keyed.dtypes)["page_id"]
    schema = f"page_id {kind}, url string, text string, n_chars long, from_template boolean"
    keyed = keyed.select("page_id", "url", "html", F.col(host).alias("host"))
    if (known.agg(F.sum(F.size("everywhere") + F.size("in_article") + 4 * F.size("slots"))).first()[0] or 0) <= BROADCAST_TOKENS:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: _template(r["everywhere"], r["in_article"], r["slots"]) for r in known.collect()})

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _extracted(batch, [sent.value.get(h, NO_TEMPLATE) for h in batch.column(3).to_pylist()])

        return keyed.mapInArrow(extract, schema)
    return _with_templates(keyed, known).mapInArrow(_follow, schema)


NO_TEMPLATE = (frozenset(), frozenset(), None)


def _template(everywhere: list, in_article: list, slots: list) -> tuple[frozenset[int], frozenset[int], dict[int, tuple[int, int, int]]]:
    return frozenset(everywhere), frozenset(in_article), {x["token"]: (x["text"], x["linked"], x["page_text"]) for x in slots}


def _extracted(batch: pa.RecordBatch, told: list[tuple]) -> pa.RecordBatch:
    """The result of pages (page_id, url, html) with a template for each."""
    found = [main_text(html or "", *t) for html, t in zip(batch.column(2).to_pylist(), told, strict=True)]
    texts = [t for t, _ in found]
    columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([by for _, by in found], pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "from_template"])


def _with_templates(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """Pages dealt to parts of PART_PAGES of a host, with the host's template in front of each part's pages."""
    parts = keyed.groupBy("host").agg(F.ceil(F.count("*") / F.lit(PART_PAGES)).alias("parts")).where("parts > 1")
    columns = ["host", "part", "first", "page_id", "url", "html", "everywhere", "in_article", "slots"]
    no = {c: F.lit(None).cast(dict(known.dtypes)[c]).alias(c) for c in ("everywhere", "in_article", "slots")}
    dealt = keyed.withColumn("row", F.monotonically_increasing_id()).join(parts, "host", "left")
    dealt = dealt.select("host", F.coalesce(F.pmod("row", "parts"), F.lit(0)).alias("part"), F.lit(1).alias("first"), "page_id", "url", "html", *no.values())
    fronts = known.join(parts, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    none = [F.lit(None).cast(dict(keyed.dtypes)[c]).alias(c) for c in ("page_id", "url", "html")]
    fronts = fronts.select("host", "part", F.lit(0).alias("first"), *none, "everywhere", "in_article", "slots")
    both = fronts.unionByName(dealt).repartition("host", "part").sortWithinPartitions("host", "part", "first")
    return both.select("page_id", "url", "html", *[c for c in columns if c not in ("page_id", "url", "html")])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in the order of ``_with_templates``: one template is held at a time."""
    of, template = None, NO_TEMPLATE
    for batch in batches:
        first, hosts = batch.column(5).to_pylist(), batch.column(3).to_pylist()
        rows, told = [], []
        for i, (f, h) in enumerate(zip(first, hosts, strict=True)):
            if h != of:
                of, template = h, NO_TEMPLATE
            if f:
                rows.append(i)
                told.append(template)
            else:
                template = _template(*(batch.column(k)[i].as_py() for k in (6, 7, 8)))
        if rows:
            yield _extracted(batch.take(pa.array(rows)), told)
