"""HTML extraction by consensus host paths.

Every page's containers are scored; their generalised tag-class paths are voted on by host in Spark; every page is then
extracted again from its host's winning path. A page without text under that path uses its own best container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bound_batches, join_salted, private, small, staged, with_struct
from .urls import host_and_path

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*'|["'][^>]*\Z)*+)(?:>|\Z)""", re.S)
#: One attribute after another: a name and, if there is one, its value, so that no value is taken for a name.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|["'=]""")
TOLD = frozenset("class id role hidden itemprop aria-hidden style".split())

# Kinds of elements, and words of their classes and ids.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg noembed noframes".split())
DROPPED = frozenset("head nav header footer aside form button select menu dialog object canvas audio video datalist fieldset".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover output q rb rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CONTAINERS = frozenset("article main section div td body".split())
KEPT = frozenset("html body main".split())
BOILERPLATE = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related recommended reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that say so at the start of a class whatever follows ("sidebar-left"), and words that make others say so ("social-links").
ALWAYS = frozenset("ad ads advert advertisement adverts breadcrumb breadcrumbs commentlist disqus footer masthead nav navbar navigation pagination sidebar toolbar".split())
THINGS = frozenset("area bar block body bottom box button buttons container count feed form group icon icons inner item items left link links list main media message outer panel post posts right row section strip text title tools top widget widgets wrap wrapper".split())
#: What a class of the form "has-comments" tells of an element is not what the element is.
ABOUT = frozenset("has have with without no not is js show hide".split())
#: Reader comments stay out however long they are.
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
GOOD = frozenset("article articlebody body content entry main post story text".split())
#: An opening tag that ends an open element of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A class can't make boilerplate of an element if outside all such elements less than this share of its text is left.
LEFT = 0.1


def boilerplate_word(token: str) -> str | None:
    """The word by which a class or id names boilerplate: the whole, its last part, or its first part with what it goes by."""
    parts = [w for w in re.split(r"[^a-z]+", token) if w]
    if not parts or parts[0] in ABOUT:
        return None
    if parts[-1] in BOILERPLATE:
        return parts[-1]
    if parts[0] in ALWAYS or (parts[0] in BOILERPLATE and all(w in THINGS or w in BOILERPLATE for w in parts[1:])):
        return parts[0]
    return None


class Page:
    """Blocks of text (element, text, characters in links) of a page and its elements (parent, label, bonus, path).

    An element's path is a 64-bit hash of its parent's and its own label, so deep pages cost no more than flat ones.
    Elements that are boilerplate by their kind or role never give blocks. Those that are so by class or id, and forms,
    lose their blocks only if the page has other text to show: see `spare`.
    """

    def __init__(self, source: str):
        self.parent, self.label, self.bonus, self.path, self.depth = [-1], ["#"], [0.0], [0], [0]
        self.soft: dict[int, bool] = {}  # elements that class or id make boilerplate: whether it's the readers'
        self.blocks: list[tuple[int, str, int]] = []
        stack: list[tuple[str, int, bool]] = [("#", 0, False)]
        opened: dict[str, int] = {"#": 1}
        unclosed: set[str] = set()
        buffer: list[str] = []
        linked, link = 0, 0
        at, end = 0, len(source)

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join(html.unescape("".join(buffer)).split())
                if text:
                    self.blocks.append((stack[-1][1], text, min(linked, len(text))))
                buffer.clear()
            linked = 0

        def pop() -> str:
            tag = stack.pop()[0]
            opened[tag] -= 1
            return tag

        while at < end:
            m = MARKUP.search(source, at)
            text = source[at : m.start() if m else end]
            if text and not stack[-1][2]:
                buffer.append(text)
                if link:
                    linked += len(text)
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in INLINE:
                    if tag == "a":
                        link = max(0, link - 1)
                    if tag != "span" or not opened.get("span"):
                        continue
                    if stack[-1][0] == "span" and stack[-1][1] == stack[-2][1]:  # a plain one
                        pop()
                        continue
                if opened.get(tag):
                    flush()
                    while pop() != tag:
                        pass
                elif tag not in INLINE and not stack[-1][2]:
                    flush()
                continue
            if tag == "br":
                buffer.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in RAW or tag == "xmp":
                if tag == "svg" and m[3].rstrip().endswith("/"):
                    continue
                close = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                if not close:
                    unclosed.add(tag)
                if tag == "xmp" and not stack[-1][2]:  # shown as it stands
                    flush()
                    buffer.append(html.escape(source[at : close.start() if close else end]))
                    flush()
                if close:
                    at = close.end()
                elif tag != "svg":
                    at = end
                continue
            words, bad, soft, good = self.attributes(tag, m[3])
            if tag in INLINE and not ((bad or soft) and tag == "span"):
                if tag == "a":
                    link += 1
                elif tag == "span" and opened.get("span"):  # within a span that counts, plain ones do until they close
                    stack.append(("span", *stack[-1][1:]))
                    opened["span"] += 1
                continue
            flush()
            if tag not in INLINE and stack[-1][0] == "p":
                pop()
            while stack[-1][0] in CLOSES.get(tag, ()):
                pop()
            above, e = stack[-1][1], len(self.parent)
            label = tag + "".join("." + w for w in words)
            self.parent.append(above)
            self.label.append(label)
            self.bonus.append(good if tag in CONTAINERS else 0.0)
            self.path.append(xxhash.xxh64_intdigest(label, self.path[above]))
            self.depth.append(self.depth[above] + 1)
            if soft:
                self.soft[e] = soft in READERS
            stack.append((tag, e, stack[-1][2] or bad))
            opened[tag] = opened.get(tag, 0) + 1
        flush()
        self.spare()

    @staticmethod
    def attributes(tag: str, text: str) -> tuple[list[str], bool, str | None, float]:
        """Generalised classes, whether kind or role make the element boilerplate, the word by which class or id do, and its bonus as a container."""
        bad, soft, words, good = tag in DROPPED and tag != "form", "form" if tag == "form" else None, [], False
        for m in ATTRIBUTE.finditer(text) if text and not text.isspace() else ():
            name, value = (m[1] or "").lower(), (m[2] or m[3] or m[4] or "").lower()
            if name not in TOLD:
                continue
            if name in ("class", "id", "itemprop"):
                for token in value.split():
                    word = boilerplate_word(token)
                    soft = word if soft is None or word in READERS else soft
                    good |= any(w in GOOD for w in re.split(r"[^a-z]+", token))
                if name == "class":
                    words = sorted({re.sub(r"\d+", "#", w) for w in value.split()})[:2]
            elif name == "role":
                bad |= value in ROLES
            else:
                bad |= name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", ""))
        bonus = 1.5 if tag == "article" else 1.35 if tag == "main" else 1.3 if good else 1.0
        return (words, False, None, bonus) if tag in KEPT else (words, bad, soft, bonus)

    def spare(self) -> None:
        """Take the blocks of boilerplate by class out, but not of an element beside which the page has next to no text.

        Elements with the most text of their own are tried first; one is spared if less than LEFT of its text, and no
        text of a container of a better kind, is left outside. Readers' comments are never spared.
        """
        if not self.soft:
            return
        size = len(self.parent)
        nearest, better = [0] * size, [False] * size
        for i in range(1, size):
            nearest[i] = i if i in self.soft else nearest[self.parent[i]]
            better[i] = self.bonus[i] > 1.0 or better[self.parent[i]]
        own, outside, good = dict.fromkeys(self.soft, 0), 0, False
        for e, text, linked in self.blocks:
            if nearest[e]:
                own[nearest[e]] += max(len(text) - linked, 0)
            else:
                outside += max(len(text) - linked, 0)
                good |= better[e]
        readers = [False] * size  # in comments, at any depth
        for i in range(1, size):
            readers[i] = readers[self.parent[i]] or self.soft.get(i, False)
        spared: set[int] = set()
        for e in sorted(own, key=lambda e: (-own[e], e)):
            if good or not own[e] or outside >= LEFT * own[e]:
                break
            if not readers[e]:
                i = e
                while i and i not in spared:
                    spared.add(i)
                    i = nearest[self.parent[i]]
                outside += own[e]
        gone = [False] * size
        for i in range(1, size):
            gone[i] = gone[self.parent[i]] or (i in self.soft and i not in spared)
        self.blocks = [b for b in self.blocks if not gone[b[0]]]

    def scores(self) -> dict[int, tuple[float, int]]:
        """Score and depth of each container path: its share of the page's text outside links, by the kind of container."""
        held = [0.0] * len(self.parent)
        for e, text, linked in self.blocks:
            held[e] += max(len(text) - 2 * linked, 0)
        for i in range(len(self.parent) - 1, 0, -1):
            held[self.parent[i]] += held[i]
        total, out = held[0], {}
        for i in range(1, len(self.parent)):
            if self.bonus[i] and held[i] and total:
                depth = min(self.depth[i], 10)
                out[self.path[i]] = out.get(self.path[i], (0.0,))[0] + held[i] / total * self.bonus[i] * (1 + 0.02 * depth), self.depth[i]
        return out

    def best(self) -> list[tuple[int, tuple[float, int]]]:
        return sorted(self.scores().items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))

    def extract(self, path: int | None) -> tuple[str | None, str]:
        """The path in words and the blocks under its elements in page order; if there are none, under the page's own best, else all."""

        def under(path: int) -> tuple[str | None, list[str]]:
            inside, some = [False] * len(self.parent), 0
            for i in range(1, len(self.parent)):
                mine = self.path[i] == path
                inside[i] = inside[self.parent[i]] or mine
                some = some or (i if mine else 0)
            found = [t for e, t, _ in self.blocks if inside[e]]
            return (self.name(some) if found else None), found

        name, found = under(path) if path is not None and path in self.path[1:] else (None, [])
        if not found:
            name, found = next((x for p, _ in self.best() if (x := under(p))[1]), (None, [t for _, t, _ in self.blocks]))
        return name, "\n".join(found)

    def name(self, e: int) -> str:
        """An element's path in words: `body>div.post`."""
        out = []
        while e:
            out.append(self.label[e])
            e = self.parent[e]
        return ">".join(reversed(out))

    def text(self, name: str | None = None) -> str:
        """The text under a path in words."""
        path = 0
        for label in name.split(">") if name else ():
            path = xxhash.xxh64_intdigest(label, path)
        return self.extract(path or None)[1]


def _signed(path: int) -> int:
    return path - (1 << 64) if path >= 1 << 63 else path


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, path, score, depth): what each host's pages (host, html) give each container path; tasks add theirs up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(votes: dict) -> pa.RecordBatch:
            columns = [pa.array([h for h, _ in votes], pa.string()), pa.array([_signed(p) for _, p in votes], pa.int64()), pa.array([s for s, _ in votes.values()], pa.float64()), pa.array([d for _, d in votes.values()], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["host", "path", "score", "depth"])

        votes: dict[tuple[str, int], tuple[float, int]] = {}
        for batch in small(batches):
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, (score, depth) in Page(source or "").scores().items():
                    votes[host, path] = votes.get((host, path), (0.0,))[0] + score, depth
            if len(votes) > 200_000:
                yield batch_of(votes)
                votes = {}
        yield batch_of(votes)

    found = pages.select("host", "html").mapInArrow(run, "host string, path long, score double, depth int")
    return found.groupBy("host", "path").agg(F.round(F.sum("score"), 6).alias("score"), F.max("depth").alias("depth"))


def with_main_text(pages: DataFrame) -> DataFrame:
    """pages (url, html; others stay) with a struct column __page: path (where the text was found) and text.

    The article without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments:
    character references decoded, white space inside a block one space, blocks joined by a newline. Null and empty html
    give an empty text. Hosts mostly agree on one path; only hosts with another are joined, by broadcast if there are at
    most BROADCAST_ROWS of them, else by a salted shuffle.
    """
    bound_batches(pages.sparkSession)
    host, choice, weight = private(pages, "host", "path", "pages")
    keyed = pages.withColumn(host, host_and_path(F.col("url"))[0])
    votes = host_votes(keyed.select(F.col(host).alias("host"), "html"))
    winners = staged(votes.groupBy("host").agg(F.max(F.struct("score", "depth", "path")).getField("path").alias("path")), "paths")
    usual = winners.where(F.col("path").isNotNull()).groupBy("path").count().orderBy(F.desc("count"), "path").limit(1).collect()
    common = F.lit(usual[0]["path"] if usual else None).cast("long")
    others = winners.where(~F.col("path").eqNullSafe(common)).select(F.col("host").alias(host), F.col("path").alias(choice))
    if others.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = keyed.join(F.broadcast(others), host, "left")
    else:
        sizes = keyed.groupBy(host).agg(F.count("*").alias(weight))
        found = join_salted(keyed, others.join(sizes, host), host, weight, keyed.count(), "url")

    def make():
        mask = (1 << 64) - 1
        return lambda sources, paths: list(zip(*[Page(s or "").extract(None if p is None else p & mask) for s, p in zip(sources, paths, strict=True)], strict=True)) or [[], []]

    path = F.coalesce(choice, common)
    return with_struct(found.select(*pages.columns, path.alias(choice)), "__page", "path string, text string", [F.col("html"), F.col(choice)], make).drop(choice)


def page_report(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) a row of pages."""
    p = with_main_text(pages.select("page_id", "url", "html"))
    return p.select("page_id", "url", F.col("__page.text").alias("text"), F.length("__page.text").cast("long").alias("n_chars"))
