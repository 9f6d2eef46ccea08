"""HTML extraction by consensus of hosts.

Each page's containers are scored by the text of the blocks in them, less the text of links; a page gives one vote in all, shared
by score among its containers' generalised paths (tags and classes, digits as #). A container that stands several times under one parent
votes for that parent. Spark adds up the votes per host and path, and each host keeps its PATHS strongest paths. Pages are then extracted again
by the first of their host's paths that they have, from all containers on it; a page that has none of them uses its own best
container. So a page whose own text is thin or whose comments are long follows its host's other pages.

What is not the article is left out: by tag (DROP_TAGS), what is hidden, and by the names in class, id or role. A name whose head word is one of
DROP_WORDS (`sidebar`, `post-comments`, `ad-box`) drops its container. A word that only qualifies (`related-topic`, `search-result`), or stands
beside a name of the article (`entry related`), marks it; names of a state (`no-sidebar`, `has-banner`, `share-enabled`) say nothing. Whether a marked
container goes is for the host to say: on average over the host's pages it must hold at least LARGE of the text to stay. A host keeps
that answer for its VERDICTS most frequent marked paths; for any other the page's own share decides. No name drops html, body, main or article.
Character references are decoded, white space inside a block becomes one space, blocks are joined by two line feeds.

A host with a third of all pages costs one partial sum per task and path in the vote. Hosts with over 1/HOT of all pages, of which there are at most HOT,
are broadcast to their pages; the others are joined by host. Defined results: a null html
counts as empty and gives an empty text; a null or odd url belongs to the host ''; an html without tags is one block; broken
markup is read as far as it goes; repeated rows vote and are extracted each. Ties between paths go to the one that comes first by code
point, between a page's own containers to the first in the page. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import small_batches, staged, table, tidy

PATHS = 8
VERDICTS = 64
LARGE = 0.3
HOT = 256

# Tags by their part in a page, and words of classes, ids and roles that mark what is not the article.
DROP_TAGS = frozenset("nav header footer aside form button select option input label fieldset dialog menu iframe object embed canvas svg math audio video map".split())
RAW_TAGS = frozenset("script style title textarea noscript template xmp noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_TAGS = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var img br wbr".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th address summary".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section summary table ul".split())
DROP_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar side rail related recommended share sharing social comment comments respond reply replies disqus newsletter subscribe subscription signup login paywall menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer foot header masthead topbar toolbar popup modal overlay hidden widget widgets complementary contentinfo search".split())
GOOD_WORDS = frozenset("article post entry story content body text main".split())
STATE_WORDS = frozenset("no not non has have with without is hide hides enabled disabled active inactive on off".split())
PLACE_WORDS = frozenset("box boxes area areas section sections container wrapper wrap inner outer list bar links link block blocks slot unit group panel item items icons buttons tools left right top bottom first last primary secondary s".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.S)
_BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$|=)")
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SCOPE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCE = frozenset("ul ol dl table body html article section div main".split())


def mark(names: list[str]) -> int:
    """What the names of an element say: 2 that it is no part of the article, 1 that it may not be, 0 nothing."""
    found, good = 0, False
    for name in names:
        words = [w.lower() for w in _WORDS.findall(name)]
        good = good or len(words) == 1 and words[0] in GOOD_WORDS
        if not STATE_WORDS.isdisjoint(words):
            continue
        while len(words) > 1 and words[-1] in PLACE_WORDS:
            words.pop()
        if words and words[-1] in DROP_WORDS:
            found = 2
        elif not DROP_WORDS.isdisjoint(words):
            found = max(found, 1)
    return 1 if good and found else found


class Page:
    """Nodes (parent, tag, path, dropped, marked ones around them) and blocks (node, text, characters in links) of one page."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.path, self.dropped = [-1], [""], [""], [False]
        self.good = [False]
        self.marked: list[tuple[int, ...]] = [()]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)
        #: each marked node's share of the text
        self.shares: dict[int, float] = {}
        total = 0
        for node, text, _ in self.blocks:
            if not self.dropped[node]:
                total += len(text)
                for k in self.marked[node]:
                    self.shares[k] = self.shares.get(k, 0) + len(text)
        self.shares = {k: n / total for k, n in self.shares.items()}

    def settle(self, verdicts: dict[str, bool]) -> None:
        """Drops the marked nodes that are to go: by verdicts on their paths, or else by their share of this page."""
        gone = {k for k, share in self.shares.items() if not verdicts.get(self.path[k], share >= LARGE)}
        if gone:
            self.dropped = [d or not gone.isdisjoint(m) for d, m in zip(self.dropped, self.marked, strict=True)]

    def _open(self, stack: list[int], name: str, attributes: str) -> None:
        up, number = stack[-1], len(self.parent)
        label, dropped, good, marked = name, self.dropped[up] or name in DROP_TAGS, name in ("article", "main"), self.marked[up]
        if attributes and not attributes.isspace() and name not in INLINE_TAGS:
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            names = " ".join(found.get(k, "") for k in ("class", "id", "role")).split()
            if name not in ("html", "body"):
                said = mark(names)
                if said == 2 and name in ("article", "main"):
                    said = 1
                if said == 1:
                    marked = (*marked, number)
                dropped = dropped or said == 2 or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "") or bool(_BARE_HIDDEN.search(attributes))
            good = good or any(not GOOD_WORDS.isdisjoint(w.lower() for w in _WORDS.findall(x)) for x in names)
            if classes := found.get("class"):
                label += "." + ".".join(sorted({_DIGITS.sub("#", x) for x in classes.lower().split()}))
        stack.append(number)
        self.parent.append(up)
        self.tag.append(name)
        self.path.append(f"{self.path[up]}/{label}")
        self.dropped.append(dropped)
        self.good.append(good)
        self.marked.append(marked)

    def _read(self, source: str) -> None:
        stack, inline_links, text, linked = [0], 0, [], 0
        lower = source.lower() if "<" in source else source
        at, end = 0, len(source)

        def finish() -> None:
            nonlocal linked
            if text:
                whole = "".join(text)
                words = (entities.unescape(whole) if "&" in whole else whole).split()
                if words:
                    self.blocks.append((stack[-1], " ".join(words), linked))
                text.clear()
            linked = 0

        while at < end:
            m = _TOKEN.search(source, at)
            piece = source[at : m.start() if m else end]
            if piece:
                text.append(piece)
                if inline_links:
                    linked += len(piece)
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                if name == "a":
                    inline_links = max(0, inline_links - 1)
                elif name == "br":
                    text.append(" ")
                elif name not in INLINE_TAGS:
                    finish()
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == name:
                            del stack[k:]
                            break
                continue
            if name in RAW_TAGS:
                close = lower.find(f"</{name}", at)
                at = end if close < 0 else (lower.find(">", close) + 1 or end)
                continue
            if name in INLINE_TAGS:
                if name == "a":
                    inline_links += 1
                elif name in ("br", "wbr", "img"):
                    text.append(" " if name == "br" else "")
                continue
            finish()
            inline_links = 0
            if name in CLOSES_P or name in _SCOPE:
                closing = ("p",) if name in CLOSES_P else _SCOPE[name]
                for k in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[k]]
                    if tag in closing:
                        del stack[k:]
                        break
                    if tag in _FENCE:
                        break
            if name not in VOID_TAGS:
                self._open(stack, name, m[3])
                if m[3].endswith("/") and name in ("svg", "iframe"):
                    stack.pop()
        finish()

    def scores(self) -> dict[int, float]:
        """Of each container: the text of the blocks in it, halved for each further container around them. What stands several
        times under a parent has no score of its own and counts whole there."""
        total: dict[int, float] = {}
        for node, text, linked in self.blocks:
            if not self.dropped[node]:
                while node >= 0 and (self.tag[node] in TEXT_TAGS or self.tag[node] in ("ul", "ol", "dl", "tr", "tbody", "table")):
                    node = self.parent[node]
                total[node] = total.get(node, 0.0) + max(0, len(text) - 2 * linked)
        alike: dict[tuple[int, str], int] = {}
        waiting = sorted(total)
        for node in waiting:
            while node > 0 and (key := (self.parent[node], self.path[node])):
                fresh = self.parent[node] not in total
                alike[key] = alike.get(key, 0) + 1
                total.setdefault(self.parent[node], 0.0)
                node = self.parent[node]
                if not fresh:
                    break
        out: dict[int, float] = {}
        for node in sorted(total, reverse=True):  # a child comes after its parent
            weight = total[node]
            several = node > 0 and alike[self.parent[node], self.path[node]] > 1
            if node > 0:
                total[self.parent[node]] += weight if several else weight / 2
            if weight >= 1 and not several:
                out[node] = weight * (3 if self.tag[node] in ("article", "main") else 1.5 if self.good[node] else 1)
        return out

    def text(self, paths: list[str]) -> str:
        """The blocks in all containers on the first of paths that the page has, or else in its best container."""
        live = set()
        for node, _, _ in self.blocks:
            while not self.dropped[node] and node >= 0 and node not in live:
                live.add(node)
                node = self.parent[node]
        held = {self.path[k] for k in live}
        wanted = next((p for p in paths if p in held), None)
        if wanted is not None:
            inside = {k for k in live if self.path[k] == wanted}
        else:
            scores = self.scores()
            inside = {max(scores, key=lambda k: (scores[k], -k)) if scores else 0}
        kept = []
        for node, text, _ in self.blocks:
            if self.dropped[node]:
                continue
            while node >= 0 and node not in inside:
                node = self.parent[node]
            if node >= 0:
                kept.append(text)
        return "\n\n".join(kept)


def host() -> Column:
    return F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, str], list[float]] = {}

        def add(host: str, path: str, vote: float, share: float, times: int, votes: dict[tuple[str, str], list[float]] = votes) -> None:
            own = votes.setdefault((host, path), [0.0, 0.0, 0, 0])
            own[0] += vote
            own[1] += share
            own[2] += times

        for own_host, source in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            page = Page(source.as_py() or "")
            for node, share in page.shares.items():
                add(own_host, page.path[node], 0.0, share, 1)
            page.settle({})
            scores = page.scores()
            total = sum(scores.values())
            for node, score in scores.items():
                add(own_host, page.path[node], score / total, 0.0, 0)
            add(own_host, "", 0.0, 0.0, 0)
            votes[own_host, ""][3] += 1
        # millionths, so that sums don't depend on their order
        rows = [(h, p, round(v * 1e6), round(s * 1e6), n, pages) for (h, p), (v, s, n, pages) in votes.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["host", "path", "votes", "share", "times", "pages"])


def winners(pages: DataFrame, paths: int = PATHS) -> DataFrame:
    """host, paths (its strongest paths, strongest first), stay and go (its most frequent marked paths, by their verdict), pages."""
    small_batches(pages.sparkSession)
    votes = pages.select(host().alias("host"), "html").mapInArrow(tidy(_votes), "host string, path string, votes long, share long, times long, pages long")
    summed = staged(votes.groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("votes", "share", "times", "pages")]))

    def best(rows: DataFrame, by: str, most: int) -> DataFrame:
        order = W.partitionBy("host").orderBy(F.desc(by), "path")
        return rows.where(F.col(by) > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    def listed(what: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(what, F.struct("rank", "path")))), lambda x: x["path"])

    ranked = best(summed, "votes", paths).groupBy("host").agg(listed(F.lit(True)).alias("paths"))
    stays = F.col("share") >= F.lit(LARGE * 1e6) * F.col("times")
    settled = best(summed, "times", VERDICTS).groupBy("host").agg(listed(stays).alias("stay"), listed(~stays).alias("go"))
    counts = summed.where("path = ''").select("host", "pages")
    return counts.join(ranked, "host", "left").join(settled, "host", "left")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for source, paths, stay, go in zip(*[batch.column(c) for c in ("html", "paths", "stay", "go")], strict=True):
            page = Page(source.as_py() or "")
            page.settle(dict.fromkeys(stay.as_py() or [], True) | dict.fromkeys(go.as_py() or [], False))
            texts.append(page.text(paths.as_py() or []))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, paths: int = PATHS) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    best = staged(winners(pages, paths))
    least = (best.agg(F.sum("pages")).first()[0] or 0) / HOT
    hot = F.broadcast(best.where(F.col("pages") > least).drop("pages"))  # at most HOT rows
    own = pages.select("page_id", "url", "html", host().alias("host"))
    cold = own.join(hot.select("host"), "host", "left_anti").join(best.where(F.col("pages") <= least).drop("pages"), "host", "left")
    columns = ("page_id", "url", "html", "paths", "stay", "go")
    kind = pages.schema["page_id"].dataType
    schema = T.StructType([T.StructField("page_id", kind), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return own.join(hot, "host").select(*columns).unionByName(cold.select(*columns)).mapInArrow(tidy(_extract), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
