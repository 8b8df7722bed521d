"""Main text of web pages by container paths that the pages of a host agree on.

Each page is read once to score its containers: text of a block counts for the element around it, half for the
next one, and so on; text inside links counts against it. The containers vote for their generalised path
(tags with their first class, digits folded), Spark sums the votes per host, and in a second reading
every page gives the text of its host's winning path. A page that lacks it uses its own best container.
Reading takes time in proportion to a page's length, however deep its elements are.
"""

from __future__ import annotations

import heapq
import html as entities
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadenz.llm import words as W
from kadenz.llm.staging import stage
from kadenz.llm.url_filter import host

#: A page votes for containers with this share of its best one's score; what only holds the best one has half of it.
VOTED = 0.6
#: A winning path is passed over on a page where it holds less than this share of the best container's score.
WORTH = 0.3
#: Pages that must vote for a path before it is a host's. What one page alone votes for is no agreement.
AGREED = 2

# HTML's element names by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption summary".split())
DROPPED = frozenset("head nav footer aside form button select dialog menu object audio video canvas datalist label search".split())
ENDS_P = BLOCK - {"option", "optgroup", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Which open element of the same kind a start tag ends, unless one of the others stands between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in a class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner sidebar sidenav comment comments commentlist reply replies respond disqus "
    "menu submenu nav navbar navigation navi breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login register social share sharing sharebar related recommended recommendations widget widgets toolbar pagination pager hidden skip contentinfo complementary search "
    "responses feedback discussion disclaimer legal copyright".split()
)
#: Those of them that mark talk, whose text can be much longer than the article's.
TALK = frozenset("comment comments commentlist reply replies respond disqus responses feedback discussion".split())
ARTICLE = frozenset({"article", "main"})
#: Words that deny or describe the next one, and words for a wrapper of what is named before.
ASIDE, WRAPPER = frozenset("no not non has have with without".split()), frozenset("wrap wrapper wrapping".split())
#: Words of a wrapper that holds the article besides the boilerplate it names.
HOLDS = frozenset("content main page site article post entry story primary".split())
#: What is kept is stray text if it has no article, paragraph or heading, and less than this share of the unlinked text.
REST = 0.05
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADING | {"p", "blockquote", "pre"}
#: Words that make a header part of the article.
OWN_HEADER = frozenset("entry post article content story".split())

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<open>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<loose>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)>"
    r"|</(?P<close>[a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|<[!?][^>]*+>",
    re.DOTALL,
)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
SEPARATOR = re.compile(r" (?:[|:·»«•/]|-|–|—) ")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def marked_words(marks: str) -> set[str]:
    """Words of a class, id or role, without those that no-sidebar, has-comments or content-sidebar-wrap only mention."""
    found: set[str] = set()
    for token in marks.split():
        parts = [p.lower() for p in PARTS.findall(token)]
        if WRAPPER.intersection(parts) and HOLDS.intersection(parts):
            parts = [p for p in parts if p not in MARKS and p != "header"]
        found |= {p for before, p in zip(["", *parts], parts, strict=False) if before not in ASIDE}
    return found


class Page:
    """Elements of a page (parent, label, tag) and its blocks (element, text, characters in links)."""

    def __init__(self, text: str):
        self.parent, self.label, self.tag, self.off, self.inside = [-1], [""], [""], [False], [False]
        self.marked: dict[int, bool] = {}  # blocks of HTML with boilerplate marks, and whether they mark talk
        self.own: set[int] = set()  # articles without such marks
        self.titles: set[str] = set()  # the page's title, and what stands between separators in it
        self.blocks: list[tuple[int, str, int]] = []
        self.stack = [0]
        self.open: dict[str, list[int]] = {}  # where the open elements of a name stand in the stack
        self.open_blocks = [0]
        self.buffer: list[str] = []
        self.linked = 0
        at, last = 0, text.rfind(">") + 1  # no tag ends later
        while m := TAG.search(text, at, last):
            self._text(text[at : m.start()])
            at = m.end()
            if name := m["open"] or m["loose"]:
                name = name.lower()
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(text, at)
                    if name == "title" and not self.titles:
                        title = " ".join(entities.unescape(text[at : end.start() if end else len(text)]).casefold().split())
                        self.titles = {title, *SEPARATOR.split(title)} - {""}
                    at = end.end() if end else len(text)
                else:
                    self._start(name, m["attrs"] or m["rest"] or "")
            elif m["close"]:
                self._end(m["close"].lower())
            elif at == last and text.startswith("<!--", m.start()) and not text.endswith(("-->", "--!>"), 0, at):
                at = len(text)  # a comment without an end
        rest = text[at:]
        self._text(rest[: rest.find("<!--")] if "<!--" in rest else rest)
        self._flush()
        if self.marked:
            self._drop_marked()

    def _drop_marked(self) -> None:
        """Drops the blocks below marked elements, but for elements that hold the article.

        These are, in this order: one whose own article has more text than all that is kept, one that holds the page's
        title as a heading where nothing kept does, and the largest where nothing but stray text is kept.
        """
        # of each element the mark that it stands in, -1 if none, and whether an article, or main, stands between them
        mark: list[int] = []
        between: list[tuple[bool, bool]] = []
        for n, up in enumerate(self.parent):
            inherits = up >= 0 and n not in self.marked
            mark.append(mark[up] if inherits else n if n in self.marked else -1)
            own = inherits and mark[n] >= 0 and n in self.own
            was = between[up] if inherits else (False, False)
            between.append((was[0] or own, was[1] or own and self.tag[n] == "main"))
        holds = lambda n: between[n][self.marked.get(mark[n], False)]
        # marks as a tree: text of a mark's own, text in and below it, and how much of that an article of the mark's holds
        direct: dict[int, float] = dict.fromkeys([-1, *self.marked], 0.0)
        articles: dict[int, float] = dict.fromkeys(direct, 0.0)
        prose, titles = set(), set()  # marks whose own text has paragraphs or headings, and those with the page's title as heading
        for node, text, linked in self.blocks:
            worth = max(len(text) - linked, 0)
            direct[mark[node]] += worth
            articles[mark[node]] += worth * holds(node)
            if worth and (self.inside[node] or self.tag[node] in PROSE):
                prose.add(mark[node])
            if self.tag[node] in HEADING and text.casefold() in self.titles:
                titles.add(mark[node])
        held, heads = dict(direct), {n: n in titles for n in direct}
        below: dict[int, list[int]] = {n: [] for n in direct}
        for n in sorted(self.marked, reverse=True):
            up = self.parent[n]
            below[mark[up]].append(n)
            held[mark[up]] += held[n]
            heads[mark[up]] |= heads[n]
            articles[mark[up]] += held[n] * holds(up)
        # below what: marks that are open to be kept, plain ones and talk apart, those that hold most first
        key = lambda n: (-articles[n], -held[n], n)
        plain, talk, titled = [], [], []
        rest, total, kept, firm, has_title = direct[-1], held[-1], {-1}, -1 in prose, -1 in titles

        def enter(found: list[int]) -> None:
            for n in found:
                heapq.heappush(talk if self.marked[n] else plain, key(n))
                if heads[n] and not self.marked[n]:
                    heapq.heappush(titled, key(n))

        def first(heap: list) -> int | None:
            while heap and heap[0][2] in kept:
                heapq.heappop(heap)
            return heap[0][2] if heap else None

        enter(below[-1])
        while True:
            a, b, t = first(plain), first(talk), first(titled)
            if a is not None and articles[a] > rest:
                n = a
            elif b is not None and articles[b] > rest:
                n = b
            elif t is not None and not has_title:
                n = t
            elif a is not None and held[a] > 0 and (rest == 0 or rest < REST * total and not firm):
                n = a
            elif b is not None and held[b] > 0 and rest == 0:
                n = b
            else:
                self.blocks = [x for x in self.blocks if mark[x[0]] in kept]
                return
            kept.add(n)
            enter(below[n])
            rest += direct[n]
            firm, has_title = firm or n in prose, has_title or n in titles

    def _text(self, raw: str) -> None:
        if raw and not self.off[self.stack[-1]]:
            self.buffer.append(raw)
            if self.open.get("a"):
                self.linked += len(raw)

    def _flush(self) -> None:
        if self.buffer:
            raw = "".join(self.buffer)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                self.blocks.append((self.stack[self.open_blocks[-1]], text, self.linked))
            self.buffer = []
        self.linked = 0

    def _last(self, *names: str) -> int:
        """Where the innermost open element of these names stands, 0 if there is none."""
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=0)

    def _pop_to(self, k: int) -> None:
        """Closes the open elements from position k on."""
        for n in reversed(self.stack[k:]):
            self.open[self.tag[n]].pop()
        del self.stack[k:]
        while self.open_blocks[-1] >= k:
            self.open_blocks.pop()

    def _start(self, name: str, attrs: str) -> None:
        if name in BLOCK:
            self._flush()
            paragraph = self._last("p") if name in ENDS_P else 0
            if name in ENDS:
                ends, stop = ENDS[name]
                k = max(paragraph, self._last(*ends))
                if k > self._last(*stop):
                    self._pop_to(k)
            elif paragraph and paragraph == self.open_blocks[-1]:
                self._pop_to(paragraph)
        if name in VOID:
            if name == "br":
                self._text(" ")
            return
        found = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attrs)} if attrs else {}
        marks = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}"
        up = self.stack[-1]
        off = self.off[up] or name in DROPPED or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        parts = marked_words(marks) if marks.strip() else set()
        if off or name in ("html", "body"):
            pass
        elif name in ARTICLE:
            if not parts & MARKS:
                self.own.add(len(self.tag))
        elif self.inside[up]:
            off = bool(parts & MARKS) and name not in BLOCK
            if parts & MARKS and name in BLOCK:
                self.marked[len(self.tag)] = bool(parts & TALK)
        elif parts & MARKS or not parts & OWN_HEADER and (name == "header" or "header" in parts):
            if name in BLOCK:
                self.marked[len(self.tag)] = bool(parts & TALK)
            else:
                off = True
        first = (found.get("class") or "").split()[:1] or [f"#{i}" for i in (found.get("id") or "").split()[:1]]
        self.parent.append(up)
        self.tag.append(name)
        self.off.append(off)
        self.inside.append(self.inside[up] or name in ARTICLE)
        self.label.append(re.sub(r"\d+", "0", f"{name}.{first[0]}" if first else name))
        self.open.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.open_blocks.append(len(self.stack))
        self.stack.append(len(self.tag) - 1)

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self._flush()
        k = self._last(name)
        # an inline end tag does not close blocks
        if k and (name in BLOCK or k > self.open_blocks[-1]):
            self._pop_to(k)

    def path(self, node: int) -> str:
        labels = []
        while node > 0:
            labels.append(self.label[node])
            node = self.parent[node]
        return "/".join(reversed(labels))

    def path_keys(self) -> list[int]:
        """Of each element a hash of its path, so that deep paths take no more room than others."""
        keys = [0]
        for up, label in zip(self.parent[1:], self.label[1:], strict=True):
            keys.append(xxhash.xxh3_64_intdigest(label.encode(), keys[up] & (1 << 64) - 1) - (1 << 63))
        return keys

    def scores(self) -> dict[int, float]:
        """Of each container: worth of the blocks below it, halved with each level between."""
        out: dict[int, float] = {}
        for node, text, linked in self.blocks:
            worth = len(text) - 2.0 * linked
            node = self.parent[node] if self.tag[node] in LEAF and self.parent[node] >= 0 else node
            while node >= 0 and abs(worth) >= 1:
                out[node] = out.get(node, 0.0) + worth * (3.0 if self.tag[node] in ARTICLE else 1.0)
                worth /= 2
                node = self.parent[node]
        return {n: s for n, s in out.items() if s > 0}

    def below(self, nodes: set[int]) -> Callable[[int], bool]:
        """Whether an element is one of the nodes or stands in one."""
        inside = dict.fromkeys(nodes, True)

        def below(n: int) -> bool:
            trail = []
            while n >= 0 and n not in inside:
                trail.append(n)
                n = self.parent[n]
            found = n >= 0 and inside[n]
            inside.update(dict.fromkeys(trail, found))
            return found

        return below

    def text(self, nodes: set[int]) -> str:
        """Blocks at or below the nodes, in page order."""
        below = self.below(nodes)
        return "\n".join(t for n, t, _ in self.blocks if below(n))

    def lifted(self, nodes: list[int]) -> set[int]:
        """The parent of several containers, where they share one and what else it holds is text rather than links: sections
        of an article, which has its title and introduction beside them."""
        up = self.parent[nodes[0]]
        if len(nodes) < 2 or up <= 0 or self.tag[up] in ("html", "body") or any(self.parent[n] != up for n in nodes):
            return set(nodes)
        inner, outer = self.below(set(nodes)), self.below({up})
        other = [(len(t), linked) for n, t, linked in self.blocks if outer(n) and not inner(n)]
        return {up} if sum(linked for _, linked in other) * 2 <= sum(n for n, _ in other) else set(nodes)


def _candidates(page: Page, share: float) -> tuple[dict[int, float], dict[int, list[int]]]:
    """Score of each path with at least this share of the best one's, by its key, and its containers."""
    found, keys = page.scores(), page.path_keys()
    total: dict[int, float] = {}
    nodes: dict[int, list[int]] = {}
    for n, s in found.items():
        total[keys[n]] = total.get(keys[n], 0.0) + s
        nodes.setdefault(keys[n], []).append(n)
    bar = share * max(total.values(), default=0.0)
    return {k: s for k, s in total.items() if s >= bar}, nodes


def votes_of(text: str | None) -> list[tuple[int, float]]:
    """Votes of a page, together 1."""
    total, _ = _candidates(Page(text or ""), VOTED)
    whole = sum(total.values()) or 1.0
    return [(k, s / whole) for k, s in total.items()]


def main_text(text: str | None, winners: list[int]) -> tuple[str, str | None]:
    """Main text, and the path that gave it. winners: the host's path keys, best first."""
    page = Page(text or "")
    total, nodes = _candidates(page, WORTH)
    if not total:
        return "", None
    use = next((k for k in winners if k in total), None)
    if use is None:
        use = max(total, key=lambda k: (total[k], -nodes[k][0]))
    return page.text(page.lifted(nodes[use])), page.path(nodes[use][0])


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", columns: list[str] | None = None) -> DataFrame:
    """Adds text and text_path (the container's path; null if none) to every page.

    columns: input columns to return (all but the html, if not given); those named like a result are replaced.
    Null or empty html, and pages without a container, have an empty text. Pages with a null url, or
    one without a host, vote together. A host's list has each path that two pages vote for, so it grows with the host's
    layouts; of equal votes the lower key wins. Rows may repeat. An empty table gives an empty result.
    """
    new = ["text", "text_path"]
    keep = [c for c in columns or pages.columns if c not in (*new, html_col)]
    named = pages.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[tuple[str, int], list[float]] = {}
            for h, t in zip(W.column(b, "host"), W.column(b, "html"), strict=True):
                for p, s in votes_of(t):
                    by.setdefault((h, p), []).append(s)
            cols = [pa.array([k[0] for k in by], pa.string()), pa.array([k[1] for k in by], pa.int64()), pa.array(map(sum, by.values()), pa.float64()), pa.array(map(len, by.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["host", "path", "vote", "pages"])

    votes = named.select("host", "html").mapInArrow(vote, "host string, path long, vote double, pages long").groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("vote"), F.sum("pages").alias("pages"))
    agreed = votes.where(F.col("pages") >= AGREED).groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.negate("vote").alias("order"), "path"))).alias("w"))
    winners = stage(agreed.select("host", F.transform("w", lambda x: x.path).alias("winners")), "host-paths")
    kinds = dict(named.dtypes)
    inner = [f"__k{i}" for i in range(len(keep))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(t, w or []) for t, w in zip(W.column(b, "html"), W.column(b, "winners"), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in inner], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=[*inner, *new])

    out = named.join(winners, "host", "left").select(*inner, "html", "winners").mapInArrow(read, ", ".join([*[f"{c} {kinds[c]}" for c in inner], "text string", "text_path string"]))
    return out.toDF(*keep, *new)
