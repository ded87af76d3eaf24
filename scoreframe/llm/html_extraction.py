"""Main text of web pages by wrapper induction.

1. Each page becomes a tree of its block elements and its skeleton: the tree's tags
   and classes, with the repeated records of a parent (paragraphs, items, rows) as one
   node. Tasks count skeletons by host, and for each node what texts it had: a
   smallest and a largest hash, and a bit set of its parent's texts.
2. A host's most frequent skeleton is its reference. Every other skeleton is aligned
   with it by simple tree matching, each distinct one once, and the nodes' texts
   are added up by reference node.
3. A node that had one and the same text on ``SUPPORT`` pages or more, while its
   parent had ``SUPPORT`` different ones, is constant: part of the template. All
   others are slots.
4. Pages are read again, aligned with their host's reference, and give the blocks of
   their slots. Of these, blocks inside elements whose tag, role or class says that
   they are menus, headers, footers, sidebars, notices, adverts, forms or comments
   don't count. If the page marks its article, only that counts.

A wrapper is one skeleton and a flag a node, whatever the number of the host's
pages, so a host with a third of all pages costs a row a task.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm import shared
from scoreframe.llm.url_filter import with_host_and_path

#: Pages that must agree on a node's text, and different texts that its parent must have had, before it is template.
SUPPORT = 3
#: Counts of matched nodes that are remembered at a time; one that went is computed again.
REMEMBERED = 1 << 18
#: Deeper elements count as children of this level.
DEEPEST = 150
#: Wrappers of all hosts that are sent to all tasks at most, in bytes; more meet the pages by a join.
BROADCAST_BYTES = 32 << 20

#: Elements without content, with raw text, and those that cut text into blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noframes noembed xmp textarea title svg math object".split())
RECORDS = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6 blockquote pre figcaption option".split())
BLOCKS = RECORDS | frozenset("html body head address article aside caption center details dialog dir div dl fieldset figure footer form header hgroup hr main menu nav ol section summary table tbody tfoot thead ul select button label".split())
#: An open element of the set ends where one of the given tags begins.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"]), "head": frozenset(["body"]),
    **{f"h{k}": frozenset("h1 h2 h3 h4 h5 h6".split()) for k in range(1, 7)},
}
#: Elements that end tags inside them don't reach out of.
SCOPES = frozenset("table td th caption html".split())
#: Tags, roles and words of a class or id that tell what isn't main text; those of the second set of words don't count inside an article.
SIDE_TAGS = frozenset("nav footer aside form menu dialog select button label head".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
SIDE_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr notice popup modal newsletter subscribe signup login comment comments reply replies disqus respond pagination pager toolbar".split())
OUTER_WORDS = frozenset("header masthead banner related recommended recommendations social share sharing widget alert search hidden".split())
ARTICLE_SIDE = frozenset("comment comments reply ad advert promo teaser related sponsored".split())

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
#: A quoted value may hold a ``>``; a quote that nothing closes is a letter like others.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """A page's block elements: parent, tag, signature and kind of each, and its blocks of text as (element, text, characters in links)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.sign, self.side, self.article = [-1], [""], [""], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self.open: list[int] = [0]
        self.said: list[str] = []
        self.linked = self.links = 0
        self._read(source)

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            begin = source.find("<", at)
            if begin < 0:
                self._say(source[at:])
                break
            if begin > at:
                self._say(source[at:begin])
            after = source[begin + 1 : begin + 2]
            if not (after in ("!", "?", "/") or after.isascii() and after.isalpha()):
                self._say("<")
                at = begin + 1
                continue
            found = (_COMMENT if after in ("!", "?") else _TAG).match(source, begin)
            if not found:  # an end tag without a name, or a tag whose last quote swallows its end; nothing follows a tag without end
                if (stop := source.find(">", begin)) < 0:
                    break
                at = stop + 1
                continue
            at = found.end()
            if found.re is _COMMENT:
                continue
            tag = found[2].lower()
            if found[1]:
                self._close(tag)
                continue
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = stop.end() if stop else n
                if found[3].endswith("/") and tag in ("svg", "math", "object", "iframe"):
                    at = found.end()
                continue
            self._open(tag, found[3])
        self._flush()

    def _say(self, text: str) -> None:
        self.said.append(text)
        if 0 < self.links <= len(self.open):
            self.linked += len(text)

    def _flush(self) -> None:
        if self.said:
            text = " ".join(html.unescape("".join(self.said)).split())
            if text:
                self.blocks.append((self.open[-1], text, min(self.linked, len(text))))
        self.said, self.linked = [], 0

    def _open(self, tag: str, rest: str) -> None:
        if tag in ("br", "wbr"):
            self.said.append(" " if tag == "br" else "")
            return
        if tag == "a":
            self.links = len(self.open)  # a link ends with the block that it began in, if nothing closes it
            return
        if tag not in BLOCKS:
            return
        self._flush()
        while len(self.open) > 1 and tag in CLOSED_BY.get(self.tag[self.open[-1]], ()):
            self.open.pop()
        if tag in ("li", "tr", "td", "th", "dt", "dd"):  # ends an open one of its own list or table
            for k in range(len(self.open) - 1, 0, -1):
                inner = self.tag[self.open[k]]
                if tag in CLOSED_BY.get(inner, ()):
                    del self.open[k:]
                    break
                if inner in ("ul", "ol", "menu", "dl", "table", "tbody", "thead", "tfoot"):
                    break
        if tag in VOID:
            return
        kinds = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest else {}
        above = self.open[-1]
        inside = self.article[above] or tag in ("article", "main") or kinds.get("role", "").lower() in ("article", "main")
        names = _CAMEL.sub(" ", f"{kinds.get('class', '')} {kinds.get('id', '')}").lower()
        side = self.side[above] or tag in SIDE_TAGS or (tag == "header" and not inside)
        side = side or "hidden" in kinds or kinds.get("aria-hidden", "").lower() == "true" or "display:none" in kinds.get("style", "").lower().replace(" ", "") or kinds.get("role", "").lower() in SIDE_ROLES
        if tag == "article":
            side = side or not ARTICLE_SIDE.isdisjoint(names.split())
        elif tag not in ("html", "body", "main"):
            words = set(_WORDS.findall(names))
            side = side or not SIDE_WORDS.isdisjoint(words) or (not inside and not OUTER_WORDS.isdisjoint(words))
        self.parent.append(above), self.tag.append(tag), self.side.append(side)
        self.sign.append(re.sub(r"\d+", "#", f"{tag}.{' '.join(sorted(kinds.get('class', '').lower().split()))}"))
        self.article.append(self.article[above] or (tag in ("article", "main") or kinds.get("role", "").lower() in ("article", "main")) and not side)
        if len(self.open) < DEEPEST:
            self.open.append(len(self.tag) - 1)

    def _close(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
            return
        if tag not in BLOCKS:
            if tag == "br":
                self.said.append(" ")
            return
        for k in range(len(self.open) - 1, 0, -1):
            inner = self.tag[self.open[k]]
            if inner == tag:
                self._flush()
                del self.open[k:]
                return
            if inner in SCOPES and tag not in ("table", "body", "html"):
                return

    def skeleton(self) -> tuple[str, list[int]]:
        """Depth and signature of each node in page order, and the node of each element; records of one parent and signature are one node."""
        children: list[list[int]] = [[]]
        signs, node_of, records = [""], [0] * len(self.tag), {}
        for element in range(1, len(self.tag)):
            above, sign = node_of[self.parent[element]], self.sign[element]
            node = records.get((above, sign)) if self.tag[element] in RECORDS else None
            if node is None:
                node = len(signs)
                signs.append(sign), children.append([]), children[above].append(node)
                if self.tag[element] in RECORDS:
                    records[above, sign] = node
            node_of[element] = node
        lines, number, todo = [], [0] * len(signs), [(0, 0)]
        while todo:
            node, depth = todo.pop()
            number[node] = len(lines)
            lines.append(f"{depth} {signs[node]}")
            todo += [(c, depth + 1) for c in reversed(children[node])]
        return "\n".join(lines), [number[n] for n in node_of]


def _tree(skeleton: str) -> tuple[list[str], list[list[int]], list[int]]:
    """Signature, children and a number for the whole subtree of each node."""
    signs, children, path = [], [], []
    for line in skeleton.split("\n"):
        depth, _, sign = line.partition(" ")
        del path[int(depth) :]
        if path:
            children[path[-1]].append(len(signs))
        path.append(len(signs))
        signs.append(sign), children.append([])
    whole = [0] * len(signs)
    for node in range(len(signs) - 1, -1, -1):
        whole[node] = hash((signs[node], tuple(whole[c] for c in children[node])))
    return signs, children, whole


def _ordered_choice(gain: Callable[[int], np.ndarray], n: int, m: int, pairs: bool) -> tuple[int, list[tuple[int, int]]]:
    """The largest sum of gains of an ordered choice of pairs of n rows and m columns, and if asked for the pairs.

    ``gain`` gives a row's gains by column. Of the sums of all prefixes a row is held
    at a time; the pairs are found from every ``step``-th row, between which rows are
    computed again. So memory grows with the columns times the root of the rows.
    """
    step, best, kept = math.isqrt(n) + 1, np.zeros(m + 1, np.int32), []

    def advance(best: np.ndarray, i: int) -> np.ndarray:
        out = np.zeros(m + 1, np.int32)
        np.maximum.accumulate(np.maximum(best[1:], best[:-1] + gain(i)), out=out[1:])
        return out

    for i in range(n):
        if pairs and i % step == 0:
            kept.append(best)
        best = advance(best, i)
    total, taken, j = int(best[-1]), [], m
    for block in range(len(kept) - 1, -1, -1):
        first, rows = block * step, [kept[block]]
        for i in range(first, min(first + step, n)):
            rows.append(advance(rows[-1], i))
        for i in range(first + len(rows) - 2, first - 1, -1):
            above, here, row = rows[i - first], rows[i - first + 1], gain(i)
            # The last column up to j from which the row above has the same sum, or whose pair makes the sum.
            while j and not (row[j - 1] and here[j] == above[j - 1] + row[j - 1]) and here[j] != above[j]:
                j -= 1
            if j and row[j - 1] and here[j] == above[j - 1] + row[j - 1]:
                j -= 1
                taken.append((i, j))
    return total, taken


def matched(skeleton: str, reference: str) -> list[int]:
    """The reference node that each node of ``skeleton`` is aligned with, -1 for none: simple tree matching.

    Two nodes match if their signatures are equal and their parents match; among the
    children of both, the ordered choice that matches most nodes is taken, whatever
    their number. Equal subtrees at both ends of two lists of children are matched
    first. Subtrees that are equal are compared once; time grows with the product of
    two lists' lengths.
    """
    signs_a, kids_a, whole_a = _tree(skeleton)
    signs_b, kids_b, whole_b = _tree(reference)
    out, sizes, memo = [-1] * len(signs_a), [1] * len(signs_a), {}
    for node in range(len(signs_a) - 1, -1, -1):
        sizes[node] += sum(sizes[c] for c in kids_a[node])

    def chosen(a: int, b: int, pairs: bool) -> tuple[int, list[tuple[int, int]]]:
        """Matched nodes below two nodes of one signature, these included, and if asked for the pairs of children taken."""
        left, right, taken = kids_a[a], kids_b[b], []
        lo, hi_a, hi_b = 0, len(left), len(right)
        while lo < min(hi_a, hi_b) and whole_a[left[lo]] == whole_b[right[lo]]:
            taken.append((left[lo], right[lo]))
            lo += 1
        while hi_a > lo and hi_b > lo and whole_a[left[hi_a - 1]] == whole_b[right[hi_b - 1]]:
            hi_a, hi_b = hi_a - 1, hi_b - 1
            taken.append((left[hi_a], right[hi_b]))
        total = 1 + sum(sizes[x] for x, _ in taken)
        columns = right[lo:hi_b]
        # Columns by what is below them, and of each such kind one node, listed by its signature.
        kinds = {whole_b[y]: y for y in columns}
        number, named = {w: k for k, w in enumerate(kinds)}, {}
        for k, y in enumerate(kinds.values()):
            named.setdefault(signs_b[y], []).append((k, y))
        rows = [x for x in left[lo:hi_a] if signs_a[x] in named]
        if not rows:
            return total, taken
        column, held = np.array([number[whole_b[y]] for y in columns]), {}

        def gain(i: int) -> np.ndarray:
            if (row := held.get(whole_a[rows[i]])) is None:
                row = np.zeros(len(kinds), np.int32)
                for k, y in named[signs_a[rows[i]]]:
                    row[k] = count(rows[i], y)
                if len(held) * len(kinds) >= REMEMBERED:
                    held.clear()
                held[whole_a[rows[i]]] = row
            return row[column]

        more, places = _ordered_choice(gain, len(rows), len(columns), pairs)
        return total + more, taken + [(rows[i], columns[j]) for i, j in places]

    def count(a: int, b: int) -> int:
        """Matched nodes of two subtrees whose nodes have one signature."""
        if whole_a[a] == whole_b[b]:
            return sizes[a]
        if not (kids_a[a] and kids_b[b]):
            return 1
        key = (whole_a[a], whole_b[b])
        if (known := memo.get(key)) is None:
            known = chosen(a, b, False)[0]
            if len(memo) >= REMEMBERED:
                memo.clear()
            memo[key] = known
        return known

    todo = [(0, 0)] if signs_a[0] == signs_b[0] else []
    while todo:
        a, b = todo.pop()
        out[a] = b
        todo += chosen(a, b, True)[1]
    return out


def _text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def observed(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Of ``pages`` with host: (host, skeleton, n, lo, hi, bits), the texts of each skeleton's nodes on n pages, a row a task and skeleton.

    lo and hi are the smallest and largest hash of a node's own text, bits a set of
    61 places in which the texts of the node's parent, all that is below it included, leave a mark each.
    """
    most = 4096

    def run(batches):
        held: dict[tuple[str, str], list] = {}

        def rows():
            keys = list(held)
            columns = [list(column) for column in zip(*held.values(), strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in columns[1:])], ["host", "skeleton", "n", "lo", "hi", "bits"])

        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = Page(source.as_py() or "")
                skeleton, node_of = page.skeleton()
                nodes = skeleton.count("\n") + 1
                own, below = [0] * nodes, [0] * nodes
                for element, text, _ in page.blocks:
                    h, node = _text_hash(text), node_of[element]
                    own[node] = (own[node] * 31 + h) & 0x7FFFFFFFFFFFFFFF
                    while element >= 0:
                        below[node_of[element]] = (below[node_of[element]] * 33 + h) & 0xFFFFFFFFFFFFFFFF
                        element = page.parent[element]
                above = [0] * nodes
                for element in range(1, len(page.tag)):
                    above[node_of[element]] = node_of[page.parent[element]]
                bits = [1 << below[a] % 61 for a in above]
                if (known := held.get((host, skeleton))) is None:
                    held[host, skeleton] = [1, own, own, bits]
                else:
                    known[0] += 1
                    known[1] = [min(x) for x in zip(known[1], own, strict=True)]
                    known[2] = [max(x) for x in zip(known[2], own, strict=True)]
                    known[3] = [x | y for x, y in zip(known[3], bits, strict=True)]
                if len(held) >= most:
                    yield rows()
        if held:
            yield rows()

    return pages.select("host", html_column).mapInArrow(run, "host string, skeleton string, n long, lo array<long>, hi array<long>, bits array<long>")


def _aligned(pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (host, skeleton, reference): (host, skeleton, to), ``to`` being :func:`matched`."""

    def run(batches):
        for batch in batches:
            to = [matched(a.as_py(), b.as_py()) for a, b in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(to, pa.list_(pa.int32()))], ["host", "skeleton", "to"])

    return pairs.mapInArrow(run, "host string, skeleton string, to array<int>")


def wrappers(pages: DataFrame, support: int = SUPPORT) -> DataFrame:
    """A row for each host that has a template among ``pages`` (host, html): host, its reference skeleton, and which of its nodes are constant.

    Hosts without a constant node have no row, nor has the empty host, whose pages have nothing in common.
    """
    seen = shared.written(observed(pages.where("host <> ''")), "skeletons")
    shapes = seen.groupBy("host", "skeleton").agg(F.sum("n").alias("n"))
    chosen = shapes.groupBy("host").agg(F.max_by("skeleton", F.struct("n", "skeleton")).alias("reference"))
    names = shared.written(_aligned(shapes.select("host", "skeleton").join(chosen, "host").select("host", "skeleton", "reference")), "alignments")
    # Rows of single nodes name their skeleton by 128 bits: its text grows with its nodes.
    nodes = seen.withColumn("skeleton", F.md5("skeleton")).select("host", "skeleton", "n", F.posexplode(F.arrays_zip("lo", "hi", "bits")).alias("node", "is"))
    nodes = nodes.groupBy("host", "skeleton", "node").agg(F.sum("n").alias("n"), F.min("is.lo").alias("lo"), F.max("is.hi").alias("hi"), F.bit_or("is.bits").alias("bits"))
    to = names.withColumn("skeleton", F.md5("skeleton")).select(F.col("host").alias("__h"), F.col("skeleton").alias("__s"), F.posexplode("to").alias("__node", "to")).where("to >= 0")
    on = (F.col("host") == F.col("__h")) & (F.col("skeleton") == F.col("__s")) & (F.col("node") == F.col("__node"))
    both = nodes.join(to, on).groupBy("host", "to").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_or("bits").alias("bits"))
    constant = both.where((F.col("lo") == F.col("hi")) & (F.col("lo") != 0) & (F.col("n") >= support) & (F.bit_count("bits") >= support))
    flags = constant.groupBy("host").agg(F.sort_array(F.collect_list("to")).alias("constant"))  # at most the reference's nodes
    return flags.join(chosen, "host").select("host", F.col("reference").alias("skeleton"), "constant")


@lru_cache(maxsize=4096)
def _template(skeleton: str, reference: str, constant: tuple[int, ...]) -> frozenset[int]:
    flags = set(constant)
    return frozenset(node for node, to in enumerate(matched(skeleton, reference)) if to in flags)


def main_blocks(page: Page, template: frozenset[int], node_of: list[int]) -> list[str]:
    """The blocks of the page's slots that are main text, in page order.

    Where the page marks no article, blocks of which half or more is links don't count.
    """
    good = [b for b in page.blocks if not page.side[b[0]]]
    if any(page.article[b[0]] for b in good):
        good = [b for b in good if page.article[b[0]]]
    else:
        good = [b for b in good if 2 * b[2] < len(b[1])]
    slots = [b for b in good if node_of[b[0]] not in template]
    return [text for _, text, _ in slots]


def extracted(pages: DataFrame, found: DataFrame, key: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """key, url, text and n_chars of each of the ``pages``, by their hosts' ``found`` wrappers."""
    schema = pages.select(F.col(key), F.col(url), F.lit("").alias("text")).schema
    named = with_host_and_path(pages.select(F.col(key), F.col(url), F.col(html_column).alias("__html")), url).drop("path")
    found = found.select(F.col("host").alias("__host"), "skeleton", "constant")
    size = found.agg(F.coalesce(F.sum(F.octet_length("skeleton") + F.octet_length("__host") + 4 * F.size("constant")), F.lit(0))).first()[0]
    joined = named.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, F.col("host") == F.col("__host"), "left")

    def run(batches):
        for batch in batches:
            texts = []
            for source, reference, constant in zip(*(batch.column(k) for k in (2, 3, 4)), strict=True):
                page = Page(source.as_py() or "")
                template, node_of = frozenset(), [0] * len(page.tag)
                if reference.is_valid:
                    skeleton, node_of = page.skeleton()
                    template = _template(skeleton, reference.as_py(), tuple(constant.as_py()))
                texts.append("\n\n".join(main_blocks(page, template, node_of)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema.names)

    return joined.select(F.col(key), F.col(url), "__html", "skeleton", "constant").mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """key, url, text and n_chars (code points) of each of the ``pages``: the main text, blocks joined by two line feeds.

    A null or empty html gives an empty text. A page without a host (null url or no
    ``://``), of a host of fewer than ``SUPPORT`` pages or of one whose pages all
    say the same has no template; tags, roles and classes alone tell its main text.
    Equal pages and equal keys each keep their row; very long pages are read whole;
    elements nested deeper than ``DEEPEST`` count as that deep. Other columns aren't read.
    """
    hosts = with_host_and_path(pages.select(F.col(url), F.col(html_column).alias("html")), url).select("host", "html")
    return extracted(pages, shared.written(wrappers(hosts), "wrappers"), key, url, html_column)
