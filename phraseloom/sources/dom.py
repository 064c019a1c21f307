"""Scans of HTML pages: document trees as rows, and the texts in them that may be segmented.

Static HTML has no layout; visibility and geometry come as columns where a caller has them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HAN, contains_han, utf16_length
from ..schema import DOM_NODE

# Elements whose texts are never read.
SKIPPED = ("script", "style", "noscript", "input", "textarea", "select", "button", "code", "pre", "kbd", "samp", "var", "svg", "math", "canvas", "iframe")
#: The name of the meta element by which a page opts out; callers pass the name that their pages use.
META_NAME = "phraseloom"
DIVIDER_CLASS = "phrase-divider"
HIDING = r"(^|;)(display:none|content-visibility:hidden|opacity:0(\.0*)?)(;|!|$)"
VISIBILITY = r"(?:^|;)visibility:(visible|hidden|collapse)(?:;|!|$)"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
STORES = ("chrome.google.com", "webstore.google.com")


def skipped(tag: Column, attrs: Column) -> Column:
    """Whether an element's whole subtree is left out."""
    editable = F.lower(F.element_at(attrs, "contenteditable"))
    style = F.lower(F.regexp_replace(F.coalesce(F.element_at(attrs, "style"), F.lit("")), r"\s", ""))
    return (
        tag.isin(*SKIPPED)
        | F.map_contains_key(attrs, "hidden")
        | F.coalesce(F.element_at(attrs, "aria-hidden") == "true", F.lit(False))
        | F.coalesce(editable.isNotNull() & (editable != "false"), F.lit(False))
        | F.array_contains(F.split(F.coalesce(F.element_at(attrs, "class"), F.lit("")), r"\s+"), DIVIDER_CLASS)
        | style.rlike(HIDING)
    )


class _Tree(HTMLParser):
    """Rows of elements (node_type 1), texts (3) and open shadow roots (11) in the order of the source.

    A `<template shadowrootmode=open>` is the shadow root of the element that holds it, unless that
    has one; what any other template holds is no part of the page. A shadow root's parent_id is its
    host. Paths follow what is drawn: a child of a host lies in the first slot of its name.
    """

    def __init__(self, page_id: int) -> None:
        super().__init__(convert_charrefs=True)
        #: open elements: node, tag, and whether they are or lie in a template that is not drawn
        self.open: list[tuple[int, str, bool]] = []
        self.page, self.rows, self.next = page_id, [], 1
        self.ords: dict[int | None, int] = {}
        self.roots: dict[int, int] = {}
        self.slots: dict[tuple[int, str], int] = {}
        self.slotted: dict[int, tuple[int, str]] = {}

    def _add(self, kind: int, tag: str | None, attrs: list, value: str | None) -> int:
        parent = self.open[-1][0] if self.open else None
        self.ords[parent] = self.ords.get(parent, -1) + 1
        node, self.next = self.next, self.next + 1
        self.rows.append((self.page, node, parent, self.ords[parent], [n for n, *_ in self.open], kind, tag, attrs, value))
        return node

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._close("p", until=CLOSES_P)
        if tag in ("li", "option", "tr", "td", "th"):
            self._close(tag, until={"ul", "ol", "select", "table", "tr"} - {tag})
        known = {k: v or "" for k, v in dict(attrs).items()}
        host = self.open[-1][0] if self.open else None
        unseen = bool(self.open) and self.open[-1][2]
        if unseen:
            node, self.next = self.next, self.next + 1
        elif tag == "template" and known.get("shadowrootmode", "").lower() == "open" and host is not None and self.open[-1][1] != "template" and host not in self.roots:
            node = self.roots[host] = self._add(11, None, [], None)
        else:
            node = self._add(1, tag, list(known.items()), None)
            self.slotted[node] = (host, known.get("slot", ""))
            unseen = tag == "template"
            if tag == "slot" and (root := next((n for n, t, _ in reversed(self.open) if t == "template"), None)) is not None:
                self.slots.setdefault((root, known.get("name", "")), node)
        if tag not in VOID:
            self.open.append((node, tag, unseen))

    def _close(self, tag: str, until: frozenset | set = frozenset()) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][1] == tag:
                del self.open[k:]
                return
            if self.open[k][1] in until or self.open[k][1] == "template":
                return

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def handle_comment(self, data: str) -> None:
        self.next += 1

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][2]:
            self.next += 1
        elif self.rows and self.rows[-1][5] == 3 and self.rows[-1][1] == self.next - 1 and self.rows[-1][2] == (self.open[-1][0] if self.open else None):
            self.rows[-1] = (*self.rows[-1][:8], self.rows[-1][8] + data)
        else:
            self._add(3, None, [], data)

    def slot_of(self, node: int, parent: int | None) -> int | None:
        """The slot that a child of a shadow host is drawn in; texts go to the unnamed one."""
        root = self.roots.get(parent)
        return None if root is None or root == node else self.slots.get((root, self.slotted.get(node, (parent, ""))[1]))

    def drawn(self) -> list[tuple]:
        """The rows with the slot each is in, and with paths through slots."""
        if not self.roots:
            return [(*r, None) for r in self.rows]
        parents = {r[1]: r[2] for r in self.rows}
        out = []
        for r in self.rows:
            path, at = [], r[1]
            while at is not None:
                slot = self.slot_of(at, parents[at])
                at = parents[at] if slot is None else slot
                path.append(at)
            out.append((*r[:4], path[-2::-1], *r[5:], self.slot_of(r[1], r[2])))
        return out


def dom_nodes(pages: DataFrame) -> DataFrame:
    """The nodes of each page (page_id, html) in the order of its source; pages without html have none. slot_id is the slot that a host's child is drawn in."""
    kinds = [("page_id", pa.int64()), ("node_id", pa.int64()), ("parent_id", pa.int64()), ("ord", pa.int32()), ("path", pa.list_(pa.int64())), ("node_type", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("value", pa.string()), ("slot_id", pa.int64())]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for key, html in zip(batch.column("page_id").slice(at, 64).to_pylist(), batch.column("html").slice(at, 64).to_pylist(), strict=True):
                    tree = _Tree(key)
                    tree.feed(html or "")
                    tree.close()
                    rows += tree.drawn()
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    return pages.select("page_id", "html").mapInArrow(parsed, DOM_NODE)


def readable_texts(nodes: DataFrame, han_only: bool = True) -> DataFrame:
    """Texts that no left-out element holds: snapshot rows, in document order by idx."""
    out = nodes.where(F.col("node_type") == 1).where(skipped(F.col("tag"), F.col("attrs"))).select("page_id", F.col("node_id").alias("above"))
    texts = nodes.where((F.col("node_type") == 3) & (F.length("value") > 0))
    if han_only:
        texts = texts.where(contains_han(F.col("value")))
    # a page's left-out elements, met by each of a text's ancestors
    under = texts.select("page_id", "node_id", F.explode("path").alias("above")).join(out, ["page_id", "above"]).select("page_id", "node_id").distinct()
    # visibility passes on to what is below until an element sets another one
    style = F.lower(F.regexp_replace(F.coalesce(F.element_at("attrs", "style"), F.lit("")), r"\s", ""))
    sets = nodes.where(F.col("node_type") == 1).select("page_id", F.col("node_id").alias("above"), F.regexp_extract(style, VISIBILITY, 1).alias("sets")).where("sets != ''")
    nearest = texts.select("page_id", "node_id", F.posexplode("path").alias("depth", "above")).join(sets, ["page_id", "above"]).groupBy("page_id", "node_id").agg(F.max_by("sets", "depth").alias("sets"))
    hidden = nearest.where("sets != 'visible'").select("page_id", "node_id")
    kept = texts.join(under.union(hidden).distinct(), ["page_id", "node_id"], "left_anti")
    order = Window.partitionBy("page_id").orderBy("node_id")
    return kept.select("page_id", (F.row_number().over(order) - 1).alias("idx"), "node_id", "parent_id", F.col("value").alias("text"), F.lit(0).alias("start"), utf16_length(F.col("value")).alias("end"))


class _Texts(_Tree):
    """The readable texts of a page only: what is left out is pruned while the page is read."""

    def __init__(self, page_id: int) -> None:
        super().__init__(page_id)
        #: of each open element: whether its texts are left out, and whether they show
        self.state: dict[int, tuple[bool, bool]] = {}
        #: of each element, before what its slot says: its parent, whether it is left out, the visibility it sets
        self.own: dict[int, tuple[int | None, bool, bool | None]] = {}

    def _add(self, kind: int, tag: str | None, attrs: list, value: str | None) -> int:
        if kind == 3:
            return super()._add(kind, tag, attrs, value)
        parent = self.open[-1][0] if self.open else None
        gone, shows = self.state.get(parent, (False, True))
        node, self.next = self.next, self.next + 1
        sets = None
        if kind == 1 and not gone:
            known = dict(attrs)
            style = _SPACES.sub("", known.get("style", "")).lower()
            found = _VISIBILITY.search(style)
            gone, sets = _left_out(tag, known, style), None if found is None else found[1] == "visible"
        self.own[node] = parent, gone, sets
        self.state[node] = gone, shows if sets is None else sets
        return node

    def _through_slots(self, node: int, parent: int | None) -> tuple[bool, bool]:
        """As `state` says of a node's texts, from its drawn ancestors up."""
        gone, shows, slot = False, None, self.slot_of(node, parent)
        at = parent if slot is None else slot
        while at is not None:
            above, out, sets = self.own[at]
            gone, shows = gone or out, sets if shows is None else shows
            slot = self.slot_of(at, above)
            at = above if slot is None else slot
        return gone, shows is not False

    def readable(self) -> Iterator[tuple[int, int | None, str]]:
        """node_id, parent_id and text."""
        for row in self.rows:
            gone, shows = self._through_slots(row[1], row[2]) if self.roots else self.state.get(row[2], (False, True))
            if not gone and shows and row[8]:
                yield row[1], row[2], row[8]


_SPACES, _HIDING, _VISIBILITY, _HAN = re.compile(r"\s"), re.compile(HIDING), re.compile(VISIBILITY), regex.compile(HAN.replace("IsHan", "Han"))


def _left_out(tag: str, attrs: dict[str, str], style: str) -> bool:
    """As `skipped`, of one element."""
    editable = attrs.get("contenteditable")
    return (
        tag in SKIPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or editable is not None and editable.lower() != "false"
        or DIVIDER_CLASS in _ASCII_SPACES.split(attrs.get("class", "")) or bool(_HIDING.search(style))
    )


_ASCII_SPACES = re.compile(r"[ \t\n\x0b\f\r]+")


def page_texts(pages: DataFrame, han_only: bool = True) -> DataFrame:
    """The readable texts of pages (page_id, html), in one pass and without a shuffle: snapshot rows, in document order by idx."""
    kinds = [("page_id", pa.int64()), ("idx", pa.int32()), ("node_id", pa.int64()), ("parent_id", pa.int64()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for key, html in zip(batch.column("page_id").slice(at, 64).to_pylist(), batch.column("html").slice(at, 64).to_pylist(), strict=True):
                    tree = _Texts(key)
                    tree.feed(html or "")
                    tree.close()
                    found = [x for x in tree.readable() if not han_only or _HAN.search(x[2])]
                    rows += [(key, idx, node, parent, text, 0, len(text) + sum(c > "\uffff" for c in text)) for idx, (node, parent, text) in enumerate(found)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    return pages.select("page_id", "html").mapInArrow(read, "page_id long, idx int, node_id long, parent_id long, text string, start int, end int")


def shadow_roots(nodes: DataFrame) -> DataFrame:
    """(page_id, root_id, host_id) of the open shadow roots among nodes."""
    return nodes.where("node_type = 11").select("page_id", F.col("node_id").alias("root_id"), F.col("parent_id").alias("host_id"))


def drawn_parent(nodes: DataFrame) -> Column:
    """The element that a node is drawn in: its slot, its parent, or at a shadow root the host."""
    return F.coalesce(nodes["slot_id"], nodes["parent_id"])


def ancestors(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, ancestor_id, distance) from each node's path."""
    return nodes.select("page_id", "node_id", F.size("path").alias("depth"), F.posexplode("path").alias("pos", "ancestor_id")).select("page_id", "node_id", "ancestor_id", (F.col("depth") - F.col("pos")).alias("distance"))


def opted_out(html: Column, name: str = META_NAME) -> Column:
    """Whether the page has a meta element of this name whose content is `off`."""
    named, off = rf"name\s*=\s*[\"']?{name}(?=[\"'\s/>])", r"content\s*=\s*[\"']?off(?=[\"'\s/>])"
    return F.coalesce(html.rlike(rf"(?is)<meta\s(?=[^>]*{named})(?=[^>]*{off})"), F.lit(False))


def supports_url(url: Column) -> Column:
    """Whether a page's address is one to read: http, https or file, and no extension store or a part of one."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")
    store = F.lit(False)
    for s in STORES:
        store = store | (host == s) | host.endswith("." + s)
    return F.coalesce(url.rlike("^(https?|file):") & ~store, F.lit(False))


def supports_tab(tab_id: Column, url: Column, status: Column, discarded: Column, file_access: Column) -> Column:
    ready = tab_id.isNotNull() & ~F.coalesce(discarded, F.lit(False)) & (F.coalesce(status, F.lit("")) != "loading")
    return ready & supports_url(url) & (~url.startswith("file:") | F.coalesce(file_access, F.lit(False)))


# Messages that say a page cannot be changed.
DENIED = ("The extensions gallery cannot be scripted.", "The New Tab Page cannot be scripted.", "Cannot access a chrome:// URL", "Cannot access a chrome-extension:// URL of different extension", "This page cannot be scripted due to an ExtensionsSettings policy.", "Blocked")


def access_denied(message: Column) -> Column:
    return F.coalesce(message.startswith("Cannot access contents of ") | message.isin(*DENIED), F.lit(False))


def viewport(visual: Column, client_width: Column, client_height: Column) -> Column:
    """The visual viewport (left, top, width, height), or the client area from the origin."""
    rect = lambda x, y, w, h: F.struct(x.alias("left"), y.alias("top"), (x + w).alias("right"), (y + h).alias("bottom"))
    return F.when(visual.isNotNull(), rect(visual["left"], visual["top"], visual["width"], visual["height"])).otherwise(rect(F.lit(0.0), F.lit(0.0), client_width.cast("double"), client_height.cast("double")))


def meets(rect: Column, area: Column) -> Column:
    """Whether a rectangle of positive size and an area share more than an edge."""
    return (rect["right"] > rect["left"]) & (rect["bottom"] > rect["top"]) & (rect["right"] > area["left"]) & (rect["left"] < area["right"]) & (rect["bottom"] > area["top"]) & (rect["top"] < area["bottom"])


def visible(rects: Column, area: Column) -> Column:
    """Whether any of a text's rectangles meets the area; the first that does ends the search."""
    return area.isNotNull() & F.exists(rects, lambda r: meets(r, area))


def clip_of(style: Column, box: Column) -> Column:
    """What an element leaves visible: (left, top, right, bottom), null sides where it does not clip.

    Client sizes are unscaled; the drawn size over the offset size gives the scale.
    """
    clips = ["hidden", "clip", "auto", "scroll"]
    scale_x = F.when(box["offset_width"] != 0, box["width"] / box["offset_width"]).otherwise(1.0)
    scale_y = F.when(box["offset_height"] != 0, box["height"] / box["offset_height"]).otherwise(1.0)
    left, top = box["left"] + box["client_left"] * scale_x, box["top"] + box["client_top"] * scale_y
    across = style["overflow_x"].isin(clips) & ~style["display"].isin("inline", "contents")
    down = style["overflow_y"].isin(clips) & ~style["display"].isin("inline", "contents")
    return F.struct(F.when(across, left).alias("left"), F.when(down, top).alias("top"), F.when(across, left + box["client_width"] * scale_x).alias("right"), F.when(down, top + box["client_height"] * scale_y).alias("bottom"))


def visible_areas(chains: DataFrame, area: Column) -> DataFrame:
    """Of rows (page_id, node_id, clip) of each text's ancestors and an area: the area that all of them leave, null if none."""
    least = lambda f, k: f(F.coalesce(F.col("clip")[k], area[k])).alias(k)
    sides = chains.groupBy("page_id", "node_id").agg(least(F.max, "left"), least(F.max, "top"), least(F.min, "right"), least(F.min, "bottom"), F.max(area["left"]).alias("_l"), F.max(area["top"]).alias("_t"), F.max(area["right"]).alias("_r"), F.max(area["bottom"]).alias("_b"))
    box = F.struct(F.greatest("left", "_l").alias("left"), F.greatest("top", "_t").alias("top"), F.least("right", "_r").alias("right"), F.least("bottom", "_b").alias("bottom"))
    return sides.select("page_id", "node_id", F.when((box["right"] > box["left"]) & (box["bottom"] > box["top"]), box).alias("area"))
