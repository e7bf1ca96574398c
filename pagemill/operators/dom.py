"""HTML to a flat DOM row, plus Column helpers over that row.

One page row in, one row out: ``(ids..., page_text, nodes)``.

* ``nodes`` is the element tree in pre-order. ``node_id`` is the array index,
  node 0 is the document root, ``parent_id`` points into the same array and
  the subtree of node ``a`` is ``a.node_id < node_id <= a.last_id``.
* ``page_text`` is the visible text of the page in document order. Every node
  carries ``[txt_start, txt_end)`` into it, so the text of any element is a
  substring: no aggregation, no second pass.

Tree rules follow the public behaviour of the classic ``html.parser`` tree
builder: void elements close themselves, an end tag pops to its nearest open
match or is ignored, there are no implied end tags (``<p>a<p>b`` nests), a
repeated attribute keeps its last value, whitespace-only strings collapse to one
newline or space outside ``pre``/``textarea``, and strings inside script, style,
template, rt and rp (plus comments, doctype, processing instructions) are not
part of the visible text. References in text are resolved as that builder does
it: an unknown name stays, without its semicolon. A page whose markup the
tokenizer rejects has null ``page_text`` and ``nodes`` and says why in
``parse_error``; its neighbours are not affected.

The parse is the one step Spark cannot express; it runs as an Arrow-batched
``mapInArrow`` so rows cross the JVM/Python boundary in columnar batches, and
everything after it (selection, text, images, blocks) is Spark expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.charsets import charsets
from ..session import bound_batches

# Fixed values of the tree-builder behaviour being reproduced.
VOID_TAGS = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link",
    "menuitem", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer",
])
HIDDEN_STRING_TAGS = frozenset(["script", "style", "template", "rt", "rp"])
PRESERVE_WS_TAGS = frozenset(["pre", "textarea"])
ROOT_TAG = "[document]"
_ASCII_SPACES = " \n\t\x0c\r"
_NOT_ASCII_SPACE = re.compile(r"[^ \n\t\x0c\r]")
_NON_WS = re.compile(r"\S+")

NODE_TYPE = T.StructType([
    T.StructField("node_id", T.IntegerType()),
    T.StructField("parent_id", T.IntegerType()),
    T.StructField("last_id", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("txt_start", T.IntegerType()),
    T.StructField("txt_end", T.IntegerType()),
])

_ARROW_NODE = pa.struct([
    ("node_id", pa.int32()), ("parent_id", pa.int32()), ("last_id", pa.int32()),
    ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("classes", pa.list_(pa.string())), ("txt_start", pa.int32()), ("txt_end", pa.int32()),
])


class _TreeBuilder(HTMLParser):
    """Builds the flat node table for one document."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.text: list[str] = []
        self.text_len = 0
        # columns of the node table
        self.parent: list[int] = [-1]
        self.last: list[int] = [0]
        self.tags: list[str] = [ROOT_TAG]
        self.attrs: list[dict] = [{}]
        self.starts: list[int] = [0]
        self.ends: list[int] = [0]
        self.stack: list[int] = [0]
        self.open_count: dict[str, int] = {}
        self.hidden_open = 0
        self.preserve_open = 0
        self.pending: list[str] = []
        self.closed_void: Counter[str] = Counter()

    # -- strings -----------------------------------------------------------
    def _flush(self, visible: bool = True):
        if not self.pending:
            return
        s = self.pending[0] if len(self.pending) == 1 else "".join(self.pending)
        self.pending = []
        # whitespace-only strings collapse; the first character settles most cases
        if not self.preserve_open and (not s or (s[0] in _ASCII_SPACES and _NOT_ASCII_SPACE.search(s) is None)):
            s = "\n" if "\n" in s else " "
        if visible and not self.hidden_open:
            self.text.append(s)
            self.text_len += len(s)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_entityref(self, name):
        self.pending.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name):
        base = 16 if name[:1] in "xX" else 10
        try:
            code = int(name.lstrip("xX"), base)
            # numbers below 256 mean the Windows code page where it has them
            data = bytes([code]).decode("windows-1252") if code < 256 else chr(code)
        except (UnicodeDecodeError, ValueError, OverflowError):
            data = "\N{REPLACEMENT CHARACTER}"
        self.pending.append(data)

    def _invisible(self, data):
        self._flush()
        self.pending.append(data)
        self._flush(visible=False)

    def handle_comment(self, data):
        self._invisible(data)

    def handle_decl(self, decl):
        self._invisible(decl)

    def handle_pi(self, data):
        self._invisible(data)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            # CDATA sections count as visible text.
            self._flush()
            self.pending.append(data[len("CDATA["):])
            self._flush()
        else:
            self._invisible(data)

    # -- tags --------------------------------------------------------------
    def _push(self, tag, attrs):
        self._flush()
        amap = dict(attrs)  # a repeated attribute keeps its last value
        if None in amap.values():
            amap = {k: ("" if v is None else v) for k, v in amap.items()}
        nid = len(self.tags)
        self.parent.append(self.stack[-1])
        self.last.append(nid)
        self.tags.append(tag)
        self.attrs.append(amap)
        self.starts.append(self.text_len)
        self.ends.append(self.text_len)
        self.stack.append(nid)
        self.open_count[tag] = self.open_count.get(tag, 0) + 1
        if tag in HIDDEN_STRING_TAGS:
            self.hidden_open += 1
        if tag in PRESERVE_WS_TAGS:
            self.preserve_open += 1

    def _pop(self):
        nid = self.stack.pop()
        tag = self.tags[nid]
        self.last[nid] = len(self.tags) - 1
        self.ends[nid] = self.text_len
        self.open_count[tag] -= 1
        if tag in HIDDEN_STRING_TAGS:
            self.hidden_open -= 1
        if tag in PRESERVE_WS_TAGS:
            self.preserve_open -= 1

    def _pop_to(self, tag):
        self._flush()
        if tag == ROOT_TAG:
            return
        while len(self.stack) > 1 and self.open_count.get(tag):
            top = self.tags[self.stack[-1]]
            self._pop()
            if top == tag:
                break

    def handle_starttag(self, tag, attrs):
        self._push(tag, attrs)
        if tag in VOID_TAGS:
            self._pop_to(tag)
            self.closed_void[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._push(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.closed_void[tag]:
            # end tag of a void element that already closed itself
            self.closed_void[tag] -= 1
        else:
            self._pop_to(tag)

    def finish(self):
        self.close()
        self._flush()
        while len(self.stack) > 1:
            self._pop()
        self.last[0] = len(self.tags) - 1
        self.ends[0] = self.text_len
        return "".join(self.text)


def parse_document(html: str):
    """Parse one document; returns (page_text, columns of the node table)."""
    b = _TreeBuilder()
    b.feed(html)
    text = b.finish()
    return text, b


# An output Arrow batch is closed once it holds this many nodes, or characters
# of html, so neither very large pages nor pages of many tiny elements build a
# huge (2 GB-limited) column. Until then the trees are Python objects, several
# hundred bytes a node, so a worker's memory does not grow with the rows that
# the session puts in an input batch.
OUT_BATCH_CHARS = 2 * 1024 * 1024
OUT_BATCH_NODES = 20_000

# Attributes that some rule reads; the others stay behind in Python.
KEPT_ATTRS = frozenset(["id", "class", "style", "property", "name", "content", "alt", "width", "height",
                        "src", "data-src", "data-original", "data-lazy-src", "data-lazy", "data-srcset", "srcset"])


def _to_batch(ids, id_names, texts, parsed, errors):
    node_offsets = [0]
    f_id, f_par, f_last, f_tag, f_s, f_e = [], [], [], [], [], []
    a_off, a_k, a_v = [0], [], []
    c_off, c_v = [0], []
    for b in parsed:
        if b is None:
            node_offsets.append(node_offsets[-1])
            continue
        n = len(b.tags)
        f_id.extend(range(n))
        f_par.extend(b.parent)
        f_last.extend(b.last)
        f_tag.extend(b.tags)
        f_s.extend(b.starts)
        f_e.extend(b.ends)
        for amap in b.attrs:
            for k in amap.keys() & KEPT_ATTRS:
                a_k.append(k)
                a_v.append(amap[k])
            a_off.append(len(a_k))
            cls = amap.get("class")
            if cls:
                c_v.extend(_NON_WS.findall(cls))
            c_off.append(len(c_v))
        node_offsets.append(node_offsets[-1] + n)
    attrs = pa.MapArray.from_arrays(pa.array(a_off, pa.int32()), pa.array(a_k, pa.string()),
                                    pa.array(a_v, pa.string()))
    classes = pa.ListArray.from_arrays(pa.array(c_off, pa.int32()), pa.array(c_v, pa.string()))
    structs = pa.StructArray.from_arrays(
        [pa.array(f_id, pa.int32()), pa.array(f_par, pa.int32()), pa.array(f_last, pa.int32()),
         pa.array(f_tag, pa.string()), attrs, classes,
         pa.array(f_s, pa.int32()), pa.array(f_e, pa.int32())],
        fields=list(_ARROW_NODE))
    mask = pa.array([b is None for b in parsed], pa.bool_())
    nodes = pa.ListArray.from_arrays(pa.array(node_offsets, pa.int32()), structs, mask=mask)
    return pa.RecordBatch.from_arrays(
        ids + [pa.array(texts, pa.string()), nodes, pa.array(errors, pa.string())],
        names=list(id_names) + ["page_text", "nodes", "parse_error"])


def decoded(body, codecs):
    """The text of a body by the first of the codecs that takes all of its bytes."""
    for codec in codecs:
        try:
            return body.decode(codec)
        except (UnicodeError, LookupError):
            continue
    raise ValueError(f"bytes of no charset among {', '.join(codecs)}")


def _try_parse(html, codecs=None):
    """``(page_text, node table, error)``; whatever the tokenizer raises concerns this page alone.

    ``html`` is text, or bytes with the codecs to try.
    """
    if html is None:
        return None, None, None
    try:
        return (*parse_document(html if codecs is None else decoded(html, codecs)), None)
    except MemoryError:  # the task's trouble, not the page's
        raise
    except Exception as e:  # noqa: BLE001 - the page's record says what it was
        return None, None, f"{type(e).__name__}: {e}"


def _parse_batches(id_names, html_name, codecs_name=None):
    def run(batches):
        for batch in batches:
            htmls = batch.column(batch.schema.get_field_index(html_name))
            codecs = (batch.column(batch.schema.get_field_index(codecs_name)).to_pylist() if codecs_name
                      else [None] * len(htmls))
            id_cols = [batch.column(batch.schema.get_field_index(c)) for c in id_names]
            start, chars, nodes, done = 0, 0, 0, []
            for i, h in enumerate(htmls):
                html = h.as_py()
                done.append(_try_parse(html, codecs[i]))
                chars += len(html or "")
                nodes += len(done[-1][1].tags) if done[-1][1] else 0
                if chars >= OUT_BATCH_CHARS or nodes >= OUT_BATCH_NODES or i + 1 == len(htmls):
                    texts, parsed, errors = zip(*done)
                    yield _to_batch([c.slice(start, i + 1 - start) for c in id_cols], id_names, texts, parsed, errors)
                    start, chars, nodes, done = i + 1, 0, 0, []
    return run


def parse_html(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """N1 ``dom_nodes``: add ``page_text``, ``nodes`` and ``parse_error`` for ``html_col``.

    ``keep`` are the columns carried through (default: all but the html).
    Select and filter *before* calling: the Python step is opaque to Catalyst,
    so nothing is pushed through it. A binary ``html_col`` holds bodies as they
    were received: their charsets are found by expressions, and the same step
    decodes them.
    """
    bound_batches(df.sparkSession)
    keep = [c for c in (keep if keep is not None else df.columns) if c != html_col]
    codecs = None
    if isinstance(df.schema[html_col].dataType, T.BinaryType):
        codecs = "_codecs"
        df = df.withColumn(codecs, charsets(F.col(html_col)))
    src = df.select(*keep, html_col, *[c for c in [codecs] if c])
    fields = [src.schema[c] for c in keep]
    out_schema = T.StructType(fields + [
        T.StructField("page_text", T.StringType()),
        T.StructField("nodes", T.ArrayType(NODE_TYPE)),
        T.StructField("parse_error", T.StringType()),
    ])
    return src.mapInArrow(_parse_batches(keep, html_col, codecs), out_schema)


PARSED_TYPE = T.StructType([T.StructField("page_text", T.StringType()), T.StructField("nodes", T.ArrayType(NODE_TYPE)),
                            T.StructField("parse_error", T.StringType())])


@F.arrow_udf(T.ArrayType(PARSED_TYPE))
def parse_snippets(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """N1 over an array of snippets, each parsed on its own: an array of (page_text, nodes, parse_error)."""
    for batch in lists:
        rows = batch.to_pylist()
        done = [_try_parse(h) for snippets in rows for h in snippets or []]
        texts, parsed, errors = zip(*done) if done else ((), (), ())
        flat = _to_batch([], [], texts, parsed, errors)
        offsets = [0]
        for snippets in rows:
            offsets.append(offsets[-1] + len(snippets or []))
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.to_struct_array())


# ---------------------------------------------------------------------------
# Column helpers over a dom row
# ---------------------------------------------------------------------------

def settle(df: DataFrame, *names: str) -> DataFrame:
    """Evaluate the named columns here, once.

    Columns defined in steps are merged into one expression by the optimizer; a
    long chain of steps that use each other several times would grow without
    bound. A generator of one row is never merged with what is below it.
    """
    # stars and SQL text: a select of many names is as many calls to the JVM
    listed = ", ".join(f"`{n}`" for n in names)
    return df.selectExpr(f"* EXCEPT ({listed})", f"explode(array(struct({listed}))) AS _settled").selectExpr(
        "* EXCEPT (_settled)", "_settled.*")


def first_node(nodes: Column, pred) -> Column:
    """N2 ``find``: first node in document order with ``pred(node)``, else NULL."""
    return F.get(F.filter(nodes, pred), 0)


def node_text(page_text: Column, node: Column) -> Column:
    """Visible text of ``node`` (``get_text()``): a substring of the page text."""
    return page_text.substr(node["txt_start"] + 1, node["txt_end"] - node["txt_start"])


def inside(node: Column, area: Column) -> Column:
    """``node`` is a proper descendant of ``area``."""
    return (node["node_id"] > area["node_id"]) & (node["node_id"] <= area["last_id"])


def subtree(nodes: Column, area: Column) -> Column:
    """The proper descendants of ``area``: a contiguous slice in pre-order, so
    scanning them costs the subtree's size, not the page's."""
    return F.slice(nodes, area["node_id"] + 2, F.greatest(area["last_id"] - area["node_id"], F.lit(0)))


def nodes_table(dom: DataFrame, *carry: str) -> DataFrame:
    """One row per element: ``inline`` of the node array, ids carried along."""
    return dom.select(*carry, F.inline("nodes"))
