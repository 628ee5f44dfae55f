"""Operator 1: interleaved document sequences.

HTML is parsed into an ordered array of items: text blocks, and media references that carry the digest of
their payload and a caption. References are resolved by a join on the digest with a media store; positions
and captions stay aligned with the text around them.

Payloads are stored losslessly as samples of 8 bits in portable graymaps of WIDTH columns.
"""

from __future__ import annotations

import re
from hashlib import sha256
from html import escape
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, hot_join, hot_keys, map_arrow, prepare, shared_path, stored, without

WIDTH = 192
PAD = b" "
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
_ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
STORE_SCHEMA = "digest string, n_bytes long, media binary"

#: Attributes that refer to a medium, by tag; of those in one group the first given counts.
_MEDIA = {"img": (("src", "srcset"),), "audio": (("src",),), "video": (("poster",), ("src",)), "source": (("src", "srcset"),), "embed": (("src",),), "object": (("data",),)}
_BLOCK = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "br", "hr", "figure", "blockquote", "pre", "nav", "footer", "header", "body", "title", "main", "aside"}
#: What stands in these is not shown as text; without an end, a template hides nothing.
_SILENT = {"script", "style", "template"}
_SPACE = re.compile(r"\s+")


def _references(tag: str, given: dict) -> list[str]:
    """What a tag refers to; of a set of sources the first."""
    found = []
    for group in _MEDIA[tag]:
        name = next((n for n in group if (given.get(n) or "").strip()), None)
        if name:
            value = given[name].strip()
            found.append(re.split(r",?\s", value)[0].rstrip(",") if name == "srcset" else value)
    return found


class _Sequence(HTMLParser):
    """Items in page order, as [kind, text, digest, caption, captions shown]. ``figures`` holds, for each open figure, where
    its items begin, its captions so far and its own media (those of no inner figure)."""

    def __init__(self, scheme: str):
        super().__init__(convert_charrefs=True)
        self.scheme, self.items, self.held, self.caption, self.inner = scheme, [], [], None, 0
        self.figures: list[tuple[int, list[str], list[list]]] = []
        self.silent, self.hidden = [], []

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.held)).strip()
        self.held = []
        if text:
            self.items.append(["text", text, None, None, []])

    @staticmethod
    def _show(item: list, text: str) -> None:
        """Put a caption behind those that a medium has; the first takes the place of its alternative text."""
        item[4].append(text)
        item[3] = " ".join(item[4])

    def close_caption(self) -> None:
        """End an open caption: it waits for its figure's end; outside a figure it belongs to the medium just before it, or is text."""
        if self.caption is None:
            return
        text, self.caption = _SPACE.sub(" ", "".join(self.caption)).strip(), None
        if not text:
            return
        if self.figures:
            self.figures[-1][1].append(text)
        elif self.items and self.items[-1][0] == "media":
            self._show(self.items[-1], text)
        else:
            self.items.append(["text", text, None, None, []])

    def close_figure(self) -> None:
        """A figure's captions, in order, go to all its own media, before or after them; without any, to those of the
        figures inside it, behind their own captions; without a medium they are text."""
        self.close_caption()
        self._flush()
        if not self.figures:
            return
        since, captions, own = self.figures.pop()
        media = own or [item for item in self.items[since:] if item[0] == "media"]
        for item in media if captions else ():
            self._show(item, " ".join(captions))
        if not media:
            self.items += [["text", text, None, None, []] for text in captions]

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent.append(tag)
        elif tag == "figcaption":
            self.close_caption()
            self._flush()
            self.caption, self.inner = [], 0
        elif tag in _MEDIA:
            given = dict(attrs)
            for src in _references(tag, given) if not self.silent else ():
                self._flush()
                self.items.append(["media", None, src.removeprefix(self.scheme), given.get("alt") or None, []])
                if self.figures:
                    self.figures[-1][2].append(self.items[-1])
        elif tag == "figure":
            self.close_caption()
            self._flush()
            self.figures.append((len(self.items), [], []))
        elif tag in _BLOCK:
            if self.caption is not None:  # blocks may stand inside a caption
                self.caption.append(" ")
                self.inner += tag not in ("br", "hr")
            self._flush()

    def handle_endtag(self, tag):
        if tag in _SILENT:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
                if not self.silent:
                    self.hidden = []
        elif tag == "figcaption":
            self.close_caption()
        elif tag == "figure":
            self.close_figure()
            self.inner = 0
        elif tag in _BLOCK:
            if self.caption is not None:
                if not self.inner:  # an end of a block that began outside
                    self.close_caption()
                else:
                    self.caption.append(" ")
                    self.inner -= 1
            self._flush()

    def handle_data(self, data):
        if self.silent:
            if self.silent[-1] == "template":
                self.hidden.append(data)
        elif self.caption is not None:
            self.caption.append(data)
        else:
            self.held.append(data)

    def finish(self) -> list:
        self.close()
        if self.silent:  # a template that never ended
            self.silent, left = [], "".join(self.hidden)
            self.handle_data(" " + left)
        while self.figures:
            self.close_figure()
        self.close_caption()
        self._flush()
        return self.items


def sequence(html: str | None, scheme: str = "sha256:") -> list[dict]:
    """Ordered items of one HTML text; positions count from 0. Null or empty HTML has none.

    A caption stands with every medium of its own figure, on whichever side (without any: of the figures inside); one
    outside a figure with the medium just before it; else it is text. Several captions of a medium follow one another,
    none is replaced. Media are what src, srcset (its first), poster and an object's data refer to. All shown text is
    kept, also where tags have no end.
    """
    if not html:
        return []
    p = _Sequence(scheme)
    p.feed(html)
    return [{"position": i, "kind": k, "text": t, "digest": d, "caption": c} for i, (k, t, d, c, _) in enumerate(p.finish())]


def parse_html(df: DataFrame, html: str = "html", out: str = "items", scheme: str = "sha256:") -> DataFrame:
    """Add ``out``, the ordered items of the HTML column. Other columns stay, one of that name is replaced.

    Null and empty HTML give an empty array; repeated rows stay; an empty table stays empty.
    """
    if out != html:
        df = without(df, out)
    at = df.columns.index(html)

    def run(batches):
        for b in batches:
            items = pa.array([sequence(x, scheme) for x in b.column(at).to_pylist()], pa.list_(_ITEM))
            yield pa.RecordBatch.from_arrays([*b.columns, items], names=[*b.schema.names, out])

    return map_arrow(df, run, extended(df, f"{out} array<{ITEM}>"))


def padded(text: str | None) -> tuple[bytes, int]:
    """The payload of a text: UTF-8, spaces up to a positive multiple of WIDTH; and the bytes before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + PAD * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw)), len(raw)


def graymap(payload: bytes) -> bytes:
    if not payload or len(payload) % WIDTH:
        raise ValueError("a payload fills whole rows")
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def samples(media: bytes) -> bytes:
    """The payload of a graymap; raises on another form or a wrong size."""
    m = re.match(rb"P5\s(\d+)\s(\d+)\s255\s", media[:64])
    if not m or len(media) - m.end() != int(m[1]) * int(m[2]):
        raise ValueError("not a graymap of 8 bits")
    return media[m.end() :]


def features(payload: bytes) -> str:
    """Rows, mean, and a 64-bit difference hash of the samples' 8 by 9 block means."""
    x = np.frombuffer(payload, np.uint8)
    edges = np.linspace(0, len(x), 73).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    means = ((sums[edges[1:]] - sums[edges[:-1]]) / np.diff(edges)).reshape(8, 9)
    bits = (means[:, 1:] > means[:, :-1]).ravel()
    return f"rows={len(x) // WIDTH};mean={sums[-1] / len(x):.4f};dhash={int(''.join('01'[b] for b in bits.tolist()), 2):016x}"


def write_store(docs: DataFrame, path: str, text: str = "text") -> None:
    """Store every text's payload as a graymap keyed by the payload's digest; copies within a batch once.

    Null is the empty text; a very long text is one graymap of many rows; an empty table writes no form.
    """
    at = docs.columns.index(text)
    schema = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for b in batches:
            seen = {}
            for t in b.column(at).to_pylist():
                payload, n = padded(t)
                key = sha256(payload).hexdigest()
                seen.setdefault((key, n), payload)
            rows = [(k, n, graymap(p)) for (k, n), p in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(list(zip(*rows)) or [[]] * 3, schema)], schema=schema)

    map_arrow(docs, run, STORE_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_store(spark, path: str) -> DataFrame:
    """What each stored form holds, computed from the bytes read back: one row for each digest; none from an empty store.

    A stored form that is no graymap of 8 bits raises.
    """
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            rows = []
            for digest, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = samples(media)
                rows.append((digest, len(p), sha256(p).hexdigest(), crc32(p[-16:]), len(media), sha256(media).hexdigest(), features(p)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, kinds)], names=names)

    stored = spark.read.schema(STORE_SCHEMA).parquet(path).select("digest", "media")
    out = map_arrow(stored, run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.dropDuplicates(["digest"])


def resolve(sequences: DataFrame, store: DataFrame, keys: list[str], items: str = "items") -> DataFrame:
    """One row for each item, in order, with its medium's columns (null where none is found or it is text).

    ``store`` has one row for each digest; only its small columns should be passed, not the payloads. Rows of
    digests that very many items share stay where they are. A row without items keeps one row of nulls.
    """
    flat = stored(sequences.select(*keys, F.explode_outer(items).alias("__i")).select(*keys, "__i.*"), "media-items")
    hot = hot_keys(flat, "digest", flat.count())
    return hot_join(flat, store.withColumnRenamed("digest", "__key"), "digest", hot, "left")


def document_html(text, key):
    """A page that names a document, shows it as its medium with a caption, and ends with its digest's head."""
    return f'<article><p>{escape(text)}</p><figure><img src="sha256:{key}" alt=""><figcaption>{escape(text)}</figcaption></figure><p>{key[:8]}</p></article>'


def op1_media_sequences(spark, sf_dir: str) -> DataFrame:
    """Every document becomes a page that refers to its text as a medium between text blocks; pages are parsed and references resolved.

    Null and empty texts have one row of spaces as payload; a null doc_id is named None; repeated rows stay; an empty
    table gives no row.
    """
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = shared_path(spark, "media")
    write_store(docs.select("text"), path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("html", pa.string())])

    def pages(batches):
        for b in batches:
            made = [padded(t) for t in b.column(1).to_pylist()]
            html = [document_html(f"document {i}", sha256(p).hexdigest()) for i, (p, _) in zip(b.column(0).to_pylist(), made)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in made], pa.int64()), pa.array(html, pa.string())], schema=schema)

    items = parse_html(map_arrow(docs, pages, "doc_id long, n_bytes long, html string"))
    found = resolve(items, read_store(spark, path), ["doc_id", "n_bytes"])
    return found.filter("kind = 'media'").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
