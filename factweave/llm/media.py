"""Interleaved document sequences: ordered text and media items from HTML, with payloads joined by digest."""

from __future__ import annotations

import hashlib
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import free_name, map_rows, record, stash, text_of

TILE = 24
#: One tile of 8-bit samples.
UNIT = TILE * TILE
_REF = "sha256:"
_SILENT = {"script", "style", "noscript", "template", "title"}
#: Elements that end what runs on without its end tag.
_BLOCKS = {"div", "li", "h1", "h2", "h3", "h4", "section", "article", "table", "tr", "ul", "ol", "nav", "footer", "header", "main", "aside", "body"}
_MEDIA = {"img", "video", "audio", "source", "embed"}
ITEMS = "array<struct<position: int, kind: string, text: string, digest: string, caption: string>>"


class _Sequence(HTMLParser):
    """Items of a page in reading order. A figure's caption belongs to its media and is no text of its own.

    End tags may be missing: a head ends where the body begins, a caption with its figure, with the
    next block or with the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[int] = []
        self.silent = 0

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self._add("text", text=text)

    def _add(self, kind, text=None, digest=None, caption=None):
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "digest": digest, "caption": caption})

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag == "body":
            self.silent = 0
        if tag in _BLOCKS or tag in ("figure", "figcaption"):
            self.end_caption()
        if tag in _SILENT:
            self.silent += 1
        elif tag in _MEDIA and (src := found.get("src")):
            self.flush()
            digest = src.removeprefix(_REF) if src.startswith(_REF) else hashlib.sha256(src.encode("utf-8", "surrogatepass")).hexdigest()
            self._add("media", digest=digest, caption=found.get("alt") or None)
            self.figure.append(len(self.items) - 1)
        elif tag == "figure":
            self.flush()
            self.figure = []
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag not in ("a", "b", "i", "em", "strong", "span"):
            if tag in _BLOCKS or (tag == "p" and self.caption is None):
                self.flush()
            else:
                (self.text if self.caption is None else self.caption).append(" ")

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "head":
            self.silent = 0
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_caption()
            self.figure = []
        elif tag in _BLOCKS or (tag == "p" and self.caption is None):
            self.end_caption()
            self.flush()

    def end_caption(self):
        if self.caption is None:
            return
        caption = " ".join("".join(self.caption).split())
        self.caption = None
        for at in self.figure:
            self.items[at]["caption"] = caption or self.items[at]["caption"]
        if not self.figure and caption:
            self._add("text", text=caption)

    def close(self):
        super().close()
        self.end_caption()
        self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    """Ordered items of one page; none for a null or empty page."""
    if not html:
        return []
    parser = _Sequence()
    parser.feed(html)
    parser.close()
    return parser.items


def parse_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with its HTML replaced by ``items``; all other columns stay, but for one called ``items``."""
    rest = [c for c in pages.columns if c not in (html_col, "items")]

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("position", pa.int32()), *[(c, pa.string()) for c in ("kind", "text", "digest", "caption")]]))
            items = pa.array([parse_sequence(h) for h in batch.column(len(rest)).to_pylist()], kind)
            return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], items], [*rest, "items"])

        return apply

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(rest).schema), f"items {ITEMS}"])
    return map_rows(pages.select(*rest, html_col), make, schema)


def resolve(parsed: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """Add ``media`` to the items of ``parsed(key, items, ...)``: the struct of ``media(digest, ...)`` with the item's digest, null where there is none.

    Only references travel, once per item, and the join is by digest; the results go back to
    their positions, so order, captions and texts stay as parsed. ``key`` must be unique.
    ``media`` must have one row per digest; a common digest is a skewed join that adaptive
    execution splits, both sides being plain scans.
    """
    held = [c for c in media.columns if c != "digest"]
    at = free_name("found", parsed.columns)
    refs = parsed.select(F.col(key).alias("of"), F.explode("items").alias("item")).filter("item.digest is not null").select("of", "item.position", "item.digest")
    known = media.select("digest", F.struct(*held).alias("media"))
    found = refs.join(known, "digest").groupBy("of").agg(F.map_from_entries(F.collect_list(F.struct("position", "media"))).alias(at))
    out = parsed.join(found.withColumnRenamed("of", key), key, "left")
    filled = F.transform("items", lambda i: i.withField("media", F.col(at)[i["position"]]))
    return out.withColumn("items", filled).drop(at)


def encode_samples(payload: bytes) -> bytes:
    """A payload of whole units as a binary grey map of 8-bit samples, 24 wide."""
    return b"P5\n%d %d\n255\n" % (TILE, len(payload) // TILE) + payload


def decode_samples(media: bytes) -> bytes:
    """The samples of a binary grey map, by its own header."""
    magic, size, top, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or top != b"255" or len(samples) != width * height:
        raise ValueError("not a whole 8-bit grey map")
    return samples


def describe(samples: bytes) -> str:
    """Tiles, mean, spread, commonest sample, and mean absolute step along the rows, all from integer sums."""
    x = np.frombuffer(samples, np.uint8)
    total, squares = int(x.sum(dtype=np.int64)), int(np.bincount(x, minlength=256) @ np.arange(256, dtype=np.int64) ** 2)
    steps = int(np.abs(np.diff(x.reshape(-1, TILE).astype(np.int16), axis=1)).sum(dtype=np.int64))
    n = len(x)
    return f"tiles={n // UNIT};mean={total / n:.6f};var={(squares - total * total / n) / n:.6f};mode={int(np.bincount(x, minlength=256).argmax())};step={steps / n:.6f}"


def text_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, id, n_bytes, html, digest, media)``: each text as stored samples and a page that shows them.

    The UTF-8 of the text (null: empty) is filled up with bytes 255 to a positive multiple of 576.
    """

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, pages, digests, media = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                stored = encode_samples(raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT))
                digest = hashlib.sha256(stored).hexdigest()
                caption = escape(f"document {i}: {len(raw)} bytes")
                sizes.append(len(raw))
                digests.append(digest)
                media.append(stored)
                pages.append(f'<article><p>{caption}</p><figure><img src="{_REF}{digest}"><figcaption>{caption}</figcaption></figure></article>')
            return record(id=batch.column(0), n_bytes=pa.array(sizes, pa.int64()), html=pa.array(pages), digest=pa.array(digests), media=pa.array(media, pa.binary()))

        return apply

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    made = map_rows(rows, make, "id long, n_bytes long, html string, digest string, media binary")
    return made.withColumn("row", F.monotonically_increasing_id())


def read_media(store: DataFrame) -> DataFrame:
    """One row per digest of ``store(digest, media)``: what reading the stored bytes back shows."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for stored in batch.column(1):
                stored = stored.as_py()
                samples = decode_samples(stored)
                values = len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(samples)
                for c, v in zip(out, values, strict=True):
                    out[c].append(v)
            return record(digest=batch.column(0), **{c: pa.array(v) for c, v in out.items()})

        return apply

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(store.select("digest", "media"), make, schema).dropDuplicates(["digest"])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the facts of its stored samples, by way of its page's resolved sequence.

    Null and empty texts are one unit of 255s; equal texts have equal values; an empty table gives
    no rows; repeated rows, and those without an id, stay apart; other columns are ignored, whatever their names. Stored media go to the shared folder once and are read from it.
    """
    stored = stash(text_pages(docs, id_col, text_col))
    known = stash(read_media(stored))
    pages = resolve(parse_pages(stored.select("row", "id", "n_bytes", "html")), known, "row")
    shown = pages.withColumn("m", F.element_at(F.filter("items", lambda i: i["kind"] == "media"), 1)["media"])
    return shown.select(F.col("id").alias(id_col), "n_bytes", "m.*")
