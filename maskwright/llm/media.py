"""Interleaved document sequences: text and media in reading order, payloads resolved by digest.

* interleave: HTML becomes an ordered array of items: text blocks, and media references with their caption (figcaption
  of the same figure, else the alt text). A figcaption before any media of its figure, or outside a figure, is a text block. Positions count items, so text, media and captions stay aligned.
* Media are content-addressed: src="media:<sha256>" names the payload. A store keeps each payload losslessly
  as an 8-bit grey PNG, rows of ROW samples.
* resolve: references join the store by digest. A hot payload (a logo on every page) is one row of the store, and
  only references travel; both sides have an exchange of their own, so the hot digest can be split at run time.

Null HTML has no items; unknown digests resolve to null and keep their place. Payloads of any size are stored, an
empty one as one row of padding; a very long text is one image. Repeated rows are documents of their own. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, save, table, twin

ROW, PAD, TAIL = 576, b"\xff", 32
ITEM = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
#: Fixed values of HTML: elements that end a text block, and elements whose content isn't text.
BLOCKS = set("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul title".split())
HIDDEN = {"script", "style", "template", "noscript"}
MEDIA = {"img": "src", "video": "src", "audio": "src", "source": "src", "embed": "src"}


# ---- sequences ---------------------------------------------------------------------------


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.hidden = [], [], 0
        self.figures: list[list[int]] = []  # of each open figure the media in it
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in MEDIA and (ref := dict(attrs).get(MEDIA[tag])):
            self.flush()
            for figure in self.figures:
                figure.append(len(self.items))
            self.items.append({"kind": "media", "text": None, "ref": ref, "caption": dict(attrs).get("alt")})
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figures.append([])
            elif tag == "figcaption":
                self._caption()
                self.caption = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN:
            self.hidden -= 1

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.flush()
            if tag == "figcaption":
                self._caption()
            elif tag == "figure":
                self._caption()
                if self.figures:
                    self.figures.pop()

    def _caption(self) -> None:
        """The caption goes to the media of the innermost figure; without any it is text like other."""
        if self.caption is not None:
            text = " ".join("".join(self.caption).split())
            within = self.figures[-1] if self.figures else []
            for i in within:
                self.items[i]["caption"] = text or self.items[i]["caption"]
            if text and not within:
                self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})
            self.caption = None

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    parser._caption()
    return [{"position": i} | item for i, item in enumerate(parser.items)]


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and items, in reading order."""
    import pyarrow as pa

    item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])

    def run(batches):
        for part in blocks(batches, "html", 4 << 20):
            items = [sequence(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(items, pa.list_(item))], names=["id", "items"])

    kind = dict(pages.dtypes)[id_col]
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, items {ITEM}")


def references(sequences: DataFrame) -> DataFrame:
    """id, position, caption and digest of every media item."""
    item = F.explode(F.filter("items", lambda i: i["kind"] == "media")).alias("item")
    return sequences.select("id", item).select("id", "item.position", "item.caption", F.regexp_extract("item.ref", "^media:([0-9a-f]{64})$", 1).alias("digest"))


def resolve(found: DataFrame, held: DataFrame) -> DataFrame:
    """references() with the columns that held (one row for each digest) has for their payload."""
    return found.withColumn("twin", twin("digest")).join(held.withColumn("twin", twin("digest")), ["digest", "twin"], "left").drop("twin")


def interleaved(pages: DataFrame, held: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per page the items in order, media with their stored bytes (held: digest, media)."""
    rows = interleave(pages, id_col, html_col).withColumn("key", F.monotonically_increasing_id())
    rows = save(rows, "sequences")
    flat = rows.select("id", "key", F.explode_outer("items").alias("item")).withColumn("digest", F.regexp_extract("item.ref", "^media:([0-9a-f]{64})$", 1))
    joined = resolve(flat, held.select("digest", "media"))
    item = F.struct("item.position", "item.kind", "item.text", "item.ref", "item.caption", "media")
    return joined.groupBy("key", "id").agg(F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), item))).alias("items")).drop("key")


# ---- stored form -------------------------------------------------------------------------


def padded(data: bytes) -> bytes:
    """data with bytes 255 appended up to a positive multiple of ROW."""
    return data + PAD * (ROW - len(data) if len(data) < ROW else -len(data) % ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image, ROW samples a line; payload is a positive multiple of ROW."""
    height = len(payload) // ROW
    lines = np.zeros((height, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    head = struct.pack(">2I5B", ROW, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples, height x width. Reads 8-bit grey images without filters, as to_png writes them."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">2I5B", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    width, height, *form = shape
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if form != [8, 0, 0, 0, 0] or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit grey images are read")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation, share of steep steps along lines, and a histogram of 16 levels in thousandths."""
    flat = samples.ravel()
    n = len(flat)
    total, squares = int(flat.sum(dtype=np.int64)), int((flat.astype(np.int64) ** 2).sum())
    steps = np.abs(np.diff(samples.astype(np.int16), axis=1))
    levels = np.bincount(flat >> 4, minlength=16)
    deviation = max(0.0, squares / n - (total / n) ** 2) ** 0.5
    return f"{samples.shape[1]}x{samples.shape[0]} mean {total / n:.3f} dev {deviation:.3f} steep {int((steps > 32).sum()) * 1000 // n} hist " + " ".join(str(int(v) * 1000 // n) for v in levels)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a page with one figure (html) and its payload's digest and stored form."""
    import pyarrow as pa

    def run(batches):
        for part in blocks(batches, "text", 4 << 20):
            n, html, digest, media = [], [], [], []
            for text in part.column("text").to_pylist():
                data = text.encode()
                payload = padded(data)
                n.append(len(data))
                digest.append(hashlib.sha256(payload).hexdigest())
                media.append(to_png(payload))
                html.append(f'<figure><img src="media:{digest[-1]}"><figcaption>{escape(text[:40])}</figcaption></figure>')
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n, pa.int64()), pa.array(html, pa.string()), pa.array(digest, pa.string()), pa.array(media, pa.binary())], names=["id", "n_bytes", "html", "digest", "media"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n_bytes long, html string, digest string, media binary")


def describe(held: DataFrame) -> DataFrame:
    """Per digest of a store: what its stored bytes, read back, hold."""
    import pyarrow as pa

    def run(batches):
        for part in blocks(batches, "media", 4 << 20):
            out = []
            for media in part.column("media").to_pylist():
                samples = from_png(media)
                payload = samples.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            size, sha, crc, media_size, media_sha, text = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [part.column("digest"), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), pa.array(media_size, pa.int64()), pa.array(media_sha, pa.string()), pa.array(text, pa.string())],
                names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    one = held.select("digest", "media").mapInArrow(run, schema)
    rest = [c for c in one.columns if c != "digest"]
    return one.groupBy("digest").agg(*[F.min(c).alias(c) for c in rest])


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = save(store_texts(table(spark, sf_dir, "documents")), "media")
    pages = stored.select(F.struct("id", "n_bytes").alias("doc"), "html")
    found = references(interleave(pages, "doc", "html"))
    return resolve(found, describe(stored)).select(
        F.col("id.id").alias("doc_id"), F.col("id.n_bytes").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption"
    )
