"""Media columns: payloads stored losslessly as PNG images, and documents as interleaved sequences of text and media.

A document is HTML. ``interleave`` parses it into an ordered sequence of structs, each a text or a reference to
media with its caption; ``resolve`` joins the references' digests with stored media, or what was computed of them, and keeps
each reference at its position. In ``media_documents`` neither payloads nor texts pass a shuffle: media are stored where their document is
read, features are computed where the stored bytes are read back, and only digests, positions and features are exchanged.
"""

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emtally.llm.tables import new_path, small_batches, written

#: A row of an image: 64 pixels of three 8-bit samples.
WIDTH, ROW_BYTES = 64, 192
_PNG = b"\x89PNG\r\n\x1a\n"
#: Digests of stored texts that a task remembers; the set is emptied when full, and later copies are stored once more.
REMEMBERED = 200_000
#: Characters of a text that are its media's caption.
CAPTION = 60
_HIDDEN = ("script", "style")
_MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": "media"}

SPAN = "span int, pos int, texts array<string>, kind string, digest string, caption string"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(payload: bytes) -> bytes:
    """``payload`` with spaces appended up to a positive multiple of ROW_BYTES."""
    return payload + b" " * (-len(payload) % ROW_BYTES if payload else ROW_BYTES)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """An 8-bit RGB image, rows unfiltered, whose samples are ``payload``; the unpadded length is in a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    raw = np.zeros((len(rows), ROW_BYTES + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0" + str(n_bytes).encode()) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 5)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The samples and the unpadded length of an image of ``to_png``; each chunk's checksum is verified."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, parts, n_bytes, width, height = 8, [], 0, 0, 0
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"a {kind.decode()} chunk has a wrong checksum")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", data[:8])
        elif kind == b"IDAT":
            parts.append(data)
        elif kind == b"tEXt" and data.startswith(b"Length\0"):
            n_bytes = int(data[7:])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width * 3 + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return rows[:, 1:].tobytes(), n_bytes


def feature(payload: bytes) -> str:
    """Of the samples: mean and deviation, the mean of each channel, and a 64-bit average hash over 64 equal spans."""
    x = np.frombuffer(payload, np.uint8)
    spans = np.add.reduceat(x.astype(np.int64), np.arange(64) * len(x) // 64) / np.diff(np.append(np.arange(64) * len(x) // 64, len(x)))
    bits = sum(1 << i for i, above in enumerate(spans > np.median(spans)) if above)
    channels = x.reshape(-1, 3).mean(axis=0)
    return f"mean={x.mean():.4f};std={x.std():.4f};rgb={','.join(f'{c:.3f}' for c in channels)};ahash={bits:016x}"


class _Sequence(HTMLParser):
    """Text and media references in the order of the document; a figcaption is the caption of its figure's media. One that
    isn't closed ends with its figure, the next figure or the page; one without media is text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.buffer, self.hidden, self.figure, self.caption = [], [], 0, None, None

    def flush(self):
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if text:
            self.items.append(["text", text, None, None])

    def end_caption(self):
        if self.caption is None:
            return
        said, self.caption = " ".join("".join(self.caption).split()), None
        of = [item for item in self.items[self.figure :] if item[0] != "text"] if self.figure is not None else []
        for item in of:
            item[3] = said
        if said and not of:
            self.items.append(["text", said, None, None])

    def end(self):
        self.close()
        self.end_caption()
        self.flush()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag in _MEDIA and a.get("src"):
            self.flush()
            self.items.append([_MEDIA[tag], None, a["src"].removeprefix("sha256:"), a.get("alt")])
        elif tag == "figure":
            self.end_caption()
            self.flush()
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag in ("p", "div", "br", "li", "h1", "h2", "h3", "article", "section", "tr"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_caption()
            self.flush()
            self.figure = None
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "article", "section", "tr"):
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.buffer if self.caption is None else self.caption).append(data)


def parse_sequence(page: str) -> list[list]:
    """[kind, text, digest, caption] of each item of an HTML document, in order."""
    parser = _Sequence()
    parser.feed(page)
    parser.end()
    return parser.items


def document_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, html) of each row: its text's lines as paragraphs and, after the first half of them, a figure that
    refers to the text's payload by digest, with the text's first CAPTION characters as its caption."""
    text = F.coalesce("text", F.lit(""))
    lines = documents.select("doc_id", F.sha2(text.cast("binary"), 256).alias("text_sha256"), _safe(F.substr(text, F.lit(1), F.lit(CAPTION))).alias("said"), F.filter(F.split(_safe(text), "\n"), lambda x: F.trim(x) != "").alias("lines"))
    half = F.ceil(F.size("lines") / 2).cast("int")
    paragraphs = lambda part: F.array_join(F.transform(part, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    figure = F.concat(F.lit('<figure><img src="sha256:'), F.col("text_sha256"), F.lit('"><figcaption>'), F.col("said"), F.lit("</figcaption></figure>"))
    after = F.slice("lines", half + 1, F.size("lines"))
    return lines.select("doc_id", "text_sha256", F.concat(F.lit("<article>"), paragraphs(F.slice("lines", F.lit(1), half)), figure, paragraphs(after), F.lit("</article>")).alias("html"))


def _safe(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def spans(pages: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The sequence of each page (``keys``, html) in rows of a media reference and the texts before it: the keys, span (from 0), pos (of its
    first item among all, from 0), texts, kind, digest, caption. Texts after the last reference are a span without one. A null or
    empty html has none; repeated rows repeat theirs; markup that isn't closed ends with the page."""
    schema = StructType([pages.schema[k] for k in keys] + StructType.fromDDL(SPAN).fields)
    types = (pa.int32(), pa.int32(), pa.list_(pa.string()), *[pa.string()] * 3)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows = [], []
            for i, page in enumerate(batch.column(len(keys)).to_pylist()):
                span, start, texts = 0, 0, []
                for pos, (kind, text, digest, caption) in enumerate(parse_sequence(page or "")):
                    if kind == "text":
                        texts.append(text)
                        continue
                    of.append(i)
                    rows.append((span, start, texts, kind, digest, caption))
                    span, start, texts = span + 1, pos + 1, []
                if texts:
                    of.append(i)
                    rows.append((span, start, texts, None, None, None))
            for i in range(0, len(rows), 4096):
                held = batch.select(list(range(len(keys)))).take(pa.array(of[i : i + 4096]))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows[i : i + 4096]), types)]
                yield pa.record_batch(held.columns + columns, names=schema.names)

    return pages.select(*keys, "html").mapInArrow(parse, schema)


def items(sequences: DataFrame) -> DataFrame:
    """``spans``, resolved or not, in one row per item: pos (from 0, among all of its page), kind, text, digest, caption, and other columns as they
    are, null for texts."""
    others = [c for c in sequences.columns if c not in {"span", "pos", "texts", "kind", "digest", "caption"}]
    keys, found = others[: sequences.columns.index("span")], others[sequences.columns.index("span") :]
    text = lambda t, i: F.struct((F.col("pos") + i).alias("pos"), F.lit("text").alias("kind"), t.alias("text"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("caption"))
    media = F.struct((F.col("pos") + F.size("texts")).alias("pos"), "kind", F.lit(None).cast("string").alias("text"), "digest", "caption")
    every = F.concat(F.transform("texts", text), F.when(F.col("kind").isNotNull(), F.array(media)).otherwise(F.array().cast("array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>")))
    return sequences.select(*keys, F.explode(every).alias("item"), *found).select(*keys, "item.*", *(F.when(F.col("item.kind") != "text", F.col(c)).alias(c) for c in found))


def interleave(pages: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per item of each page (``keys``, html), a text or a media reference: the keys, pos, kind, text, digest, caption."""
    return items(spans(pages, keys))


def store_media(documents: DataFrame) -> DataFrame:
    """A written table (digest string, media binary): each distinct text of a task once, padded and as a PNG.
    ``digest`` is the SHA-256 of the UTF-8 text; a null text is empty. The same text in two tasks is stored by both."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            digests, media, size = [], [], 0
            for text in batch.column(0):
                payload = text.as_buffer().to_pybytes() if text.is_valid else b""
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(digest)
                    digests.append(digest.hex())
                    media.append(to_png(padded(payload), len(payload)))
                    size += len(media[-1])
                if size > 8 << 20:
                    yield pa.record_batch([pa.array(digests), pa.array(media, pa.binary())], names=["digest", "media"])
                    digests, media, size = [], [], 0
            if digests:
                yield pa.record_batch([pa.array(digests), pa.array(media, pa.binary())], names=["digest", "media"])

    out = documents.select("text").mapInArrow(store, "digest string, media binary")
    # stored media are compressed already
    path = new_path(documents.sparkSession, "media")
    out.write.option("compression", "none").parquet(path)
    return documents.sparkSession.read.schema("digest string, media binary").parquet(path)


def media_features(media: DataFrame) -> DataFrame:
    """One row per digest, computed from the stored bytes as they are read back; a payload that isn't its digest's is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, stored in zip(batch.column(0).to_pylist(), batch.column(1)):
                stored = stored.as_py()
                payload, n = from_png(stored)
                if hashlib.sha256(payload[:n]).hexdigest() != digest:
                    raise ValueError(f"the media stored as {digest} hold something else")
                out.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)))
            if out:
                cols = list(zip(*out))
                yield pa.record_batch([pa.array(c) for c in cols], names=[x.split()[0] for x in FEATURES.split(", ")])

    # equal digests have equal features
    return media.mapInArrow(read, FEATURES).groupBy("digest").agg(*[F.first(x.split()[0]).alias(x.split()[0]) for x in FEATURES.split(", ")[1:]])


def resolve(sequences: DataFrame, stored: DataFrame) -> DataFrame:
    """``sequences`` (of spans, or of items) with what ``stored`` has of the media that each row refers to, null for rows that refer to none
    and for digests without media. ``stored`` has features, or the media themselves, a row per digest, and must be a written table: then
    Spark may split a digest that many rows share. Rows without a reference are spread over all tasks by a second key."""
    spread = F.when(F.col("digest").isNull(), F.xxhash64("doc_id", "pos")).otherwise(F.lit(0).cast("long"))
    joined = sequences.withColumn("spread", spread).join(stored.withColumn("spread", F.lit(0).cast("long")), ["digest", "spread"], "left")
    return joined.select(*sequences.columns, *(c for c in stored.columns if c != "digest"))


def media_sequences(documents: DataFrame) -> DataFrame:
    """Stores every whole text as media and returns the spans of the documents' sequences (``document_pages``), resolved: doc_id,
    text_sha256 (of the document, binary), the columns of SPAN, those of FEATURES, n_texts and texts_sha256, a digest of the span's texts. ``items`` gives it by
    items. A null text is empty: its sequence is its media alone. Repeated rows repeat their spans."""
    small_batches(documents.sparkSession)
    features = written(media_features(store_media(documents)), "media-features")
    pages = document_pages(documents).withColumn("text_sha256", F.unhex("text_sha256"))
    said = F.array_join(F.transform("texts", lambda t: F.sha2(t.cast("binary"), 256)), " ")
    return resolve(spans(pages, ("doc_id", "text_sha256")).withColumn("n_texts", F.size("texts")).withColumn("texts_sha256", F.unhex(F.sha2(said.cast("binary"), 256))), features)


def media_documents(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``, from its resolved sequence: doc_id, the columns of FEATURES and ``pos`` and ``caption`` of
    its media item (pos is the number of paragraphs before it), ``n_items`` and ``sequence_sha256``, of the digests, in order, of a
    line per span: digest of its texts' digests, kind, digest of the payload that was read back, digest of the caption (the latter three empty where there is none),
    joined by blanks. No text is shuffled for it, only digests. Equal texts have equal rows but for doc_id; repeated rows,
    which are one group here, are given as often as they are there; an empty table an empty result."""
    rows = media_sequences(documents).withColumn("n", F.col("n_texts") + F.col("kind").isNotNull().cast("int"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat_ws(" ", F.lower(F.hex("texts_sha256")), blank(F.col("kind")), blank(F.col("payload_sha256")), blank(F.sha2(F.col("caption").cast("binary"), 256)))
    held = F.struct((F.col("pos") + F.col("n_texts")).alias("pos"), "caption", *(x.split()[0] for x in FEATURES.split(", ")[1:]))
    found = (
        rows.withColumn("line", F.struct("span", F.unhex(F.sha2(line, 256)).alias("said"), "n"))
        .groupBy("doc_id", "text_sha256")
        # a span of each place once, however often the row is repeated; each has one at the first place
        .agg(F.array_sort(F.collect_set("line")).alias("lines"), F.count(F.when(F.col("span") == 0, 1)).alias("rows"), F.first(F.when(F.col("kind").isNotNull(), held), ignorenulls=True).alias("media"))
    )
    sequence = F.sha2(F.array_join(F.transform("lines", lambda x: F.lower(F.hex(x["said"]))), "\n").cast("binary"), 256)
    n = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    one = found.select("doc_id", "rows", "media.*", n.alias("n_items"), sequence.alias("sequence_sha256"))
    return one.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("row", "rows")
