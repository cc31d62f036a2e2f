"""Media columns: interleaved sequences of texts and media references, and lossless payloads.

* ``sequences`` parses HTML into an ordered array of items: a text, or a
  reference to a medium with its caption. Each item keeps its position.
* ``stored`` puts payloads into a media column: bytes padded with zeros to a
  positive multiple of 64, as the 8-bit samples of a WAV stream.
* ``features_of`` reads stored media back and describes their samples; ``payloads`` keeps one row for each digest.
* ``resolve`` joins references with payloads by digest. Positions and
  captions stay aligned, and a reference without payload keeps its place with
  nulls.

Null HTML gives an empty sequence, a null payload counts as empty. Equal
payloads are one payload: whichever row is read gives the same values.
Repeated references and pages are resolved each for itself. Empty tables give empty results, very long pages are read whole.
HTML may be malformed: a caption ends with its figure, at the next figure, at an element within
it that isn't inline once it has text, and at the end of the page; what follows is text. What is
in a hidden element is neither text nor reference. Other columns than those to ``keep`` are dropped.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stash

UNIT = 64
SAMPLE_RATE = 8000
#: Elements that hold a reference in their src, and those whose text isn't content.
MEDIA, HIDDEN = {"img", "audio", "video", "source", "embed"}, {"script", "style", "template"}
#: Elements within a text; all others end the text before them.
INLINE = {"a", "abbr", "b", "br", "cite", "code", "em", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u"}
ITEM = "struct<pos: int, kind: string, text: string, ref: string, caption: string>"


class _Reader(HTMLParser):
    """Collects items; the caption of a figure belongs to all references in it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def end_text(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.items.append(["text", text, None, None])
        self.text = []

    def end_caption(self) -> None:
        if self.caption is not None:
            caption = " ".join("".join(self.caption).split())
            for i in self.figure or []:
                self.items[i][3] = caption or self.items[i][3]
            self.caption = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        if self.hidden:
            return
        if tag not in INLINE:
            if tag == "figure" or tag not in MEDIA and "".join(self.caption or ()).strip():
                self.end_caption()
            if self.caption is None:
                self.end_text()
        if tag == "figure":
            self.figure = []
        if tag == "figcaption":
            self.caption = []
        if tag in MEDIA:
            has = dict(attrs)
            if has.get("src"):
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append(["media", None, has["src"], has.get("alt") or has.get("title")])

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
            return
        if self.hidden:
            return
        if tag in ("figcaption", "figure"):
            self.end_caption()
        if tag not in INLINE and self.caption is None:
            self.end_text()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        (self.text if self.caption is None else self.caption).append(data)


def read_html(html: str | None) -> list[tuple]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.end_caption()
    reader.end_text()
    return [(i, *item) for i, item in enumerate(reader.items)]


def sequences(pages: DataFrame, id_col: str, html_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., items): texts and references of each page in order."""
    names = ("pos", "kind", "text", "ref", "caption")
    kinds = "".join(f"{c} {dict(pages.dtypes)[c]}, " for c in (id_col, *keep))
    return map_rows(pages.select(id_col, *keep, html_col), lambda: lambda *v: (*v[:-1], [dict(zip(names, x)) for x in read_html(v[-1])]), f"{kinds}items array<{ITEM}>")


def padded(data: Column) -> Column:
    """Bytes with zeros up to a positive multiple of UNIT."""
    size = F.greatest(F.lit(UNIT), F.ceil(F.length(data) / UNIT) * UNIT).cast("int")
    return F.rpad(data, size, F.lit(b"\x00"))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setparams((1, 1, SAMPLE_RATE, len(payload), "NONE", "not compressed"))
        file.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def pad(data: bytes) -> bytes:
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def describe(samples: bytes) -> str:
    """Features of 8-bit samples: mean, deviation, extremes, crossings of the middle, and a 16-part histogram."""
    x = np.frombuffer(samples, np.uint8)
    tally = np.bincount(x >> 4, minlength=16)
    whole = x.astype(np.int64)
    mean = whole.sum() / len(x)
    deviation = max(0.0, (whole * whole).sum() / len(x) - mean * mean) ** 0.5
    high = x >= 128
    return f"mean={mean:.6f};std={deviation:.6f};min={x.min()};max={x.max()};crossings={int((high[1:] != high[:-1]).sum())};histogram={','.join(map(str, tally))}"


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features_from(media: bytes) -> tuple:
    samples = from_wav(media)
    return (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), describe(samples))


def stored(rows: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(id, media): each payload as a WAV stream of 8-bit samples."""
    kind = dict(rows.dtypes)[id_col]
    return map_rows(rows.select(id_col, data_col), lambda: lambda key, data: (key, to_wav(pad(bytes(data or b"")))), f"{id_col} {kind}, media binary")


def features_of(media: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """(id, features...): what is read back from each stored medium; null media are left out."""
    kind = dict(media.dtypes)[id_col]
    return map_rows(media.select(id_col, media_col).where(F.col(media_col).isNotNull()), lambda: lambda key, data: (key, *features_from(bytes(data))), f"{id_col} {kind}, {FEATURES}")


def payloads(features: DataFrame) -> DataFrame:
    """One row for each distinct payload, as a table of its own."""
    rest = [c.split()[0] for c in FEATURES.split(", ") if not c.startswith("payload_sha256")]
    return stash(features.groupBy("payload_sha256").agg(*(F.first(c).alias(c) for c in rest)), "payloads")


def resolve(items: DataFrame, payloads: DataFrame, id_col: str, keep: tuple[str, ...] = (), kinds: tuple[str, ...] = ("text", "media")) -> DataFrame:
    """(id, keep..., pos, kind, text, caption, digest, payload columns...): each item of these kinds in its place, media with their payload.

    A reference is ``sha256:`` and the payload's digest. Items without a digest are dealt out by their place, and meet nothing.
    """
    flat = items.select(id_col, *keep, F.explode("items").alias("x")).where(F.col("x.kind").isin(*kinds))
    digest = F.nullif(F.regexp_extract("x.ref", "^sha256:([0-9a-f]{64})$", 1), F.lit(""))
    flat = flat.select(id_col, *keep, "x.pos", "x.kind", "x.text", "x.caption", digest.alias("digest"))
    flat = flat.withColumn("__key", F.coalesce("digest", F.concat(F.lit("-"), F.xxhash64(id_col, "pos").cast("string"))))
    return flat.join(payloads.withColumnRenamed("payload_sha256", "__key"), "__key", "left").drop("__key")
