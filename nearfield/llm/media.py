"""Media columns: documents as ordered text and media structs, with payloads resolved by digest.

parse() turns HTML into an array of (position, kind, text, reference, caption). items() explodes it, resolve()
joins what is known of each payload by digest, and assemble() puts the items of a row back in order, so that
positions and captions stay with their payloads. store() and read_back() keep payloads as binary PPM images, and illustrated()
makes pages of whole texts that refer to them; payload_rows() goes all the way.

Null and empty HTML has no items; null and empty texts have an empty payload, padded like others, and a page with its figure
only. Equal texts have one digest, and repeated rows are rows of their own. Items with one position in a row keep the order of
their other fields. Very long texts are one item and one payload. Empty tables give empty results. Columns with the names that
a function adds give way; others stay.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import map_slices, spill

ITEM = "struct<position:int,kind:string,text:string,reference:string,caption:string>"
#: RGB pixels in a row of a stored image, and bytes.
WIDTH, ROW = 64, 192
_SKIP = {"script", "style", "template", "noscript", "head"}
_BLOCK = set("address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "embed", "object": "object"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.words: list[str] = []
        self.skip = 0
        self.open: list[int] = []  # media items of the open figure
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.words)).strip()
        self.words = []
        if text:
            self.out.append({"kind": "text", "text": text, "reference": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIP:
            self.skip += 1
            return
        if tag == "figure":
            self.open = []
        if tag in _BLOCK or tag == "figcaption":
            self.flush()
        if tag == "figcaption":
            self.caption = []
        if tag in _MEDIA and not self.skip:
            at = dict(attrs)  # of a repeated attribute the last
            if ref := at.get("src") or at.get("data"):
                self.flush()
                self.open.append(len(self.out))
                self.out.append({"kind": _MEDIA[tag], "text": None, "reference": ref, "caption": at.get("alt") or None})

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if tag == "figcaption" and self.caption is not None:
            said = re.sub(r"\s+", " ", "".join(self.caption)).strip()
            for i in self.open:
                self.out[i]["caption"] = said or self.out[i]["caption"]
            self.caption = None
        if tag in _BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.words if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    """The text and media items of one page in reading order; null or empty: none."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    if reader.caption:  # never closed
        reader.words = reader.caption + reader.words
    reader.flush()
    return [{"position": i} | x for i, x in enumerate(reader.out)]


def parse(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds items, an array of ITEM, in place of the html column. Other columns stay."""
    kept = [c for c in pages.columns if c not in (html, "items")]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), f"items array<{ITEM}>"])

    def make():
        return lambda rows: {c: rows[c] for c in kept} | {"items": [sequence(x) for x in rows[html]]}

    return map_slices(pages.select(*kept, html), make, schema)


def items(parsed: DataFrame) -> DataFrame:
    """A row for each item, with the item's fields and digest (of references media:<digest>) as columns item_*, which replace such names."""
    out = parsed.select(*[c for c in parsed.columns if c != "items" and not c.startswith("item_")], F.explode("items").alias("_nf_item"))
    fields = [F.col(f"_nf_item.{f}").alias(f"item_{f}") for f in ("position", "kind", "text", "reference", "caption")]
    digest = F.regexp_extract("_nf_item.reference", r"^media:([0-9a-f]+)$", 1)
    return out.select("*", *fields, F.nullif(digest, F.lit("")).alias("item_digest")).drop("_nf_item")


def resolve(found: DataFrame, media: DataFrame) -> DataFrame:
    """Left-join items with media (one row for each digest); what has no payload keeps nulls. Media's columns replace equal names."""
    found = found.drop(*[c for c in media.columns if c != "item_digest"])
    return found.join(media, found.item_digest == media.digest, "left").drop("digest")


def assemble(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key again, its items in order of position, each with the joined columns."""
    fields = ["item_position", *[c for c in resolved.columns if c not in (*keys, "item_position")]]
    return resolved.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))


def encode(data: bytes) -> tuple[bytes, bytes]:
    """The padded payload, and it as a PPM image of 8-bit RGB samples; the header notes the unpadded length."""
    payload = data + b" " * (-len(data) % ROW if data else ROW)
    return payload, b"P6\n# bytes %d\n%d %d\n255\n" % (len(data), WIDTH, len(payload) // ROW) + payload


_HEADER = re.compile(rb"P6\n# bytes (\d+)\n(\d+) (\d+)\n255\n")


def decode(blob: bytes) -> tuple[int, bytes]:
    """The unpadded length and the samples of a stored image."""
    head = _HEADER.match(blob)
    if not head or len(blob) - head.end() != 3 * int(head[2]) * int(head[3]):
        raise ValueError("not a stored payload")
    return int(head[1]), blob[head.end() :]


def feature(payload: bytes) -> str:
    """Size, means and deviations of the channels, and a 64-bit difference hash of the mean brightness in an 8 x 9 grid."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    flat = pixels.reshape(-1, 3)
    n = len(flat)
    total, square = (np.add.reduce(flat.astype(np.uint32) ** p, axis=0, dtype=np.uint64).astype(float) for p in (1, 2))
    mean = total / n
    deviation = np.sqrt(np.maximum(square / n - mean * mean, 0))
    light = pixels.sum(axis=2, dtype=np.uint32)
    edges = np.linspace(0, len(light), 9).astype(int)
    rows = np.stack([light[a : max(b, a + 1)].mean(axis=0) if a < len(light) else np.zeros(WIDTH) for a, b in zip(edges, edges[1:], strict=False)])
    sides = np.linspace(0, WIDTH, 10).astype(int)
    grid = np.stack([rows[:, a:b].mean(axis=1) for a, b in zip(sides, sides[1:], strict=False)], axis=1)
    bits = int.from_bytes(np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes(), "big")
    return f"{WIDTH}x{len(pixels)} rgb8 mean={','.join(f'{x:.3f}' for x in mean)} sd={','.join(f'{x:.3f}' for x in deviation)} dhash={bits:016x}"


def _payload(text: str | None) -> tuple[int, str, bytes]:
    data = (text or "").encode()
    blob = encode(data)[1]
    return len(data), hashlib.sha256(blob).hexdigest(), blob


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """Writes every text (null: empty) as a payload to the shared folder: the columns of docs but the text, digest, blob."""
    kept = [c for c in docs.columns if c not in (text, "digest", "blob")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "digest string, blob binary"])

    def make():
        def each(rows: dict[str, list]) -> dict[str, list]:
            _, digest, blob = map(list, zip(*map(_payload, rows[text]), strict=True))
            return {c: rows[c] for c in kept} | {"digest": digest, "blob": blob}

        return each

    return spill(map_slices(docs.select(*kept, text), make, schema), "media")


def illustrated(docs: DataFrame, text: str = "text") -> DataFrame:
    """A page (HTML) for each text, in its place: its first line, a figure that refers to the payload, and all other lines."""
    kept = [c for c in docs.columns if c not in (text, "page")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "page string"])

    def page(x: str | None) -> str:
        n, digest, _ = _payload(x)
        head, _, rest = (x or "").partition("\n")
        return f'<article><p>{escape(head)}</p><figure><img src="media:{digest}"><figcaption>{n} bytes</figcaption></figure><p>{escape(rest)}</p></article>'

    return map_slices(docs.select(*kept, text), lambda: lambda rows: {c: rows[c] for c in kept} | {"page": list(map(page, rows[text]))}, schema)


def payload_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """For each row of docs (doc_id and the text): its page's sequence, resolved and put together again, as n_items, text_chars (of all
    its text, without white space), and what was read back of its medium, with its position and caption."""
    docs = docs.select("doc_id", F.col(text).alias("text"))
    media = read_back(store(docs))
    found = items(parse(illustrated(docs.withColumn("row", F.monotonically_increasing_id())), "page"))
    found = found.withColumn("item_chars", F.length(F.regexp_replace("item_text", r"\s", ""))).drop("item_text", "item_reference")  # texts aren't moved
    whole = assemble(resolve(found, media), ["row", "doc_id"])
    one = F.filter("items", lambda x: x["item_digest"].isNotNull())[0]
    chars = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x["item_chars"], F.lit(0)))
    return whole.select("doc_id", *[one[c].alias(c) for c in media.columns if c != "digest"], one["item_position"].alias("position"), one["item_caption"].alias("caption"), F.size("items").alias("n_items"), chars.alias("text_chars"))


def read_back(stored: DataFrame) -> DataFrame:
    """One row for each digest of a store() table: what its stored bytes hold."""
    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def make():
        def one(digest: str, blob: bytes) -> tuple:
            n, payload = decode(blob)
            return digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(payload)

        return lambda rows: dict(zip(names, map(list, zip(*map(one, rows["digest"], rows["blob"]), strict=True)), strict=True)) if rows["digest"] else {n: [] for n in names}

    each = map_slices(stored.select("digest", "blob"), make, schema)
    return spill(each.groupBy("digest").agg(*(F.min(n).alias(n) for n in names[1:])), "media-read")
