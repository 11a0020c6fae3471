"""Media columns: TIFF files in a binary column, one row per page out; and texts carried losslessly as TIFF.

`tiff_pages` gives a row per page. A null file gives no row; a file that is not valid or uses what is not supported gives one row
with page -1 and `error`. Repeated rows give repeated pages. Files are read one at a time and pages one at a
time, so memory is bounded by a file and a page; rows leave in batches of a bounded number of bytes.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from viewloom.llm.tiff import TiffError, read_tiff, write_tiff

WIDE, SAMPLES = 64, 3
UNIT = WIDE * SAMPLES
PAGE_ROWS = 1024
BATCH_BYTES = 1 << 22

PAGES = pa.schema(
    [("doc_id", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("codec", pa.string()), ("predictor", pa.int32())]
    + [("layout", pa.string()), ("description", pa.string()), ("pixels", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("error", pa.string())]
)
PAGES_DDL = (
    "doc_id long, page int, width int, height int, samples int, codec string, predictor int, layout string, "
    "description string, pixels binary, media_bytes long, media_sha256 string, error string"
)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= BATCH_BYTES or len(held) >= 4000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def text_to_tiff(text: str | None) -> bytes:
    """UTF-8 padded with spaces to whole rows of 64 RGB pixels; long texts take several pages."""
    raw = (text or "").encode()
    payload = raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDE, SAMPLES)
    turn = zlib.crc32(payload)
    codec = ("lzw", "packbits", "deflate")[turn // 2 % 3]
    pages = [pixels[i : i + PAGE_ROWS] for i in range(0, len(pixels), PAGE_ROWS)]
    return write_tiff(pages, codec, tile=64 * (turn % 2), description=f"bytes={len(raw)}")


def texts_as_tiff(docs: DataFrame) -> DataFrame:
    """doc_id and media, the text as a TIFF file. A null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((d.as_py(), text_to_tiff(t.as_py())) for b in batches for d, t in zip(b.column(0), b.column(1), strict=True))
        return _batches(rows, schema, lambda r: len(r[1]))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def tiff_pages(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page: doc_id, page, width, height, samples, codec, predictor, layout, description, pixels (rows of samples), the file's size and digest, error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc, media in zip(batch.column(0), batch.column(1), strict=True):
                if not media.is_valid:
                    continue
                data = media.as_py()
                kept = (len(data), hashlib.sha256(data).hexdigest())
                try:
                    for p in read_tiff(data):
                        height, width, samples = p.pixels.shape
                        yield doc.as_py(), p.number, width, height, samples, p.codec, p.predictor, p.layout, p.description, p.pixels.tobytes(), *kept, None
                except (TiffError, ArithmeticError, ValueError, TypeError, MemoryError, struct.error, zlib.error) as e:
                    yield doc.as_py(), -1, None, None, None, None, None, None, None, None, *kept, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches), PAGES, lambda r: len(r[9] or b""))

    return files.select(id_col, media_col).mapInArrow(run, PAGES_DDL)


def page_features(pixels: np.ndarray) -> dict:
    """Sample means and a 64-bit average hash of a page."""
    grey = pixels.sum(axis=2, dtype=np.float64)
    rows, columns = (np.arange(8) * n // 8 for n in grey.shape)
    tall, wide = (np.maximum(1, np.diff(edges, append=n)) for edges, n in ((rows, grey.shape[0]), (columns, grey.shape[1])))
    cells = np.add.reduceat(np.add.reduceat(grey, rows, axis=0), columns, axis=1) / (tall[:, None] * wide)
    bits = (cells > cells.mean()).astype(int).ravel()
    return {"mean": [round(float(x), 3) for x in pixels.mean(axis=(0, 1))], "hash": f"{int(''.join(map(str, bits)), 2):016x}"}


class _Fold:
    """What all pages of a file say together; holds no page."""

    def __init__(self) -> None:
        self.pages, self.pixels, self.sums, self.digest, self.first, self.last = 0, 0, 0, hashlib.sha256(), None, None

    def add(self, pixels: np.ndarray) -> None:
        sums = pixels.sum(axis=(0, 1), dtype=np.int64)
        self.last = page_features(pixels)
        self.first = self.first or self.last
        self.pages, self.pixels, self.sums = self.pages + 1, self.pixels + pixels.shape[0] * pixels.shape[1], self.sums + sums
        self.digest.update(f"{sums.tolist()}{self.last['hash']}".encode())

    def whole(self) -> dict:
        """Sample means over the pixels of all pages, and a digest of every page's sample sums and hash."""
        return {"mean": [round(float(x) / self.pixels, 3) for x in self.sums], "digest": self.digest.hexdigest()[:32]}


def payload_digests(pages: DataFrame) -> DataFrame:
    """One row per file of texts_as_tiff, from its pages as tiff_pages gives them (a file's pages are neighbours and stay so)."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
        + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pages", pa.int64()), ("codec", pa.string())]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now = None

        def done():
            first, digest, size, tail, fold = now
            feature = json.dumps({"pages": fold.pages, "layout": first["layout"], "first": fold.first, "last": fold.last} | fold.whole(), separators=(",", ":"))
            n_bytes = int(first["description"].partition("=")[2])
            return first["doc_id"], n_bytes, size, digest.hexdigest(), zlib.crc32(tail), first["media_bytes"], first["media_sha256"], feature, fold.pages, first["codec"]

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for k in range(batch.num_rows):
                row = {name: c[k].as_py() for name, c in zip(batch.schema.names, columns, strict=True)}
                if row["error"]:
                    raise TiffError(f"document {row['doc_id']}: {row['error']}")
                if row["page"] == 0:
                    if now:
                        yield done()
                    now = [row, hashlib.sha256(), 0, b"", _Fold()]
                pixels = row["pixels"]
                now[1].update(pixels)
                now[2] += len(pixels)
                now[3] = pixels[-16:]
                now[4].add(np.frombuffer(pixels, np.uint8).reshape(row["height"], row["width"], row["samples"]))
                if row["page"] == 0:
                    row["pixels"] = None
        if now:
            yield done()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches), schema, lambda r: 500)

    return pages.select(*PAGES.names).mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages long, codec string",
    )
