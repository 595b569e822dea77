"""Media columns: TIFF files walked directory by directory, one row a page.

The reader follows the chain of image directories of a file in either byte order,
decodes strips or tiles that are stored plainly, as PackBits, LZW or deflate, unpacks
samples of 1, 2, 4, 8, 16 and 32 bits, chunky or in planes, and undoes horizontal
differencing and the floating-point predictor. The writer stores pages of 8- and 16-bit
samples losslessly in the same schemes; it serves tests and stores payloads.

Results: a page that can't be read gives a row with its number and the reason in
``error``, and reading goes on with the next directory. A null file, one without
directories or one whose chain breaks gives a row with page -1 (rows are never lost); an
empty table gives an empty result. Repeated rows are read each time. Extra columns are
never read. A chain of directories that runs in a circle ends. A page of more than
``MOST_BYTES`` of samples is an error, found before any memory is taken for it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from citeweave.llm.common import map_arrow, texts

#: Tags, field types and compression schemes of TIFF 6.0 (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT = 322, 323, 324, 325, 339
FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Samples of one page, in bytes, that a reader takes at most.
MOST_BYTES = 1 << 28
#: What a damaged file can raise.
BROKEN = (ValueError, struct.error, zlib.error, MemoryError, IndexError, TypeError, OverflowError)
NAMES = {PLAIN: "plain", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        j = i + 1
        while j < len(data) and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < len(data) and j - i < 128 and not (j + 1 < len(data) and data[j] == data[j + 1]):
                j += 1
            out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; widths grow one code early."""
    out: list[bytes] = []
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    width, held, bits, last = 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table = {bytes((i,)): i for i in range(256)}
    put(256, 9)
    word, size, width = b"", 258, 9
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer], size = size, size + 1
        width = min(12, max(9, size.bit_length()))
        if size >= 4094:
            put(256, width)
            table = {bytes((k,)): k for k in range(256)}
            size, width = 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word], width)
        size += 1
        width = min(12, max(9, size.bit_length()))
    put(257, width)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def decompress(data: bytes, scheme: int, size: int) -> bytes:
    """One strip or tile; ``size`` bytes are needed and more are never kept."""
    if scheme == PLAIN:
        out = data
    elif scheme in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif scheme == PACKBITS:
        out = unpack_bits(data)
    elif scheme == LZW:
        out = lzw_decode(data)
    else:
        raise ValueError(f"compression {scheme} is not known")
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out[:size]


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, tag -> values) of each image directory; entries of unknown type or without values are left out."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        (count,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in FIELDS and 0 < n <= len(data):
                form = f"{order}{n}{FIELDS[kind]}"
                size = struct.calcsize(form)
                where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
                if where + size <= len(data):
                    tags[tag] = struct.unpack_from(form, data, where)
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)


def _undo(raw: bytes, kind: np.dtype, bits: int, shape: tuple[int, int, int], predictor: int) -> np.ndarray:
    """Samples (rows, width, samples) of an unpacked strip or tile."""
    h, w, samples = shape
    if predictor not in (1, 2, 3) or (predictor == 3 and kind.kind != "f") or (predictor == 2 and (bits < 8 or kind.kind == "f")):
        raise ValueError(f"predictor {predictor} is not known for these samples")
    if predictor == 3:  # rows of differenced bytes, the highest bytes of all samples first
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(h, -1), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(planes.reshape(h, kind.itemsize, w * samples).transpose(0, 2, 1)).view(">f" + str(kind.itemsize)).astype(kind.newbyteorder("=")).reshape(shape)
    if bits < 8:
        rows = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(h, -1), axis=1)[:, : w * samples * bits]
        return np.packbits(np.pad(rows.reshape(h, -1, bits), ((0, 0), (0, 0), (8 - bits, 0))), axis=2).reshape(shape)
    block = np.frombuffer(raw, kind).astype(kind.newbyteorder("=")).reshape(shape)
    return np.cumsum(block, axis=1, dtype=block.dtype) if predictor == 2 else block


def page(data: bytes, order: str, tags: dict[int, tuple]) -> tuple[np.ndarray, dict]:
    """Samples (height, width, samples) of one directory and how they were stored."""

    def one(tag: int, default: int) -> int:
        value = tags.get(tag, (default,))[0]
        if not isinstance(value, int):
            raise ValueError(f"tag {tag} is no whole number")
        return value

    width, height, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    scheme, predictor, form, planar = one(COMPRESSION, PLAIN), one(PREDICTOR, 1), one(FORMAT, 1), one(PLANAR, 1) == 2
    if bits not in (1, 2, 4, 8, 16, 32) or any(b != bits for b in tags.get(BITS, ())) or (form == 3 and bits != 32):
        raise ValueError("only samples of 1, 2, 4, 8, 16 or 32 bits of one size are read")
    if width < 1 or height < 1 or samples < 1 or width * height * samples * max(bits // 8, 1) > MOST_BYTES:
        raise ValueError("the page has no size or is too large")
    kind = np.dtype(np.uint8) if bits <= 8 else np.dtype(order + ("f" if form == 3 else "u") + str(bits // 8))
    chunk = 1 if planar else samples  # samples that stand together
    tiled = TILES in tags
    if tiled:
        w, h = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)
        if w < 1 or h < 1 or w * h * chunk * max(bits // 8, 1) > MOST_BYTES:
            raise ValueError("tiles have no size or are too large")
        boxes = [(top, left, h, w) for top in range(0, height, h) for left in range(0, width, w)]
        places, sizes = tags[TILES], tags.get(TILE_SIZES, ())
    else:
        h = max(1, min(one(STRIP_ROWS, height), height))
        boxes = [(top, 0, min(h, height - top), width) for top in range(0, height, h)]
        places, sizes = tags.get(STRIPS, ()), tags.get(STRIP_SIZES, ())
    if min(len(places), len(sizes)) < len(boxes) * (samples if planar else 1):
        raise ValueError("strips or tiles are missing")
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for number, (place, size) in enumerate(zip(places, sizes, strict=False)):
        plane, k = divmod(number, len(boxes))
        if plane >= (samples if planar else 1):
            break
        top, left, h, w = boxes[k]
        raw = decompress(data[place : place + size], scheme, h * (-(-w * chunk * bits // 8)))
        block = _undo(raw, kind, bits, (h, w, chunk), predictor)[: height - top, : width - left]
        out[top : top + h, left : left + w, plane : plane + chunk] = block
    return out, {"width": width, "height": height, "samples": samples, "bits": bits, "compression": NAMES.get(scheme, str(scheme)), "predictor": predictor, "tiled": tiled}


def read(data: bytes) -> list[tuple[np.ndarray, dict]]:
    """All pages of a file."""
    return [page(data, order, tags) for order, tags in directories(data)]


def write(pages: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 1, order: str = "<", rows: int = 64, tile: tuple[int, int] | None = None) -> bytes:
    """A file of 8- or 16-bit pages (height, width) or (height, width, samples)."""
    pack = {PLAIN: bytes, LZW: lzw_encode, PACKBITS: pack_bits, DEFLATE: lambda b: zlib.compress(b, 1)}[scheme]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in pages:
        cube = image if image.ndim == 3 else image[:, :, None]
        height, width, samples = cube.shape
        h, w = tile or (min(rows, height), width)
        stored, sizes = [], []
        for top in range(0, height, h):
            for left in range(0, width, w):
                block = cube[top : top + h, left : left + w]
                if tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                data = pack(np.ascontiguousarray(block.astype(block.dtype.newbyteorder(order))).tobytes())
                stored.append(len(out))
                sizes.append(len(data))
                out += data
        out += b"\0" * (len(out) % 2)
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [cube.dtype.itemsize * 8] * samples), (COMPRESSION, 3, [scheme]), (PHOTOMETRIC, 3, [1])]
        fields += [(SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor])]
        if tile:
            fields += [(TILE_WIDTH, 4, [w]), (TILE_HEIGHT, 4, [h]), (TILES, 4, stored), (TILE_SIZES, 4, sizes)]
        else:
            fields += [(STRIPS, 4, stored), (STRIP_ROWS, 4, [h]), (STRIP_SIZES, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(fields):
            value = struct.pack(f"{order}{len(values)}{FIELDS[kind]}", *values)
            if len(value) > 4:
                place = struct.pack(order + "I", len(out))
                out += value + b"\0" * (len(value) % 2)
            else:
                place = value.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + place
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_pages(df: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """(id, page, width, height, samples, bits, compression, predictor, tiled, pixels, error): a row a page."""
    id_type = df.schema[id_col].dataType.simpleString()
    names = ("width", "height", "samples", "bits", "compression", "predictor", "tiled")

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("id", "page", *names, "pixels", "error")}

        def add(key, number, facts, pixels, error):
            for name, value in (("id", key), ("page", number), *((n, facts.get(n)) for n in names), ("pixels", pixels), ("error", error)):
                out[name].append(value)

        for key, content in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist(), strict=True):
            number = -1
            try:
                for number, (order, tags) in enumerate(directories(content or b"")):
                    try:
                        pixels, facts = page(content, order, tags)
                    except BROKEN as e:
                        add(key, number, {}, None, str(e) or type(e).__name__)
                    else:
                        add(key, number, facts, pixels.tobytes(), None)
                if number < 0:
                    add(key, -1, {}, None, "no image directory")
            except BROKEN as e:
                add(key, -1, {}, None, str(e) or type(e).__name__)
        return out

    schema = f"id {id_type}, page int, width int, height int, samples int, bits int, compression string, predictor int, tiled boolean, pixels binary, error string"
    return map_arrow(df.select(df[id_col].alias("id"), df[content_col].alias("content")), run, schema)


LINE = 192
#: Rows of a page of a stored payload; longer payloads have several pages.
PAGE_ROWS = 4096


def payload(text: str) -> bytes:
    """UTF-8 padded by blanks to a positive multiple of ``LINE``."""
    data = text.encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // LINE)) * LINE, b" ")


#: (compression, predictor, byte order, tile) of stored payloads, by their CRC-32: all ways are in use.
FORMS = ((DEFLATE, 1, "<", None), (LZW, 2, "<", None), (PACKBITS, 1, ">", None), (DEFLATE, 2, ">", (64, 64)))


def store(data: bytes) -> bytes:
    """A payload as a grey image of ``LINE`` samples a row, in one of ``FORMS``."""
    image = np.frombuffer(data, np.uint8).reshape(-1, LINE)
    scheme, predictor, order, tile = FORMS[zlib.crc32(data) % len(FORMS)]
    return write([image[top : top + PAGE_ROWS] for top in range(0, len(image), PAGE_ROWS)], scheme, predictor, order, tile=tile)


def feature(pages: list[tuple[np.ndarray, dict]]) -> str:
    """Pages, size, mean and contrast, and the share of 16 grey bands of what was read back."""
    every = np.concatenate([p.ravel() for p, _ in pages])
    bands = np.bincount(every >> 4, minlength=16)
    total = int(every.sum(dtype=np.int64))
    square = int(np.dot(np.bincount(every, minlength=256), np.arange(256, dtype=np.int64) ** 2))
    n = len(every)
    return f"pages={len(pages)};rows={n // LINE};{pages[0][1]['compression']};predictor={pages[0][1]['predictor']};tiled={pages[0][1]['tiled']};mean={total / n:.4f};var={square / n - (total / n) ** 2:.4f};bands=" + ",".join(map(str, bands))


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Each text stored as TIFF, read back and described; ``with_media`` adds the file.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature[, media])
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media")}
        for text in texts(batch):
            media = store(payload(text))
            pages = read(media)
            back = b"".join(p.tobytes() for p, _ in pages)
            row = (len(text.encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(pages), media)
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        return out | {"doc_id": batch.column("doc_id")}

    schema = f"doc_id {id_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", media binary" * with_media
    return map_arrow(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")), run, schema)
