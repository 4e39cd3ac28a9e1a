"""TIFF media columns: image directories are walked, strips and tiles decoded (none, PackBits, LZW, deflate),
predictors undone, and every page becomes a row."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm.common import small_batches

# Tags, type sizes and compression codes of the TIFF 6.0 specification.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "c", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


class TiffError(ValueError):
    """The bytes are not a TIFF file that this reader knows."""


# --- decoding


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; a width grows one code early."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, held, bits, last = [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 256:
            del table[258:]
            width, last = 9, b""
        elif code == 257:
            break
        else:
            if code < len(table):
                word = table[code]
            elif code == len(table) and last:
                word = last + last[:1]
            else:
                raise TiffError("an LZW code that is not yet known")
            out.append(word)
            if last:
                table.append(last + word[:1])
            last = word
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
    return b"".join(out)


def decode(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return unpack_lzw(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    raise TiffError(f"compression {compression}")


def undo_predictor(block: np.ndarray, predictor: int) -> np.ndarray:
    """block: (rows, columns, samples); horizontal differences (2) are summed along rows. Floating-point numbers (3) are
    rows of their first bytes, then their second ones, ..., as differences of bytes; they stay bits of numbers."""
    if predictor == 1:
        return block
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3 and block.itemsize > 1:
        rows, columns, samples = block.shape
        raw = np.ascontiguousarray(block).view(np.uint8).reshape(rows, -1, samples)
        planes = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, block.itemsize, columns * samples)
        whole = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">u{block.itemsize}")
        return whole.reshape(block.shape).astype(block.dtype)
    raise TiffError(f"predictor {predictor}")


def unpack_samples(raw: bytes, rows: int, width: int, depth: int) -> np.ndarray:
    """(rows, width) samples of 1, 2 or 4 bits; every row begins with a byte."""
    line = -(-width * depth // 8)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), axis=1)[:, : width * depth]
    return (bits.reshape(rows, width, depth) << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory in turn."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise TiffError("image directories do not end")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags: dict[int, tuple] = {0: (order,)}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            form = TYPES.get(kind)
            if form is None:
                continue
            form = order + (form * count if count <= 16 or len(form) > 1 else f"{count}{form}")
            size, place = struct.calcsize(form), at + 10 + 12 * k
            if size > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            tags[tag] = struct.unpack_from(form, data, place)
        yield tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def samples_of(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """(height, width, samples) of one directory."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    order, width, height, depth = tags[0][0], one(WIDTH, 0), one(HEIGHT, 0), one(BITS, 1)
    if depth not in (1, 2, 4, 8, 16, 32, 64) or len(set(tags.get(BITS, (1,)))) > 1:
        raise TiffError(f"{tags[BITS]} bits a sample")
    kind, n = np.dtype(f"{order}u{max(depth // 8, 1)}"), one(SAMPLES, 1)
    planes = n if one(PLANAR, 1) == 2 else 1
    inner, out = n // planes, np.zeros((height, width, n), kind.newbyteorder("="))
    tiled = TILE_OFFSETS in tags
    wide, high = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    across, down = -(-width // wide), -(-height // high)
    for k, (at, size) in enumerate(zip(offsets, sizes)):
        plane, y, x = k // (across * down), k // across % down * high, k % across * wide
        rows = high if tiled else min(high, height - y)
        raw = decode(data[at : at + size], one(COMPRESSION, NONE))
        predictor = one(PREDICTOR, 1)
        if depth < 8:
            if predictor != 1:
                raise TiffError(f"predictor {predictor} of {depth} bits")
            block = unpack_samples(raw, rows, wide * inner, depth).reshape(rows, wide, inner)
        else:
            block = np.frombuffer(raw, kind, rows * wide * inner).reshape(rows, wide, inner)
            block = undo_predictor(block if predictor == 3 else block.astype(out.dtype), predictor).astype(out.dtype)
        seen = out[y : y + high, x : x + wide]
        seen[:, :, plane * inner : (plane + 1) * inner] = block[: seen.shape[0], : seen.shape[1]]
    return out


#: What broken bytes raise.
BROKEN = (TiffError, struct.error, zlib.error, ValueError, KeyError, IndexError, ZeroDivisionError, OverflowError)


def page_results(data: bytes) -> Iterator[tuple[int | None, int, np.ndarray | str]]:
    """Number, bits and samples of each page, or why it cannot be read; without a number, why there are no more pages."""
    number = 0
    try:
        for tags in directories(data):
            try:
                found: np.ndarray | str = samples_of(data, tags)
            except BROKEN as e:
                found = str(e) or type(e).__name__
            yield number, tags.get(BITS, (1,))[0], found
            number += 1
    except BROKEN as e:
        yield None, 0, str(e) or type(e).__name__


def pages(data: bytes) -> Iterator[np.ndarray]:
    """The samples of each page: (height, width, samples); those of fewer than 8 bits as bytes."""
    for tags in directories(data):
        yield samples_of(data, tags)


# --- encoding


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and data[i + run : i + run + 1] == data[i : i + 1]:
            run += 1
        if run > 1:
            out += bytes([257 - run]) + data[i : i + 1]
            i += run
            continue
        end = i + 1
        while end < len(data) and end - i < 128 and data[end : end + 1] != data[end + 1 : end + 2]:
            end += 1
        out += bytes([end - i - 1]) + data[i:end]
        i = end
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    table = {bytes([i]): i for i in range(256)}
    held, bits, width, out, word = 256, 9, 9, bytearray(), b""
    codes = 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = codes
        codes += 1
        if codes + 1 > 1 << width and width < 12:
            width += 1
        if codes == 4094:
            put(256)
            table, codes, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word])
        codes += 1
        if codes + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def encode(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, strip_rows: int = 256, level: int = 6, order: str = "<", bits: int = 8) -> bytes:
    """A TIFF file of (height, width) images, each a page, in strips or tiles of (height, width). Images are unsigned, or
    floating-point for predictor 3; those of bytes may be stored in fewer bits."""
    if compression not in (NONE, PACKBITS, LZW, DEFLATE):
        raise TiffError(f"compression {compression}")
    pack = {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda x: zlib.compress(x, level)}[compression]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4  # where the next directory's place goes
    for image in images:
        height, width = image.shape
        high, wide = tile or (min(strip_rows, max(1, height)), width)
        places, sizes = [], []
        for y in range(0, height, high):
            for x in range(0, width, wide):
                block = image[y : y + high, x : x + wide]
                if tile:
                    block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1])))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                raw = np.ascontiguousarray(block.astype(image.dtype.newbyteorder(order)))
                if predictor == 3:
                    planes = np.ascontiguousarray(block.astype(image.dtype.newbyteorder(">"))).view(np.uint8).reshape(*block.shape, -1).transpose(0, 2, 1).reshape(len(block), -1)
                    raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1)
                elif image.itemsize == 1 and bits < 8:
                    raw = np.packbits((block[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8) & 1).reshape(len(block), -1), axis=1)
                packed = pack(raw.tobytes())
                places.append(len(out))
                sizes.append(len(packed))
                out += packed + b"\0" * (len(packed) % 2)
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [bits if image.itemsize == 1 else 8 * image.itemsize], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [wide], TILE_HEIGHT: [high], TILE_OFFSETS: places, TILE_BYTES: sizes} if tile else {STRIP_OFFSETS: places, ROWS_PER_STRIP: [high], STRIP_BYTES: sizes}
        entries = b""
        for tag, values in sorted(tags.items()):
            body = struct.pack(f"{order}{len(values)}I", *values)
            if len(body) > 4:
                place = len(out)
                out += body
                body = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, 4, len(values)) + body
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# --- on tables


PAGE = "page int, width int, height int, samples int, bits int, payload binary, error string"


def page_table(media: DataFrame, column: str = "media") -> DataFrame:
    """One row per page of the binary column: the other columns of media (but for those named like a new one), then
    page (from 0), width, height, samples, bits, payload, error.

    payload holds the samples row by row, little-endian; those of 1, 2 and 4 bits as a byte each, floating-point ones
    by their bits. A page that cannot be read has only its number and error (the reason), and the walk goes on; where
    the directories end in error, as in a null or broken file, a row has only that. Repeated rows give repeated pages,
    an empty table an empty one. Samples of different sizes in one page and files beyond 4 GB are such errors.
    """
    small_batches(media.sparkSession, 200)
    new = [c.split()[0] for c in PAGE.split(", ")]
    others = media.drop(column, *new)
    schema = T.StructType([*others.schema.fields, *T.StructType.fromDDL(PAGE).fields])
    names = others.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, data in enumerate(batch.column(column)):
                for k, bits, x in page_results(data.as_buffer().to_pybytes() if data.is_valid else b""):
                    if isinstance(x, str):
                        rows.append((i, k, None, None, None, None, None, x))
                    else:
                        rows.append((i, k, x.shape[1], x.shape[0], x.shape[2], bits, x.astype(x.dtype.newbyteorder("<")).tobytes(), None))
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int32()] * 5 + [pa.binary(), pa.string()]
            taken = [batch.column(c).take(pa.array(columns[0], pa.int64())) for c in names]
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, t) for c, t in zip(columns[1:], kinds))], names=[*names, *new])

    return media.select(*names, column).mapInArrow(run, schema)


ROW = 64


def text_payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (ROW - len(raw) % ROW if len(raw) % ROW or not raw else 0)


def text_media(docs: DataFrame, level: int = 1) -> DataFrame:
    """doc_id, n_bytes and media of docs(doc_id, text): a grey image, 64 wide, of the text's UTF-8 bytes and zeros."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, files = [], []
            for text in batch.column("text").to_pylist():
                n, payload = text_payload(text)
                sizes.append(n)
                files.append(encode([np.frombuffer(payload, np.uint8).reshape(-1, ROW)], DEFLATE, 1, level=level))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(payload: bytes) -> str:
    """Rows, mean, spread and the shares of an eight-bin histogram of 8-bit samples."""
    x = np.frombuffer(payload, np.uint8)
    shares = np.bincount(x >> 5, minlength=8) / max(1, len(x))
    return f"rows={len(x) // ROW};mean={x.mean():.4f};std={x.std():.4f};hist=" + ",".join(f"{s:.4f}" for s in shares)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: each text stored as a one-page image, read back by page_table() and measured."""
    stored = text_media(docs).select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-ROW:]), features(x)) for x in batch.column("payload").to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string()]
            kept = [batch.column(c) for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    return page_table(stored).drop("error").mapInArrow(run, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
