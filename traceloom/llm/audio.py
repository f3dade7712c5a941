"""Media columns: telephony audio."""

from __future__ import annotations

import hashlib
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import whole_text

#: Bytes of an ADPCM block (a header of 4, then two samples a byte), samples a second, and those of stored PCM.
ADPCM_BLOCK, RATE, TARGET = 36, 8000, 16000
#: Bytes decoded at a time; longer payloads are decoded in such runs, whole ADPCM blocks each, and joined without a seam.
RUN = ADPCM_BLOCK * 29_127
#: Format numbers of the RIFF container.
FORMATS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
# Fixed values of IMA ADPCM: index steps by code, and quantiser step sizes.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)
STEP_SIZES = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767])


def mulaw_table() -> np.ndarray:
    """16-bit sample of each mu-law byte (ITU-T G.711)."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit sample of each A-law byte (ITU-T G.711)."""
    code = np.arange(256) ^ 0x55
    segment, low = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(segment == 0, low + 8, low + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def decode_adpcm(data: np.ndarray) -> np.ndarray:
    """Samples of whole IMA ADPCM blocks, 65 a block: one step of all blocks at a time."""
    blocks = data.reshape(-1, ADPCM_BLOCK)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int8).astype(np.int32) << 8)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], 2).reshape(len(blocks), 2 * (ADPCM_BLOCK - 4))
    out = np.empty((len(blocks), codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(codes.shape[1]):
        code = codes[:, k]
        step = STEP_SIZES[index]
        change = step >> 3
        change = change + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_STEPS[code], 0, 88)
        out[:, k + 1] = value
    return out.ravel()


def decode(data: np.ndarray, codec: str) -> np.ndarray:
    if codec == "adpcm":
        return decode_adpcm(data[: len(data) // ADPCM_BLOCK * ADPCM_BLOCK])
    return (MULAW if codec == "mulaw" else ALAW)[data]


def resampled(samples: np.ndarray, after: int | None, rate: int, target: int, first: int = 0) -> np.ndarray:
    """The samples at another rate, on straight lines between neighbours.

    `first` is the number of the first sample in its stream, `after` the one that follows the last
    (None: the stream ends, and the last is held). So the runs of a stream give what the whole does.
    """
    low = -(-first * target // rate)
    high = -(-(first + len(samples)) * target // rate)
    at = np.arange(low, high, dtype=np.int64) * rate
    place, part = at // target - first, at % target
    wide = np.append(samples, samples[-1] if after is None else after).astype(np.int64)
    return ((wide[place] * (target - part) + wide[place + 1] * part) // target).astype(np.int16)


def pcm_runs(payload: bytes, codec: str, rate: int = RATE, target: int = TARGET):
    """The stream's 16-bit samples at the target rate, a run at a time."""
    unit = ADPCM_BLOCK if codec == "adpcm" else 1
    number = 0
    for at in range(0, len(payload), RUN):
        samples = decode(np.frombuffer(payload[at : at + RUN], np.uint8), codec)
        follows = decode(np.frombuffer(payload[at + RUN : at + RUN + unit], np.uint8), codec)
        if len(samples):
            yield resampled(samples, int(follows[0]) if len(follows) else None, rate, target, number)
        number += len(samples)


def wrap(payload: bytes, codec: str = "mulaw", rate: int = RATE) -> bytes:
    """A RIFF WAVE file of one channel that holds the payload as it is."""
    block = ADPCM_BLOCK if codec == "adpcm" else 1
    samples = len(payload) // ADPCM_BLOCK * 65 if codec == "adpcm" else len(payload)
    extra = struct.pack("<H", 65) if codec == "adpcm" else b""
    form = struct.pack("<HHIIHHH", FORMATS[codec], 1, rate, rate if codec != "adpcm" else rate * ADPCM_BLOCK // 65, block, 4 if codec == "adpcm" else 8, len(extra)) + extra
    chunks = b"".join(k + struct.pack("<I", len(v)) + v + bytes(len(v) % 2) for k, v in ((b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unwrap(media: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and payload of what wrap() made, found by walking the chunks."""
    at, codec, rate, payload = 12, "", 0, b""
    while at + 8 <= len(media):
        kind, (n,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if kind == b"fmt ":
            number, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = next(k for k, v in FORMATS.items() if v == number)
        elif kind == b"data":
            payload = media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    return codec, rate, payload


def measured(runs) -> str:
    """Whole numbers about a stream of samples: count, peak, zero crossings, mean square."""
    count, peak, crossings, energy, last = 0, 0, 0, 0, None
    for pcm in runs:
        wide, negative = pcm.astype(np.int64), pcm < 0
        count += len(pcm)
        peak = max(peak, int(np.abs(wide).max()))
        crossings += int((negative[1:] != negative[:-1]).sum()) + int(last is not None and last != negative[0])
        energy += int(wide @ wide)
        last = negative[-1]
    return f"n={count},peak={peak},zc={crossings},ms={energy // count if count else 0}"


def decode_media(media: DataFrame, media_col: str = "media", target: int = TARGET) -> DataFrame:
    """The columns of media, with pcm: 16-bit little-endian samples at the target rate; null where it is null."""

    @F.pandas_udf("binary")
    def pcm(column):
        def one(data):
            if data is None:
                return None
            codec, rate, payload = unwrap(data)
            return b"".join(run.astype("<i2").tobytes() for run in pcm_runs(payload, codec, rate, target))

        return column.map(one)

    return media.withColumn("pcm", pcm(media_col))


def documents_as_audio(docs: DataFrame, unit: int = 576, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False, target: int = TARGET) -> DataFrame:
    """Store every text's bytes as mu-law audio, read them back, resample them to PCM and measure them.

    The UTF-8 bytes, padded with 255 to a positive multiple of `unit`, are the samples of a WAVE file.
    The payload read back from it is expanded by the mu-law table and brought to the target rate: the
    PCM to store. As A-law and as ADPCM blocks it is expanded and measured likewise. Returns doc_id,
    n_bytes, payload_bytes, payload_sha256, tail_crc32 (last 32 bytes), media_bytes, media_sha256,
    feature, pcm_bytes, pcm_sha256, and the columns media and pcm themselves if asked for. Null and empty
    texts are one unit of padding. Equal texts give equal values; repeated rows each have a row; an
    empty table gives no rows. Payloads of any length are resampled run by run.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256", *["media", "pcm"] * keep_media]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.binary(), pa.binary()] * keep_media]

    def one(doc, data, stored, payload, decoded):
        digest, size, kept = hashlib.sha256(), 0, []

        def passed(runs):
            nonlocal size
            for run in runs:
                raw = run.astype("<i2").tobytes()
                digest.update(raw)
                size += len(raw)
                if keep_media:
                    kept.append(raw)
                yield run

        features = []
        for codec in FORMATS:
            runs = [resampled(decoded[codec], None, RATE, target)] if decoded else pcm_runs(payload, codec, RATE, target)
            features.append(f"{codec}:" + measured(passed(runs) if codec == "mulaw" else runs))
        row = [doc, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), " ".join(features), size, digest.hexdigest()]
        return row + [stored, b"".join(kept)] * keep_media

    def together(rows):
        """Rows of one batch: payloads that fit a run are decoded side by side, all their blocks at once."""
        read = []
        for doc, text in rows:
            data = text.as_py().encode("utf-8", "replace")
            stored = wrap(data + b"\xff" * (-len(data) % unit or (0 if data else unit)))
            read.append((doc, data, stored, unwrap(stored)[2]))
        if sum(len(r[3]) for r in read) > RUN or unit % ADPCM_BLOCK:
            return [one(*r, None) for r in read]
        joined = np.frombuffer(b"".join(r[3] for r in read), np.uint8)
        ends = np.cumsum([len(r[3]) for r in read])
        parts = {c: np.split(decode(joined, c), (ends // ADPCM_BLOCK * 65 if c == "adpcm" else ends)[:-1]) for c in FORMATS}
        return [one(*r, {c: parts[c][k] for c in FORMATS}) for k, r in enumerate(read)]

    def run(batches):
        for batch in batches:
            rows, some, size = zip(batch.column(0).to_pylist(), batch.column(1)), [], 0
            for row in chain(rows, [None]):
                long = row is not None and row[1].as_buffer().size
                if some and (row is None or len(some) == 256 or size + long > RUN // 2):
                    columns = zip(*together(some))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
                    some, size = [], 0
                if row is not None:
                    some.append(row)
                    size += long

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string" + ", media binary, pcm binary" * keep_media
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, schema)
