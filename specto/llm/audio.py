"""Audio features of texts kept as 8-bit sound: polyphase resampling, log-mel filterbanks, hysteresis segmentation."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, narrow


@dataclass(frozen=True)
class Settings:
    rate: int = 8000
    up: int = 3
    down: int = 4
    taps: int = 16  # of each phase
    frame: int = 192
    hop: int = 96
    fft: int = 256
    mels: int = 24
    tensor_frames: int = 32
    block: int = 4096  # frames at once
    pad: int = 64

    @property
    def new_rate(self) -> int:
        return self.rate * self.up // self.down


def to_payload(text: str, pad: int = 64) -> tuple[bytes, int]:
    """UTF-8 bytes, with zeros up to a positive multiple of `pad`; and how many bytes there were."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(max(pad, -(-len(raw) // pad) * pad) - len(raw)), len(raw)


def store(payload: bytes, rate: int) -> bytes:
    """A mono wave file of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


class Extractor:
    """Features of one sound at a time; frames come in blocks, so beside the samples memory stays the same."""

    def __init__(self, s: Settings) -> None:
        self.s = s
        n = s.taps * s.up
        t = np.arange(n) - (n - 1) / 2
        cutoff = 0.9 / max(s.up, s.down)
        low = s.up * cutoff * np.sinc(cutoff * t) * np.hanning(n + 2)[1:-1]
        #: phase by tap, each turned round so that it slides forward over the samples
        self.phases = np.ascontiguousarray(low.reshape(s.taps, s.up).T[:, ::-1]).astype(np.float32)
        self.window = np.hanning(s.frame).astype(np.float32)
        self.filters = self.mel_filters()

    def mel_filters(self) -> np.ndarray:
        """Triangles evenly spaced on the mel scale, bin by band."""
        s, mel = self.s, lambda f: 2595 * np.log10(1 + f / 700)
        edges = 700 * (10 ** (np.linspace(mel(40.0), mel(s.new_rate / 2), s.mels + 2) / 2595) - 1)
        bins = np.arange(s.fft // 2 + 1)[:, None] * s.new_rate / s.fft
        rise, fall = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
        return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)

    def resampled(self, samples: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Samples start to stop at the new rate: each output is the dot product of one phase of the filter with the input around it."""
        s = self.s
        first = start // s.up * s.up
        count = -(-(stop - first) // s.up)
        base = first // s.up * s.down
        need = count * s.down + s.taps + s.down
        left = base - s.taps + 1
        x = np.zeros(need + s.taps, np.float32)
        a, b = max(0, left), min(len(samples), left + len(x))
        if b > a:
            x[a - left : b - left] = (samples[a:b].astype(np.float32) - 128) / 128
        y = np.empty((count, s.up), np.float32)
        for r in range(s.up):
            shift, phase = divmod(r * s.down, s.up)
            y[:, r] = np.lib.stride_tricks.as_strided(x[shift:], (count, s.taps), (4 * s.down, 4)) @ self.phases[phase]
        return y.ravel()[start - first : stop - first]

    def blocks(self, samples: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Log-mel energies (frame by band) and the level of each frame in dB, block by block."""
        s = self.s
        length = len(samples) * s.up // s.down
        frames = max(1, 1 + -(-(length - s.frame) // s.hop))
        for f in range(0, frames, s.block):
            n = min(s.block, frames - f)
            y = self.resampled(samples, f * s.hop, (f + n - 1) * s.hop + s.frame)
            cut = np.lib.stride_tricks.as_strided(y, (n, s.frame), (4 * s.hop, 4))
            spectrum = np.fft.rfft(cut * self.window, s.fft, axis=1)
            power = spectrum.real**2 + spectrum.imag**2
            yield np.log10(power @ self.filters + 1e-6) * 10, 10 * np.log10(np.einsum("ij,ij->i", cut, cut) / s.frame + 1e-6)

    def segments(self, level: np.ndarray) -> list[tuple[int, int]]:
        """Spans of frames that begin above mean + half a deviation and last until the level falls below the mean."""
        mean, wide = float(level.mean(dtype=np.float64)), float(level.std(dtype=np.float64))
        mark = np.where(level > mean + wide / 2, 1, np.where(level < mean, -1, 0))
        last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
        on = np.concatenate(([0], ((last >= 0) & (mark[last] == 1)).astype(np.int8), [0]))
        edge = np.flatnonzero(np.diff(on))
        return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))

    def features(self, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Tensors of a fixed shape (the last is filled up with its lowest value), levels and segments of a sound."""
        parts = list(self.blocks(samples))
        mel, level = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        t = self.s.tensor_frames
        full = -(-len(mel) // t) * t
        mel = np.concatenate((mel, np.full((full - len(mel), mel.shape[1]), mel.min(), np.float32)))
        return mel.reshape(-1, t, mel.shape[1]), level, self.segments(level)


def stored(tensors: np.ndarray, settings: Settings) -> bytes:
    """Tensors with their time spans as an Arrow stream: a fixed-shape tensor column, start_s and end_s."""
    step = settings.hop / settings.new_rate * settings.tensor_frames
    start = np.arange(len(tensors)) * step
    batch = pa.RecordBatch.from_arrays([pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors, np.float32)), pa.array(start), pa.array(start + step)], ["logmel", "start_s", "end_s"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def described(stream: bytes, frames: int, spans: list[tuple[int, int]]) -> str:
    """A short string of the features as read back from their stored form.

    Frames, tensors with the end of the last one, segments and frames in them, a digest of all tensors and their spans in
    whole dB and milliseconds, and the mean of each band in whole dB.
    """
    with pa.ipc.open_stream(stream) as reader:
        rows = reader.read_all().combine_chunks()
    tensors, start, end = rows["logmel"].chunk(0).to_numpy_ndarray(), rows["start_s"].to_numpy(), rows["end_s"].to_numpy()
    whole = zlib.crc32(np.rint(tensors).astype("<i2").tobytes())
    whole = zlib.crc32(np.rint(np.stack((start, end)) * 1000).astype("<i8").tobytes(), whole)
    whole = zlib.crc32(np.array(spans, "<i8").tobytes(), whole)
    bands = np.rint(tensors.mean((0, 1), dtype=np.float64)).astype(int).tolist()
    return f"frames={frames};tensors={len(tensors)};end_s={end[-1]:.3f};segments={len(spans)};active={sum(b - a for a, b in spans)};digest={whole:08x};mel=" + ",".join(map(str, bands))


TENSORS = "doc_id long, part int, start_s double, end_s double, logmel array<float>"
SUMMARY = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, segments array<struct<start_s: double, end_s: double>>"


def audio_tensors(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log-mel tensors with their time spans, one row each. Every `logmel` has tensor_frames x mels values in row order.

    They are built as Arrow fixed-shape tensors; a column can't carry that type, so it carries their storage, which
    as_tensors() turns back. A null text counts as empty and gives one tensor of silence; an empty table gives none.
    """

    def make():
        own = Extractor(settings)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, part, start, parts = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload, _ = to_payload(text, settings.pad)
                tensors = own.features(np.frombuffer(load(store(payload, settings.rate)), np.uint8))[0]
                ids += [i] * len(tensors)
                part += range(len(tensors))
                parts.append(tensors)
            stored = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(np.concatenate(parts), np.float32)).storage
            step = settings.hop / settings.new_rate * settings.tensor_frames
            start = [p * step for p in part]
            return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "part": pa.array(part, pa.int32()), "start_s": pa.array(start, pa.float64()), "end_s": pa.array([x + step for x in start], pa.float64()), "logmel": stored.cast(pa.list_(pa.float32()))})

        return work

    return map_batches(narrow(docs, id_col, text_col), make, TENSORS)


def as_tensors(logmel: pa.Array, settings: Settings = Settings()) -> pa.FixedShapeTensorArray:
    """The Arrow tensors of a `logmel` column read with pyarrow."""
    kind = pa.fixed_shape_tensor(pa.float32(), (settings.tensor_frames, settings.mels))
    return pa.ExtensionArray.from_storage(kind, logmel.cast(kind.storage_type))


def audio_summary(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document with digests of what was stored and read back, its features as a string, and its active spans.

    The features are built as fixed-shape Arrow tensors with time spans (as audio_tensors() gives them), stored as an
    Arrow stream and read back; the string is made of what was read. No shuffle; equal texts give equal values. A null
    text counts as empty: its payload is `pad` zero bytes. A text of any length is one sound, framed in blocks. Repeated
    rows and null ids pass through, other columns are passed over; an empty table gives no rows.
    """

    def make():
        own = Extractor(settings)
        step = settings.hop / settings.new_rate

        def one(text: str) -> tuple:
            payload, n = to_payload(text, settings.pad)
            media = store(payload, settings.rate)
            back = load(media)
            tensors, level, spans = own.features(np.frombuffer(back, np.uint8))
            return (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-settings.pad :]), len(media), hashlib.sha256(media).hexdigest(), described(stored(tensors, settings), len(level), spans), [{"start_s": a * step, "end_s": b * step} for a, b in spans])

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "segments"]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [one(text) for text in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64())} | {n: pa.array([r[i] for r in found], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

        return work

    return map_batches(narrow(docs, id_col, text_col), make, SUMMARY)


def op3_audio_features(docs: DataFrame) -> DataFrame:
    return audio_summary(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.size("segments").alias("n_segments"))
