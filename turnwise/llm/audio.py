"""Audio columns: lossless 8-bit WAV media, and features of them as fixed-shape Arrow tensors with time spans.

Media are made and stored by JVM expressions.  Features are computed where the stored media are read:
polyphase resampling, overlapped log-mel filterbanks and segments of sound by hysteresis on the frame
energy.  Rows never meet, so there is no shuffle, and a task works on one medium at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.base import full, kept, query, table
from turnwise.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PADDING = 192
RATE = 12_000
UP, DOWN = 4, 3  # to 16 kHz
TAPS = 16  # of each phase of the resampling filter
WINDOW, HOP, FFT, MELS = 400, 160, 512, 40
PATCH = 64  # frames of a tensor
HEADER = 44  # bytes of a plain WAV header
FEATURES = (
    "n_bytes long, media binary, tensors binary, spans array<struct<start: double, end: double>>, n_frames long, feature string")


def _little(value: Column, size: int) -> Column:
    """A whole number as ``size`` little-endian bytes."""
    digits = F.lpad(F.hex(value), 2 * size, "0")
    return F.unhex(F.concat(*[digits.substr(2 * i + 1, 2) for i in reversed(range(size))]))


def padded_payload(text: Column, multiple: int = PADDING) -> Column:
    """UTF-8 bytes of a text, filled up with blanks to a positive multiple of ``multiple``."""
    size = F.octet_length(text)
    return F.concat(text.cast("binary"), F.repeat(
        F.lit(" "), F.when(size == 0, multiple).otherwise(F.pmod(-size, F.lit(multiple))).cast("int")).cast("binary"))


def wav(payload: Column, rate: int = RATE) -> Column:
    """A mono WAV file of unsigned 8-bit samples, one for each byte of the payload (an even number)."""
    size = F.octet_length(payload)
    text = lambda s: F.lit(s).cast("binary")
    return F.concat(
        text("RIFF"), _little(size + 36, 4), text("WAVEfmt "), _little(F.lit(16), 4), _little(F.lit(1), 2),
        _little(F.lit(1), 2), _little(F.lit(rate), 4), _little(F.lit(rate), 4), _little(F.lit(1), 2),
        _little(F.lit(8), 2), text("data"), _little(size, 4), payload)


def wav_samples(media: Column) -> Column:
    """The sample bytes of a medium made by ``wav``."""
    return media.substr(F.lit(HEADER + 1), F.octet_length(media))


def read_wav(media: bytes) -> tuple[int, np.ndarray]:
    """Rate and unsigned 8-bit samples of a mono WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at:at + 4], int.from_bytes(media[at + 4:at + 8], "little")
        if name == b"fmt ":
            if media[at + 8:at + 12] != b"\x01\0\x01\0" or media[at + 22:at + 24] != b"\x08\0":
                raise ValueError("not mono 8-bit samples")
            rate = int.from_bytes(media[at + 12:at + 16], "little")
        elif name == b"data":
            return rate, np.frombuffer(media, np.uint8, size, at + 8)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def filter_phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """A windowed-sinc low pass cut into its ``up`` phases: ``taps`` weights each, of sum 1."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * np.kaiser(n, 8.0)
    phases = h.reshape(taps, up).T[:, ::-1]
    return (phases / phases.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, phases: np.ndarray | None = None) -> np.ndarray:
    """``ceil(len(x) * up / down)`` samples; each phase of the output is a weighted sum of strided slices."""
    phases = filter_phases(up, down) if phases is None else phases
    taps = phases.shape[1]
    n = -(-len(x) * up // down)
    y = np.zeros(n, np.float32)
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps + down, np.float32)])
    for first in range(min(up, n)):
        count = -(-(n - first) // up)
        at, phase = divmod(first * down, up)
        part = np.zeros(count, np.float32)
        for k in range(taps):
            part += phases[phase, k] * padded[at + k + 1 - taps % 2:][:(count - 1) * down + 1:down]
        y[first::up] = part
    return y


def mel_weights(rate: int, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, as a (bins, mels) matrix."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1)[:, None] * rate / fft
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.clip(np.minimum((f - low) / (mid - low), (high - f) / (high - mid)), 0, None).astype(np.float32)


def log_mel(y: np.ndarray, weights: np.ndarray, window: int = WINDOW, hop: int = HOP, fft: int = FFT) -> np.ndarray:
    """(frames, mels) log energies of overlapping Hann windows; the last window is filled up with zeros."""
    frames = 1 + max(0, -(-(len(y) - window) // hop))
    y = np.concatenate([y, np.zeros(max(0, (frames - 1) * hop + window - len(y)), np.float32)])
    hann = np.hanning(window).astype(np.float32)
    out = np.empty((frames, weights.shape[1]), np.float32)
    for at in range(0, frames, 4096):  # so memory stays small for long media
        part = np.lib.stride_tricks.sliding_window_view(y[at * hop:], window)[::hop][:min(4096, frames - at)]
        spectrum = np.fft.rfft(part * hann, fft)
        out[at:at + len(part)] = np.log((spectrum.real ** 2 + spectrum.imag ** 2).astype(np.float32) @ weights + 1e-6)
    return out


def sound_spans(energy: np.ndarray, rise: float = 0.5, fall: float = -0.5) -> list[tuple[int, int]]:
    """Frame ranges of sound: one begins above mean + ``rise`` deviations and lasts while above mean + ``fall`` deviations."""
    z = energy - energy.mean()
    deviation = float(z.std())
    if deviation < 1e-6:
        return []
    above = np.concatenate([[False], z >= fall * deviation, [False]])
    edges = np.flatnonzero(above[1:] != above[:-1])
    loud = np.concatenate([[0], np.cumsum(z >= rise * deviation)])
    # A run above the lower threshold counts from its first frame above the upper one.
    spans = []
    for start, end in zip(edges[::2], edges[1::2]):
        if loud[end] > loud[start]:
            spans.append((int(np.searchsorted(loud, loud[start] + 1)) - 1, int(end)))
    return spans


def patches(mel: np.ndarray, seconds: float, frames: int = PATCH) -> bytes:
    """An Arrow stream with one row per patch: a (frames, mels) tensor, its time span and its number of frames."""
    n = -(-len(mel) // frames)
    tensor = np.zeros((n, frames, mel.shape[1]), np.float32)
    tensor.reshape(n * frames, -1)[:len(mel)] = mel
    first = np.arange(n) * frames
    used = np.minimum(frames, len(mel) - first)
    batch = pa.record_batch({
        "tensor": pa.FixedShapeTensorArray.from_numpy_ndarray(tensor), "start": first * seconds,
        "end": (first + used) * seconds, "frames": used})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def medium_features(media: bytes, up: int, down: int) -> dict:
    rate, samples = read_wav(media)
    rate = rate * up // down
    weights = kept(f"mel {rate}", lambda: mel_weights(rate))
    phases = kept(f"phases {up} {down}", lambda: filter_phases(up, down))
    mel = log_mel(resample((samples.astype(np.float32) - 128) / 128, up, down, phases), weights)
    hop = HOP / rate
    spans = sound_spans(mel.mean(axis=1))
    bands = " ".join(f"{x:.2f}" for x in mel.mean(axis=0).reshape(8, -1).mean(axis=1))
    return {
        "media": media, "tensors": patches(mel, hop), "spans": [{"start": a * hop, "end": b * hop} for a, b in spans],
        "n_frames": len(mel),
        "feature": f"{len(mel)} frames; {len(spans)} spans of {sum(b - a for a, b in spans)} frames; bands {bands}"}


def feature_task(up: int, down: int):
    """Task function: (id, n_bytes, media) to features, in frames of some megabytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some, size = [], 0
            for key, n_bytes, media in zip(batch["id"], batch["n_bytes"], batch["media"]):
                some.append({"id": key, "n_bytes": n_bytes} | medium_features(media, up, down))
                size += 3 * len(media)
                if size > 4 << 20:
                    yield pd.DataFrame(some)
                    some, size = [], 0
            if some:
                yield pd.DataFrame(some)
    return run


def store_media(docs: DataFrame, *, id: str = "doc_id", text: str = "text", rate: int = RATE) -> DataFrame:
    """``id``, ``n_bytes`` and ``media``: the UTF-8 bytes of each text, padded, as samples of a WAV file in the shared folder.

    A null text is stored as an empty one, that is 192 blanks; ``n_bytes`` is the length without padding.
    """
    return cut_lineage(docs.select(
        F.col(id).alias("id"), F.octet_length(full(text)).cast("long").alias("n_bytes"),
        wav(padded_payload(full(text)), rate).alias("media")))


def audio_features(media: DataFrame, *, up: int = UP, down: int = DOWN) -> DataFrame:
    """``id``, ``n_bytes`` and the features of each medium of ``store_media``, read from its stored bytes.

    ``media`` (as read), ``tensors`` (Arrow stream of 64 x 40 log-mel patches with ``start``, ``end`` in
    seconds and ``frames``), ``spans`` (segments of sound in seconds, none for constant energy),
    ``n_frames`` and ``feature`` (a line of text; equal media have equal lines).  Null ids stay null,
    repeated rows are worked one by one, an empty table gives none; other columns are ignored.
    """
    key = media.schema["id"].dataType.simpleString()
    return media.select("id", "n_bytes", "media").mapInPandas(feature_task(up, down), f"id {key}, {FEATURES}")


@query("op1_audio_features")
def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = wav_samples(F.col("media"))
    size = F.octet_length(payload)
    return audio_features(store_media(table(spark, sf_dir, "documents"))).select(
        F.col("id").alias("doc_id"), "n_bytes", size.cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"), F.crc32(payload.substr(size - 15, F.lit(16))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        "feature", "n_frames", F.size("spans").alias("n_spans"))
