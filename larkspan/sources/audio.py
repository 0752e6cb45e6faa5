"""Sound files as rows: RIFF/WAVE (integer and float samples) to mono doubles, with a status instead of an exception."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, status string, reason string, rate int, channels int, samples array<double>"


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate, and samples x channels in [-1, 1). PCM of 8, 16, 24 and 32 bits, float of 32 and 64."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE header")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if kind == 0xFFFE and len(body) >= 26:
                kind = struct.unpack_from("<H", body, 24)[0]
            form = kind, channels, rate, bits
        elif name == b"data":
            if form is None:
                raise ValueError("data before format")
            kind, channels, rate, bits = form
            body = body[: len(body) // (channels * bits // 8) * (channels * bits // 8)]
            if kind == 3:
                x = np.frombuffer(body, f"<f{bits // 8}").astype(float)
            elif kind != 1:
                raise ValueError(f"format {kind}")
            elif bits == 8:
                x = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
            elif bits == 24:
                raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
                x = ((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) << 8 >> 8) / 2.0**23
            else:
                x = np.frombuffer(body, f"<i{bits // 8}").astype(float) / 2.0 ** (bits - 1)
            return rate, x.reshape(-1, channels)
        at += 8 + size + (size & 1)
    raise ValueError("no data")


def encode_wav(samples: np.ndarray, rate: int, tags: dict[str, str] | None = None) -> bytes:
    """Mono 32-bit float file, with INFO tags (four-letter names)."""
    body = np.asarray(samples, "<f4").tobytes()
    chunks = b"fmt " + struct.pack("<IHHIIHH", 16, 3, 1, rate, 4 * rate, 4, 32) + b"data" + struct.pack("<I", len(body)) + body
    if tags:
        info = b"INFO"
        for k, v in tags.items():
            raw = v.encode() + b"\0"
            info += k.encode() + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) & 1)
        chunks += b"LIST" + struct.pack("<I", len(info)) + info
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def mixdown(x: np.ndarray, channel: int | None = None) -> np.ndarray:
    """One channel, or the mean of all."""
    return x.mean(1) if channel is None else x[:, channel]


def read_recordings(spark: SparkSession, path: str, glob: str = "*.wav", channel: int | None = None) -> DataFrame:
    """path, status (ok, failed), reason, rate, channels, samples: one row per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rate, x = decode_wav(bytes(data))
                    mono = mixdown(x, channel) if len(x) else x
                    reason = "empty" if not len(x) else None if np.isfinite(mono).all() else "samples that are not numbers"
                    rows.append((name, "failed" if reason else "ok", reason, rate, x.shape[1], None if reason else mono.tolist()))
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((name, "failed", f"unreadable: {e}", None, None, None))
            yield pd.DataFrame(rows, columns=["path", "status", "reason", "rate", "channels", "samples"])

    return files.mapInPandas(run, SCHEMA)


def frame_levels(recordings: DataFrame, hop: int = 512, window: int = 2048) -> DataFrame:
    """path, frame, level_db: power of centred frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, x in zip(pdf["path"], pdf["samples"], strict=True):
                v = np.asarray(x, float)
                sums = np.concatenate([[0], np.cumsum(v * v)])
                at = np.arange(1 + len(v) // hop) * hop
                lo, hi = np.clip(at - window // 2, 0, len(v)), np.clip(at + window // 2, 0, len(v))
                yield pd.DataFrame({"path": name, "frame": np.arange(len(at)), "level_db": 10 * np.log10(np.maximum((sums[hi] - sums[lo]) / window, 1e-15))})

    return recordings.where("status = 'ok'").select("path", "samples").mapInPandas(run, "path string, frame long, level_db double")


def content_key(samples: np.ndarray, rate: int, label: str) -> str:
    """SHA-256 over float samples, rate and label: the name of a cached result."""
    h = hashlib.sha256(np.asarray(samples, "<f4").tobytes())
    h.update(f"|{rate}|{label}".encode())
    return h.hexdigest()


def tone(spark: SparkSession, notes: list[tuple[float, float]], rate: int = 8000) -> DataFrame:
    """Synthetic melody with exact truth: sample, value, note, f0 for (hertz, seconds) notes; phase runs on over note borders."""
    rows = spark.createDataFrame([(k, f, int(round(s * rate))) for k, (f, s) in enumerate(notes)], "note int, f0 double, n long")
    from pyspark.sql import Window

    w = Window.orderBy("note").rowsBetween(Window.unboundedPreceding, -1)  # a melody's notes
    rows = rows.withColumns({"at": F.coalesce(F.sum("n").over(w), F.lit(0)), "phase": F.coalesce(F.sum(F.col("f0") * F.col("n")).over(w), F.lit(0.0)) / rate})
    one = rows.where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return one.select((F.col("at") + F.col("i")).alias("sample"), F.sin(2 * np.pi * (F.col("phase") + F.col("f0") * F.col("i") / rate)).alias("value"), "note", "f0")
