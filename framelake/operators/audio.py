"""Audio operators on clips (clip_id, samples array<double>) and their long form (clip_id, i, s)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import audio
from ..kernels import audio as kernels

#: Samples of a batch that a kernel takes at once, padding included.
BATCH = 4_000_000


def change(df: DataFrame, f: Callable, *args) -> DataFrame:
    """samples through a function of functions.audio."""
    return df.withColumn("samples", f(F.col("samples"), *args))


def measure(df: DataFrame) -> DataFrame:
    s = F.col("samples")
    return df.select("clip_id", F.round(audio.rms(s), 6).alias("rms"), F.round(audio.floored_db(audio.peak(s)), 6).alias("peak_db"), F.round(audio.floored_db(audio.rms(s)), 6).alias("rms_db"), F.size(s).alias("n"))


def _groups(lengths: np.ndarray):
    """Rows of like length together, so that padding stays small."""
    order = np.argsort(lengths, kind="stable")
    first = 0
    while first < len(order):
        last = first + 1
        while last < len(order) and (last + 1 - first) * max(1, lengths[order[last]]) <= BATCH and lengths[order[last]] <= 2 * lengths[order[first]] + 64:
            last += 1
        yield order[first:last]
        first = last


def recurrence(df: DataFrame, name: str, rate: int, **settings) -> DataFrame:
    """samples through a recurrence of kernels.audio (compress, gate, equalizer, delay, reverb, chorus, flanger)."""
    df = df.select("clip_id", "samples")

    def run(batches):
        kernel = getattr(kernels, name)
        for batch in batches:
            clips = [np.array(v.as_py() or [], float) for v in batch.column(1)]
            out: list = [None] * len(clips)
            lengths = np.array([len(c) for c in clips], np.int64)
            for rows in _groups(lengths):
                x = np.zeros((len(rows), int(lengths[rows].max(initial=0))))
                for k, row in enumerate(rows):
                    x[k, : lengths[row]] = clips[row]
                y = kernel(x, rate, **settings) if x.shape[1] else x
                for k, row in enumerate(rows):
                    out[row] = y[k, : lengths[row]].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["clip_id", "samples"])

    return df.mapInArrow(run, df.schema)


def spectra(df: DataFrame, most: int = 2048, bins: int | None = None) -> DataFrame:
    """Magnitudes (clip_id, k, magnitude) of the first min(most, length) samples, or their means in log bins."""

    def run(batches):
        for batch in batches:
            for clip, samples in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = min(most, len(samples or ()))
                if n >= 2:
                    m = kernels.spectrum(np.array([samples], float), n)
                    m = (kernels.log_bins(m, bins) if bins else m)[0]
                    yield pa.RecordBatch.from_arrays([pa.array([clip] * len(m), pa.int64()), pa.array(range(len(m)), pa.int32()), pa.array(m)], ["clip_id", "k", "magnitude"])

    return df.select("clip_id", "samples").mapInArrow(run, "clip_id long, k int, magnitude double")


def spectrograms(df: DataFrame, width: int, height: int) -> DataFrame:
    """clip_id, x, y (0: lowest), level 0..1."""

    def run(batches):
        for batch in batches:
            for clip, samples in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if samples:
                    g = kernels.spectrogram(np.array(samples, float), width, height)
                    y, x = np.divmod(np.arange(g.size), width)
                    yield pa.RecordBatch.from_arrays([pa.array([clip] * g.size, pa.int64()), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(g.ravel())], ["clip_id", "x", "y", "level"])

    return df.select("clip_id", "samples").mapInArrow(run, "clip_id long, x int, y int, level double")


def waveform_points(long: DataFrame, points: int) -> DataFrame:
    """The least and greatest sample, with 0, of each of points buckets of length div points samples."""
    size = F.count(F.lit(1)).over(W.partitionBy("clip_id"))
    rows = long.withColumn("bucket", F.floor(F.col("i") / F.greatest(F.lit(1), F.floor(size / points))))
    rows = rows.where(F.col("bucket") < points)
    return rows.groupBy("clip_id", "bucket").agg(F.least(F.lit(0.0), F.min("s")).alias("low"), F.greatest(F.lit(0.0), F.max("s")).alias("high"))


def detect_silence(long: DataFrame, db: float, least: int) -> DataFrame:
    """Runs [start, end) of at least so many samples at or below a level: gaps and islands."""
    quiet = long.where(F.abs(F.col("s")) <= audio.db_to_linear(db))
    island = F.col("i") - F.row_number().over(W.partitionBy("clip_id").orderBy("i"))
    runs = quiet.withColumn("island", island).groupBy("clip_id", "island").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"))
    return runs.where(F.col("end") - F.col("start") >= least).drop("island")


def separate(df: DataFrame, model: Callable[[np.ndarray], np.ndarray], chunk: int, stems: list[str]) -> DataFrame:
    """Stems of each clip by a model on overlapping chunks (three quarters of one apart), joined by Hann weights.

    model takes (chunks, samples) and gives (stems, chunks, samples). Returns clip_id, stem, samples.
    """

    def run(batches):
        window = np.maximum(np.hanning(chunk), 1e-6)
        for batch in batches:
            for clip, samples in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.array(samples or [], float)
                starts = list(range(0, max(1, len(x)), max(1, chunk * 3 // 4)))
                parts = np.stack([np.pad(x[a : a + chunk], (0, max(0, chunk - len(x[a : a + chunk])))) for a in starts])
                got = model(parts)
                out, weight = np.zeros((len(stems), starts[-1] + chunk)), np.zeros(starts[-1] + chunk)
                for k, a in enumerate(starts):
                    out[:, a : a + chunk] += got[:, k] * window
                    weight[a : a + chunk] += window
                out = (out / weight)[:, : len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([clip] * len(stems), pa.int64()), pa.array(stems), pa.array(out.tolist(), pa.list_(pa.float64()))], ["clip_id", "stem", "samples"])

    return df.select("clip_id", "samples").mapInArrow(run, "clip_id long, stem string, samples array<double>")


def without_vocals(stems: DataFrame) -> DataFrame:
    """The sum of all stems but the vocals."""
    rest = stems.where("stem <> 'vocals'").groupBy("clip_id").agg(F.collect_list("samples").alias("all"))
    total = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.col("all")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return rest.select("clip_id", total.alias("samples"))


def mel_frames(long: DataFrame, n_fft: int = 400, hop: int = 160, mels: int = 80) -> DataFrame:
    """The plain mel stand-in of the transcriber: frame energies times sin(mel / mels pi), log10, standardised by clip."""
    size = F.count(F.lit(1)).over(W.partitionBy("clip_id"))
    frames = F.greatest(F.lit(1), F.floor((size - n_fft) / hop) + 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (n_fft - 1)) / hop))
    rows = long.withColumn("frames", frames).withColumn("frame", F.explode(F.sequence(first, F.floor(F.col("i") / hop)))).where("frame < frames")
    energy = rows.groupBy("clip_id", "frame").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("energy"))
    cells = energy.withColumn("mel", F.explode(F.sequence(F.lit(0), F.lit(mels - 1))))
    raw = F.log10(F.greatest(F.col("energy") * F.sin(F.col("mel") / float(mels) * F.lit(np.pi)), F.lit(1e-10)))
    clip = W.partitionBy("clip_id")
    cells = cells.withColumn("raw", raw).withColumns({"m": F.avg("raw").over(clip), "d": F.stddev_pop("raw").over(clip)})
    return cells.select("clip_id", "frame", "mel", ((F.col("raw") - F.col("m")) / F.greatest(F.col("d"), F.lit(1e-8))).alias("value"))
