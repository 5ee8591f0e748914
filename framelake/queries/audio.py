"""Audio over the clips that a user's events make."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import model
from ..functions import audio as f
from ..kernels import audio as kernels
from ..operators import audio as a
from . import query

RATE = 1000


def add(name: str, sql: str, g, *args, places: int = 6):
    @query(name, sql)
    def run(spark, sf_dir):
        return model.samples(a.change(model.clips(spark, sf_dir), g, *args)).withColumn("s", F.round("s", places))


def each(expression: str, of: str = "{sig}") -> str:
    return f"SELECT clip_id, i, round({expression}, 6) AS s FROM {of}"


def unit(e: str) -> str:
    return f"greatest(-1, least(1, {e}))"


N = "(SELECT *, count(*) OVER (PARTITION BY clip_id) AS n, max(abs(s)) OVER (PARTITION BY clip_id) AS peak, sqrt(avg(s * s) OVER (PARTITION BY clip_id)) AS rms, avg(s) OVER (PARTITION BY clip_id) AS dc FROM {sig})"
DB = lambda db: f"{10.0 ** (db / 20)!r}::DOUBLE"

add("volume", each(unit(f"s * {DB(6)}")), f.volume, 6.0)
add("gain", each(unit("s * 1.7::DOUBLE")), f.gain, 1.7)
add("limit", each(f"greatest(-{DB(-12)}, least({DB(-12)}, s))"), f.limit, -12.0)
add("invert_phase", each("-s"), f.invert_phase)
add("normalize_peak", each(f"CASE WHEN peak < 1e-10 THEN s ELSE {unit(f's * ({DB(-3)} / peak)')} END", N), f.normalize_peak, -3.0)
add("normalize_rms", each(f"CASE WHEN rms < 1e-10 THEN s ELSE {unit(f's * least({DB(-9)} / rms, 1 / peak)')} END", N), f.normalize_rms, -9.0)
add("remove_dc", each("s - dc", N), f.remove_dc)
P = "least(37, n)"
CURVE = {"linear": "p", "logarithmic": "CASE WHEN p < 0.001 THEN 0 ELSE p * (1 - p) END", "exponential": "p * p", "s_curve": "p * p * (3 - 2 * p)", "sine": f"sin(p * {math.pi / 2!r}::DOUBLE)"}
for kind, sql in CURVE.items():
    add(f"fade_in_{kind}", each(f"CASE WHEN i < {P} THEN s * ({sql}) ELSE s END", f"(SELECT *, i / CAST({P} AS DOUBLE) AS p FROM {N})"), f.fade_in, RATE, 0.0375, kind)
add("fade_out", each(f"CASE WHEN i >= n - {P} THEN s * p * p ELSE s END", f"(SELECT *, 1 - (i - (n - {P})) / CAST({P} AS DOUBLE) AS p FROM {N})"), f.fade_out, RATE, 0.0375, "exponential")
for kind, sql in {"overdrive": "tanh(s * 3)", "hard_clip": unit("s * 3"), "tube": "sign(s) * (1 - exp(-abs(s * 3)))", "fuzz": "sign(s) * (1 - exp(-3 * abs(s * 3)))", "bitcrush": f"sign(s) * floor(abs(s * 3) * {2.0 ** 15.58!r}::DOUBLE + 0.5) / {2.0 ** 15.58!r}::DOUBLE"}.items():
    add(f"distortion_{kind}", each(f"({sql}) * 0.8::DOUBLE"), f.distortion, kind, 3.0, 0.8)
add("mono_to_stereo", "SELECT clip_id, 2 * i + k AS i, round(s, 6) AS s FROM {sig}, (VALUES (0), (1)) AS c(k)", f.mono_to_stereo)
add("stereo_to_mono", "SELECT clip_id, i // 2 AS i, round(avg(s), 6) AS s FROM {sig} GROUP BY 1, 2", f.stereo_to_mono)
add("trim_silence", each("s").replace("i, round", "i - greatest(0, lo - 2) AS i, round").replace("{sig}", f"(SELECT *, coalesce(min(CASE WHEN abs(s) > {DB(-10)} THEN i END) OVER c, 0) AS lo, coalesce(max(CASE WHEN abs(s) > {DB(-10)} THEN i + 3 END) OVER c, 1000000) AS hi, count(*) OVER c AS n FROM {{sig}} WINDOW c AS (PARTITION BY clip_id)) WHERE i >= greatest(0, lo - 2) AND i < least(hi, n)"), f.trim_silence, -10.0, 2)


def resampled(ratio: float, length: str) -> str:
    return f"SELECT c.clip_id, j AS i, round(coalesce(p.s * (1 - (j * {ratio!r}::DOUBLE - floor(j * {ratio!r}::DOUBLE))) + q.s * (j * {ratio!r}::DOUBLE - floor(j * {ratio!r}::DOUBLE)), p.s, 0), 10) AS s FROM (SELECT clip_id, unnest(range(CAST({length} AS BIGINT))) AS j FROM {{sig}} GROUP BY clip_id) c LEFT JOIN {{sig}} p ON p.clip_id = c.clip_id AND p.i = floor(j * {ratio!r}::DOUBLE) LEFT JOIN {{sig}} q ON q.clip_id = c.clip_id AND q.i = floor(j * {ratio!r}::DOUBLE) + 1"


add("pitch_shift", resampled(2.0 ** (5 / 12), f"floor(count(*) / {2.0 ** (5 / 12)!r}::DOUBLE + 1e-9)"), f.pitch_shift, 5.0, places=10)
add("resample_linear", resampled(44100 / 16000, "greatest(1, floor(count(*) * 16000 / 44100.0::DOUBLE + 0.5))"), f.resample_linear, 44100, 16000, places=10)
add("pcm16", "SELECT clip_id, i, CAST(trunc(s * 32767) AS DOUBLE) AS s FROM {sig}", lambda s: F.transform(f.pcm(s, 16), lambda v: v.cast("double")))


@query("audio_levels", "SELECT clip_id, round(sqrt(avg(s * s)), 6) AS rms, round(20 * log10(greatest(max(abs(s)), 1e-10)), 6) AS peak_db, round(20 * log10(greatest(sqrt(avg(s * s)), 1e-10)), 6) AS rms_db, CAST(count(*) AS INTEGER) AS n FROM {sig} GROUP BY clip_id")
def audio_levels(spark, sf_dir):
    return a.measure(model.clips(spark, sf_dir))


@query("detect_silence", f"SELECT clip_id, min(i) AS \"start\", max(i) + 1 AS \"end\" FROM (SELECT clip_id, i, i - row_number() OVER (PARTITION BY clip_id ORDER BY i) AS k FROM {{sig}} WHERE abs(s) <= {DB(-20)}) GROUP BY clip_id, k HAVING count(*) >= 3")
def detect_silence(spark, sf_dir):
    return a.detect_silence(model.signal(spark, sf_dir), -20.0, 3)


@query("waveform_points", "SELECT clip_id, b AS bucket, least(0, min(s)) AS low, greatest(0, max(s)) AS high FROM (SELECT clip_id, s, i // greatest(1, n // 10) AS b FROM " + N + ") WHERE b < 10 GROUP BY 1, 2")
def waveform_points(spark, sf_dir):
    return a.waveform_points(model.signal(spark, sf_dir), 10)


HALF = "(SELECT clip_id, i // 2 AS i, s, i % 2 AS k FROM {sig})"


def halves(spark, sf_dir):
    """Even and odd samples of a clip as two clips."""
    df = model.clips(spark, sf_dir)
    s = F.col("samples")
    return df.select("clip_id", f.channel(s, 0, 2).alias("a"), f.channel(s, 1, 2).alias("b"))


@query("mix", f"SELECT clip_id, i, round(greatest(-1, least(1, coalesce(sum(s) FILTER (k = 0), 0) * 0.7::DOUBLE + coalesce(sum(s) FILTER (k = 1), 0) * 0.3::DOUBLE)), 6) AS s FROM {HALF} GROUP BY 1, 2")
def mix(spark, sf_dir):
    df = halves(spark, sf_dir).select("clip_id", f.mix(F.col("a"), F.col("b"), 0.3).alias("samples"))
    return model.samples(df).withColumn("s", F.round("s", 6))


@query("add", f"SELECT clip_id, i, round(greatest(-1, least(1, sum(s))), 6) AS s FROM {HALF} GROUP BY 1, 2")
def add_clips(spark, sf_dir):
    df = halves(spark, sf_dir).select("clip_id", f.add(F.col("a"), F.col("b")).alias("samples"))
    return model.samples(df).withColumn("s", F.round("s", 6))


def recurrent(name: str, sql: str | None, kernel: str, places: int = 6, **settings):
    @query(name, sql)
    def run(spark, sf_dir):
        return model.samples(a.recurrence(model.clips(spark, sf_dir), kernel, RATE, **settings)).withColumn("s", F.round("s", places))


def envelope_sql(attack: float, release: float, more: str = "", first: str = "") -> str:
    k = f"CASE WHEN abs(n.s) > e.e THEN {attack!r}::DOUBLE ELSE {release!r}::DOUBLE END"
    step = f"({k}) * e.e + (1 - ({k})) * abs(n.s)"
    return f"RECURSIVE_HERE e AS (SELECT clip_id, CAST(-1 AS BIGINT) AS i, 0.0::DOUBLE AS s, 0.0::DOUBLE AS e{first} FROM (SELECT DISTINCT clip_id FROM {{sig}}) UNION ALL SELECT n.clip_id, n.i, n.s, {step}{more.replace('STEP', step)} FROM e JOIN {{sig}} n ON n.clip_id = e.clip_id AND n.i = e.i + 1)"


def recursive(sql: str) -> str:
    """A recursive statement with its inputs in front."""
    out = model.with_inputs("WITH " + sql.replace("RECURSIVE_HERE ", "", 1))
    return out.replace("WITH ", "WITH RECURSIVE ", 1)


AT, RE = math.exp(-1000.0 / (2 * RATE)), math.exp(-1000.0 / (20 * RATE))
recurrent("compress", recursive(envelope_sql(AT, RE) + f" SELECT clip_id, i, round(greatest(-1, least(1, s * CASE WHEN e > {DB(-12)} THEN pow(10, (-12 + (20 * log10(e) + 12) / 4.0::DOUBLE) / 20) / e ELSE 1 END)), 6) AS s FROM e WHERE i >= 0"), "compress", threshold_db=-12, ratio=4.0, attack_ms=2, release_ms=20)
G = f", CASE WHEN STEP > {DB(-14)} THEN e.g * {AT!r}::DOUBLE + (1 - {AT!r}::DOUBLE) ELSE e.g * {RE!r}::DOUBLE + {DB(-60)} * (1 - {RE!r}::DOUBLE) END"
recurrent("gate", recursive(envelope_sql(AT, RE, G, f", {DB(-60)} AS g") + " SELECT clip_id, i, round(s * g, 6) AS s FROM e WHERE i >= 0"), "gate", threshold_db=-14, attack_ms=2, release_ms=20, range_db=-60)
B = kernels.biquad_coefficients("peak", 120, 4, 1.2, RATE)
recurrent("equalizer", recursive("e AS (SELECT clip_id, CAST(-1 AS BIGINT) AS i, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS y1, 0.0::DOUBLE AS y2 FROM (SELECT DISTINCT clip_id FROM {sig}) UNION ALL SELECT n.clip_id, n.i, n.s, e.x1, " + f"{B[0]!r}::DOUBLE * n.s + {B[1]!r}::DOUBLE * e.x1 + {B[2]!r}::DOUBLE * e.x2 - {B[3]!r}::DOUBLE * e.y1 - {B[4]!r}::DOUBLE * e.y2, e.y1" + " FROM e JOIN {sig} n ON n.clip_id = e.clip_id AND n.i = e.i + 1) SELECT clip_id, i, round(y1, 6) AS s FROM e WHERE i >= 0"), "equalizer", bands=[("peak", 120, 4, 1.2)])
recurrent("delay_once", "SELECT clip_id, i, round(s * 0.6::DOUBLE + coalesce(lag(s, 7) OVER (PARTITION BY clip_id ORDER BY i), 0) * 0.4::DOUBLE, 6) AS s FROM {sig}", "delay", ms=7, feedback=0.0, wet=0.4)
recurrent("delay", recursive("e AS (SELECT clip_id, i, s, s AS z FROM {sig} WHERE i < 7 UNION ALL SELECT n.clip_id, n.i, n.s, n.s + 0.6::DOUBLE * e.z FROM e JOIN {sig} n ON n.clip_id = e.clip_id AND n.i = e.i + 7) SELECT clip_id, i, round(s * 0.6::DOUBLE + coalesce(lag(z, 7) OVER (PARTITION BY clip_id ORDER BY i), 0) * 0.4::DOUBLE, 10) AS s FROM e"), "delay", 10, ms=7, feedback=0.6, wet=0.4)
recurrent("reverb", None, "reverb", room=0.8, damping=0.3, wet=0.4, pre_delay_ms=3)
recurrent("chorus", None, "chorus")
recurrent("flanger", None, "flanger")
SHORT = "(SELECT clip_id, i, s, n FROM (SELECT *, least(2048, count(*) OVER (PARTITION BY clip_id)) AS n FROM {sig}) WHERE i < n AND n >= 2)"
DFT = f"SELECT clip_id, CAST(k AS INTEGER) AS k, sqrt(pow(sum(s * h * cos({2 * math.pi!r}::DOUBLE * k * i / n)), 2) + pow(sum(s * h * sin({2 * math.pi!r}::DOUBLE * k * i / n)), 2)) AS magnitude FROM (SELECT *, 0.5 * (1 - cos({2 * math.pi!r}::DOUBLE * i / greatest(1, n - 1))) AS h, unnest(range(n // 2)) AS k FROM {SHORT}) GROUP BY 1, 2"


@query("spectrum_dft", f"SELECT clip_id, k, round(magnitude, 5) AS magnitude FROM ({DFT})")
def spectrum_dft(spark, sf_dir):
    return a.spectra(model.clips(spark, sf_dir)).withColumn("magnitude", F.round("magnitude", 5))


@query("spectrum_bins", f"WITH m AS ({DFT}), c AS (SELECT clip_id, max(k) + 1 AS m FROM m GROUP BY 1), b AS (SELECT clip_id, m, j, CASE WHEN m > 1 THEN CAST(floor(exp(j / 4.0::DOUBLE * ln(m)) + 1e-9) AS BIGINT) ELSE 0 END AS lo, CASE WHEN m > 1 THEN CAST(floor(exp((j + 1) / 4.0::DOUBLE * ln(m)) + 1e-9) AS BIGINT) ELSE 0 END AS hi FROM c, (SELECT unnest(range(4)) AS j)) SELECT b.clip_id, CAST(j AS INTEGER) AS k, round(avg(magnitude), 5) AS magnitude FROM b JOIN m ON m.clip_id = b.clip_id AND m.k >= least(lo, m - 1) AND m.k < greatest(least(lo, m - 1) + 1, hi) GROUP BY 1, 2")
def spectrum_bins(spark, sf_dir):
    return a.spectra(model.clips(spark, sf_dir), bins=4).withColumn("magnitude", F.round("magnitude", 5))


@query("spectrogram")
def spectrogram(spark, sf_dir):
    return a.spectrograms(model.clips(spark, sf_dir), 8, 6)


@query("mel_frames", f"WITH n AS (SELECT *, count(*) OVER (PARTITION BY clip_id) AS n FROM {{sig}}), f AS (SELECT clip_id, i, s, unnest(range(CAST(greatest(0, ceil((i - 15) / 8.0::DOUBLE)) AS BIGINT), i // 8 + 1)) AS frame, greatest(1, CAST(floor((n - 16) / 8.0::DOUBLE) AS BIGINT) + 1) AS frames FROM n), e AS (SELECT clip_id, frame, sqrt(sum(s * s)) AS energy FROM f WHERE frame < frames GROUP BY 1, 2), r AS (SELECT clip_id, frame, mel, log10(greatest(energy * sin(mel / 4.0::DOUBLE * {math.pi!r}::DOUBLE), 1e-10)) AS raw FROM e, (SELECT unnest(range(4)) AS mel)) SELECT clip_id, frame, CAST(mel AS INTEGER) AS mel, round((raw - avg(raw) OVER c) / greatest(stddev_pop(raw) OVER c, 1e-8), 5) AS value FROM r WINDOW c AS (PARTITION BY clip_id)")
def mel_frames(spark, sf_dir):
    return a.mel_frames(model.signal(spark, sf_dir), 16, 8, 4).withColumn("value", F.round("value", 5))
