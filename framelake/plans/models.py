"""Model operators: a DataFrame of images or clips through a model, with its tensors made and its outputs read.

Each operator takes rows in any number, so there is no batch form of its own; name_quick(df, path) loads with the defaults.
A model is a file that all executors can read, opened once by each worker; no weights come with the engine. A bad row has
its error in the column error, null elsewhere, and does not end the job; null planes or samples are such rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..kernels import image as pictures
from ..kernels import postprocess as p
from .infer import IMAGENET, session

#: Settings of each task and their defaults.
DEFAULTS: dict[str, dict] = {
    "background": {"side": 1024},
    "upscale": {"factor": 4, "tile": 256, "overlap": 16},
    "face_restore": {"side": 512},
    "colorize": {"side": 512, "saturation": 1.0},
    "interpolate": {"multiple": 32},
    "inpaint": {"side": 512, "dilate": 3},
    "face_detect": {"side": 640, "least": 0.5, "nms": 0.4, "most": 100},
    "depth": {"side": 384, "normalize": True, "invert": False},
    "transcribe": {"rate": 16_000, "seconds": 30},
    "separate": {"chunk": 44_100 * 6, "stems": ("vocals", "drums", "bass", "other")},
    "style": {"most": 1024, "strength": 1.0, "preserve_colors": False},
    "ocr": {"recognizer": "", "alphabet": "", "most": 960, "least": 0.5, "keep": 0.5},
    "pose": {"side": 192, "least": 0.3, "most": 6},
    "face_analysis": {"gender": "", "emotion": "", "side": 224, "smallest": 48},
}
EMOTIONS = ("neutral", "happy", "sad", "angry", "fearful", "disgusted", "surprised")
PICTURE = "image_id long, w int, h int, planes array<array<int>>, error string"


@dataclass(frozen=True)
class Model:
    task: str
    path: str
    settings: dict = field(default_factory=dict)

    def __getitem__(self, name: str):
        return self.settings[name]

    def __call__(self, *inputs: np.ndarray, path: str = "") -> list[np.ndarray]:
        model = session(path or self.path)
        return model.run(None, dict(zip([i.name for i in model.get_inputs()], inputs)))


def load(task: str, path: str, **settings) -> Model:
    """A model file with the settings of its task; a missing file or an unknown setting is an error at once."""
    unknown = set(settings) - set(DEFAULTS[task])
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    model = Model(task, path, DEFAULTS[task] | settings)
    for name in [path, *(model[k] for k in ("recognizer", "gender", "emotion") if model.settings.get(k))]:
        fs, place = pyarrow.fs.FileSystem.from_uri(name if "://" in name else f"file://{name}")
        if fs.get_file_info(place).type != pyarrow.fs.FileType.File:
            raise FileNotFoundError(name)
    return model


def _loader(task: str) -> Callable[..., Model]:
    return lambda path, **settings: load(task, path, **settings)


load_model = _loader("background")
load_upscaler = _loader("upscale")
load_restorer = _loader("face_restore")
load_colorizer = _loader("colorize")
load_interpolator = _loader("interpolate")
load_inpainter = _loader("inpaint")
load_detector = _loader("face_detect")
load_depth_estimator = _loader("depth")
load_transcriber = _loader("transcribe")
load_separator = _loader("separate")
load_style_model = _loader("style")
load_ocr_model = _loader("ocr")
load_pose_model = _loader("pose")
load_analyzer = _loader("face_analysis")


def array(row: dict, name: str = "planes") -> np.ndarray:
    """The (h, w, c) uint8 image of a row's planes."""
    if row[name] is None or not row["w"] or not row["h"]:
        raise ValueError("no image")
    return np.array(row[name], np.uint8).T.reshape(row["h"], row["w"], -1)


def cells(image: np.ndarray) -> dict:
    flat = image.reshape(-1, image.shape[2])
    return {"w": image.shape[1], "h": image.shape[0], "planes": [flat[:, k].astype(np.int32).tolist() for k in range(flat.shape[1])]}


def rows(df: DataFrame, f: Callable[[dict], dict | Iterator[dict]], schema: str, keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """f of each row, which may give several; keep are columns that result rows take over, also in a row with an error."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():  # one image at a time in Arrow, as they may be large
                head = {k: row[k] for k in keep} | {"error": None}
                try:
                    found = f(row)
                    out = [head | r for r in ([found] if isinstance(found, dict) else found)]
                except Exception as error:  # noqa: BLE001  a bad row is a result
                    out = [head | {"error": f"{type(error).__name__}: {error}"[:300]}]
                yield pa.RecordBatch.from_pylist(out, kinds)

    return df.mapInArrow(run, schema)


def image_to_tensor(image: np.ndarray, side: int | None = None, imagenet: bool = True) -> np.ndarray:
    from .infer import to_tensor

    return to_tensor(p.rgb(image), side, imagenet)


image_to_tensor_parallel = image_to_tensor  # Spark's tasks are the parallelism


def remove_background(df: DataFrame, model: Model) -> DataFrame:
    """RGBA images whose alpha is the model's mask at full size, led by the image's edges."""

    def one(row: dict) -> dict:
        image = array(row)
        return cells(p.apply_mask(image, p.plane(model(image_to_tensor(image, model["side"]))[0])))

    return rows(df, one, PICTURE)


def apply_mask(df: DataFrame, masks: DataFrame) -> DataFrame:
    """RGBA images with masks (image_id, mw, mh, mask array of 0..1) as alpha."""

    def one(row: dict) -> dict:
        return cells(p.apply_mask(array(row), np.array(row["mask"], float).reshape(row["mh"], row["mw"])))

    return rows(df.join(masks.select("image_id", "mw", "mh", "mask"), "image_id"), one, PICTURE)


def _enlarged(model: Model) -> Callable[[np.ndarray], np.ndarray]:
    return lambda part: p.truncated(p.hwc(model(image_to_tensor(part, imagenet=False))[0]) * 255)


def upscale_direct(df: DataFrame, model: Model) -> DataFrame:
    return rows(df, lambda row: cells(_enlarged(model)(array(row))), PICTURE)


def upscale_tiled(df: DataFrame, model: Model) -> DataFrame:
    """Overlapping tiles, joined by weights that never fall to 0, so the output has no dark border."""

    def one(row: dict) -> dict:
        return cells(pictures.upscale_tiled(p.rgb(array(row)), _enlarged(model), model["factor"], model["tile"], model["overlap"]))

    return rows(df, one, PICTURE)


def upscale(df: DataFrame, model: Model) -> DataFrame:
    """Images that fit a tile in one go, others in tiles."""

    def one(row: dict) -> dict:
        image = p.rgb(array(row))
        if max(image.shape[:2]) <= model["tile"]:
            return cells(_enlarged(model)(image))
        return cells(pictures.upscale_tiled(image, _enlarged(model), model["factor"], model["tile"], model["overlap"]))

    return rows(df, one, PICTURE)


def restore_faces(df: DataFrame, model: Model) -> DataFrame:
    """Whole images through a model of values in -1..1 and back to their size."""

    def one(row: dict) -> dict:
        image = p.rgb(array(row))
        small = pictures.resize_lanczos(image, model["side"], model["side"])
        out = p.truncated((p.hwc(model(p.nchw(small / 127.5 - 1))[0]) + 1) * 127.5)
        return cells(pictures.resize_lanczos(out, image.shape[1], image.shape[0]))

    return rows(df, one, PICTURE)


def colorize(df: DataFrame, model: Model) -> DataFrame:
    """RGB of luma by a model that gives colours or the ab of Lab, whose saturation is scaled."""

    def one(row: dict) -> dict:
        image = array(row)
        gray = np.floor(p.luma(image) + 0.5).astype(np.uint8)[..., None]
        small = pictures.resize_lanczos(gray, model["side"], model["side"])[..., 0] / 255.0
        out = p.colorized(small, model(small[None, None].astype(np.float32))[0], model["saturation"])
        return cells(pictures.resize_lanczos(out, image.shape[1], image.shape[0]))

    return rows(df, one, PICTURE)


def _between(frames: DataFrame, model: Model, shares: list[float]) -> DataFrame:
    order = W.partitionBy("source").orderBy("frame_no")
    pairs = frames.select("source", "frame_no", "w", "h", "planes").withColumn("next", F.lead(F.struct("w", "h", "planes")).over(order)).where("next is not null")
    steps = pairs.withColumn("t", F.explode(F.array(*map(F.lit, shares))))

    def one(row: dict) -> dict:
        a, b = p.rgb(array(row)), p.rgb(array(row["next"]))
        if a.shape != b.shape:
            raise ValueError("frames must have the same dimensions")
        h, w, m = *a.shape[:2], model["multiple"]
        size = (-(-w // m) * m, -(-h // m) * m)
        ready = [image_to_tensor(x if size == (w, h) else pictures.resize_lanczos(x, *size), imagenet=False) for x in (a, b)]
        out = p.truncated(p.hwc(model(*ready, np.array([row["t"]], np.float32))[0]) * 255)
        return cells(out[:h, :w])

    return rows(steps, one, "source long, frame_no long, t double, w int, h int, planes array<array<int>>, error string", ("source", "frame_no", "t"))


def interpolate_frames(frames: DataFrame, model: Model, n: int = 1) -> DataFrame:
    """n frames between each frame and the next of its source (source, frame_no, w, h, planes): source, frame_no, t, image.

    Sizes must be equal. Frames are made up to a multiple the model asks for by resizing, and cut back.
    """
    return _between(frames, model, [k / (n + 1) for k in range(1, n + 1)])


def interpolate_frame(frames: DataFrame, model: Model, t: float = 0.5) -> DataFrame:
    """The frame at share t between each frame and the next of its source."""
    return _between(frames, model, [float(t)])


def inpaint(df: DataFrame, masks: DataFrame, model: Model) -> DataFrame:
    """Images whose masked places (mask image of one id, over 127, grown by a radius) a model fills; all places are the model's."""
    pairs = df.join(masks.select("image_id", F.struct("w", "h", "planes").alias("mask")), "image_id")

    def one(row: dict) -> dict:
        image, mask, side = p.rgb(array(row)), array(row["mask"])[..., :1], model["side"]
        y, x = (np.minimum((np.arange(side) + 0.5) * n / side, n - 1).astype(int) for n in mask.shape[:2])
        hit = mask[y][:, x, 0] > 127
        hit = p.box_mean(hit.astype(float), model["dilate"]) > 1e-9 if model["dilate"] else hit
        out = model(image_to_tensor(image, side, False), hit[None, None].astype(np.float32))[0]
        return cells(pictures.resize_lanczos(p.truncated(p.hwc(out) * 255), image.shape[1], image.shape[0]))

    return rows(pairs, one, PICTURE)


FACE = "image_id long, det_id int, x int, y int, w int, h int, score double, landmarks array<array<double>>, error string"


def detect_faces(df: DataFrame, model: Model) -> DataFrame:
    """A row for each face, best first, in the image's own pixels; overlaps are suppressed."""

    def one(row: dict) -> Iterator[dict]:
        image, side = p.rgb(array(row)), model["side"]
        h, w = image.shape[:2]
        found = p.detections(model(image_to_tensor(image, side, False)), w / side, h / side, w, h, model["least"], model["nms"], model["most"])
        return [{"det_id": k, **face} for k, face in enumerate(found)]

    return rows(df, one, FACE)


DEPTH = "image_id long, w int, h int, depth array<double>, error string"


def estimate_depth(df: DataFrame, model: Model) -> DataFrame:
    """A depth for each pixel, 0..1 where normalised; inverted depths keep their range."""

    def one(row: dict) -> dict:
        image = p.rgb(array(row))
        depth = p.normalized_depth(p.plane(model(image_to_tensor(image, model["side"]))[0]), model["normalize"], model["invert"])
        return {"w": image.shape[1], "h": image.shape[0], "depth": p.resize_plane(depth, image.shape[1], image.shape[0]).ravel().tolist()}

    return rows(df, one, DEPTH)


def depth_at(depths: DataFrame, x: int, y: int) -> DataFrame:
    """The depth at a place of each image, null outside."""
    inside = (F.lit(x) >= 0) & (F.lit(y) >= 0) & (F.lit(x) < F.col("w")) & (F.lit(y) < F.col("h"))
    return depths.select("image_id", F.when(inside, F.get("depth", F.lit(y) * F.col("w") + F.lit(x))).alias("depth"))


def stylize(df: DataFrame, model: Model) -> DataFrame:
    """Images in a model's style, at most `most` on a side inside; colours may stay the image's, strength blends."""

    def one(row: dict) -> dict:
        image = p.rgb(array(row))
        small = p.fitted(image, model["most"])
        out = p.truncated(p.hwc(model(p.nchw(small.astype(float)))[0]))[: small.shape[0], : small.shape[1]]
        if model["preserve_colors"]:
            out = p.recolored(out, small)
        if model["strength"] < 1:
            out = p.blend(small, out, max(0.0, model["strength"]))
        return cells(out if out.shape == image.shape else pictures.resize_lanczos(out, image.shape[1], image.shape[0]))

    return rows(df, one, PICTURE)


def blended(df: DataFrame, other: DataFrame, strength: float) -> DataFrame:
    """planes of df and of other, of one id and size, mixed: v (1 - strength) + other strength, cut."""
    strength = min(1.0, max(0.0, float(strength)))
    joined = df.join(other.select("image_id", F.col("planes").alias("other")), "image_id")
    mix = lambda a, b: F.floor(a * F.lit(1 - strength) + b * F.lit(strength) + F.lit(1e-9)).cast("int")
    return joined.withColumn("planes", F.zip_with("planes", "other", lambda u, v: F.zip_with(u, v, mix))).drop("other")


def stylize_blended(df: DataFrame, model: Model, strength: float) -> DataFrame:
    """Styled images mixed with the images themselves."""
    return stylize(df, Model(model.task, model.path, model.settings | {"strength": min(1.0, max(0.0, strength)) * model["strength"]}))


TEXT = "image_id long, text string, confidence double, blocks array<struct<text:string,x:int,y:int,w:int,h:int,confidence:double,angle:double,vertices:array<array<double>>>>, error string"


def extract_text(df: DataFrame, model: Model) -> DataFrame:
    """Text of images: the detector's quads (n, 9: four points and a score) made upright, read one by one, in reading order."""

    def one(row: dict) -> dict:
        image = p.rgb(array(row))
        small = p.fitted(image, model["most"])
        h, w = small.shape[:2]
        ready = (small / 255.0 - IMAGENET[0]) / IMAGENET[1]
        padded = np.pad(ready, ((0, -h % 32), (0, -w % 32), (0, 0)))
        quads = np.asarray(model(p.nchw(padded))[0], float).reshape(-1, 9)
        scale = np.array([image.shape[1] / w, image.shape[0] / h])
        blocks = []
        for quad in quads[quads[:, 8] >= model["least"]]:
            corners = p.ordered_quad(quad[:8].reshape(4, 2) * scale)
            part = p.luma(p.rectified(image, corners))
            width = int(np.clip(np.floor(32 * part.shape[1] / part.shape[0] + 0.5), 32, 320))
            part = pictures.resize_lanczos(np.floor(part + 0.5).astype(np.uint8)[..., None], width, 32)[..., 0]
            logits = np.asarray(model((part / 127.5 - 1)[None, None].astype(np.float32), path=model["recognizer"])[0], float)
            text, confidence = p.ctc(logits.reshape(-1, logits.shape[-1]), model["alphabet"])
            if text and confidence >= model["keep"]:
                (x0, y0), (x1, y1) = corners.min(0), corners.max(0)
                angle = float(np.degrees(np.arctan2(*(corners[1] - corners[0])[::-1])))
                blocks.append({"text": text, "x": int(x0), "y": int(y0), "w": int(x1 - x0), "h": int(y1 - y0), "confidence": confidence, "angle": angle, "vertices": corners.tolist()})
        blocks = p.reading_order(blocks)
        return {"text": "\n".join(b["text"] for b in blocks), "confidence": float(np.mean([b["confidence"] for b in blocks])) if blocks else 0.0, "blocks": blocks}

    return rows(df, one, TEXT)


def extract_text_simple(df: DataFrame, model: Model) -> DataFrame:
    return extract_text(df, model).select("image_id", "text", "error")


POSE = "image_id long, person int, confidence double, points array<array<double>>, error string"


def detect_pose(df: DataFrame, model: Model) -> DataFrame:
    """A row for each person: 17 points (x, y, confidence) in 0..1 of a model that takes NHWC values of 0..255."""

    def one(row: dict) -> Iterator[dict]:
        small = pictures.resize_lanczos(p.rgb(array(row)), model["side"], model["side"])
        found = p.poses(model(small[None].astype(np.float32))[0], model["least"], model["most"])
        return [{"person": k, **person} for k, person in enumerate(found)]

    return rows(df, one, POSE)


ANALYSIS = "image_id long, det_id int, x int, y int, w int, h int, age double, gender string, gender_confidence double, emotion string, emotion_confidence double, emotions array<double>, error string"


def _analysed(image: np.ndarray, model: Model) -> dict:
    tensor = image_to_tensor(image, model["side"])
    out = {"age": float(np.clip(np.asarray(model(tensor)[0], float).ravel()[0], 0, 100)), "gender": "unknown", "gender_confidence": 0.0, "emotion": "unknown", "emotion_confidence": 0.0, "emotions": []}
    if model["gender"]:
        scores = np.asarray(model(tensor, path=model["gender"])[0], float).ravel()
        male = float(p.softmax(scores)[1]) if len(scores) > 1 else float(scores[0])
        out |= {"gender": "male" if male > 0.6 else "female" if male < 0.4 else "unknown", "gender_confidence": max(male, 1 - male)}
    if model["emotion"]:
        scores = p.softmax(np.asarray(model(tensor, path=model["emotion"])[0], float).ravel()[: len(EMOTIONS)])
        best = len(scores) - 1 - int(scores[::-1].argmax())  # of equal ones the last
        out |= {"emotion": EMOTIONS[best], "emotion_confidence": float(scores[best]), "emotions": scores.tolist()}
    return out


def analyze_face(df: DataFrame, model: Model) -> DataFrame:
    """Age, gender and emotion of images of one face."""
    return rows(df, lambda row: {"det_id": 0, "x": 0, "y": 0, "w": row["w"], "h": row["h"], **_analysed(p.rgb(array(row)), model)}, ANALYSIS)


def analyze_faces(df: DataFrame, faces: DataFrame, model: Model) -> DataFrame:
    """The same for faces (image_id, det_id, x, y, w, h) of images; faces under a size are left out."""
    boxes = faces.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("det_id", "x", "y", "w", "h"))).alias("faces"))

    def one(row: dict) -> Iterator[dict]:
        image, out = p.rgb(array(row)), []
        for f in row["faces"]:
            part = image[max(0, f["y"]) : f["y"] + f["h"], max(0, f["x"]) : f["x"] + f["w"]]
            if min(f["w"], f["h"]) >= model["smallest"] and part.size:
                out.append({**f, **_analysed(part, model)})
        return out

    return rows(df.join(boxes, "image_id"), one, ANALYSIS)


def analyze_and_annotate(df: DataFrame, faces: DataFrame, model: Model) -> DataFrame:
    """Images with their analysed faces drawn in."""
    from ..operators import annotate

    return annotate.analysis(df, analyze_faces(df, faces, model))


TOKENS = "clip_id long, pos int, token long, error string"


def mel(samples: np.ndarray, n_fft: int = 400, hop: int = 160, mels: int = 80) -> np.ndarray:
    """(1, mels, frames): the plain stand-in of operators.audio.mel_frames for one clip."""
    n = max(1, (len(samples) - n_fft) // hop + 1)
    energy = np.array([np.sqrt((samples[k * hop : k * hop + n_fft] ** 2).sum()) for k in range(n)])
    raw = np.log10(np.maximum(energy[None] * np.sin(np.arange(mels) / mels * np.pi)[:, None], 1e-10))
    return ((raw - raw.mean()) / max(raw.std(), 1e-8))[None]


def transcribe_tokens(clips: DataFrame, model: Model) -> DataFrame:
    """The model's token ids of clips (clip_id, sample_rate, samples), brought to the model's rate; its first seconds."""

    def one(row: dict) -> Iterator[dict]:
        samples = np.array(row["samples"], float)
        rate = model["rate"]
        if row["sample_rate"] != rate and len(samples):
            at = np.arange(int(len(samples) * rate / row["sample_rate"])) * row["sample_rate"] / rate
            samples = np.interp(at, np.arange(len(samples)), samples)
        found = model(mel(samples[: rate * model["seconds"]]).astype(np.float32))[0]
        return [{"pos": k, "token": int(t)} for k, t in enumerate(np.asarray(found).ravel().tolist())]

    return rows(clips, one, TOKENS, ("clip_id",))


def transcribe(clips: DataFrame, model: Model) -> DataFrame:
    """Segments (clip_id, start, end, text) of clips; text is the token ids in brackets, as no vocabulary comes with a model."""
    from ..operators import detection

    return detection.token_segments(transcribe_tokens(clips, model).where("error is null").select("clip_id", "pos", "token"))


def separate(clips: DataFrame, model: Model) -> DataFrame:
    """Stems (clip_id, stem, samples) by a model of (1, samples) to (1, stems, samples) on overlapping chunks."""
    from ..operators import audio

    def stems(parts: np.ndarray) -> np.ndarray:
        return np.stack([np.asarray(model(part[None].astype(np.float32))[0], float).reshape(len(model["stems"]), -1) for part in parts], 1)

    return audio.separate(clips, stems, model["chunk"], list(model["stems"]))


separate_quick = lambda clips, path: separate(clips, load_separator(path))


def isolate_vocals(clips: DataFrame, model: Model) -> DataFrame:
    return separate(clips, model).where("stem = 'vocals'").drop("stem")


def remove_vocals(clips: DataFrame, model: Model) -> DataFrame:
    from ..operators import audio

    return audio.without_vocals(separate(clips, model))


remove_background_batch = remove_background
upscale_batch = upscale
restore_faces_batch = restore_faces
colorize_batch = colorize
upscale_quick = lambda df, path, **settings: upscale(df, load_upscaler(path, **settings))
colorize_quick = lambda df, path: colorize(df, load_colorizer(path))
interpolate_quick = lambda frames, path, t=0.5: interpolate_frame(frames, load_interpolator(path), t)
inpaint_quick = lambda df, masks, path: inpaint(df, masks, load_inpainter(path))
detect_faces_quick = lambda df, path: detect_faces(df, load_detector(path))
estimate_depth_quick = lambda df, path: estimate_depth(df, load_depth_estimator(path))
transcribe_quick = lambda clips, path: transcribe(clips, load_transcriber(path))
