"""Model inference as a plan step: one ONNX session for each Python worker, images or clips in Arrow batches.

No weights come with the engine; path is a file that all executors can read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Side of the input of each kind of model, and mean and deviation of ImageNet.
SIDES = {"background": 1024, "face_detect": 640, "depth": 384, "colorize": 512, "inpaint": 512, "face_restore": 512, "pose": 192, "face_analysis": 224}
IMAGENET = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))


@lru_cache(maxsize=4)
def session(path: str):
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    if "://" in path:  # a store that only the file system layer reads
        import pyarrow.fs

        fs, place = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_input_stream(place) as f:
            path = f.read()
    return onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])


def to_tensor(image: np.ndarray, side: int | None = None, imagenet: bool = True) -> np.ndarray:
    """NCHW float32 of an (h, w, 3) image, resized to a square if a side is given."""
    from ..kernels.image import resize_lanczos

    image = resize_lanczos(image, side, side) if side else image
    v = image[..., :3].astype(np.float32) / 255
    if imagenet:
        v = (v - np.array(IMAGENET[0], np.float32)) / np.array(IMAGENET[1], np.float32)
    return np.ascontiguousarray(v.transpose(2, 0, 1)[None]).astype(np.float32)


def to_image(tensor: np.ndarray) -> np.ndarray:
    """(h, w, c) uint8 of an NCHW tensor in 0..1, cut."""
    return np.clip(tensor[0].transpose(1, 2, 0) * 255, 0, 255).astype(np.uint8)


def infer(df: DataFrame, path: str, prepare: Callable[[dict], list[np.ndarray]], finish: Callable[[dict, list[np.ndarray]], dict], schema: str) -> DataFrame:
    """Rows through a model: prepare makes the inputs of a row, finish a result row of the outputs; an error becomes one.

    schema has the columns of finish and a last column error string.
    """
    names = [part.strip().split()[0] for part in schema.split(",")]
    kinds = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        model = session(path)
        wanted = [i.name for i in model.get_inputs()]
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    out = finish(row, model.run(None, dict(zip(wanted, prepare(row)))))
                    rows.append({**{n: None for n in names}, **out, "error": None})
                except Exception as error:  # noqa: BLE001  a bad row is a result
                    rows.append({**{n: None for n in names}, "error": f"{type(error).__name__}: {error}"[:300]})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.mapInArrow(run, schema)
