"""The scoring network's file: named float32 tensors, a vocabulary and the architecture."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Formats are named by their maker, then float32 weights, then the version.
FORMAT = re.compile(r"[a-z-]+-f32-v1")


@dataclass
class ModelFile:
    vocabulary: dict[str, int]
    channels: int
    blocks: int
    tensors: dict[str, tuple[int, int, list[int]]]
    encoded: str
    metadata: dict = field(default_factory=dict)
    _weights: np.ndarray | None = None

    @classmethod
    def parse(cls, text: str) -> ModelFile:
        data = json.loads(text)
        if not FORMAT.fullmatch(data.get("format") or ""):
            raise ValueError(f"the model's format is {data.get('format')}, which is no float32 format of version 1")
        tensors = {k: (v["offset"], v["length"], v.get("shape", [v["length"]])) for k, v in data["tensors"].items()}
        rest = {k: v for k, v in data.items() if k not in ("tensors", "vocabulary", "architecture", "weightsBase64")}
        return cls(data["vocabulary"], data["architecture"]["channels"], data["architecture"]["residualBlocks"], tensors, data["weightsBase64"], rest)

    @classmethod
    def random(cls, vocabulary: list[str], channels: int, blocks: int, seed: int = 0) -> ModelFile:
        """A network of seeded random weights, for tests; its cuts mean nothing."""
        rng = np.random.default_rng(seed)
        shapes: dict[str, tuple[int, ...]] = {"embedding.weight": (len(vocabulary) + 1, channels)}
        for k in range(blocks):
            p = f"blocks.{k}."
            shapes |= {p + "normalization.weight": (channels,), p + "normalization.bias": (channels,), p + "residual_scale": (1,)}
            for part in ("first", "second"):
                shapes |= {p + part + ".weight": (channels, channels, 3), p + part + ".bias": (channels,)}
        shapes |= {"boundary_hidden.weight": (channels, 4 * channels), "boundary_hidden.bias": (channels,), "boundary_output.weight": (1, channels), "boundary_output.bias": (1,)}
        tensors, parts, at = {}, [], 0
        for name, shape in shapes.items():
            size = int(np.prod(shape))
            tensors[name] = (at, size, list(shape))
            parts.append(rng.normal(0, 1 / np.sqrt(shape[-1] if len(shape) > 1 else 4), size))
            at += size
        encoded = base64.b64encode(np.concatenate(parts).astype("<f4").tobytes()).decode()
        return cls({"<unk>": 0} | {w: i + 1 for i, w in enumerate(vocabulary)}, channels, blocks, tensors, encoded, {"inputRepresentation": "unicode-context-v1"})

    def tensor(self, name: str) -> np.ndarray:
        """A view of the named weights, decoded at first use."""
        if name not in self.tensors:
            raise KeyError(f"the model has no tensor {name}")
        if self._weights is None:
            raw = base64.b64decode(self.encoded)
            if len(raw) % 4:
                raise ValueError("the weights are no whole number of floats")
            self._weights = np.frombuffer(raw, "<f4")
        at, size, shape = self.tensors[name]
        return self._weights[at : at + size].reshape(shape)

    @property
    def context(self) -> bool:
        return self.metadata.get("inputRepresentation", "han-only-v1") == "unicode-context-v1"

    def info(self) -> dict:
        return {"format": self.metadata.get("format", "random-f32-v1"), "input_representation": self.metadata.get("inputRepresentation", "han-only-v1"), "vocabulary_size": len(self.vocabulary), "channels": self.channels, "residual_blocks": self.blocks, "convolution_layers": 2 * self.blocks, "parameters": sum(n for _, n, _ in self.tensors.values())}


def model_info(spark: SparkSession, model: ModelFile) -> DataFrame:
    row = model.info()
    return spark.createDataFrame([tuple(row.values())], "format string, input_representation string, vocabulary_size int, channels int, residual_blocks int, convolution_layers int, parameters long")


def read_model(spark: SparkSession, path: str) -> ModelFile:
    """Reads a model from any path that Spark reads."""
    return ModelFile.parse(spark.read.text(path, wholetext=True).first()[0])
