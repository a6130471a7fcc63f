"""Running an embedding model over units: in batches, a model a worker, results in the order of the units."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Units that a model gets at a time. Fixed value.
BATCH = 16
#: Units that take a model seconds each, and so go alone.
ALONE = ("audio", "video")

Model = Callable[[str, list[str]], Sequence[Sequence[float]]]
#: Models of this worker process, by name; a worker that is used again for the next task has its model already.
_models: dict[str, Model] = {}


@dataclass(frozen=True)
class Runner:
    """`load` makes the model, once in each worker process: a function of a modality and inputs that gives a vector for each. `name` tells models
    apart; `modalities` are those that it reads, `dim` the length of its vectors."""

    name: str
    load: Callable[[], Model]
    dim: int
    modalities: tuple[str, ...] = ("text", "image", "query")
    batch: int = BATCH

    def model(self) -> Model:
        if self.name not in _models:
            _models[self.name] = self.load()
        return _models[self.name]


def batches_of(modalities: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive units of one modality, `size` at most; units of sound and film one by one."""
    at = 0
    while at < len(modalities):
        most = 1 if modalities[at] in ALONE else size
        to = at + 1
        while to < len(modalities) and to - at < most and modalities[to] == modalities[at]:
            to += 1
        yield at, to
        at = to


def embed_units(units: DataFrame, runner: Runner) -> DataFrame:
    """`units` (with modality and input) with vector: null for a null input and for modalities that the model doesn't read.

    A model that gives another number of vectors than it got inputs, or one of another length, is an error. Columns pass through but for one
    named vector, which is replaced. What a task holds is an Arrow batch of units, what the model gets at a time runner.batch of them.
    """
    rows = units.drop("vector")
    at = {name: rows.columns.index(name) for name in ("modality", "input")}

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            modalities, inputs = (frame.column(at[name]).to_pylist() for name in ("modality", "input"))
            vectors: list[list[float] | None] = [None] * frame.num_rows
            todo = [i for i in range(frame.num_rows) if modalities[i] in runner.modalities and inputs[i] is not None]
            for from_, to in batches_of([modalities[i] for i in todo], runner.batch):
                own = todo[from_:to]
                made = runner.model()(modalities[own[0]], [inputs[i] for i in own])
                if len(made) != len(own):
                    raise ValueError(f"{runner.name} gave {len(made)} vectors for {len(own)} inputs")
                for i, vector in zip(own, made, strict=True):
                    if len(vector) != runner.dim:
                        raise ValueError(f"{runner.name} gave a vector of length {len(vector)} instead of {runner.dim}")
                    vectors[i] = [float(x) for x in vector]
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*frame.schema.names, "vector"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, vector array<float>")
