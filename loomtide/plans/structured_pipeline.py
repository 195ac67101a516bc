"""A pipeline over annotated samples: the image pipeline's steps, moving boxes, masks and keypoints along."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import selection, structured
from ..operators.rng import Context, combine, op_key
from .pipeline import Ops, PipelineError


@dataclass(frozen=True)
class StructuredPipeline(Ops):
    """``df`` has the columns of ``structured.SCHEMA``, pos dense from 0. Steps are checked as they are added, nested ones
    too; each kind counts its own occurrences, so draws are those of the row and step, whatever the batches are."""

    df: DataFrame
    steps: tuple = ()
    seed_: int = 0
    epoch_: int = 0
    batch_: tuple[int, bool] | None = None
    shuffled: bool = False

    def _add(self, name: str, **args) -> StructuredPipeline:
        if self.batch_:
            raise PipelineError(f"{name} comes after batch")
        try:
            structured.checked([(name, args)])
        except ValueError as e:
            raise PipelineError(str(e)) from None
        return replace(self, steps=(*self.steps, (name, args)))

    def seed(self, seed: int) -> StructuredPipeline:
        return replace(self, seed_=seed)

    def epoch(self, epoch: int) -> StructuredPipeline:
        return replace(self, epoch_=epoch)

    def workers(self, n: int) -> StructuredPipeline:
        """A hint that never changes results."""
        return self

    def shuffle(self) -> StructuredPipeline:
        return replace(self, shuffled=True)

    def clamp_boxes(self) -> StructuredPipeline:
        return self._add("ClampBoxes")

    def sanitize(self, min_size: float = 1.0, min_area: float = 1.0) -> StructuredPipeline:
        return self._add("Sanitize", min_size=min_size, min_area=min_area)

    def random_iou_crop(self, **options) -> StructuredPipeline:
        try:
            return self._add("RandomIoUCrop", **structured.iou_crop_options(**options))
        except ValueError as e:
            raise PipelineError(str(e)) from None

    def batch(self, size: int, drop_last: bool = False) -> StructuredPipeline:
        if size <= 0:
            raise PipelineError("batch size must be positive")
        return replace(self, batch_=(size, drop_last))

    def execute(self) -> DataFrame:
        """Rows of ``structured.SCHEMA`` with source (the row before the shuffle), and batch_id and batch_pos after batch().
        The images of a batch have one shape where they are stacked; rows keep their own here."""
        df = self.df.withColumn("source", F.col("pos"))
        if self.shuffled:
            # the order of the stream of row 0 and the step StructuredShuffle
            state = combine(combine(Context(self.seed_, self.epoch_).root, 0), op_key("StructuredShuffle"))
            n = df.count()
            df = selection.drawn_shuffle(df, n, state)
        if self.batch_:
            df = selection.batch(df, *self.batch_)
        return structured.transformed(df, list(self.steps), self.seed_, self.epoch_)
