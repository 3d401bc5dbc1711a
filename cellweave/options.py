"""Options of the engine, passed explicitly; fields can be preset in the session under ``cellweave.<field>``."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


#: Options of the survey that have no effect here: an error wherever they are set.
UNSUPPORTED = ("finalize_through_stages", "pairwise_join_limit")


@dataclass(frozen=True)
class Options:
    derive_nice_names: bool = True
    reduced_orientations: bool = False
    check_entrapment_on_full_overlap: bool = True
    finalize_till: str = "collate"
    collate_on_whole: bool = True
    delink_corner_headers: bool = False
    focus_range: tuple[float, float] = (float("-inf"), float("inf"))
    focus_absolute_range: tuple[float, float] = (0.0, float("inf"))
    single_block_filter: bool = False
    single_block_share: float = 0.75

    @classmethod
    def of(cls, spark: SparkSession, **given: object) -> "Options":
        """Given values first, then the session's, then the defaults."""
        preset = [f for f in UNSUPPORTED if spark.conf.get(f"cellweave.{f}", None) is not None]
        if preset:
            raise ValueError(f"not supported: {', '.join(preset)}")
        out = cls()
        for f in fields(cls):
            preset = spark.conf.get(f"cellweave.{f.name}", None)
            if preset is not None and f.name not in given:
                old = getattr(out, f.name)
                if isinstance(old, bool):
                    value: object = preset.lower() == "true"
                elif isinstance(old, tuple):
                    value = tuple(float(x) for x in preset.split(","))
                else:
                    value = type(old)(preset)
                out = replace(out, **{f.name: value})
        return replace(out, **given)
