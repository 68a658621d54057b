"""Synthetic frames behind Spark's own reader interface:

    spark.dataSource.register(SyntheticFrames)
    spark.read.format("plumbline_synthetic").option("defects", "clean,drops").option("n_eps", "4").load()

One partition makes one dataset.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .synth import DEFECTS, episodes

SCHEMA = "dataset string, timestamp float, frame_index long, episode_index long, action array<float>, state array<float>, pos long, fps double"
_KINDS = {"fps": float, "noise": float, "n_eps": int, "T": int, "n_joints": int, "lag": int, "seed": int}


@dataclass
class _Dataset(InputPartition):
    defect: str


class _Reader(DataSourceReader):
    def __init__(self, options):
        names = {k.lower(): k for k in _KINDS}
        self.settings = {names[k.lower()]: _KINDS[names[k.lower()]](v) for k, v in options.items() if k.lower() in names}
        asked = [d.strip() for d in options.get("defects", ",".join(d or "clean" for d in DEFECTS)).split(",")]
        self.defects = ["" if d == "clean" else d for d in asked]
        for d in self.defects:
            if d not in DEFECTS:
                raise ValueError(f"defect must be one of {DEFECTS}")

    def partitions(self):
        return [_Dataset(d) for d in self.defects]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        t = episodes(defect=partition.defect, **self.settings)
        n, name = t.num_rows, f"synthetic/{partition.defect or 'clean'}"
        columns = [pa.array([name] * n), *[c.combine_chunks() for c in t.columns], pa.array(np.arange(n)), pa.array([float(self.settings.get("fps", 30.0))] * n)]
        yield pa.RecordBatch.from_arrays(columns, names=["dataset", "timestamp", "frame_index", "episode_index", "action", "state", "pos", "fps"])


class SyntheticFrames(DataSource):
    @classmethod
    def name(cls):
        return "plumbline_synthetic"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
