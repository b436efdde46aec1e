"""Fixed table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


WINDOW_METADATA = _struct(
    dataset_id=S, subject_id=S, edf_id=S, window_index=L, start_sec=D, end_sec=D, label=I, sampling_rate=D,
    n_channels=I, n_samples=I,
)
PREDICTIONS = _struct(
    dataset_id=S, subject_id=S, edf_id=S, window_index=L, start_sec=D, end_sec=D, y_true=I, y_pred=I, y_prob=D,
)
ANNOTATIONS = _struct(subject_id=S, edf_id=S, start_sec=D, end_sec=D)
SPLIT_MANIFEST = _struct(
    format_version=I, split_type=S, dataset=S, train=T.ArrayType(S), validation=T.ArrayType(S), test=T.ArrayType(S),
    all_subjects=T.ArrayType(S),
)
