"""Schemas and fixed values of the inputs."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


TRACK_FILE = _struct(frame=T.ShortType(), type=T.StringType(), landmark_index=T.ShortType(),
                     x=T.DoubleType(), y=T.DoubleType(), z=T.DoubleType())
CATALOG = _struct(path=T.StringType(), participant_id=T.LongType(), sequence_id=T.LongType(),
                  sign=T.StringType())
ARCHIVE_FRAMES = "id string, label string, fps float, frame int, row smallint, x float, y float, z float"

# The fields of run records and their parts.
METRICS = _struct(train_val_acc=T.DoubleType(), eval_status=T.StringType(),
                  overall_accuracy=T.DoubleType(), macro_accuracy=T.DoubleType(),
                  median_class_accuracy=T.DoubleType(), n_classes_below_50pct=T.LongType())
SUBMISSION = _struct(tested=T.BooleanType(), platform=T.StringType(), submitted_at=T.StringType(),
                     public_score=T.DoubleType(), private_score=T.DoubleType(),
                     reference=T.StringType(), notes=T.StringType())
RUN = _struct(
    schema_version=T.LongType(), run_id=T.LongType(), created=T.StringType(), dataset=T.StringType(),
    architecture=T.StringType(), model_name=T.StringType(), streaming=T.BooleanType(),
    subset=T.StringType(), coords=T.StringType(), n_landmarks=T.LongType(), feature_dim=T.LongType(),
    n_classes=T.LongType(), n_params=T.LongType(),
    split=_struct(strategy=T.StringType(), random_state=T.LongType(), n_val=T.LongType()),
    training=_struct(regime=T.StringType(), source=T.StringType(), epoch_cap=T.LongType(),
                     epochs_trained=T.LongType(), best_epoch=T.LongType(),
                     early_stopped=T.BooleanType(), finished=T.BooleanType(),
                     wall_time_min=T.DoubleType()),
    hyperparameters=T.MapType(T.StringType(), T.StringType()), metrics=METRICS,
    checkpoints=T.MapType(T.StringType(), T.StringType()),
    assets=T.MapType(T.StringType(), T.StringType()), submission=SUBMISSION, notes=T.StringType())
HISTORY = _struct(**{c: T.ArrayType(T.DoubleType())
                     for c in ("train_loss", "train_acc", "val_loss", "val_acc", "lr")})

# Rows of the 543-channel layout, (group, first row, size).
CHANNEL_LAYOUT = [("face", 0, 468), ("left_hand", 468, 21), ("pose", 489, 33), ("right_hand", 522, 21)]
SCHEMA_VERSION = 3
MAX_SEQ_LEN = 128
DAILY_LIMIT = 100

# Component groups as rows of the 543-channel layout.
LIPS = [0, 13, 14, 17, 37, 39, 40, 61, 78, 80, 81, 82, 84, 87, 88, 91, 95, 146, 178, 181, 185, 191,
        267, 269, 270, 291, 308, 310, 311, 312, 314, 317, 318, 321, 324, 375, 402, 405, 409, 415]
RIGHT_EYE = [7, 33, 133, 144, 145, 153, 154, 155, 157, 158, 159, 160, 161, 163, 173, 246]
LEFT_EYE = [249, 263, 362, 373, 374, 380, 381, 382, 384, 385, 386, 387, 388, 390, 398, 466]
NOSE = [1, 2, 98, 327]
LEFT_HAND = list(range(468, 489))
RIGHT_HAND = list(range(522, 543))
UPPER_BODY_POSE = [489 + i for i in (11, 12, 13, 14, 15, 16, 23, 24)]
POSE_HAND_POINTS = [489 + i for i in (17, 18, 19, 20, 21, 22)]
# Subsets as unions of component groups, with the size each must have.
_HANDS = [LEFT_HAND, RIGHT_HAND]
_FACE = [LIPS, RIGHT_EYE, LEFT_EYE, NOSE]
CHANNEL_SUBSETS = {
    "FULL_543": ([list(range(543))], 543),
    "FP_118": (_HANDS + _FACE, 118),
    "ME_126": (_HANDS + _FACE + [UPPER_BODY_POSE], 126),
    "ME_132": (_HANDS + _FACE + [UPPER_BODY_POSE, POSE_HAND_POINTS], 132),
    "HANDS_42": (_HANDS, 42),
    "HANDS_POSE_50": (_HANDS + [UPPER_BODY_POSE], 50),
}
