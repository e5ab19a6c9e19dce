"""Gap-filled gridded surfaces from scattered points, as Spark DataFrame plans."""

from importlib import import_module

__version__ = "0.1.0"

#: Public names by module; they load on first use, so that Python workers load only what they run.
_MODULES = {
    "gridloom.functions.transforms": ("PercentileTransform", "make_transform", "transforms"),
    "gridloom.operators.calibrate": ("blocked_cv_skill", "calibrate_fill_cap", "choose_transform", "icc"),
    "gridloom.operators.cells": ("bin_points", "box_count", "downsample_sum", "upsample_bilinear", "upsample_nearest"),
    "gridloom.operators.surface": ("pull_push", "pull_push_frames", "surface"),
    "gridloom.plans.pipeline": ("Pipeline", "run"),
    "gridloom.spec": ("NODATA", "GridSpec", "pad_to_pyramid"),
}
_WHERE = {name: module for module, names in _MODULES.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_WHERE[name]), name)
