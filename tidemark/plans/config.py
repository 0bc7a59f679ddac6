"""Settings of the analysis, with their ranges."""

from __future__ import annotations

import math
import os
import tomllib
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Thresholds and weights. Defaults and ranges are fixed values of the analysis."""

    video_sample_fps: float = 10.0
    max_video_pixels: int = 40_000_000
    max_video_dimension: int = 8192
    max_video_duration_seconds: float = 14_400.0
    analysis_width: int = 768
    stable_frames: int = 5
    motion_threshold: float = 0.012
    turn_threshold: float = 0.025
    candidates_per_spread: int = 7
    processing_workers: int = 3
    candidate_selection_mode: str = "spread"
    output_layout: str = "spread"
    sharpness_weight: float = 1.0
    motion_weight: float = 2.0
    hand_overlap_weight: float = 8.0
    glare_overlap_weight: float = 6.0
    distortion_weight: float = 0.3
    flatness_weight: float = 0.2
    clipping_weight: float = 0.2
    exposure_weight: float = 0.3
    hand_backend: str = "mediapipe"
    hand_model: str = "models/hand_landmarker.task"
    hand_padding: float = 0.015
    finger_repair: bool = True
    glare_repair: bool = True
    finger_repair_min_coverage: float = 0.9
    finger_repair_fallback: str = "paper"
    page_background_fill: str = "paper"
    duplicate_hash_distance: int = 4
    duplicate_ssim: float = 0.985
    duplicate_suspect_ssim: float = 0.94
    dedupe_window: int = 3
    refine_quad: bool = True
    quad_max_shift: float = 0.025
    roi_tracking: bool = True
    roi_tracking_max_step: float = 0.08
    roi_tracking_max_total: float = 0.16
    perspective_mode: str = "spread"
    page_contour_min_confidence: float = 0.55
    split_mode: str = "auto"
    spine_ratio: float = 0.5
    gutter_fraction: float = 0.0
    reading_order: str = "rtl"
    image_format: str = "png"
    max_image_pixels: int = 60_000_000
    max_image_dimension: int = 12_000
    max_image_files: int = 5_000
    jpeg_quality: int = 92
    grayscale: bool = False
    contrast: float = 1.0
    illumination_correction: bool = True
    illumination_strength: float = 0.7
    white_normalization: bool = True
    white_target: int = 245
    white_strength: float = 0.6
    rotation: int = 0
    auto_rotation: bool = True
    dewarp_mode: str = "auto"
    dewarp_strength: float = 0.0
    dewarp_max_strength: float = 0.25
    dewarp_min_confidence: float = 0.6
    pdf_dpi: int = 300
    hwaccel: str = "videotoolbox"
    save_lowres: bool = False
    suspect_sharpness: float = 60.0
    suspect_hand_overlap: float = 0.015
    suspect_glare_overlap: float = 0.01
    interval_gap_factor: float = 3.0
    auto_high_fps_fallback: bool = True
    auto_high_fps_fallback_fps: float = 60.0
    auto_high_fps_min_stable_seconds: float = 0.18

    def problems(self) -> list[str]:
        """One line per rule that is broken."""
        found = []
        for f in fields(self):
            value, kind = getattr(self, f.name), f.type
            if kind == "int" and type(value) is not int:
                found.append(f"{f.name} must be an integer")
            elif kind == "float" and (type(value) not in (int, float) or not math.isfinite(value)):
                found.append(f"{f.name} must be a finite number")
            elif kind == "bool" and type(value) is not bool:
                found.append(f"{f.name} must be true or false")
            elif kind == "str" and not isinstance(value, str):
                found.append(f"{f.name} must be a string")
            elif f.name in RANGES and not RANGES[f.name][0] <= value <= RANGES[f.name][1]:
                found.append(f"{f.name} must lie in {RANGES[f.name][0]:g}..{RANGES[f.name][1]:g}")
            elif f.name.endswith("_weight") and value < 0:
                found.append(f"{f.name} must not be negative")
            elif f.name in CHOICES and value not in CHOICES[f.name]:
                found.append(f"{f.name} must be one of {', '.join(map(str, CHOICES[f.name]))}")
        # Rules on two settings make sense only where each is right by itself.
        if found:
            return found
        if self.finger_repair and self.hand_backend != "mediapipe":
            found.append("finger_repair needs a hand_backend")
        for low, high in NOT_BELOW:
            if getattr(self, high) < getattr(self, low):
                found.append(f"{high} must not be below {low}")
        return found

    def checked(self) -> Config:
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self

    @classmethod
    def of(cls, given: dict) -> Config:
        """Settings from named values; unknown names fail, some defaults depend on what is given."""
        if unknown := sorted(set(given) - {f.name for f in fields(cls)}):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        implied = {name: value for other, values, name, value in LEFT_OUT if given.get(other) in values}
        return cls(**{**IN_FILES, **implied, **given}).checked()

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """Settings from a TOML file, or the defaults; a model's path is relative to the file."""
        if path is None:
            return cls().checked()
        with open(path, "rb") as f:
            found = cls.of(tomllib.load(f))
        folder = os.path.dirname(os.path.abspath(path))
        return replace(found, hand_model=os.path.join(folder, os.path.expanduser(found.hand_model)))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The settings as a table of one row."""
        return spark.range(1).select(*[F.lit(getattr(self, f.name)).alias(f.name) for f in fields(self)])


#: Smallest and largest value of each setting.
RANGES = {
    "video_sample_fps": (1, 30),
    "max_video_pixels": (1_000_000, 40_000_000),
    "max_video_dimension": (1024, 8192),
    "max_video_duration_seconds": (60, 14_400),
    "analysis_width": (128, 1920),
    "stable_frames": (2, 100),
    "motion_threshold": (0.00001, 1),
    "turn_threshold": (0.00001, 1),
    "candidates_per_spread": (2, 30),
    "processing_workers": (1, 4),
    "hand_padding": (0, 0.1),
    "finger_repair_min_coverage": (0, 1),
    "duplicate_hash_distance": (0, 64),
    "duplicate_ssim": (0, 1),
    "duplicate_suspect_ssim": (0, 1),
    "dedupe_window": (1, 50),
    "quad_max_shift": (0, 0.1),
    "roi_tracking_max_step": (0.01, 0.25),
    "roi_tracking_max_total": (0.02, 0.4),
    "page_contour_min_confidence": (0, 1),
    "spine_ratio": (0.25, 0.75),
    "gutter_fraction": (0, 0.05),
    "max_image_pixels": (1_000_000, 60_000_000),
    "max_image_dimension": (1024, 12_000),
    "max_image_files": (1, 5_000),
    "jpeg_quality": (1, 100),
    "contrast": (0.5, 2),
    "illumination_strength": (0, 1),
    "white_target": (200, 255),
    "white_strength": (0, 1),
    "dewarp_strength": (0, 0.6),
    "dewarp_max_strength": (0, 0.35),
    "dewarp_min_confidence": (0, 1),
    "pdf_dpi": (36, 1200),
    "suspect_sharpness": (0, 100000),
    "suspect_hand_overlap": (0, 1),
    "suspect_glare_overlap": (0, 1),
    "interval_gap_factor": (1, 20),
    "auto_high_fps_fallback_fps": (10, 120),
    "auto_high_fps_min_stable_seconds": (0.1, 1.0),
}

#: Settings of a few values.
CHOICES = {
    "candidate_selection_mode": ("spread", "per_page"),
    "output_layout": ("spread", "split"),
    "hand_backend": ("mediapipe", "none"),
    "finger_repair_fallback": ("preserve", "paper", "white"),
    "page_background_fill": ("preserve", "paper", "white"),
    "perspective_mode": ("spread", "per_page"),
    "split_mode": ("center", "auto"),
    "reading_order": ("rtl", "ltr"),
    "image_format": ("png", "jpeg"),
    "rotation": (0, 90, 180, 270),
    "dewarp_mode": ("off", "manual", "auto"),
    "hwaccel": ("none", "videotoolbox"),
}

#: The second setting of a pair must not be below the first.
NOT_BELOW = [("motion_threshold", "turn_threshold"), ("roi_tracking_max_step", "roi_tracking_max_total"), ("duplicate_suspect_ssim", "duplicate_ssim")]

#: What given settings mean that leave another one out (setting, its values, the other, what it is).
LEFT_OUT = [("hand_backend", ("none",), "finger_repair", False), ("rotation", (90, 180, 270), "auto_rotation", False)]

#: What files mean that leave a setting out, where it isn't the default.
IN_FILES = {"page_background_fill": "preserve"}
