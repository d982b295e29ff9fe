"""Run configuration."""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass

MODES = ("scatter", "cluster_mid", "cluster_tight", "stacking", "close_far")


@dataclass(frozen=True)
class SceneConfig:
    glbs: str
    out: str
    scenes: int = 100
    products_per_scene: int = 6
    cameras_per_scene: int = 6
    resolution: int = 640
    seed: int = 0
    hdri: str | None = None
    cameras_json: str | None = None
    backgrounds: str | None = None
    placement: str = "scatter"
    n_close: int = 3
    n_far: int = 1
    attempts: int = 3

    def __post_init__(self) -> None:
        if self.placement not in MODES:
            raise ValueError(f"unknown placement {self.placement}")
        if self.scenes < 0 or self.products_per_scene < 1 or self.cameras_per_scene < 1 or self.attempts < 1:
            raise ValueError("scenes must be 0 or more; products, cameras and attempts 1 or more")

    @staticmethod
    def from_args(argv: list[str]) -> SceneConfig:
        """Options as --name value; where a bare -- occurs, only what follows counts."""
        argv = argv[argv.index("--") + 1 :] if "--" in argv else argv
        p = argparse.ArgumentParser()
        for name, field in SceneConfig.__dataclass_fields__.items():
            required = name in ("glbs", "out")
            kind = int if field.type == "int" else str
            p.add_argument("--" + name.replace("_", "-"), dest=name, type=kind, required=required, default=None if required else field.default)
        return SceneConfig(**vars(p.parse_args(argv)))


@dataclass(frozen=True)
class SizingConfig:
    bundle: str
    redo: bool = False
    api_key: str | None = None

    @staticmethod
    def from_env(key: str = "TEXT_MODEL_API_KEY", **options) -> SizingConfig:
        return SizingConfig(api_key=os.environ.get(key), **options)
