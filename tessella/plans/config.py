"""Program configurations: typed, unknown keys refused, as YAML."""

from __future__ import annotations

from pathlib import Path
from typing import Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field, model_validator


class Model(BaseModel):
    model_config = ConfigDict(extra="forbid")


class ProgramConfig(Model):
    @classmethod
    def from_yaml(cls, text_or_path: str):
        text = Path(text_or_path).read_text() if "\n" not in text_or_path and text_or_path.endswith((".yaml", ".yml")) else text_or_path
        return cls.model_validate(yaml.safe_load(text) or {})

    def to_yaml(self) -> str:
        return yaml.safe_dump(self.model_dump(mode="json"), sort_keys=False)


class PolarGridConfig(Model):
    kind: Literal["spiral", "offset"] = "spiral"
    num_radius: int = Field(32, ge=4)
    num_angle: int | None = Field(None, ge=1)


class WhiteningConfig(ProgramConfig):
    images: str
    output: str
    bins: int = Field(64, ge=2)
    band_cutoff: float = Field(0.45, gt=0)
    band_falloff: float = Field(0.05, gt=0)
    max_freq: float | None = 0.5


class DecomposeConfig(ProgramConfig):
    volume: str
    output: str
    nside: int = Field(1, ge=1)
    polar: PolarGridConfig = PolarGridConfig()
    eig_max: int = Field(8, ge=1)
    k_max: int | None = Field(None, ge=1)
    pad: float = Field(2.0, ge=1)
    normalize_projections: bool = True
    low_rank: bool = False
    whitening: str | None = None


class SuggestTarget(Model):
    max_error: float | None = Field(None, gt=0)
    max_components: int | None = Field(None, ge=1)


class CalibrateConfig(ProgramConfig):
    decomposition: str
    output: str
    rectangles: list[tuple[int, int, int, int]] = []
    suggest: list[SuggestTarget] = []
    noise_tables: list[list[tuple[int, int, int, int]]] = []
    bins: int = Field(64, ge=2)

    @model_validator(mode="after")
    def _some(self):
        if not self.rectangles and not self.suggest and not self.noise_tables:
            raise ValueError("give rectangles or noise tables to make, or targets to suggest rectangles for")
        return self


class CalibrationConfig(Model):
    alpha: float = Field(0.01, gt=0, lt=1)
    zeta: float = Field(1.0, gt=0)
    eps_rho: float = Field(0.0, ge=0)
    b_factor: float = Field(0.0, ge=0)


class DecisionConfig(Model):
    threshold: float | Literal["auto"] = "auto"
    accept: bool = True
    reject: bool = True
    absorb_radius: float | None = None
    calibration: CalibrationConfig | None = None


class MicrographConfig(Model):
    """The optics of one image; planes are its mean defocus plus the search's offsets."""

    defocus_u: float
    defocus_v: float
    astigmatism_angle: float = 0.0


class StageConfig(Model):
    rectangles: list[tuple[int, int, int, int]]
    n_psi: int = Field(ge=2)
    planes: list[int] | None = None
    level: int | None = Field(None, ge=0)
    rings: int | None = Field(None, ge=0)
    orientations: list[int] | None = None
    decision: DecisionConfig = DecisionConfig()


class SearchConfig(ProgramConfig):
    images: str
    decomposition: str
    output: str
    defocus: list[float] = [0.0]
    masks: str | None = None
    pixel_size: float = Field(1.0, gt=0)
    voltage: float = Field(300.0, gt=0)
    spherical_aberration: float = 2.7
    amplitude_contrast: float = Field(0.07, ge=0, lt=1)
    phase_shift: float = 0.0
    micrographs: dict[str, MicrographConfig] = {}
    invert: bool = False
    whitening: str | None = None
    error_tables: str | None = None
    prepared: str | None = None
    execution: dict = {}
    save_stages: bool = True
    stages: list[StageConfig]

    @model_validator(mode="after")
    def _noise_model(self):
        if any(s.decision.calibration for s in self.stages) and not (self.whitening and self.error_tables):
            raise ValueError("a calibrated decision needs whitening and error_tables")
        if self.stages and self.stages[0].rings is not None:
            raise ValueError("the first stage has no seeds to be local about")
        return self


class ExportConfig(ProgramConfig):
    result: str
    output: str
    radius: float = Field(gt=0)
    pixel_size: float = Field(1.0, gt=0)
    optics: dict[str, float | str] = {}


PROGRAMS = {"whitening": WhiteningConfig, "decompose": DecomposeConfig, "calibrate": CalibrateConfig, "search": SearchConfig, "export": ExportConfig}


def example(name: str) -> str:
    """A configuration with every default; required values are marked."""
    fields = PROGRAMS[name].model_fields
    lines = []
    for key, f in fields.items():
        value = "<required>" if f.is_required() else f.get_default(call_default_factory=True)
        value = value.model_dump(mode="json") if isinstance(value, BaseModel) else value
        lines.append(yaml.safe_dump({key: value}, sort_keys=False).strip())
    return "\n".join(lines) + "\n"
