"""What a stage will do, decided before it does it: hypotheses, feature form, bands of positions, blocks of templates.

A plan is a value. Limits are bytes of one Python worker; they decide on time and memory, never on results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from tessella.operators import correlate as C

PRECISIONS = {"fp32": 8, "fp64": 16}  # bytes of a complex number


def check_precision(name: str) -> str:
    """A precision that features can have here. Half precision has no type in Spark."""
    if name not in PRECISIONS:
        raise ValueError(f"unknown precision {name!r}; known: {', '.join(PRECISIONS)}")
    return name


@dataclass(frozen=True)
class Execution:
    """Limits of a search, in bytes of a worker but for ``broadcast``, which is that of a block of templates."""

    features: int = 256 << 20
    spectrum: int = 128 << 20
    broadcast: int = C.BROADCAST_LIMIT
    precision: str = "fp64"
    mode: str | None = None  # direct or fft; None lets the plan choose
    contraction: str | None = None  # planar or adjoint; None lets the plan choose

    def __post_init__(self):
        check_precision(self.precision)
        if min(self.features, self.spectrum, self.broadcast) < 1:
            raise ValueError("limits are positive numbers of bytes")
        if self.mode not in (None, "direct", "fft"):
            raise ValueError(f"unknown mode {self.mode!r}")


def execution_config(spec: dict | None) -> Execution:
    """The execution options of a configuration; unknown ones are refused."""
    known = {f.name for f in fields(Execution)}
    if unknown := set(spec or {}) - known:
        raise ValueError(f"unknown execution options: {', '.join(sorted(unknown))}")
    return Execution(**(spec or {}))


def feature_bytes_per_pixel(groups: Sequence[tuple[C.Rect, str, int]]) -> int:
    """Of one position's features over groups (rectangle, precision, planes)."""
    return sum(planes * rect[2] * rect[3] * PRECISIONS[check_precision(precision)] for rect, precision, planes in groups)


def choose_mode(positions: int, selected: int, image: tuple[int, int], box: tuple[int, int]) -> str:
    """Direct features for a center, for images hardly larger than the box, or for few positions; else by transforms."""
    close = max(image[0] - box[0], image[1] - box[1]) <= 32
    return "direct" if image == box or close or selected <= 0.02 * positions else "fft"


def choose_tile(sizes: Sequence[int], *, n_planes: int, width: int, cells: int, n_freq: int, n_psi: int, choices: Sequence[int] = (8, 16, 32, 64, 128, 256)) -> int:
    """How many pixels of a neighborhood are taken at once: the choice that moves the fewest bytes. A tile reads its
    templates once and is filled up to its size, so large tiles waste room where groups are small."""
    pixel = n_planes * (16 * cells + width * (24 * n_freq + 8 * n_psi))
    moved = {t: sum(-(-s // t) for s in sizes) * (t * pixel + 16 * width * cells) for t in choices}
    return min(choices, key=lambda t: (moved[t], t))


@dataclass(frozen=True)
class Memory:
    """Positions whose features are held at once, and templates per contraction with how many of these positions."""

    positions: int
    pixels: int
    templates: int


def plan_memory(cells: int, n_freq: int, n_psi: int, n_templates: int, execution: Execution = Execution()) -> Memory:
    positions = max(1, execution.features // max(1, cells * 16))
    pair = 16 * n_freq + 8 * n_psi + 16  # spectrum, angles, and what the transform needs of one position and template
    pairs = max(1, execution.spectrum // pair)
    templates = max(1, min(n_templates, 256, pairs))
    return Memory(positions, max(1, min(positions, pairs // templates)), templates)


def plan_bands(out: tuple[int, int], cells: int, execution: Execution = Execution()) -> int:
    """Rows of positions in a band: as many as let all its features fit, at least one."""
    return max(1, min(out[0], execution.features // max(1, out[1] * cells * 16)))


@dataclass(frozen=True)
class StagePlan:
    planes: tuple[int, ...]
    n_templates: int
    cells: int
    memory: Memory
    blocks: tuple[tuple[int, int], ...]  # template rows, end exclusive
    mode: str | None
    precision: str = "fp64"
    local: bool = False
    passes: int = field(default=1)

    @property
    def n_hypotheses(self) -> int:
        return len(self.planes) * self.n_templates


def plan_stage(stage, n_planes: int, n_templates: int, execution: Execution = Execution()) -> StagePlan:
    """Of a stage over ``n_templates`` selected rows. A selection beyond what is there, or of nothing, is refused."""
    planes = tuple(range(n_planes)) if stage.planes is None else tuple(sorted(set(stage.planes)))
    if not planes or planes[0] < 0 or planes[-1] >= n_planes:
        raise ValueError(f"planes {planes} of {n_planes}")
    if n_templates < 1:
        raise ValueError("a stage selects no template")
    if n_planes * n_templates * stage.n_psi >= 1 << 63:
        raise ValueError("more hypotheses than a long counts")
    k_stop, m_stop = max(r[0] + r[2] for r in stage.rectangles), max(r[1] + r[3] for r in stage.rectangles)
    cells = len({(k, m) for k0, m0, ke, me in stage.rectangles for k in range(k0, k0 + ke) for m in range(m0, m0 + me)})
    size = max(1, execution.broadcast // (k_stop * m_stop * 16))
    blocks = tuple((lo, min(lo + size, n_templates)) for lo in range(0, n_templates, size))
    return StagePlan(planes, n_templates, cells, plan_memory(cells, k_stop, stage.n_psi, n_templates, execution), blocks, execution.mode, execution.precision, stage.rings is not None, math.ceil(n_templates / size))
