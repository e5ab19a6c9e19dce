"""Grid geometry: cells, pyramid depth, tiles and their halos."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: The raster sentinel, and the support of a cell without data anywhere above it.
NODATA = -32768
UNRESOLVED_M = 1e9
INT16_MAX = 32767


def pad_to_pyramid(n: int, levels: int) -> int:
    """The least multiple of 2 ** levels that is not below n."""
    return -(-n // (1 << levels)) << levels


def levels_for(cap_m: float, res: float) -> int:
    """Pyramid depth whose coarsest cell spans the cap."""
    return max(1, math.ceil(math.log2(max(cap_m / res, 2.0))))


@dataclass(frozen=True)
class GridSpec:
    """Geometry of one surface; every limit is checked on construction.

    Cells are half open, [x0 + ix * res, x0 + (ix + 1) * res).  Tiles are a multiple of the
    coarsest cell, so that a tile with its halo gives the same values as the whole grid.
    """

    x0: float
    y0: float
    res: float
    nx: int
    ny: int
    levels: int
    cap_m: float
    block: int = 2048
    saturation: float = 1.0
    scale: float = 100

    def __post_init__(self) -> None:
        for name, least in (("res", 0), ("saturation", 0), ("scale", 0)):
            if not getattr(self, name) > least:
                raise ValueError(f"{name} must be positive, not {getattr(self, name)}")
        if self.cap_m < 0:
            raise ValueError(f"the cap must not be negative, not {self.cap_m}")
        if self.block < 1:
            raise ValueError(f"block must be at least 1, not {self.block}")
        check_scale(self.scale)
        if (reach := self.raw_halo) > max(self.block, self.step):
            raise ValueError(f"halo ({reach}) exceeds block size ({max(self.block, self.step)}): lower the cap or raise the block size (cap {self.cap_m / 1000:g} km, res {self.res:g}, block {self.block})")

    @property
    def step(self) -> int:
        return 1 << self.levels

    @property
    def raw_halo(self) -> int:
        return max(math.ceil(self.cap_m / self.res) + 2, self.step)

    @property
    def halo(self) -> int:
        """Cells around a tile that its values depend on, as a multiple of the coarsest cell."""
        return pad_to_pyramid(self.raw_halo, self.levels)

    @property
    def tile(self) -> int:
        return pad_to_pyramid(max(self.block, self.step), self.levels)

    @property
    def radius(self) -> int:
        """The cap in cells, half to even."""
        return round(self.cap_m / self.res)

    @property
    def padded(self) -> tuple[int, int]:
        return pad_to_pyramid(self.nx, self.levels), pad_to_pyramid(self.ny, self.levels)

    @classmethod
    def from_extent(cls, extent: tuple[float, float, float, float], res: float, cap_km: float, levels: int | None = None, **more) -> GridSpec:
        """Grid over (min x, min y, max x, max y), with its origin at the least coordinates."""
        if not res > 0:
            raise ValueError(f"res must be positive, not {res}")
        x0, y0, x1, y1 = extent
        cap_m = cap_km * 1000.0
        nx, ny = int((x1 - x0) // res) + 1, int((y1 - y0) // res) + 1
        return cls(x0, y0, res, nx, ny, levels_for(cap_m, res) if levels is None else levels, cap_m, **more)


def check_scale(scale: float) -> None:
    if scale * 100 > INT16_MAX:
        raise ValueError(f"scale {scale:g} exceeds int16 max: 100 * scale must be at most {INT16_MAX}")


def check_divisible(shape: tuple[int, int], levels: int) -> None:
    if any(n % (1 << levels) for n in shape):
        raise ValueError(f"grid dimensions must be divisible by 2 ** levels ({1 << levels}), not {shape}")
