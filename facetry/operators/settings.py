"""Settings of an adaptation with their defaults, and what makes them inconsistent."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    dimension: int = 3
    iterations: int = 3
    good_quality: float | None = None  # 0.027 in three dimensions, 0.2 in two
    most_ratio: float | None = None  # of edge lengths: 100 in three dimensions, 2 in two
    most_imbalance: float = 1.10
    refine: bool = True
    coarsen: bool = True
    snap: bool = False
    has_model: bool = False

    def filled(self) -> Settings:
        """With defaults that depend on the dimension."""
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        values["good_quality"] = self.good_quality if self.good_quality is not None else (0.027 if self.dimension == 3 else 0.2)
        values["most_ratio"] = self.most_ratio if self.most_ratio is not None else (100.0 if self.dimension == 3 else 2.0)
        return Settings(**values)

    def faults(self) -> list[str]:
        """What does not fit together; empty if all does."""
        s, out = self.filled(), []
        if s.dimension not in (2, 3):
            out.append("dimension")
        if s.iterations < 0 or s.iterations > 10:
            out.append("iterations")
        if not 0 < s.good_quality <= 1:
            out.append("good_quality")
        if s.most_ratio <= 1:
            out.append("most_ratio")
        if s.most_imbalance < 1:
            out.append("most_imbalance")
        if s.snap and not s.has_model:
            out.append("snap")
        return out
