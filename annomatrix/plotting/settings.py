"""How a scatter plot looks."""

from __future__ import annotations

from dataclasses import dataclass, replace

Color = tuple[int, int, int]


@dataclass(frozen=True)
class PcaPlotSettings:
    width: int = 800
    height: int = 600
    title: str = "PCA Plot"
    x_label: str = "PC1"
    y_label: str = "PC2"
    background: Color = (255, 255, 255)
    point_color: Color = (0, 0, 255)
    point_alpha: float = 0.5
    point_size: int = 2
    axes: tuple[int, int] = (0, 1)

    def with_dimensions(self, width: int, height: int) -> PcaPlotSettings:
        if min(width, height) < 120:
            raise ValueError("a plot has 120 pixels at least on each side")
        return replace(self, width=width, height=height)

    def with_title(self, title: str) -> PcaPlotSettings:
        return replace(self, title=title)

    def with_labels(self, x: str, y: str) -> PcaPlotSettings:
        return replace(self, x_label=x, y_label=y)

    def with_background_color(self, color: Color) -> PcaPlotSettings:
        return replace(self, background=color)

    def with_point_color(self, color: Color, alpha: float = 0.5) -> PcaPlotSettings:
        return replace(self, point_color=color, point_alpha=alpha)

    def with_point_size(self, size: int) -> PcaPlotSettings:
        return replace(self, point_size=size)

    def with_axes(self, x: int, y: int) -> PcaPlotSettings:
        return replace(self, axes=(x, y))
