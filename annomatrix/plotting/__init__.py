from .scatter import plot_pca, plot_range, raster
from .settings import PcaPlotSettings

__all__ = ["PcaPlotSettings", "plot_pca", "plot_range", "raster"]
