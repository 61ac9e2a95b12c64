from .dense import to_dense, to_dense_selected
from .features import select_features
from .filters import filter_genes, filter_cells, filter_obs, filter_var
from .pca import PcaResult, gram, pca
from .selection import select_indices, select_mask, select_slice
from . import stats
from .stats import axis_stats, compute_min_max, compute_number, compute_std_dev, compute_sum, compute_variance, qc, qc_variables
from .transforms import log1p, normalize_total
from .positions import reindex, slice_positions, take_positions
from .neighbors import nearest
from .embedding import tsne
from .components import PrincipalComponents, PrincipalComponentsModel, SvdResult, apply_components, fit_components, svd

__all__ = [
    "PcaResult",
    "PrincipalComponents",
    "PrincipalComponentsModel",
    "SvdResult",
    "apply_components",
    "axis_stats",
    "compute_min_max",
    "compute_number",
    "compute_std_dev",
    "compute_sum",
    "compute_variance",
    "filter_cells",
    "filter_genes",
    "filter_obs",
    "filter_var",
    "fit_components",
    "gram",
    "log1p",
    "nearest",
    "normalize_total",
    "pca",
    "qc",
    "qc_variables",
    "reindex",
    "select_features",
    "select_indices",
    "select_mask",
    "select_slice",
    "slice_positions",
    "svd",
    "take_positions",
    "to_dense",
    "to_dense_selected",
    "tsne",
]
