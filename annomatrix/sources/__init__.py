from .blocks import BlockMatrix, read_blocks, to_blocks
from .bundles import Bundle, create_bundle
from .h5ad import read_h5ad
from .tables import read_matrix, write_matrix
from .triplets import from_arrays, from_dense, from_nested, from_triplets

__all__ = ["BlockMatrix", "Bundle", "create_bundle", "from_arrays", "from_dense", "from_nested", "from_triplets", "read_blocks", "read_h5ad", "read_matrix", "to_blocks", "write_matrix"]
