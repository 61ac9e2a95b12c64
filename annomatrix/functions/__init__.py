from .numeric import finite, log1p_ieee, skip_nan

__all__ = ["finite", "log1p_ieee", "skip_nan"]
