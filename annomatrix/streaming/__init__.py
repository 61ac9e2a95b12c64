from .growing import GrowingStatistics
from .stats import read_entry_stream, streaming_axis_stats

__all__ = ["GrowingStatistics", "read_entry_stream", "streaming_axis_stats"]
