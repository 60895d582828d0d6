"""Structured Streaming forms of the tile, thinning and view operators."""

from terraframe.streaming.incremental import stream_refine, stream_thin, stream_tile_stats

__all__ = ["stream_refine", "stream_thin", "stream_tile_stats"]
