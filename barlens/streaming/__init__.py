"""Structured Streaming form of the incremental load."""

from barlens.streaming.feed_stream import load_batch, start_feed_load

__all__ = ["load_batch", "start_feed_load"]
