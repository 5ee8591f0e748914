"""Streaming forms of the operators, for files and events that keep coming."""

from .streams import image_stream, level_stream, silence_stream

__all__ = ["image_stream", "level_stream", "silence_stream"]
