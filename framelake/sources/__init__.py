"""Media sources and sinks: readers over binaryFile, Python data sources for containers, and file writers."""

from .files import images, numbered, read_audio, read_images, read_photos, read_subtitles, write_files
from .containers import register

__all__ = ["images", "numbered", "read_audio", "read_images", "read_photos", "read_subtitles", "register", "write_files"]
