"""Tables in the folder that all machines share: the library's own."""

from ..sources.shared import append, cut, shared_folder, uncut

__all__ = ["append", "cut", "shared_folder", "uncut"]
