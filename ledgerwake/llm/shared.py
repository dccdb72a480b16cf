"""The folder that driver and executors share, and tables written to it."""

from ..staging import remove, shared_dir, shared_path, written

__all__ = ["remove", "shared_dir", "shared_path", "written"]
