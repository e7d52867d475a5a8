"""The folder that driver and executors share, and tables written there to cut lineage."""

from sabermill.sources.scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
