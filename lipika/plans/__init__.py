"""Whole jobs: configuration, an index in a folder, and the command line."""

from .config import SearchConfig, load_config, make_config

__all__ = ["SearchConfig", "load_config", "make_config"]
