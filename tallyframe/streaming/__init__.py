"""Finite streams. There is no unbounded source: standard input is read to its end, then scanned as a file."""

from __future__ import annotations

import shutil
import tempfile
from typing import BinaryIO


def spool(stream: BinaryIO, folder: str | None = None) -> str:
    """Copy a finite stream to a file in a folder that the executors can read; returns its path."""
    with tempfile.NamedTemporaryFile(dir=folder, prefix="spool-", suffix=".txt", delete=False) as f:
        shutil.copyfileobj(stream, f, 1 << 20)
        return f.name
