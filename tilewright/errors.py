"""Errors and warnings of the raster operators."""

from __future__ import annotations

from typing import Any


class TilewrightError(Exception):
    """Base of all errors; keyword arguments are kept in ``context``."""

    def __init__(self, message: str = "", **context: Any):
        super().__init__(message)
        self.context = context


class CRSError(TilewrightError):
    """A coordinate system can't be read or used."""


class MissingCRSError(CRSError):
    """A coordinate system is needed and there is none."""


class TilingError(TilewrightError):
    """A tile grid can't be made."""


class ModelError(TilewrightError):
    """A model or its input can't be used."""


class BandError(TilewrightError):
    """Bands can't be chosen or normalised."""


class ExportError(TilewrightError):
    """A result can't be written."""


class GSDWarning(UserWarning):
    """A raster's ground sampling distance is out of the useful range."""
