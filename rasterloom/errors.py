"""Typed errors. Each has a stable code and the HTTP status that a service would answer with."""

from __future__ import annotations


class GraphError(Exception):
    """The process graph is malformed: a cycle, a missing argument, a bad reference."""

    code, http_status = "InvalidProcessGraph", 400


class UnknownProcess(GraphError):
    code = "ProcessUnsupported"


class MissingBand(GraphError):
    code = "MissingBand"


class CrsMismatch(GraphError):
    code = "CrsMismatch"


class ResolutionMismatch(GraphError):
    code = "ResolutionMismatch"


class InvalidChunkPlan(GraphError):
    code = "InvalidChunkPlan"


class AuthError(Exception):
    code, http_status = "AuthenticationRequired", 401


class CatalogError(Exception):
    code, http_status = "Stac", 502


class IoError(Exception):
    code, http_status = "Io", 500


class BackendError(Exception):
    code, http_status = "Internal", 500
