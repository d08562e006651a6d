"""Analytic queries, dataset curation and result scoring as PySpark DataFrame jobs."""

from tallyframe.session import shared_dir, tune

__all__ = ["shared_dir", "tune"]
