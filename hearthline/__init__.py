"""Market analytics, segment forecasts and retrieval scoring as Spark DataFrame jobs."""

from hearthline.runtime import session, shared_folder

__all__ = ["session", "shared_folder"]
