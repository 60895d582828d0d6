"""Point-cloud and elevation-raster analytics as PySpark DataFrame operators."""

from terraframe.session import checkpointed, get_session

__all__ = ["checkpointed", "get_session"]
