"""PySpark-native scorecard for tables: quality, safety and rights, slice by slice."""

from .plans.assess import AssessmentConfig, assess
from .session import build_session

__all__ = ["AssessmentConfig", "assess", "build_session"]
