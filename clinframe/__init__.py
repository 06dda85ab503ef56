"""clinframe: longitudinal patient-record analytics as Spark DataFrame operators."""

from clinframe.schema import VisitSchema

__all__ = ["VisitSchema"]
