"""Names and roles of the columns of a visit table (one row per record and time)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its literal name: lab names may hold dots, blanks, ``%`` and ``->``."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class VisitSchema:
    """Roles of the columns; every operator on visits takes one.

    ``tiebreak`` completes ``time`` to a total order within a record, so that no result
    depends on the order in which rows arrive.
    """

    key: str = "record_id"
    time: str = "record_time"
    tiebreak: tuple[str, ...] = ()
    patient: str | None = None
    admission: str | None = None
    targets: tuple[str, ...] = ()
    static: tuple[str, ...] = ()
    #: The static columns that are scaled, such as an age; codes like 0/1 are not.
    scaled_static: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()

    @property
    def labs(self) -> tuple[str, ...]:
        return self.categorical + self.numeric

    @property
    def features(self) -> tuple[str, ...]:
        return self.static + self.labs

    @property
    def order(self) -> tuple[str, ...]:
        return (self.time, *self.tiebreak)

    def with_levels(self, levels: tuple[str, ...]) -> "VisitSchema":
        """The schema after one-hot encoding: level columns stand in for the categorical labs."""
        return replace(self, categorical=(), numeric=levels + self.numeric)
