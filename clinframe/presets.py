"""Schemas and split fractions of the three clinical tables the library is made for."""

from __future__ import annotations

from dataclasses import dataclass

from clinframe.functions import fixed_values as fixed
from clinframe.schema import VisitSchema


@dataclass(frozen=True)
class Preset:
    """A visit table: its schema, the label to stratify by, and the share of test and of
    validation in what test leaves."""

    schema: VisitSchema
    label: str
    test: float
    val: float
    los: str | None = None
    drop_empty: bool = False


ICU = Preset(
    schema=VisitSchema(
        key="RecordID",
        time="RecordTime",
        patient="PatientID",
        admission="AdmissionID",
        targets=("Outcome", "LOS", "Readmission"),
        static=("Sex", "Age"),
        scaled_static=("Age",),
        categorical=fixed.ICU_CATEGORICAL_LABS,
        numeric=fixed.ICU_NUMERIC_LABS,
    ),
    label="Outcome",
    test=1 / 100,
    val=4 / 99,
    los="LOS",
)

COVID = Preset(
    schema=VisitSchema(
        key="PatientID",
        time="RecordTime",
        targets=("Outcome", "LOS"),
        static=("Sex", "Age"),
        scaled_static=("Age",),
        numeric=fixed.COVID_LABS,
    ),
    label="Outcome",
    test=25 / 100,
    val=25 / 75,
    los="LOS",
    drop_empty=True,
)

DIALYSIS = Preset(
    schema=VisitSchema(
        key="PatientID",
        time="RecordTime",
        targets=("Outcome",),
        numeric=fixed.DIALYSIS_LABS,
    ),
    label="Outcome",
    test=20 / 100,
    val=20 / 80,
)
