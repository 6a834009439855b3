"""Declared column types of the layered tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


MONEY = T.DecimalType(10, 2)

RAW_EMPLOYEES = _struct(
    employee_id=T.VarcharType(50),
    first_name=T.VarcharType(100),
    last_name=T.VarcharType(100),
    email=T.VarcharType(200),
    department=T.VarcharType(100),
    city=T.VarcharType(100),
    salary=MONEY,
    hire_date=T.DateType(),
    extracted_at=T.TimestampNTZType(),
)

STG_EMPLOYEES = _struct(
    employee_id=T.StringType(),
    first_name=T.StringType(),
    last_name=T.StringType(),
    email=T.StringType(),
    department=T.StringType(),
    city=T.StringType(),
    salary=MONEY,
    hire_date=T.DateType(),
    extracted_at=T.TimestampNTZType(),
    processed_at=T.TimestampType(),
)

DIM_EMPLOYEE = _struct(
    employee_sk=T.StringType(),
    first_name=T.StringType(),
    last_name=T.StringType(),
    full_name=T.StringType(),
    email=T.StringType(),
    department=T.StringType(),
    city=T.StringType(),
    salary=MONEY,
    hire_date=T.DateType(),
    years_of_service=T.LongType(),
    salary_band=T.StringType(),
    processed_at=T.TimestampType(),
)

FCT_DEPARTMENT_SUMMARY = _struct(
    department=T.StringType(),
    employee_count=T.LongType(),
    avg_salary=T.DecimalType(11, 2),
    min_salary=MONEY,
    max_salary=MONEY,
    avg_years_of_service=T.DecimalType(12, 1),
    cities_count=T.LongType(),
    processed_at=T.TimestampType(),
)

RAW_FEED = _struct(
    emp_id=T.IntegerType(),
    first_name=T.StringType(),
    last_name=T.StringType(),
    dob=T.StringType(),
    doj=T.StringType(),
    record_date=T.StringType(),
)

FEED = _struct(
    emp_id=T.IntegerType(),
    first_name=T.StringType(),
    last_name=T.StringType(),
    birth_date=T.DateType(),
    date_of_joining=T.StringType(),
    record_date=T.StringType(),
)


def require_schema(df, schema: T.StructType):
    """``df`` unchanged, or an error when its names or types are not the declared ones."""
    found = [(f.name, f.dataType.simpleString()) for f in df.schema]
    declared = [(f.name, f.dataType.simpleString()) for f in schema]
    if found != declared:
        raise TypeError(f"columns {found} differ from the declared {declared}")
    return df
