"""Small made-up tables with the schemas the templates expect: the same for the same seed, on any cluster."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What the columns choose from.
FAMILY, GIVEN = ["Nguyễn", "Trần", "Lê", "Phạm", "Vũ"], ["An", "Bình", "Chi", "Dũng", "Giang", "Hà"]
TRANSACTION_TYPES = ["TRANSFER"] * 8 + ["DEPOSIT"] * 3 + ["WITHDRAW"] * 3 + ["SAVING"] * 3 + ["FX"] + ["BILL"] * 2
CHANNELS = ["MOBILE_APP", "INTERNET_BANKING", "ATM", "COUNTER"]
STATUSES = ["SUCCESS"] * 8 + ["FAILED", "PENDING"]
EMPLOYMENT = ["ACTIVE"] * 7 + ["PROBATION", "RESIGNED", "SUSPENDED"]
ATTENDANCE = ["PRESENT"] * 7 + ["LATE", "REMOTE", "ABSENT"]
LEAVE_TYPES = [("AL", "Nghỉ phép năm", 12), ("SL", "Nghỉ ốm", 30), ("CL", "Nghỉ việc riêng", 3), ("ML", "Nghỉ thai sản", 180), ("UL", "Nghỉ không lương", 30)]


def _pick(options: list, *key: object) -> Column:
    """One of the options by the hash of the key."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (_number(len(options), *key) + 1).cast("int"))


def _number(below: int, *key: object) -> Column:
    return F.pmod(F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in key]), F.lit(below))


def customers(spark: SparkSession, n: int = 8, seed: int = 42) -> DataFrame:
    i = F.col("id")
    return spark.range(1, n + 1).select("id", F.format_string("CIF%09d", i).alias("cif_no"), F.format_string("CUST%08d", i).alias("customer_no"), F.concat_ws(" ", _pick(FAMILY, seed, "f", i), _pick(GIVEN, seed, "g", i)).alias("customer_name"), F.format_string("060%07d", _number(10_000_000, seed, "p", i)).alias("mobile_phone"), F.format_string("kh%d@example.com", i).alias("email"), _pick(["ACTIVE", "ACTIVE", "INACTIVE"], seed, "s", i).alias("status"))


def accounts(spark: SparkSession, n: int = 13, n_customers: int = 8, seed: int = 42) -> DataFrame:
    """The last accounts belong to customers outside the table, so inner and left joins differ."""
    i = F.col("id")
    return spark.range(1, n + 1).select("id", F.format_string("%013d", i * 1009).alias("account_no"), F.format_string("CUST%08d", F.when(i <= n - 3, (i - 1) % n_customers + 1).otherwise(i + 1000)).alias("customer_no"), _pick(["PAYMENT", "SAVING"], seed, "c", i).alias("account_class"), F.lit("Tài khoản").alias("account_name"), _pick(["OPEN", "OPEN", "CLOSED"], seed, "s", i).alias("status"), F.date_add(F.lit(date(2022, 1, 1)), (i * 37 % 900).cast("int")).alias("create_date"))


def transactions(spark: SparkSession, n: int = 200, n_accounts: int = 13, seed: int = 42, month: date = date(2026, 3, 1)) -> DataFrame:
    """One month of transactions; withdrawals go to an empty account number, not a null one."""
    i, kind = F.col("id"), _pick(TRANSACTION_TYPES, seed, "t", F.col("id"))
    to = F.when(kind == "WITHDRAW", F.lit("")).otherwise(F.format_string("%013d", (_number(n_accounts, seed, "to", i) + 1) * 1009))
    at = F.lit(month).cast("timestamp") + F.make_dt_interval(_number(31, seed, "d", i).cast("int"), _number(24, seed, "h", i).cast("int"), _number(60, seed, "m", i).cast("int"))
    return spark.range(1, n + 1).select("id", F.format_string("TXN%08d", i).alias("trans_id"), kind.alias("trans_type"), _pick(CHANNELS, seed, "c", i).alias("request_channel"), F.format_string("%013d", (_number(n_accounts, seed, "from", i) + 1) * 1009).alias("from_account_no"), to.alias("to_account_no"), ((_number(2000, seed, "a", i) + 1) * 10_000).alias("amount_transfer"), _pick(["VND"] * 9 + ["USD"], seed, "u", i).alias("amount_currency"), _pick(STATUSES, seed, "s", i).alias("trans_status"), at.alias("trans_time"))


def departments(spark: SparkSession, n: int = 10) -> DataFrame:
    i = F.col("id")
    return spark.range(1, n + 1).select(F.format_string("D%03d", i).alias("department_id"), F.format_string("Phòng %d", i).alias("department_name"), F.format_string("EMP%03d", i).alias("manager_id"))


def employees(spark: SparkSession, n: int = 50, n_departments: int = 10, seed: int = 42) -> DataFrame:
    i = F.col("id")
    return spark.range(1, n + 1).select(F.format_string("EMP%03d", i).alias("employee_id"), F.concat_ws(" ", _pick(FAMILY, seed, "ef", i), _pick(GIVEN, seed, "eg", i)).alias("employee_name"), F.format_string("D%03d", (i - 1) % n_departments + 1).alias("department_id"), _pick(["Chuyên viên", "Trưởng phòng", "Kế toán"], seed, "j", i).alias("job_title"), _pick(EMPLOYMENT, seed, "es", i).alias("employment_status"), F.date_add(F.lit(date(2020, 1, 1)), _number(2200, seed, "hd", i).cast("int")).alias("hire_date"))


def attendance(spark: SparkSession, staff: DataFrame, first: date, last: date, seed: int = 42) -> DataFrame:
    """One row for each working day and member of staff who is employed and hired by then; no times for the absent and remote."""
    days = staff.where(F.col("employment_status").isin("ACTIVE", "PROBATION")).select("employee_id", F.explode(F.sequence(F.greatest(F.lit(first), "hire_date"), F.greatest(F.lit(last), "hire_date"))).alias("attendance_date")).where((F.weekday("attendance_date") < 5) & (F.col("attendance_date") <= F.lit(last)))
    status = _pick(ATTENDANCE, seed, "a", F.col("employee_id"), F.col("attendance_date"))
    there = status.isin("PRESENT", "LATE")
    clock = lambda h, k: F.when(there, F.format_string("%02d:%02d", F.lit(h), _number(60, seed, k, F.col("employee_id"), F.col("attendance_date"))))
    return days.select(F.abs(F.xxhash64("employee_id", "attendance_date")).alias("attendance_id"), "employee_id", "attendance_date", clock(8, "in").alias("check_in_time"), clock(17, "out").alias("check_out_time"), status.alias("status"))


def leave_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEAVE_TYPES, "leave_type_id string, leave_type_name string, max_days_per_year int")
