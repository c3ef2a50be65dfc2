"""surv: Spark-native analytics for case-notification surveillance data.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from
built-in Spark SQL expressions; nothing is collected to the driver except
tiny metadata (column names, one-row size checks).
"""

from surv.roles import FIXTURE_ROLES, NATIVE_ROLES, Roles, resolve_column
from surv.session import get_spark

__all__ = ["Roles", "FIXTURE_ROLES", "NATIVE_ROLES", "resolve_column", "get_spark"]
