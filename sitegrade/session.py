"""Session settings the wide plans of this package profit from."""

from pyspark.sql import SparkSession

# The JVM never compiles methods above 8000 bytes of byte code, and the header plans put dozens of
# expressions into one generated loop. With this limit Spark runs such a stage operator by
# operator, with generated code that is split into small methods, instead of interpreting one
# huge method.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
