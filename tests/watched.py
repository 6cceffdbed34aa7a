"""Rows that count how often they are worked out."""

from pyspark.sql import functions as F


def watched(spark, rows, schema, column):
    """The rows, and a count of how often ``column`` was worked out."""
    calls = spark.sparkContext.accumulator(0)

    def same(value):
        calls.add(1)
        return value

    frame = spark.createDataFrame(rows, schema).repartition(2)
    kind = frame.schema[column].dataType
    return frame.withColumn(column, F.udf(same, kind)(column)), calls
