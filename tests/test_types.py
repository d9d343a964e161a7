from pyspark.sql import types as T

from tablescope.functions import types as ty


def test_type_names():
    cases = {
        T.BooleanType(): "BOOLEAN",
        T.ByteType(): "TINYINT",
        T.ShortType(): "SMALLINT",
        T.IntegerType(): "INTEGER",
        T.LongType(): "BIGINT",
        T.FloatType(): "FLOAT",
        T.DoubleType(): "DOUBLE",
        T.DecimalType(10, 2): "DECIMAL(10,2)",
        T.StringType(): "VARCHAR",
        T.BinaryType(): "BLOB",
        T.DateType(): "DATE",
        T.TimestampType(): "TIMESTAMP WITH TIME ZONE",
        T.TimestampNTZType(): "TIMESTAMP",
        T.ArrayType(T.FloatType()): "FLOAT[]",
        T.StructType([T.StructField("a", T.IntegerType())]): "STRUCT(a INTEGER)",
        T.StructType([T.StructField("a b", T.IntegerType())]): 'STRUCT("a b" INTEGER)',
        T.MapType(T.StringType(), T.IntegerType()): "MAP(VARCHAR, INTEGER)",
        T.DayTimeIntervalType(): "INTERVAL",
        T.YearMonthIntervalType(): "INTERVAL",
    }
    for dt, name in cases.items():
        assert ty.type_name(dt) == name, dt


def test_categories_by_class_not_substring():
    assert ty.category(T.LongType()) == "numeric"
    assert ty.category(T.DecimalType(5, 1)) == "numeric"
    assert ty.category(T.StringType()) == "text"
    assert ty.category(T.TimestampNTZType()) == "temporal"
    assert ty.category(T.DateType()) == "temporal"
    assert ty.category(T.BooleanType()) == "boolean"
    # names that contain INT but are not numbers
    assert ty.category(T.DayTimeIntervalType()) == "other"
    assert ty.category(T.ArrayType(T.IntegerType())) == "other"
    assert ty.category(T.StructType([T.StructField("a", T.IntegerType())])) == "other"


def test_stat_classes():
    assert ty.stat_class(T.DoubleType()) == "numeric"
    assert ty.stat_class(T.DateType()) == "temporal"
    assert ty.stat_class(T.StringType()) == "scalar"
    assert ty.stat_class(T.BooleanType()) == "scalar"
    assert ty.stat_class(T.ArrayType(T.StringType())) == "counts"
    assert ty.stat_class(T.MapType(T.StringType(), T.IntegerType())) == "counts"
    assert ty.stat_class(T.DayTimeIntervalType()) == "counts"
