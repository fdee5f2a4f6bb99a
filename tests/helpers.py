import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def one_col(spark, values, name="s"):
    """DataFrame ``(i, s)`` from a list of strings (None allowed)."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, {name} STRING")


def apply(spark, fn, values):
    """Apply a Column function to each value, in order."""
    df = one_col(spark, values)
    return [r[0] for r in df.orderBy("i").select(fn("s")).collect()]
