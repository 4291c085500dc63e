import pytest
from pyspark.sql import types as T

from nearfield.errors import InvalidArgument, UnknownField
from nearfield.plans.filters import parse

ROWS = [(1, [1, 2], "a", None), (2, [3], "b", 5), (3, None, "c", 7), (4, [], None, 9), (5, [2, 3], "5", 5)]
SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("tags", T.ArrayType(T.IntegerType())), T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType())])


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("tags = 2", [1, 5]), ("tags != 2", [2, 3, 4]), ("tags IN [1, 3]", [1, 2, 5]), ("tags NOT_IN [1, 3]", [3, 4]), ("tags notin [1]", [2, 3, 4, 5]),
        ('name = "a"', [1]), ("name = 5", [5]), ('name != "a"', [2, 3, 4, 5]), ("id = 1 OR id = 2 AND n = 5", [2]), ("id = 1 OR (id = 2 AND n = 5)", [1, 2]),
        ('multi_in(tags, "1|3", "|")', [1, 2, 5]), ('MULTI_NOTIN(name, "a,b", ",")', [3, 4, 5]), ("n > 5 && n <= 9", [3, 4]), ("!(n = 5) || id = 2", [1, 2, 3, 4]),
        ("n + 1 = 6 # five", [2, 5]), ("n * 2 - 1 >= 13", [3, 4]), ("n = -5", []), ("(n + 2) * 2 = 14", [2, 5]), ("tags = '2'", [1, 5]), ("n = 5.", [2, 5]), ("n > .5e1", [3, 4]), ("n >= +7", [3, 4]), ("n +1 = 6", [2, 5]), ("n < 6E0", [2, 5]),
    ],
)
def test_filter(spark, text, ids):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(r.id for r in df.filter(parse(text, df.schema)).collect()) == ids


@pytest.mark.parametrize("text", ["n = 05", "n =", "n IN [1", "= 3", "n ~ 3", 'n = "x"', "id = 1 id = 2"])
def test_bad(text):
    with pytest.raises(InvalidArgument):
        parse(text, SCHEMA)


def test_unknown_field():
    with pytest.raises(UnknownField):
        parse("what = 1", SCHEMA)
