import duckdb
import pytest

from pyspark.sql import functions as F
from tidelog.functions.regex import BadRegex, check_by_engine, translate

TEXTS = ["", "foo", "a\rb", "a\nb", "Straße 12", "ÄRGER", "ärger", "x_1-y", "é1", "tab\there", "v\vt", "a{2}", "]x[", "a&&b", "foo\n", "AAA", "日本 7"]
PATTERNS = ["foo$", "^foo", "a.b", r"\bé", r"\b1", r"[[:digit:]]+", r"[[:^alpha:]]$", "(?i)ärger", r"\s", r"[\s]h", r"[^\S]", "(?P<n_1>a)+", "(?U)a+", r"a{2}", "a{", r"\pL\d", r"\p{Greek}|\p{Han}", "[a&&b]+", r"[]x]", r"\Qa{2}\E", r"(?s)a.b", r"(?m)^b$", r"\x{e9}", "a|b", "(?:x|y)_?", r"\D\W", "(?i:FOO)$", r"[\[x]"]


def test_same_as_linear_time_engine(spark):
    d = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    got = d.select("k", *[F.col("t").rlike(check_by_engine(spark, p)).alias(f"p{n}") for n, p in enumerate(PATTERNS)]).orderBy("k").collect()
    for n, p in enumerate(PATTERNS):
        for k, t in enumerate(TEXTS):
            want = duckdb.execute("select regexp_matches(?, ?)", [t, p]).fetchone()[0]
            assert got[k][f"p{n}"] == want, (p, t)


@pytest.mark.parametrize("p", [r"(?=a)", r"(?!a)", r"(?<=a)b", r"(?<!a)b", r"(a)\1", r"a++", r"a*+", r"(?>a)", r"\Z", r"a{1001}", "(", ")", "[a", "a**", "*a", "\\", r"\k<n>", "[[:nope:]]", "(?P<a>x)(?P<a>y)"])
def test_refused(p):
    with pytest.raises(BadRegex):
        translate(p)
