import pytest
from grantlake.errors import CaveatUnsupported
from grantlake.functions import cel
from grantlake.plans.ast import Caveat
from pyspark.sql import functions as F


def verdict(spark, params, body, static, dynamic):
    df = spark.createDataFrame([(static,)], "ctx string")
    v, m = cel.verdict(Caveat("c", tuple(params), body), F.col("ctx"), dynamic)
    r = df.select(v.alias("v"), m.alias("m")).first()
    return r.v, r.m


FRESH = ([("expires_at", "timestamp"), ("now", "timestamp")], "now < expires_at")


@pytest.mark.parametrize(
    ("params", "body", "static", "dynamic", "want"),
    [
        (*FRESH, '{"expires_at": "2099-01-01T00:00:00Z"}', {"now": "2024-01-01T00:00:00Z"}, (2, [])),
        (*FRESH, '{"expires_at": "1999-01-01T00:00:00Z"}', {"now": "2024-01-01T00:00:00Z"}, (0, [])),
        (*FRESH, '{"expires_at": "2099-01-01T00:00:00Z"}', {}, (1, ["now"])),
        (*FRESH, None, {}, (1, ["expires_at", "now"])),
        (*FRESH, '{"now": "2024-01-01T00:00:00Z", "expires_at": "2099-01-01T00:00:00Z"}', {"now": "2100-01-01T00:00:00Z"}, (0, [])),
        ([("x", "int")], "x >= 3 && x < 10 || !(x != 42)", '{"x": 5}', {}, (2, [])),
        ([("x", "int")], "x >= 3 && x < 10 || !(x != 42)", '{"x": 42}', {}, (2, [])),
        ([("x", "int")], "x >= 3 && x < 10 || !(x != 42)", '{"x": 1}', {}, (0, [])),
        ([("x", "int")], "x % 2 == 1 ? x * 2 + 1 > 6 : -x < 0 - 5", '{"x": 3}', {}, (2, [])),
        ([("s", "string")], 's.startsWith("ab") && s.endsWith("c") && s.contains("b") && s.matches("^a.*c$")', '{"s": "abc"}', {}, (2, [])),
        ([("s", "string")], 's in ["x", "y"]', '{"s": "y"}', {}, (2, [])),
        ([("t", "list")], 'size(t) == 2 && "a" in t && t[1] == "b"', '{"t": ["a", "b"]}', {}, (2, [])),
        ([("t", "timestamp")], 't + duration("1h30m") > timestamp("2024-01-01T01:00:00Z")', '{"t": "2024-01-01T00:00:00Z"}', {}, (2, [])),
        ([("b", "bool"), ("d", "double")], "b && d > 1.5", '{"b": true, "d": 2.5}', {}, (2, [])),
        ([("x", "int")], "x > 1", '{"x": "no number"}', {}, (0, [])),
        ([("x", "int")], "x > y", '{"x": 1}', {}, (1, ["y"])),
        ([("x", "int")], "x > y", '{"x": 3}', {"y": 2}, (2, [])),
    ],
)
def test_verdicts(spark, params, body, static, dynamic, want):
    assert verdict(spark, params, body, static, dynamic) == want


@pytest.mark.parametrize(
    ("params", "body", "static", "want"),
    [
        ([("s", "string")], "size(s) == 3", '{"s": "abc"}', 2),
        ([("s", "string"), ("t", "string")], 's + t == "abcd" && size(s + "x") == 3', '{"s": "ab", "t": "cd"}', 2),
        ([("n", "int")], "n / 2 == 3 && -n / 2 == -3 && n % 4 == 3", '{"n": 7}', 2),
        ([("n", "int"), ("d", "double")], "n / 2.0 == d && n > d", '{"n": 7, "d": 3.5}', 2),
        ([("l", "list<int>")], "l[1] + 1 == 8 && 7 in l && size(l) == 2", '{"l": [1, 7]}', 2),
        ([("m", "map<string,int>")], 'm.a == 1 && m["b"] > 1 && "a" in m', '{"m": {"a": 1, "b": 2}}', 2),
        ([("l", "list")], 'l + ["c"] == ["a", "b", "c"]', '{"l": ["a", "b"]}', 2),
        ([("a", "timestamp"), ("d", "duration")], 'timestamp("2024-01-02T00:00:00Z") - a > d', '{"a": "2024-01-01T00:00:00Z", "d": "1h30m"}', 2),
        ([("b", "bytes")], "size(b) == 4", '{"b": "\u00e9\u00e9"}', 2),
        ([("n", "int")], "10 / n > 1", '{"n": 0}', 0),
        ([("n", "int")], "n + 1 > 0", '{"n": 9223372036854775807}', 0),
    ],
)
def test_types(spark, params, body, static, want):
    assert verdict(spark, params, body, static, {})[0] == want


def test_errors_may_end_the_query(spark):
    df = spark.createDataFrame([('{"n": 0}',)], "ctx string")
    v, _ = cel.verdict(Caveat("c", (("n", "int"),), "10 / n > 1"), F.col("ctx"), {}, None, "raise")
    with pytest.raises(Exception, match="failed to evaluate"):
        df.select(v).collect()


def test_a_context_of_each_request(spark):
    df = spark.createDataFrame([('{"a": 1}', '{"b": 5}'), ('{"a": 1, "b": 0}', "{}"), ('{"a": 1, "b": 0}', '{"b": 3, "a": null}'), ('{"a": 1}', None), ('{"a": 1}', '{"c": 2}')], "ctx string, own string")
    got = lambda dynamic: [(r.v, r.m) for r in df.select(*[c.alias(n) for c, n in zip(cel.verdict(Caveat("c", (("a", "int"), ("b", "int")), "b > a"), F.col("ctx"), dynamic, F.col("own")), "vm", strict=True)]).collect()]
    assert got({}) == [(2, []), (0, []), (0, []), (1, ["b"]), (1, ["b"])]
    assert got({"b": 2}) == [(2, []), (2, []), (0, []), (2, []), (2, [])]


@pytest.mark.parametrize("body", ["ip.in_cidr(cidr)", "x >", "f(x)", "x ~ y", "(x", "x y"])
def test_unsupported(spark, body):
    with pytest.raises(CaveatUnsupported):
        verdict(spark, [("x", "int"), ("ip", "string"), ("cidr", "string")], body, "{}", {"x": 1, "ip": "", "cidr": ""})
